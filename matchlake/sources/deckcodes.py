"""Deck codes: compact base64 texts of card lists, decoded by column expressions.

A code is base64 of little-endian base-128 numbers. The numbers are read by one fold whose state says what the next number
means; anything unexpected makes the code invalid (NULL), never a guess.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

# fixed values: wire format
VERSIONS = (2, 3, 4)
MAX_CARDS, MAX_COPIES, MAX_TEXT, MAX_VARINT_BYTES = 10_000, 1000, 100_000, 5

SPAN = 128  # elements of a piece of a growing list

CARD = "struct<section:string,pos:int,title_id:bigint,qty:int>"
CARDS = f"array<{CARD}>"

# what the next number means
MARKER, VERSION, FIRST_COUNT, LEADER, SPECIAL, SPECIAL_KIND, COUNT, QUANTITY, TITLE, SIDE_FLAG, TAG, END = range(12)


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``: a lambda variable is computed once, a column named in a lambda once per element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _appended(values: str, full: str, value: str) -> tuple[str, str]:
    """Two fields that grow a list by pieces of SPAN, so that long lists are not copied at every step."""
    done = f"if(size({values}) = {SPAN}, concat({full}, array({values})), {full})"
    return f"if(size({values}) = {SPAN}, array({value}), concat({values}, array({value})))", done


def numbers_of(code: str) -> Column:
    """The little-endian base-128 numbers of a base64 text, one fold that reads each byte once; NULL if it is no such text."""
    std = f"translate({code}, '-_', '+/')"
    padded = f"concat({std}, repeat('=', cast(pmod(-length({code}), 4) as int)))"
    raw = f"if(length({code}) between 1 and {MAX_TEXT}, try_to_binary({padded}, 'base64'), null)"
    octets = _let(raw, "h", "if(length(h) > 0, transform(sequence(1, length(h)), i -> cast(conv(hex(substr(h, i, 1)), 16, 10) as bigint)), null)")
    value = "s.v + (b % 128) * s.w"
    now, full = _appended("s.now", "s.full", value)
    last = "b < 128"
    step = (f"named_struct('v', if({last}, 0L, {value}), 'w', if({last}, 1L, s.w * 128), 'n', if({last}, 0, s.n + 1), "
            f"'ok', s.ok and s.n < {MAX_VARINT_BYTES}, 'now', if({last}, {now}, s.now), 'full', if({last}, {full}, s.full))")
    start = ("named_struct('v', 0L, 'w', 1L, 'n', 0, 'ok', true, 'now', cast(array() as array<bigint>), "
             "'full', cast(array() as array<array<bigint>>))")
    fold = f"aggregate({octets}, {start}, (s, b) -> if(s.ok, {step}, s), s -> if(s.ok and s.n = 0, flatten(concat(s.full, array(s.now))), null))"
    return F.expr(fold)


def cards_of(numbers: str = "numbers") -> Column:
    """The fold over the numbers: cards as (section, pos, title_id, qty), NULL for an invalid code.

    ``m`` is the meaning of the next number, ``left`` the cards still to come in the current list, ``g`` the copies group
    (0-3: that many copies plus one; 4: each card brings its own number), ``seen`` the sections already opened.
    """
    opening = f"s.m in ({FIRST_COUNT}, {LEADER}, {SPECIAL}, {SPECIAL_KIND})"
    left = f"case when s.m in ({FIRST_COUNT}, {COUNT}) then x when s.m in ({LEADER}, {SPECIAL_KIND}, {TITLE}) then s.left - 1 else s.left end"
    over = f"(s.m in ({FIRST_COUNT}, {LEADER}, {SPECIAL_KIND}, {COUNT}, {TITLE}) and ({left}) = 0)"
    per_card = f"if(s.g = 4, {QUANTITY}, {TITLE})"
    meaning = f"""case when s.m = {MARKER} then {VERSION} when s.m = {VERSION} then {FIRST_COUNT}
      when {over} and {opening} then if(s.v < 4, {COUNT}, {TAG})
      when {over} then case when s.g < 4 then {COUNT} when s.v = 4 then {TAG} when s.sec = 'main' then {SIDE_FLAG} else {END} end
      when s.m = {FIRST_COUNT} then if(s.v = 2, {LEADER}, {SPECIAL}) when s.m = {LEADER} then {LEADER}
      when s.m = {SPECIAL} then {SPECIAL_KIND} when s.m = {SPECIAL_KIND} then {SPECIAL}
      when s.m in ({COUNT}, {TITLE}) then {per_card} when s.m = {QUANTITY} then {TITLE}
      when s.m = {SIDE_FLAG} then if(x = 1, {COUNT}, {END}) when s.m = {TAG} then if(x = 0, {END}, {COUNT}) else {END} end"""
    group = f"case when {over} and not {opening} and s.g < 4 then s.g + 1 when {over} or s.m in ({SIDE_FLAG}, {TAG}) then 0 else s.g end"
    section = f"""case when {over} and {opening} then 'main' when s.m = {SIDE_FLAG} then 'side'
      when s.m = {TAG} then case x when 1 then 'main' when 2 then 'side' else 'wish' end else s.sec end"""
    title = f"case when s.m in ({FIRST_COUNT}, {COUNT}) then 0L when s.m in ({LEADER}, {SPECIAL}, {TITLE}) then s.title + x else s.title end"
    qty = f"""case when s.m = {COUNT} then s.g + 1 when s.m = {QUANTITY} then cast(least(x, {MAX_COPIES}) as int) else s.qty end"""
    seen = f"case when s.m = {TAG} and x in (1, 2, 3) then s.seen | shiftleft(1, cast(least(x, 3) as int)) else s.seen end"
    fine = f"""s.ok and case when s.m = {MARKER} then x = 0 when s.m = {VERSION} then x in {VERSIONS}
      when s.m in ({FIRST_COUNT}, {COUNT}) then x <= {MAX_CARDS} when s.m = {SPECIAL_KIND} then x in (1, 2)
      when s.m = {QUANTITY} then x <= {MAX_COPIES}
      when s.m = {TAG} then x = 0 or (x in (1, 2, 3) and (s.seen & shiftleft(1, cast(least(x, 3) as int))) = 0)
      else s.m <> {END} end"""
    is_card = f"s.m in ({LEADER}, {SPECIAL_KIND}, {TITLE})"
    card = f"""named_struct('section', case s.m when {LEADER} then 'commanders' when {SPECIAL_KIND} then if(x = 1, 'commanders', 'companions')
      else s.sec end, 'pos', {SPAN} * size(s.full) + size(s.now), 'title_id', if(s.m = {SPECIAL_KIND}, s.title, s.title + x),
      'qty', if(s.m = {TITLE}, s.qty, 1))"""
    now, full = _appended("s.now", "s.full", card)
    start = (f"named_struct('m', {MARKER}, 'v', 0L, 'left', 0L, 'g', 0, 'sec', '', 'title', 0L, 'qty', 0, 'seen', 0, 'ok', true, "
             f"'now', cast(array() as {CARDS}), 'full', cast(array() as array<{CARDS}>))")
    step = (f"named_struct('m', {meaning}, 'v', if(s.m = {VERSION}, x, s.v), 'left', {left}, 'g', {group}, 'sec', {section}, "
            f"'title', {title}, 'qty', {qty}, 'seen', {seen}, 'ok', {fine}, 'now', if({is_card}, {now}, s.now), "
            f"'full', if({is_card}, {full}, s.full))")
    return F.expr(f"aggregate({numbers}, {start}, (s, x) -> if(s.ok, {step}, s), "
                  f"s -> if(s.ok and s.m = {END}, flatten(concat(s.full, array(s.now))), null))")


def decode_codes(codes: DataFrame, column: str) -> DataFrame:
    """code -> cards (NULL when invalid), each distinct code decoded once: numbers and cards are written tables, so that no
    later filter or join repeats the folds."""
    distinct = codes.select(F.col(column).alias("code")).filter("code is not null").distinct()
    numbers = cut_lineage(distinct.select("code", numbers_of("code").alias("numbers")))
    return cut_lineage(numbers.select("code", cards_of().alias("cards")))


def expand_codes(rows: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """((key, section, pos, title_id, qty), rejected keys)."""
    joined = rows.select(key, F.col(column).alias("code")).filter("code is not null").join(
        decode_codes(rows, column), "code")
    cards = joined.select(key, F.explode("cards").alias("c")).select(key, "c.*")
    return cards, joined.filter("cards is null").select(key)
