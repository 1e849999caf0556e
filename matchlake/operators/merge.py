"""Merging new facts into a snapshot, maintenance jobs, tagging, fingerprints, snapshot comparison, text scan.

A merge is a union followed by one aggregate per table; snapshots are immutable, so re-running the
same merge changes nothing. A match is known by (player_id, match_id), as two players may share one; tables
without player_id belong to a single player and are keyed by match_id.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import classify as C
from ..functions.winrate import count_where
from .keys import match_key
from .matchups import opponent_cards

LAST_KNOWN = ("event_key", "start_time", "end_time", "duration_sec", "my_seat", "opponent_name",
              "opponent_platform", "play_draw", "my_result", "end_reason", "my_deck_id", "my_deck_version",
              "opp_archetype_tag", "match_mode", "play_day", "is_bot")


def _with_arrival(df: DataFrame, value) -> DataFrame:
    return df if "arrival" in df.columns else df.withColumn("arrival", F.lit(value).cast("bigint"))


def _together(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    if existing is None:
        return _with_arrival(incoming, 0)
    return _with_arrival(existing, -1).unionByName(_with_arrival(incoming, 0), allowMissingColumns=True)


def merge_matches(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """One row per match. Per column the newest known value wins, except: the source is that of the
    newest record, turns are the maximum, and the first non-empty deck name stays.

    ``incoming`` may hold several records of a match, ordered by ``arrival`` (>= 0).
    """
    both = _together(existing, incoming)
    at = F.col("arrival")
    have = [c for c in LAST_KNOWN if c in both.columns]
    named = F.coalesce(F.col("my_deck_tag"), F.lit("")) != ""
    merged = both.groupBy(*match_key(both)).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in have],
        F.max_by("source", at).alias("source"),
        F.min_by("my_deck_tag", F.when(named, at)).alias("my_deck_tag"),
        F.max("total_turns").alias("_turns"), F.count(F.lit(1)).alias("_n"))
    turns = F.when(F.col("_n") > 1, F.coalesce("_turns", F.lit(0))).otherwise(F.col("_turns"))
    return merged.withColumn("total_turns", turns).withColumn("is_abnormal", F.lit(0)).drop("_turns", "_n")


def merge_games(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    both = _together(existing, incoming)
    rest = [c for c in both.columns if c not in ("player_id", "match_id", "game_no", "arrival")]
    return both.groupBy(*match_key(both), "game_no").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("arrival"))).alias(c) for c in rest])


def merge_mulligans(existing: DataFrame | None, incoming: DataFrame, matches: DataFrame) -> DataFrame:
    """Highest kept_on per (match, game, seat); a missing seat is the player's own."""
    both = incoming if existing is None else existing.unionByName(incoming)
    key = match_key(both, matches)
    own = both.join(matches.select(*key, "my_seat"), key, "left").withColumn("seat", F.coalesce("seat", "my_seat"))
    return own.groupBy(*key, "game_no", "seat").agg(F.max("kept_on").alias("kept_on"))


def merge_commanders(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    both = _together(existing, incoming)
    return both.groupBy(*match_key(both), "seat", "grp_id").agg(F.min_by("partner_idx", "arrival").alias("partner_idx"))


def refresh_modes(matches: DataFrame, games: DataFrame) -> DataFrame:
    """Recompute the match mode from the event key and the number of distinct games."""
    key = match_key(matches, games)
    counts = games.groupBy(*key).agg(F.countDistinct("game_no").alias("_games"))
    return (matches.join(counts, key, "left")
            .withColumn("match_mode", C.match_mode("event_key", F.col("_games"))).drop("_games"))


def tag_bot_decks(matches: DataFrame, patterns: list[str]) -> DataFrame:
    """Flag matches whose deck name contains any of the patterns, ignoring case."""
    words = [p.strip().lower() for p in patterns if p and p.strip()]
    if not words:
        return matches
    hit = C.contains_any(F.lower(F.coalesce("my_deck_tag", F.lit(""))), words)
    return matches.withColumn("is_bot", F.when(hit, 1).otherwise(F.col("is_bot")))


def clean_mulligans(mulligans: DataFrame, matches: DataFrame) -> DataFrame:
    """Drop rows that say nothing, give seatless rows the player's seat."""
    key = match_key(mulligans, matches)
    return (mulligans.filter("kept_on is not null").join(matches.select(*key, "my_seat"), key, "left")
            .withColumn("seat", F.coalesce("seat", "my_seat")).drop("my_seat"))


def clean_commanders(commanders: DataFrame) -> DataFrame:
    """Emblems were once recorded as card '2'; no real card has that id."""
    return commanders.filter(F.col("grp_id").isNull() | (F.col("grp_id") != "2"))


def clear_abnormal(matches: DataFrame) -> DataFrame:
    return matches.withColumn("is_abnormal", F.lit(0))


def dedupe_ranks(ranks: DataFrame) -> DataFrame:
    """One row per value tuple; two missing times are the same time."""
    key = ["player_id", "ts", "constructed_class", "constructed_level", "limited_class", "limited_level"]
    return ranks.groupBy(*key).agg(F.min("id").alias("id"))


def apply_orphan_results(matches: DataFrame, games: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results whose match was already stored without one: fill, never overwrite, only with a known seat.

    ``results([player_id,] match_id, entry_no, scope, winning_team, reason)``; returns (matches, games).
    """
    key = match_key(matches, games, results)
    open_rows = matches.filter("my_result is null and my_seat is not null").select(*key, "my_seat")
    usable = results.filter("winning_team is not null").join(open_rows, key)
    outcome = F.when(F.col("winning_team") == F.col("my_seat"), "win").otherwise("loss")
    usable = usable.select(*key, "entry_no", "scope", outcome.alias("o"),
                           F.regexp_replace("reason", "ResultReason_", "").alias("r"))
    whole = usable.filter("scope = 'MatchScope_Match'").groupBy(*key).agg(
        F.max_by("o", "entry_no").alias("o"), F.min_by("r", F.when(F.col("r").isNotNull(), F.col("entry_no"))).alias("r"))
    fixed = (matches.join(whole, key, "left").withColumn("my_result", F.coalesce("my_result", "o"))
             .withColumn("end_reason", F.when(F.col("o").isNotNull(), F.coalesce("end_reason", "r"))
                         .otherwise(F.col("end_reason"))).drop("o", "r"))
    # the k-th game result goes to the k-th game without a result, further ones append
    order = Window.partitionBy(*key).orderBy("entry_no")
    per_game = usable.filter("scope = 'MatchScope_Game'").withColumn("k", F.row_number().over(order))
    touched = games.join(per_game.select(*key).distinct(), key, "left_semi")
    slots = touched.filter("result is null").withColumn(
        "k", F.row_number().over(Window.partitionBy(*key).orderBy("game_no"))).select(*key, "game_no", "k")
    size = touched.groupBy(*key).agg(F.max("game_no").alias("top"), count_where(F.col("result").isNull()).alias("free"))
    placed = (per_game.join(slots, [*key, "k"], "left").join(size, key, "left")
              .withColumn("game_no", F.coalesce("game_no", F.coalesce("top", F.lit(0)) + F.col("k")
                                                - F.coalesce("free", F.lit(0))).cast("int"))
              .select(*key, "game_no", F.col("o").alias("n_result"), F.col("r").alias("n_reason")))
    merged = games.join(placed, [*key, "game_no"], "full_outer")
    merged = merged.withColumn("result", F.coalesce("n_result", "result"))
    if "reason" in games.columns:
        merged = merged.withColumn("reason", F.coalesce("n_reason", "reason"))
    return fixed, merged.drop("n_result", "n_reason")


# ---- tagging --------------------------------------------------------------------------------
def split_tag_requests(requests: DataFrame, single: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid with the cleaned tag string or NULL, rejects with a reason)."""
    parts = F.filter(F.transform(F.split(F.coalesce("tag", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    known = F.array(*[F.lit(a) for a in C.ARCHETYPES])
    bad = F.size(F.array_except(parts, known)) > 0
    if single:
        bad = bad | (F.size(parts) > 1)
    checked = requests.withColumn("_bad", bad).withColumn(
        "clean_tag", F.nullif(F.array_join(F.array_distinct(parts), ","), F.lit("")))
    return (checked.filter(~F.col("_bad")).drop("_bad", "tag"),
            checked.filter("_bad").drop("_bad", "clean_tag").withColumn("reason", F.lit("invalid tag")))


def _opposing_keys(matches: DataFrame, commanders: DataFrame, cards: DataFrame) -> DataFrame:
    """(player, match, key): each opposing card under its English name and under 'grpId:x'."""
    opposing = opponent_cards(matches.select("player_id", "match_id", "my_seat"), commanders)
    by_id = F.concat(F.lit("grpId:"), "grp_id")
    return (opposing.join(cards.select("grp_id", "name"), "grp_id", "left")
            .select("player_id", "match_id", F.explode(F.array_distinct(F.array(
                F.coalesce("name", by_id), by_id))).alias("card_name")))


def apply_profile_tags(matches: DataFrame, commanders: DataFrame, cards: DataFrame, profiles: DataFrame,
                       requests: DataFrame) -> dict[str, DataFrame]:
    """Tag by opposing card name. ``requests(player_id, card_name, tag, req_no)``; later requests win,
    an empty tag clears. Returns the new matches, profiles and the rejected requests."""
    valid, rejects = split_tag_requests(requests)
    set_of = F.struct(F.col("clean_tag").alias("tag"))
    hits = (_opposing_keys(matches, commanders, cards).join(valid, ["player_id", "card_name"])
            .groupBy("player_id", "match_id").agg(F.max_by(set_of, "req_no").alias("t")))
    tagged = matches.join(hits, ["player_id", "match_id"], "left").withColumn("opp_archetype_tag", F.when(
        F.col("t").isNotNull(), F.col("t.tag")).otherwise(F.col("opp_archetype_tag"))).drop("t")
    names = cards.select(F.concat(F.lit("grpId:"), "grp_id").alias("card_name"), F.col("name").alias("full"))
    keyed = (valid.join(names, "card_name", "left").withColumn("card_name", F.coalesce("full", "card_name"))
             .groupBy("player_id", "card_name").agg(F.max_by(set_of, "req_no").alias("t")))
    new_profiles = profiles.join(keyed, ["player_id", "card_name"], "full_outer").withColumn(
        "archetype_user", F.when(F.col("t").isNotNull(), F.col("t.tag")).otherwise(F.col("archetype_user"))).drop("t")
    return {"matches": tagged, "profiles": new_profiles, "rejects": rejects}


def tag_single_matches(matches: DataFrame, commanders: DataFrame, cards: DataFrame, profiles: DataFrame,
                       requests: DataFrame) -> dict[str, DataFrame]:
    """Tag one match each: eligible constructed events directly, commander events through their first
    opposing card (lowest id), everything else rejected. ``requests([player_id,] match_id, tag, req_no)``; without a
    player a request goes to every player of the match."""
    valid, invalid = split_tag_requests(requests, single=True)
    facts = matches.select("match_id", "player_id", "event_key", F.lit(True).alias("found"))
    first = opponent_cards(matches.select("player_id", "match_id", "my_seat"), commanders).groupBy("player_id", "match_id").agg(
        F.min("grp_id").alias("grp_id")).join(cards.select("grp_id", "name"), "grp_id", "left").select(
        "player_id", "match_id", F.coalesce("name", F.concat(F.lit("grpId:"), "grp_id")).alias("card_name"))
    routed = valid.join(facts, match_key(valid, facts), "left").join(first, ["player_id", "match_id"], "left")
    reason = (F.when(F.col("found").isNull(), "match not found")
              .when(C.is_constructed_event(), F.lit(None))
              .when(~C.is_brawl(), "event takes no opponent type")
              .when(F.col("card_name").isNull(), "no opposing card recorded"))
    routed = routed.withColumn("reason", reason)
    fine = routed.filter("reason is null")
    direct = fine.filter(C.is_constructed_event()).groupBy("player_id", "match_id").agg(
        F.max_by(F.struct(F.col("clean_tag").alias("tag")), "req_no").alias("t"))
    after = matches.join(direct, ["player_id", "match_id"], "left").withColumn("opp_archetype_tag", F.when(
        F.col("t").isNotNull(), F.col("t.tag")).otherwise(F.col("opp_archetype_tag"))).drop("t")
    by_card = fine.filter(~C.is_constructed_event()).select(
        "player_id", "card_name", F.coalesce("clean_tag", F.lit("")).alias("tag"), "req_no")
    out = apply_profile_tags(after, commanders, cards, profiles, by_card)
    rejects = routed.filter("reason is not null").select("match_id", "req_no", "reason").unionByName(
        invalid.select("match_id", "req_no", "reason"))
    return {"matches": out["matches"], "profiles": out["profiles"], "rejects": rejects}


# ---- fingerprints ---------------------------------------------------------------------------
def deck_fingerprints(sections: DataFrame, mapping: DataFrame, key: str = "match_id") -> DataFrame:
    """Build fingerprint per deck: NULL when the main section is empty, a card is unmapped or a quantity
    is outside 1..1000. ``sections(key, section, card_id, quantity)``, ``mapping(card_id, title_id)``.

    Commanders are taken out of the main count and companions out of the side count (never below 0).
    """
    rows = sections.join(mapping, "card_id", "left")
    bad = F.col("title_id").isNull() | ~F.coalesce(F.col("quantity").between(1, 1000), F.lit(False))
    per_title = rows.groupBy(key, "section", "title_id").agg(
        F.sum("quantity").alias("q"), F.max(bad.cast("int")).alias("bad"))
    taken = per_title.filter("section in ('commanders', 'companions')").select(
        key, F.when(F.col("section") == "commanders", "main").otherwise("side").alias("section"), "title_id",
        F.col("q").alias("less"))
    net = per_title.join(taken, [key, "section", "title_id"], "left").withColumn(
        "q", F.greatest(F.lit(0), F.col("q") - F.coalesce("less", F.lit(0))))
    entry = F.struct("section", "title_id", "q")
    decks = net.groupBy(key).agg(
        F.max("bad").alias("bad"), count_where(F.col("section") == "main").alias("main_titles"),
        F.array_sort(F.collect_list(F.when(F.col("q") > 0, entry))).alias("content"))
    text = F.array_join(F.transform("content", lambda e: F.concat(
        e["section"], F.lit(":"), e["title_id"].cast("string"), F.lit("="), e["q"].cast("string"))), ";")
    print_ = F.concat(F.lit("fp1:"), F.substring(F.sha2(text, 256), 1, 24))
    ok = (F.col("bad") == 0) & (F.col("main_titles") > 0)
    return decks.select(key, F.when(ok, print_).alias("fingerprint"))


# ---- counters and comparison ----------------------------------------------------------------
def store_counters(matches: DataFrame, games: DataFrame, mulligans: DataFrame, commanders: DataFrame,
                   ranks: DataFrame) -> DataFrame:
    def one(name: str, df: DataFrame, value: Column = F.count(F.lit(1))):
        return df.agg(value.alias("n")).select(F.lit(name).alias("counter"), "n")

    m = matches.agg(F.count(F.lit(1)).alias("matches"), F.count("my_result").alias("with_result"),
                    count_where(F.col("is_abnormal") == 1).alias("abnormal"))
    m = m.selectExpr("stack(3, 'matches', matches, 'with_result', with_result, 'abnormal', abnormal) as (counter, n)")
    return (m.unionByName(one("games", games)).unionByName(one("mulligans", mulligans))
            .unionByName(one("with_commanders", commanders, F.countDistinct("match_id")))
            .unionByName(one("ranks", ranks)))


COMPARED = ("my_result", "play_draw", "my_seat", "end_reason", "opponent_name", "event_key", "my_deck_tag")


def snapshot_diff(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """Per differing match: only_old / only_new / changed with the names of the differing parts and flips.

    Each snapshot is a dict of matches, games and commanders.
    """
    key = match_key(*old.values(), *new.values())

    def side(snap, p):
        game = F.struct("game_no", "play_draw", "result", "reason")
        games = snap["games"].groupBy(*key).agg(F.array_sort(F.collect_list(game)).alias(f"{p}_games"))
        cards = snap["commanders"].groupBy(*key).agg(F.count(F.lit(1)).alias(f"{p}_cards"))
        base = snap["matches"].select(*key, F.lit(True).alias(f"{p}_here"),
                                      *[F.col(c).alias(f"{p}_{c}") for c in COMPARED])
        return base.join(games, key, "left").join(cards, key, "left")

    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    differs = lambda c: ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    parts = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in (*COMPARED, "games", "cards")]))
    flip = lambda c: F.when(differs(c), F.concat(F.coalesce(f"o_{c}", F.lit("NULL")), F.lit("->"),
                                                 F.coalesce(f"n_{c}", F.lit("NULL"))))
    matched = F.col("o_here").isNotNull() & F.col("n_here").isNotNull()
    status = F.when(F.col("n_here").isNull(), "only_old").when(F.col("o_here").isNull(), "only_new").when(
        F.size(parts) > 0, "changed")
    return both.withColumn("status", status).filter("status is not null").select(
        *key, "status", F.when(matched, F.array_join(parts, ",")).alias("parts"),
        F.when(matched, flip("my_result")).alias("result_flip"), F.when(matched, flip("play_draw")).alias("side_flip"))


def flip_counts(diff: DataFrame) -> DataFrame:
    return (diff.selectExpr("stack(2, 'result', result_flip, 'side', side_flip) as (what, flip)")
            .filter("flip is not null").groupBy("what", "flip").agg(F.count(F.lit(1)).alias("n")))


# ---- text scan ------------------------------------------------------------------------------
# fixed values: what counts as sensitive in a line
SENSITIVE = {
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "user id": r"\b[A-Z0-9]{20,}\b",
    "user path": r"""(?i)C:\\Users\\[^\\"'\s]+""",
}
HIT_CHARS = 40


def sensitive_lines(texts: DataFrame, id_col: str, text_col: str, words: list[str] = ()) -> DataFrame:
    """(id, line_no, label, hit): first hit of every pattern per line, '<..>' placeholders exempt, and
    one row per blocked word in the line (the word itself is not repeated)."""
    lines = texts.select(id_col, F.posexplode(F.split(text_col, "\r\n|\n|\r")).alias("i", "line"))
    found = []
    for label, pattern in SENSITIVE.items():
        hit = F.regexp_extract("line", pattern, 0)
        found.append(F.when((hit != "") & ~hit.contains("<"), F.struct(
            F.lit(label).alias("label"), F.substring(hit, 1, HIT_CHARS).alias("hit"))))
    out = F.array_compact(F.array(*found))
    if words:  # the word list is one literal, however long
        hits = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("line"), w))
        mark = F.struct(F.lit("blocked word").alias("label"), F.lit("***").alias("hit"))
        out = F.concat(out, F.transform(hits, lambda _: mark))
    return lines.select(id_col, (F.col("i") + 1).alias("line_no"), F.explode(out).alias("f")).select(id_col, "line_no", "f.*")
