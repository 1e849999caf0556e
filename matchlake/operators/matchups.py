"""Opponent cards: enriched match rows, match-ups, coverage, environment, match pages, export."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import classify as C
from ..functions.event_labels import with_event_labels
from ..functions.winrate import count_where, is_decided, is_loss, is_win, pct, rate_columns, side_counts
from ..scope import Scope
from ..session import stored
from .keys import match_key
from .overview import mulligan_state, single_mode_events, top_ranked


PAGE_BLOCK = 86_400_000  # milliseconds of a block of the page index


def opponent_cards(matches: DataFrame, commanders: DataFrame, brawl_only: bool = False) -> DataFrame:
    """Distinct (player, match, opposing card) next to the match columns; an unknown seat on either side drops out."""
    rows = matches.filter(C.is_brawl()) if brawl_only else matches
    own = match_key(rows)
    opposing = (commanders.join(rows.select(*own, "my_seat"), match_key(rows, commanders))
                .filter((F.col("seat") != F.col("my_seat")) & F.col("grp_id").isNotNull())
                .select(*own, "grp_id").distinct())
    return rows.join(opposing, own)


def enriched_matches(matches: DataFrame, mulligans: DataFrame, commanders: DataFrame) -> DataFrame:
    """Match rows with tri-state mulligan and the sorted opposing card set (commander events only)."""
    own = match_key(matches)
    cards = (opponent_cards(matches.select(*own, "my_seat", "event_key"), commanders, brawl_only=True)
             .groupBy(*own).agg(F.array_sort(F.collect_set("grp_id")).alias("commanders")))
    state = mulligan_state(matches, mulligans).select(*own, "mulligan")
    empty = F.array().cast("array<string>")
    return (matches.join(state, own, "left").join(cards, own, "left")
            .withColumn("commanders", F.coalesce("commanders", empty)))


def matchups(matches: DataFrame, commanders: DataFrame, names: DataFrame, archetypes: DataFrame,
             scope: Scope, sort: str = "count") -> DataFrame:
    """Record against every opposing card with sides, last meeting, name and archetype tags."""
    rows = scope.decided(matches).select("player_id", "match_id", "my_seat", "event_key", "start_time",
                                         "play_draw", "my_result")
    agg = opponent_cards(rows, commanders).groupBy("player_id", "grp_id").agg(
        *side_counts(), F.max("start_time").alias("last_time"))
    order = ([F.desc_nulls_last("last_time"), F.desc("n")] if sort == "recent"
             else [F.desc("n"), F.desc_nulls_last("last_time")])
    position = F.row_number().over(Window.partitionBy("player_id").orderBy(*order, "grp_id"))
    tags = archetypes.select("card_name", F.array_join("tags", ",").alias("archetype"))
    named = (agg.withColumn("position", position).join(names, "grp_id", "left")
             .withColumn("card_name", F.coalesce("card_name", F.concat(F.lit("grpId:"), "grp_id"))))
    by_english = tags.select(F.col("card_name").alias("name_en"), F.col("archetype").alias("a_en"))
    by_display = tags.select("card_name", F.col("archetype").alias("a_name"))
    return (named.join(by_english, "name_en", "left").join(by_display, "card_name", "left")
            .select("player_id", "position", "grp_id", "card_name",
                    F.coalesce("a_en", "a_name", F.lit("")).alias("archetype"), "last_time",
                    *rate_columns("wins", "n"), *rate_columns("play_wins", "play", "on_play"),
                    *rate_columns("draw_wins", "draw", "on_draw")))


def commander_coverage(matches: DataFrame, commanders: DataFrame, scope: Scope) -> DataFrame:
    """Eligible decided matches, those with known opposing cards, and when the known ones span."""
    rows = scope.decided(matches)
    own = match_key(rows)
    known = opponent_cards(rows.select(*own, "my_seat", "event_key"), commanders, brawl_only=True)
    known = known.select(*own).distinct().withColumn("known", F.lit(True))
    joined = rows.join(known, own, "left")
    return joined.groupBy("player_id").agg(
        count_where(C.is_brawl()).alias("eligible"), count_where(F.col("known")).alias("with_cards"),
        F.count(F.lit(1)).alias("all_total"),
        F.min(F.when(F.col("known"), F.col("start_time"))).alias("first_time"),
        F.max(F.when(F.col("known"), F.col("start_time"))).alias("last_time"))


def match_set_summary(enriched: DataFrame, loss_streaks: DataFrame, keys: list[str], top: int = 5,
                      min_meetings: int = 3) -> DataFrame:
    """One row per key over enriched matches: results, sides, mulligans, coverage, frequent cards, streak."""
    play, draw = F.col("play_draw") == "play", F.col("play_draw") == "draw"
    has_cards = F.size("commanders") > 0
    base = enriched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"), count_where(is_win()).alias("won"),
        count_where(is_loss()).alias("losses"), count_where(play).alias("play"), count_where(draw).alias("draw"),
        count_where(F.col("mulligan").isNotNull()).alias("mulligan_known"),
        count_where(F.col("mulligan")).alias("mulligan_yes"),
        count_where(F.coalesce("my_deck_tag", F.lit("")) != "").alias("deck_known"),
        count_where(C.is_brawl()).alias("card_eligible"), count_where(C.is_brawl() & has_cards).alias("card_known"),
        F.count("duration_sec").alias("duration_known"),
        F.round(F.coalesce(F.sum("duration_sec"), F.lit(0.0)), 3).alias("duration_total"))
    met = (enriched.select(*keys, F.explode("commanders").alias("grp_id")).groupBy(*keys, "grp_id")
           .agg(F.count(F.lit(1)).alias("met")))
    distinct = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_cards"))
    frequent = (top_ranked(met, keys, [F.desc("met"), "grp_id"], top).filter(F.col("met") >= min_meetings)
                .groupBy(*keys).agg(F.array_join(F.transform(
                    F.array_sort(F.collect_list(F.struct("rank", "grp_id", "met"))),
                    lambda c: F.concat_ws("=", c.grp_id, c.met.cast("string"))), ",").alias("top_cards")))
    out = base.join(distinct, keys, "left").join(frequent, keys, "left").join(loss_streaks, keys, "left")
    known = F.col("play") + F.col("draw")
    return out.select(
        *keys, "matches", "losses", (F.col("matches") - F.col("won") - F.col("losses")).alias("unknown_result"),
        *rate_columns("won", F.col("won") + F.col("losses")), "play", "draw",
        (F.col("matches") - known).alias("unknown_side"), *rate_columns("play", known, "play_share"),
        "mulligan_known", "mulligan_yes", "deck_known", "card_eligible", "card_known",
        F.coalesce("distinct_cards", F.lit(0)).alias("distinct_cards"),
        F.coalesce("top_cards", F.lit("")).alias("top_cards"), "duration_known", "duration_total",
        F.coalesce("max_loss_streak", F.lit(0)).alias("max_loss_streak"))


def nemeses(matches: DataFrame, commanders: DataFrame, limit: int = 5) -> DataFrame:
    """Opposing cards met at least three times in decided matches with a win rate under 40%, worst first."""
    agg = (opponent_cards(matches.filter(is_decided()), commanders, brawl_only=True)
           .groupBy("player_id", "grp_id").agg(F.count(F.lit(1)).alias("n"), count_where(is_win()).alias("wins"))
           .filter((F.col("n") >= 3) & (F.col("wins") / F.col("n") < 0.4)).withColumn("wr", pct("wins", "n")))
    return top_ranked(agg, ["player_id"], ["wr", F.desc("n"), "grp_id"], limit)


def card_table(rows: DataFrame, commanders: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(coverage per key, record per key and card) of a deck's matches; needs ``keys`` on the rows."""
    cards = opponent_cards(rows, commanders, brawl_only=True)
    per_match = cards.groupBy(*keys, "match_id").agg(F.count(F.lit(1)).alias("cards"))
    known = per_match.groupBy(*keys).agg(F.count(F.lit(1)).alias("known"),
                                         count_where(F.col("cards") > 1).alias("multi_card_matches"))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), count_where(C.is_brawl()).alias("eligible"))
    per_card = cards.groupBy(*keys, "grp_id").agg(*side_counts())
    kinds = per_card.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_cards"))
    zero = F.lit(0)
    coverage = totals.join(known, keys, "left").join(kinds, keys, "left").select(
        *keys, "eligible", F.coalesce("known", zero).alias("known"),
        (F.col("eligible") - F.coalesce("known", zero)).alias("missing"),
        (F.col("matches") - F.col("eligible")).alias("not_applicable"),
        F.coalesce("multi_card_matches", zero).alias("multi_card_matches"),
        F.coalesce("distinct_cards", zero).alias("distinct_cards"))
    decided = F.col("wins") + F.col("losses")
    table = per_card.join(coverage.select(*keys, "known", "eligible"), keys).select(
        *keys, "grp_id", F.col("n").alias("met"), "losses", (F.col("n") - decided).alias("unknown_result"),
        "play", "draw", (F.col("n") - F.col("play") - F.col("draw")).alias("unknown_side"),
        pct("n", "known").alias("share_known"), pct("n", "eligible").alias("share_eligible"),
        *rate_columns("wins", decided), *rate_columns("play_wins", "play_decided", "on_play"),
        *rate_columns("draw_wins", "draw_decided", "on_draw"))
    return coverage, table


def card_environment(rows: DataFrame, baseline: DataFrame, commanders: DataFrame, keys: list[str],
                     top: int = 12) -> DataFrame:
    """Share of each opposing card in a deck's known matches against the player's whole known history."""
    met = opponent_cards(rows, commanders, brawl_only=True)
    per_card = met.groupBy(*keys, "grp_id").agg(*side_counts())
    known = met.groupBy(*keys).agg(F.countDistinct("match_id").alias("known"))
    base = opponent_cards(baseline.select("player_id", "match_id", "my_seat", "event_key"), commanders,
                          brawl_only=True)
    base_card = base.groupBy("player_id", "grp_id").agg(F.count(F.lit(1)).alias("base_n"))
    base_known = base.groupBy("player_id").agg(F.countDistinct("match_id").alias("base_known"))
    best = top_ranked(per_card, keys, [F.desc("n"), "grp_id"], top)
    out = best.join(known, keys).join(base_card, ["player_id", "grp_id"], "left").join(
        base_known, "player_id", "left")
    base_share = pct(F.coalesce("base_n", F.lit(0)), "base_known")
    share = F.lit(100.0).cast("double") * F.col("n") / F.col("known")
    decided = F.col("wins") + F.col("losses")
    return out.select(*keys, "rank", "grp_id", F.col("n").alias("met"), pct("n", "known").alias("share_known"),
                      base_share.alias("baseline_share"), F.round(share - base_share, 1).alias("delta_pp"),
                      *rate_columns("wins", decided), *rate_columns("play_wins", "play_decided", "on_play"),
                      *rate_columns("draw_wins", "draw_decided", "on_draw"))


def own_cards(rows: DataFrame, commanders: DataFrame, keys: list[str], top: int = 4) -> DataFrame:
    mine = rows.filter(C.is_brawl()).select(*dict.fromkeys([*match_key(rows), "my_seat", *keys]))
    own = (commanders.join(mine, match_key(mine, commanders))
           .filter((F.col("seat") == F.col("my_seat")) & F.col("grp_id").isNotNull())
           .select(*keys, "match_id", "grp_id").distinct())
    return top_ranked(own.groupBy(*keys, "grp_id").agg(F.count(F.lit(1)).alias("n")), keys,
                      [F.desc("n"), "grp_id"], top)


def _card_lists(page: DataFrame, commanders: DataFrame) -> DataFrame:
    """(player, match) -> sorted own and opposing card lists of the given matches."""
    mine, own = F.col("seat") == F.col("my_seat"), match_key(page)
    joined = commanders.join(page.select(*own, "my_seat"), match_key(page, commanders)).filter(
        F.col("grp_id").isNotNull() & F.col("seat").isNotNull() & F.col("my_seat").isNotNull())
    return joined.groupBy(*own).agg(
        F.array_sort(F.collect_set(F.when(mine, F.col("grp_id")))).alias("my_cards"),
        F.array_sort(F.collect_set(F.when(~mine, F.col("grp_id")))).alias("opp_cards"))


def nested_games(games: DataFrame) -> DataFrame:
    """Match (of a player, where games name one) -> games ordered by number."""
    return games.groupBy(*match_key(games)).agg(F.array_sort(F.collect_list(F.struct(
        "game_no", "result", "play_draw", "duration_sec"))).alias("games"))


def page_index(matches: DataFrame) -> DataFrame:
    """(player_id, day, n): rows of every player by day (NULL: undated), the index that pages are found by."""
    return matches.groupBy("player_id", _page_day()).agg(F.count(F.lit(1)).alias("n"))


def _page_day():
    return F.floor(F.col("start_time") / PAGE_BLOCK).alias("day")


def page_rows(matches: DataFrame, index: DataFrame, limit: int, offset: int) -> DataFrame:
    """Rows ``offset + 1 .. offset + limit`` of every player, newest first, with ``position``.

    The index tells which days hold them and how many rows come before; only rows of these days are ranked, so a far page
    costs what a near one does. Days are cumulated in a window over one row per player and day.
    """
    newest = Window.partitionBy("player_id").orderBy(F.desc_nulls_last("day"))
    until = F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    spans = index.withColumn("_until", until).withColumn("_before", F.col("_until") - F.col("n")).filter(
        (F.col("_before") < offset + limit) & (F.col("_until") > offset))
    spans = spans.withColumn("_first", F.min("_before").over(Window.partitionBy("player_id"))).select(
        F.col("player_id").alias("_player"), F.col("day").alias("_day"), "_first")
    near = matches.withColumn("_d", _page_day()).join(
        spans, F.col("player_id").eqNullSafe(F.col("_player")) & F.col("_d").eqNullSafe(F.col("_day")))
    order = Window.partitionBy("player_id").orderBy(F.desc_nulls_last("start_time"), F.desc("match_id"))
    ranked = near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") + F.col("_first") <= offset + limit)
    return ranked.withColumn("position", (F.col("_r") + F.col("_first")).cast("int")).filter(F.col("position") > offset).drop(
        "_d", "_day", "_player", "_first", "_r")


def match_page(matches: DataFrame, games: DataFrame, mulligans: DataFrame, commanders: DataFrame,
               scope: Scope, limit: int = 500, offset: int = 0, index: DataFrame | None = None) -> DataFrame:
    """The newest matches of every player, one page, with children, labels and flags.

    The page is found through ``index`` (``page_index`` of the scoped matches, made here if none is kept) and written first; the
    children are joined to its few rows afterwards.
    """
    from .decks import deck_labels
    scoped = scope.apply(matches)
    page = stored(page_rows(scoped, page_index(scoped) if index is None else index, limit, offset), "match-page")
    own = match_key(page)
    ids = page.select(*own, "my_seat")
    kept = mulligan_state(ids, mulligans).select(*own, "kept_sum")
    cards = _card_lists(ids, commanders)
    of_games = match_key(page, games)
    own_games = nested_games(games.join(ids.select(*of_games), of_games, "left_semi"))
    labels = deck_labels(matches).select("player_id", "my_deck_id", "limited_label")
    sole = single_mode_events(matches).withColumn("mode_sole", F.lit(True))
    out = (with_event_labels(page).join(kept, own, "left").join(cards, own, "left").join(own_games, of_games, "left")
           .join(labels, ["player_id", "my_deck_id"], "left").join(sole, ["player_id", "event_key"], "left"))
    empty = F.array().cast("array<string>")
    brawl = C.is_brawl()
    return out.select(
        "player_id", "position", "match_id", "event_key", "event_label", "start_time",
        "duration_sec", "opponent_name", "play_draw", C.scoop_note().alias("side_note"), "my_result",
        "end_reason", "total_turns", "is_abnormal", "is_bot", "my_deck_tag", "my_deck_id", "my_deck_version",
        F.coalesce("limited_label", F.nullif("my_deck_tag", F.lit(""))).alias("deck_label"), "source",
        F.coalesce("match_mode", F.lit("unknown")).alias("match_mode"),
        F.coalesce("mode_sole", F.lit(False)).alias("mode_sole"),
        C.is_constructed_event().alias("type_eligible"), "opp_archetype_tag", "games", "kept_sum",
        F.when(brawl, F.coalesce("my_cards", empty)).otherwise(empty).alias("my_cards"),
        F.when(brawl, F.coalesce("opp_cards", empty)).otherwise(empty).alias("opp_cards"))


def page_totals(matches: DataFrame, scope: Scope) -> DataFrame:
    return matches.filter(scope.selection()).groupBy("player_id").agg(
        count_where(scope.visible()).alias("total"), count_where(scope.hidden()).alias("hidden"))


def export_matches(matches: DataFrame, mulligans: DataFrame, commanders: DataFrame, names: DataFrame,
                   scope: Scope) -> DataFrame:
    """The flat match export: 19 text-safe columns after the player."""
    rows = scope.apply(matches)
    own = match_key(rows)
    kept = mulligan_state(rows, mulligans).select(*own, "kept_sum")
    named = commanders.join(names.select("grp_id", "card_name"), "grp_id", "left").withColumn(
        "grp_id", F.coalesce("card_name", F.concat(F.lit("grpId:"), "grp_id")))
    cards = _card_lists(rows, named)
    out = rows.join(kept, own, "left").join(cards, own, "left")

    def listed(col):
        return C.csv_safe(F.when(C.is_brawl(), F.array_join(col, " // ")))

    yes_no = lambda c: F.when(F.col(c) == 1, "yes").otherwise("no")
    return out.select(
        "player_id", "start_time", C.csv_safe("match_id").alias("match"), C.csv_safe("source").alias("source"),
        C.csv_safe("event_key").alias("event"), F.coalesce("match_mode", F.lit("unknown")).alias("mode"),
        F.coalesce(C.short_time("start_time"), F.lit("")).alias("time"), F.col("duration_sec").alias("seconds"),
        C.csv_safe("opponent_name").alias("opponent"), C.csv_safe("play_draw").alias("side"),
        C.csv_safe("my_result").alias("result"),
        C.csv_safe(F.regexp_replace("end_reason", "^ResultReason_", "")).alias("reason"),
        F.col("total_turns").alias("turns"), yes_no("is_abnormal").alias("abnormal"),
        C.csv_safe("my_deck_tag").alias("deck"), listed("my_cards").alias("own_cards"),
        C.csv_safe("opp_archetype_tag").alias("opponent_type"), F.col("kept_sum").alias("mulligans"),
        listed("opp_cards").alias("opponent_cards"), yes_no("is_bot").alias("bot"))


def export_ranks(ranks: DataFrame) -> DataFrame:
    blank = F.lit("")
    return ranks.select(
        "player_id", F.col("ts").alias("sort_ts"), F.coalesce(C.short_time("ts"), blank).alias("time"),
        C.csv_safe("constructed_class").alias("constructed_class"),
        F.coalesce(F.col("constructed_level").cast("string"), blank).alias("constructed_level"),
        C.csv_safe("limited_class").alias("limited_class"),
        F.coalesce(F.col("limited_level").cast("string"), blank).alias("limited_level"))
