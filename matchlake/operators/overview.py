"""Counting queries over match rows: totals, splits, trends, focus, options, repeat opponents.

Every function keeps ``player_id`` as the leading grouping key. All of them are plain hash
aggregates (partial aggregation before the one shuffle), so a player who owns a large share of the
rows contributes only one partial row per task and group.
"""
from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import classify as C
from ..functions.winrate import (count_where, is_decided, is_loss, is_win, pct, rate_columns, side_counts)
from ..scope import Scope
from .keys import match_key

UNKNOWN_EVENT = "(unknown)"
UNLABELLED_DECK = "(unlabelled)"
DAY_MS = 86_400_000


def event_bucket():
    return F.coalesce(F.col("event_key"), F.lit(UNKNOWN_EVENT))


def deck_bucket():
    return F.coalesce(F.nullif(F.col("my_deck_tag"), F.lit("")), F.lit(UNLABELLED_DECK))


def week_sunday(day="play_day"):
    """The Sunday that starts the week of a day."""
    return F.date_sub(F.col(day), F.dayofweek(F.col(day)) - 1)


SLICES = 64


def top_ranked(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Whatever reaches the first k of a key is among the first k of its slice, so each of
    SLICES slices of a key is cut on its own before the survivors meet; no task sorts a whole key at any k."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(SLICES))
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    df = df.withColumn("_slice", part).withColumn(rank, F.row_number().over(local)).filter(F.col(rank) <= k).drop("_slice")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def overview_totals(matches: DataFrame, scope: Scope, today: date) -> DataFrame:
    """Scoped totals, hidden-row count and the fixed 'today' block, all from one scan."""
    base = Scope(scope.event, scope.family, scope.deck, scope.deck_id, scope.mode)
    from ..scope import range_filter
    in_range = range_filter(scope.range, today)
    rows = matches.filter(base.selection() & is_decided())
    seen, is_today = scope.visible(), F.col("play_day") == F.lit(today)

    def block(cond, p):
        play, draw = F.col("play_draw") == "play", F.col("play_draw") == "draw"
        return [
            count_where(cond).alias(f"{p}n_"), count_where(cond & is_win()).alias(f"{p}w_"),
            count_where(cond & play).alias(f"{p}pn_"), count_where(cond & play & is_win()).alias(f"{p}pw_"),
            count_where(cond & draw).alias(f"{p}dn_"), count_where(cond & draw & is_win()).alias(f"{p}dw_"),
        ]

    agg = rows.groupBy("player_id").agg(
        *block(in_range & seen, ""), *block(is_today & seen, "today_"),
        count_where(in_range & scope.hidden()).alias("hidden"))

    def out(p):
        pre = p.rstrip("_")
        name = f"{pre}_" if pre else ""
        pn, dn, n = F.col(f"{p}pn_"), F.col(f"{p}dn_"), F.col(f"{p}n_")
        return [
            *rate_columns(f"{p}w_", n, pre),
            *rate_columns(f"{p}pw_", pn, f"{name}on_play"),
            *rate_columns(f"{p}dw_", dn, f"{name}on_draw"),
            (n - pn - dn).alias(f"{name}side_unknown"),
            pct(pn, pn + dn).alias(f"{name}play_rate"),
            pct(dn, pn + dn).alias(f"{name}draw_rate"),
        ]

    return agg.select("player_id", "hidden", *out(""), *out("today_"))


def overview_groups(matches: DataFrame, scope: Scope) -> DataFrame:
    """By event, by deck name, by day and by week in one scan (grouping sets)."""
    rows = scope.decided(matches).select(
        "player_id", "my_result", event_bucket().alias("event"), deck_bucket().alias("deck"),
        F.col("play_day").cast("string").alias("day"), week_sunday().cast("string").alias("week"))
    p = F.col("player_id")
    sets = [[p, F.col(c)] for c in ("event", "deck", "day", "week")]
    agg = rows.groupingSets(sets, "player_id", "event", "deck", "day", "week").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("cnt"), count_where(is_win()).alias("won"))
    section = (F.when(F.col("gid") == 0b0111, "event").when(F.col("gid") == 0b1011, "deck")
               .when(F.col("gid") == 0b1101, "day").otherwise("week_sunday"))
    return (agg.select("player_id", section.alias("section"),
                       F.coalesce("event", "deck", "day", "week").alias("key"), "cnt", "won")
            .filter(F.col("key").isNotNull())
            .select("player_id", "section", "key", *rate_columns("won", "cnt")))


def rate_by(matches: DataFrame, scope: Scope, key) -> DataFrame:
    rows = scope.decided(matches).select("player_id", "my_result", key.alias("key"))
    return (rows.filter(F.col("key").isNotNull()).groupBy("player_id", "key")
            .agg(F.count(F.lit(1)).alias("cnt"), count_where(is_win()).alias("won"))
            .select("player_id", "key", *rate_columns("won", "cnt")))


def format_focus(matches: DataFrame, today: date, window_days: int = 30) -> DataFrame:
    """Dominant event family of the recent window per player, its share and which blocks it unlocks."""
    recent = matches.filter((F.col("play_day") >= F.lit(today - timedelta(days=window_days)))
                            & F.col("my_result").isNotNull())
    fam = recent.groupBy("player_id", C.event_family().alias("family")).agg(F.count(F.lit(1)).alias("n"))
    best = fam.groupBy("player_id").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), "family")).alias("top"), F.sum("n").alias("total"))
    primary = F.col("top.family")
    return best.select(
        "player_id", primary.alias("primary"), (-F.col("top.neg")).alias("n"), "total",
        pct(-F.col("top.neg"), F.col("total")).alias("share"),
        (primary == "brawl").alias("show_commanders"),
        primary.isin("ladder", "draft", "sealed").alias("show_rank"),
        primary.isin("ladder", "play", "constructed", "weekly").alias("show_opponent_types"))


def opponent_types(matches: DataFrame, scope: Scope, exploded: bool = False) -> DataFrame:
    """Record per hand-given opponent archetype over eligible events; the whole tag set is the key,
    or each single tag when ``exploded``."""
    rows = scope.apply(matches).filter(C.is_constructed_event())
    tag = F.nullif(F.col("opp_archetype_tag"), F.lit(""))
    rows = rows.withColumn("tag", tag).filter(F.col("tag").isNotNull())
    if exploded:
        rows = rows.withColumn("tag", F.explode(C.tag_list("tag")))
    agg = rows.groupBy("player_id", "tag").agg(*side_counts(), count_where(is_decided()).alias("decided"))
    order = F.array_position(F.array(*[F.lit(a) for a in C.ARCHETYPES]), F.col("tag"))
    return agg.select(
        "player_id", "tag",
        F.when(order > 0, order).otherwise(len(C.ARCHETYPES) + 1).cast("int").alias("tag_order"),
        F.col("n").alias("matches"), "losses", (F.col("n") - F.col("decided")).alias("unknown_result"),
        "play", "draw", *rate_columns("wins", "decided"))


def opponent_type_coverage(matches: DataFrame, scope: Scope) -> DataFrame:
    rows = scope.apply(matches).filter(C.is_constructed_event())
    tagged = F.coalesce(F.col("opp_archetype_tag"), F.lit("")) != ""
    return rows.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("eligible"), count_where(tagged).alias("known"),
        count_where(~tagged).alias("unknown"))


def single_mode_events(matches: DataFrame) -> DataFrame:
    return (matches.filter(F.coalesce(F.col("event_key"), F.lit("")) != "")
            .groupBy("player_id", "event_key")
            .agg(F.countDistinct(F.coalesce(F.col("match_mode"), F.lit("unknown"))).alias("modes"))
            .filter("modes <= 1").select("player_id", "event_key"))


def repeat_opponents(matches: DataFrame, scope: Scope, min_n: int = 2, limit: int = 12) -> DataFrame:
    """People met again and again: bots and practice games excluded, per player the most frequent first."""
    rows = scope.apply(matches).filter(
        (F.coalesce(F.col("opponent_name"), F.lit("")) != "") & ~F.col("event_key").contains("BotMatch"))
    met = (rows.groupBy("player_id", "opponent_name").agg(
        F.count(F.lit(1)).alias("n"), count_where(is_win()).alias("wins"),
        count_where(is_loss()).alias("losses"), F.min("start_time").alias("first_time"),
        F.max("start_time").alias("last_time"), F.countDistinct("play_day").alias("days"))
        .filter(F.col("n") >= min_n))
    totals = met.groupBy("player_id").agg(F.count(F.lit(1)).alias("total"))
    top = top_ranked(met, ["player_id"],
                     [F.desc("n"), F.desc_nulls_last("last_time"), F.asc("opponent_name")], limit)
    return top.join(totals, "player_id")


def filter_options(matches: DataFrame, scope: Scope) -> DataFrame:
    """Choice lists family -> event -> mode -> deck with counts, from one pre-aggregated scan."""
    flags = Scope(exclude_abnormal=scope.exclude_abnormal, exclude_bot=scope.exclude_bot)
    base = flags.apply(matches).groupBy(
        "player_id", "event_key", "match_mode", "my_deck_tag", "my_deck_id").agg(F.count(F.lit(1)).alias("c"))
    base = base.withColumn("family", C.event_family())
    up = Scope(event=scope.event, family=scope.family)
    none = F.lit(None).cast("bigint")
    families = (base.filter("event_key is not null").groupBy("player_id", F.col("family").alias("value"))
                .agg(F.sum("c").alias("n")).select("player_id", F.lit("family").alias("section"), "value", "n",
                                                   none.alias("ids")))
    event_rows = base.filter("event_key is not null")
    if scope.mode:
        event_rows = event_rows.filter(F.col("match_mode") == scope.mode)
    if scope.family:
        event_rows = event_rows.filter(F.col("family") == scope.family)
    events = (event_rows.groupBy("player_id", F.col("event_key").alias("value")).agg(F.sum("c").alias("n"))
              .select("player_id", F.lit("event").alias("section"), "value", "n", none.alias("ids")))
    deck_rows = base.filter(up.selection() & (F.coalesce(F.col("my_deck_tag"), F.lit("")) != ""))
    if scope.mode:
        deck_rows = deck_rows.filter(F.col("match_mode") == scope.mode)
    decks = (deck_rows.groupBy("player_id", F.col("my_deck_tag").alias("value"))
             .agg(F.sum("c").alias("n"),
                  F.countDistinct(F.coalesce(F.col("my_deck_id"), F.lit(""))).alias("ids"))
             .select("player_id", F.lit("deck").alias("section"), "value", "n", "ids"))
    mode = F.coalesce(F.col("match_mode"), F.lit("unknown"))
    modes = (base.filter(up.selection()).groupBy("player_id")
             .agg(*[F.coalesce(F.sum(F.when(mode == k, F.col("c"))), F.lit(0)).alias(k)
                    for k in ("BO1", "BO3", "unknown")])
             .selectExpr("player_id", "'mode' as section",
                         "stack(3, 'BO1', BO1, 'BO3', BO3, 'unknown', unknown) as (value, n)")
             .select("player_id", "section", "value", "n", none.alias("ids")))
    return families.unionByName(events).unionByName(decks).unionByName(modes)


def mulligan_distribution(matches: DataFrame, mulligans: DataFrame, scope: Scope) -> DataFrame:
    """How often the player kept after k mulligans; a NULL seat is the player's own."""
    m = scope.decided(matches).select("player_id", "match_id", "my_seat")
    return (mulligans.join(m, match_key(m, mulligans))
            .filter(F.col("seat").isNull() | (F.col("seat") == F.col("my_seat")))
            .groupBy("player_id", "kept_on").agg(F.count(F.lit(1)).alias("n")))


def mulligan_state(matches: DataFrame, mulligans: DataFrame) -> DataFrame:
    """(player, match) -> any_mulligan (true/false); absent when nothing of the player's own is recorded."""
    own = mulligans.filter("kept_on is not null").join(
        matches.select(*match_key(matches), "my_seat"), match_key(matches, mulligans)).filter("seat is null or seat = my_seat")
    return own.groupBy(*match_key(matches)).agg(F.max(F.col("kept_on") > 0).alias("mulligan"),
                                       F.sum("kept_on").alias("kept_sum"))


def rate_by_mulligan(matches: DataFrame, mulligans: DataFrame, scope: Scope) -> DataFrame:
    rows = scope.decided(matches).select("player_id", "match_id", "my_seat", "my_result")
    state = mulligan_state(rows, mulligans)
    key = (F.when(F.col("mulligan"), "mulligan").when(F.col("mulligan").isNotNull(), "clean")
           .otherwise("unknown"))
    return (rows.join(state, match_key(rows), "left").groupBy("player_id", key.alias("key"))
            .agg(F.count(F.lit(1)).alias("cnt"), count_where(is_win()).alias("won"))
            .select("player_id", "key", *rate_columns("won", "cnt")))


def side_distribution(matches: DataFrame, scope: Scope) -> DataFrame:
    return side_summary(scope.apply(matches), ["player_id"])


def side_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Unknown-aware summary of any set of rows, per key (results and sides both may be missing)."""
    agg = rows.groupBy(*keys).agg(*side_counts())
    n, play, draw = F.col("n"), F.col("play"), F.col("draw")
    wins, losses = F.col("wins"), F.col("losses")
    return agg.select(
        *keys, n.alias("matches"), "losses", (n - wins - losses).alias("unknown_result"), "play", "draw",
        (n - play - draw).alias("unknown_side"), pct(play, play + draw).alias("play_rate"),
        pct(draw, play + draw).alias("draw_rate"), *rate_columns(wins, wins + losses),
        *rate_columns("play_wins", "play_decided", "on_play"),
        *rate_columns("draw_wins", "draw_decided", "on_draw"))


def date_index(matches: DataFrame, scope: Scope, today: date) -> DataFrame:
    """Match count per day with the player's latest day not after today and the undated count."""
    rows = scope.apply(matches)
    days = rows.groupBy("player_id", "play_day").agg(F.count(F.lit(1)).alias("n"))
    head = days.groupBy("player_id").agg(
        F.max(F.when(F.col("play_day") <= F.lit(today), F.col("play_day"))).cast("string").alias("latest_day"),
        F.coalesce(F.sum(F.when(F.col("play_day").isNull(), F.col("n"))), F.lit(0)).alias("undated"))
    return (days.filter("play_day is not null").join(head, "player_id")
            .select("player_id", F.col("play_day").cast("string").alias("day"), "n", "latest_day", "undated"))


def mode_counts(matches: DataFrame, scope: Scope, by: list[str] | None = None) -> DataFrame:
    keys = ["player_id", *(by or [])]
    return (scope.apply(matches)
            .groupBy(*keys, F.coalesce(F.col("match_mode"), F.lit("unknown")).alias("mode"))
            .agg(F.count(F.lit(1)).alias("n")))


def history_formats(matches: DataFrame, brawl_starts: DataFrame | None = None) -> DataFrame:
    """Match rows with a format class; raw brawl start times (player_id, start_time) override the key."""
    rows = matches
    if brawl_starts is not None:
        marked = brawl_starts.select("player_id", "start_time").distinct().withColumn("raw_brawl", F.lit(True))
        rows = rows.join(marked, ["player_id", "start_time"], "left")
    else:
        rows = rows.withColumn("raw_brawl", F.lit(None).cast("boolean"))
    fmt = (F.when(F.col("raw_brawl") | C.is_brawl(), "brawl").when(C.is_limited(), "limited")
           .otherwise("constructed"))
    return rows.withColumn("format_class", fmt).drop("raw_brawl")


def format_side_matrix(rows: DataFrame, key: str) -> DataFrame:
    """Win rate on the play against on the draw per key value, with the gap in points."""
    cells = (rows.filter(is_decided() & F.col(key).isNotNull()).groupBy("player_id", key)
             .pivot("play_draw", ["play", "draw"])
             .agg(F.count(F.lit(1)).alias("cnt"), count_where(is_win()).alias("won")))
    pn, pw = F.coalesce("play_cnt", F.lit(0)), F.coalesce("play_won", F.lit(0))
    dn, dw = F.coalesce("draw_cnt", F.lit(0)), F.coalesce("draw_won", F.lit(0))
    gap = F.when((pn > 0) & (dn > 0), F.round(F.lit(100.0).cast("double") * (pw / pn - dw / dn), 1))
    return cells.select("player_id", F.col(key).cast("string").alias("key"), *rate_columns(pw, pn, "on_play"),
                        *rate_columns(dw, dn, "on_draw"), gap.alias("delta_pp"))


def top_decks_by_side(matches: DataFrame, limit: int = 15) -> DataFrame:
    rows = matches.filter(is_decided() & (F.coalesce(F.col("my_deck_tag"), F.lit("")) != ""))
    agg = rows.groupBy("player_id", "my_deck_tag").agg(*side_counts())
    top = top_ranked(agg, ["player_id"], [F.desc("n"), F.asc("my_deck_tag")], limit)
    return top.select("player_id", "my_deck_tag", "rank", *rate_columns("wins", "n"),
                      *rate_columns("play_wins", "play_decided", "on_play"),
                      *rate_columns("draw_wins", "draw_decided", "on_draw"))


def source_counts(matches: DataFrame) -> DataFrame:
    return (matches.groupBy("player_id", "source")
            .agg(F.count(F.lit(1)).alias("n"), count_where(F.col("my_result").isNotNull()).alias("decided"),
                 F.min("start_time").alias("first_time"), F.max("start_time").alias("last_time")))
