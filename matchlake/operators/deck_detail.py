"""Everything about one deck identity, computed for all identities at once, keyed (player_id, identity)."""
from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import classify as C
from ..functions.event_labels import with_event_labels
from ..functions.winrate import count_where, is_loss, is_win, rate_columns
from ..scope import Scope
from ..session import cut_lineage
from .keys import match_key
from .decks import deck_labels
from .identity import identity_summary, with_identity
from .matchups import card_environment, card_table, nested_games, opponent_cards, own_cards
from .overview import side_summary
from .sequences import streak_observations, version_changes

KEYS = ["player_id", "identity"]
SCOPES = ("today", "yesterday", "last7", "last20", "all")
UNKNOWN_VERSION = "__unknown__"


def apply_scope(rows: DataFrame, scope: str, today: date, keys: list[str] = KEYS) -> DataFrame:
    if scope not in SCOPES:
        raise ValueError(f"unknown deck scope {scope!r}")
    if scope == "all":
        return rows
    if scope == "last20":
        newest = Window.partitionBy(*keys).orderBy(F.col("start_time").isNull(), F.desc("start_time"),
                                                   F.desc("match_id"))
        return rows.withColumn("_r", F.row_number().over(newest)).filter("_r <= 20").drop("_r")
    first, last = {"today": (0, 0), "yesterday": (1, 1), "last7": (6, 0)}[scope]
    return rows.filter(F.col("play_day").between(F.lit(today - timedelta(days=first)),
                                                 F.lit(today - timedelta(days=last))))


def select_version(rows: DataFrame, version: str | None) -> DataFrame:
    if version is None:
        return rows
    filled = F.coalesce(F.trim("my_deck_version"), F.lit(""))
    return rows.filter(filled == ("" if version == UNKNOWN_VERSION else version))


def version_rows(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per version: matches, span, sources; numbered by last use. The unknown version keeps number 0."""
    version = F.nullif(F.trim("my_deck_version"), F.lit(""))
    agg = rows.groupBy(*keys, version.alias("version")).agg(
        F.count(F.lit(1)).alias("n"), F.min("start_time").alias("first_time"), F.max("start_time").alias("last_time"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    order = Window.partitionBy(*keys).orderBy(F.col("version").isNull(), F.desc_nulls_last("last_time"),
                                              F.desc("version"))
    number = F.when(F.col("version").isNull(), 0).otherwise(F.row_number().over(order))
    return agg.withColumn("number", number)


def journey_days(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per day: results, sides, up to four event labels, versions in the order of first use."""
    dated = rows.filter("play_day is not null")
    base = side_summary(dated, [*keys, "play_day"]).select(
        *keys, "play_day", "matches", "wins", "losses", "unknown_result", "wr", "play", "draw", "unknown_side")
    labels = with_event_labels(
        dated.filter("event_key is not null").select(*keys, "play_day", "event_key").distinct())
    events = labels.groupBy(*keys, "play_day").agg(
        F.array_join(F.slice(F.array_sort(F.collect_set("event_label")), 1, 4), ",").alias("events"))
    version = F.nullif(F.trim("my_deck_version"), F.lit(""))
    first_use = (dated.withColumn("version", version).filter("version is not null")
                 .groupBy(*keys, "play_day", "version").agg(F.min(F.struct("start_time", "match_id")).alias("at")))
    versions = first_use.groupBy(*keys, "play_day").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "version"))), lambda v: v["version"]), ",").alias("versions"))
    return (base.join(events, [*keys, "play_day"], "left").join(versions, [*keys, "play_day"], "left")
            .withColumn("events", F.coalesce("events", F.lit(""))).withColumn(
                "versions", F.coalesce("versions", F.lit(""))))


def journey_span(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.countDistinct("play_day").alias("day_count"),
        F.coalesce(F.date_diff(F.max("play_day"), F.min("play_day")) + 1, F.lit(0)).alias("span_days"),
        F.count(F.when(F.col("play_day").isNull(), 1)).alias("unknown_day"))


def deck_observations(rows: DataFrame, commanders: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Up to three notable facts per deck: side streaks by scan probability, then the most frequent
    opposing card, else a plain summary."""
    none_d = F.lit(None).cast("double")
    streaks = streak_observations(rows, keys).select(
        *keys, F.concat(F.lit("streak-"), "side").alias("key"), F.lit("play_draw_streak").alias("kind"), "level",
        F.col("length").alias("n"), F.col("scan").alias("scan"), F.lit(0).alias("lane"))
    _, table = card_table(rows, commanders, keys)
    best = table.groupBy(*keys).agg(F.min(F.struct((-F.col("met")).alias("a"), "grp_id", "met", "wins", "losses"))
                                    .alias("t")).select(*keys, "t.*").filter("met >= 2")
    decided = F.col("wins") + F.col("losses")
    strong = (decided >= 3) & ((F.col("wins") == decided) | (F.col("losses") == decided))
    card = best.select(*keys, F.concat(F.lit("commander-"), "grp_id").alias("key"),
                       F.lit("commander_matchup").alias("kind"),
                       F.when(strong, "strong").otherwise("notable").alias("level"), F.col("met").alias("n"),
                       none_d.alias("scan"), F.lit(1).alias("lane"))
    plain = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(
        *keys, F.lit("range-summary").alias("key"), F.lit("range_summary").alias("kind"),
        F.lit("neutral").alias("level"), "n", none_d.alias("scan"), F.lit(2).alias("lane"))
    w = Window.partitionBy(*keys).orderBy("lane", "scan", F.desc("n"), "key")
    ranked = streaks.unionByName(card).unionByName(plain).withColumn("position", F.row_number().over(w))
    return ranked.filter("(lane < 2 and position <= 3) or (lane = 2 and position = 1)").drop("lane")


def deck_records(rows: DataFrame, games: DataFrame, commanders: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Detail rows of a deck: labels, flags, nested games and opposing cards."""
    key, of_games = match_key(rows), match_key(rows, games)
    cards = (opponent_cards(rows.select(*key, "my_seat", "event_key"), commanders, brawl_only=True)
             .groupBy(*key).agg(F.array_sort(F.collect_set("grp_id")).alias("opp_cards")))
    own = nested_games(games.join(rows.select(*of_games), of_games, "left_semi"))
    out = with_event_labels(rows).join(cards, key, "left").join(own, of_games, "left")
    return out.select(
        *keys, "match_id", "start_time", "event_key", "event_label", "play_draw", "my_result",
        "my_deck_tag", "my_deck_version", "source", F.coalesce("match_mode", F.lit("unknown")).alias("match_mode"),
        C.is_constructed_event().alias("type_eligible"), "opp_archetype_tag", "games",
        F.coalesce("opp_cards", F.array().cast("array<string>")).alias("opp_cards"))


def records_against(rows: DataFrame, commanders: DataFrame, grp_id: str | None = None,
                    evidence: DataFrame | None = None) -> DataFrame:
    """Drill-down: all rows against one card, or all rows behind one observation (never both)."""
    if (grp_id is None) == (evidence is None):
        raise ValueError("choose either a card or an observation")
    if grp_id is not None:
        key = match_key(rows)
        hit = opponent_cards(rows.select(*key, "my_seat", "event_key"),
                             commanders.filter(F.col("grp_id") == grp_id), brawl_only=True)
        return rows.join(hit.select(*key), key, "left_semi")
    key = match_key(rows, evidence)
    return rows.join(evidence.select(*key), key, "left_semi")


def deck_detail(matches: DataFrame, games: DataFrame, commanders: DataFrame, scope: Scope, today: date,
                window: str = "last20", mode: str | None = None, version: str | None = None,
                labels: DataFrame | None = None) -> dict[str, DataFrame]:
    """All blocks of the deck page, each keyed (player_id, identity)."""
    rows = cut_lineage(with_identity(matches, labels))  # read by every block below
    shown = rows.filter(scope.visible())
    visible = shown.filter(F.coalesce("match_mode", F.lit("unknown")) == mode) if mode else shown
    scoped = apply_scope(select_version(visible, version), window, today)
    coverage, cards = card_table(scoped, commanders, KEYS)
    kinds = visible.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), count_where(C.is_brawl()).alias("brawl"),
                                       count_where(C.is_limited()).alias("limited"))
    return {
        "identity": identity_summary(rows),
        "modes": shown.groupBy(*KEYS, F.coalesce("match_mode", F.lit("unknown")).alias("mode")).agg(
            F.count(F.lit(1)).alias("n")),
        "versions": version_rows(visible),
        "summary": side_summary(scoped, KEYS),
        "kind": kinds.withColumn("kind", C.deck_kind("n", "brawl", "limited")),
        "journey": journey_days(visible),
        "journey_span": journey_span(visible),
        "version_changes": version_changes(visible, KEYS),
        "environment": card_environment(visible, matches, commanders, KEYS),
        "own_cards": own_cards(visible, commanders, KEYS),
        "coverage": coverage,
        "cards": cards,
        "observations": deck_observations(scoped, commanders),
        "records": deck_records(scoped, games, commanders),
    }
