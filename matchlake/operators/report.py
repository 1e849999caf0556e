"""Day and range report: the blocks of one report, each keyed by player."""
from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from ..functions import classify as C
from ..session import cut_lineage
from .compare import adjusted, by_event, stratified
from .facts import daily_facts
from .matchups import match_set_summary
from .overview import side_summary
from .sequences import loss_streaks, side_streaks

PLAYER = ["player_id"]


def between(lo: date, hi: date):
    return F.col("play_day").between(F.lit(lo), F.lit(hi))


def selected_summary(enriched: DataFrame, lo: date, hi: date, by: list[str] | None = None) -> DataFrame:
    keys = [*PLAYER, *(by or [])]
    rows = enriched.filter(between(lo, hi))
    return match_set_summary(rows, loss_streaks(rows, keys), keys)


def range_strata(enriched: DataFrame, lo: date, hi: date, days: int = 30) -> DataFrame:
    """Selected days against the ``days`` days right before them; the two never overlap."""
    return stratified(enriched, between(lo, hi), between(lo - timedelta(days=days), lo - timedelta(days=1)), PLAYER)


def tag_counts(enriched: DataFrame, lo: date, hi: date) -> DataFrame:
    tag = F.coalesce(F.nullif("opp_archetype_tag", F.lit("")), F.lit("(untagged)"))
    rows = enriched.filter(between(lo, hi) & C.is_constructed_event())
    return rows.groupBy("player_id", tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def range_numbers(enriched: DataFrame, lo: date, hi: date) -> DataFrame:
    rows = enriched.filter(between(lo, hi))
    days = rows.groupBy(*PLAYER).agg(F.countDistinct("play_day").alias("active_days"))
    return side_summary(rows, PLAYER).join(days, PLAYER)


def day_report(enriched: DataFrame, lo: date, hi: date, *rarity) -> dict[str, DataFrame]:
    """``enriched`` holds all rows in scope (undated ones too). Facts exist for single days only;
    the streak history stops at the last selected day. ``rarity``: thresholds of rare cards, as in ``daily_facts``."""
    enriched = cut_lineage(enriched)  # every block reads it
    strata = range_strata(enriched, lo, hi)
    blocks = {
        "summary": selected_summary(enriched, lo, hi),
        "events": selected_summary(enriched, lo, hi, ["event_key"]),
        "modes": selected_summary(enriched, lo, hi, ["match_mode"]),
        "numbers": range_numbers(enriched, lo, hi),
        "strata": strata, "comparison": adjusted(strata, PLAYER), "comparison_by_event": by_event(strata, PLAYER),
        "opponent_types": tag_counts(enriched, lo, hi),
        "streaks": side_streaks(enriched.filter(between(lo, hi)), PLAYER),
        "history_streaks": side_streaks(
            enriched.filter(F.col("play_day").isNull() | (F.col("play_day") <= F.lit(hi))), PLAYER),
    }
    if lo == hi:
        dated = enriched.filter("play_day is not null")
        blocks["facts"] = daily_facts(dated, *rarity).filter(F.col("play_day") == F.lit(hi))
    return blocks
