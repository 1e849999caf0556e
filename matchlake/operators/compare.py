"""Stratified comparison of a current period with the player's own earlier record, and window reports."""
from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as C
from ..functions.tests_of_chance import chi2_tail, fair_binomial_two_sided, p_to_score, two_proportion_chi2
from ..functions.winrate import count_where, is_decided, is_win, rate_columns


def comparison_columns() -> dict[str, Column]:
    """Key parts. Limited: event and mode. Otherwise event, mode, deck and version, all required;
    rows without a usable key fall into an 'unknown' stratum that is never compared."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    mode = F.coalesce(F.col("match_mode"), F.lit("unknown"))
    usable = filled("event_key") & (mode != "unknown")
    kind = (F.when(~usable, "unknown").when(C.is_limited(), "limited")
            .when(filled("my_deck_version") & filled("my_deck_tag"), "deck").otherwise("unknown"))
    return {
        "event": F.col("event_key"), "mode": mode, "kind": kind,
        "deck": F.when(kind != "limited", F.col("my_deck_tag")),
        "version": F.when(kind == "deck", F.col("my_deck_version")),
    }


STRATUM = ["event", "mode", "kind", "deck", "version"]


def stratified(rows: DataFrame, current: Column, history: Column, keys: list[str],
               min_history: int = 20) -> DataFrame:
    """Per key and stratum: current and earlier record, gap in points when the history suffices."""
    tagged = rows.withColumn("_now", F.coalesce(current, F.lit(False))).withColumn(
        "_then", F.coalesce(history, F.lit(False)))
    tagged = tagged.filter(F.col("_now") | F.col("_then")).withColumns(comparison_columns())
    agg = tagged.groupBy(*keys, *STRATUM).agg(
        count_where(F.col("_now")).alias("rows_now"),
        count_where(F.col("_now") & is_decided()).alias("cn"), count_where(F.col("_now") & is_win()).alias("cw"),
        count_where(F.col("_then") & is_decided()).alias("bn"), count_where(F.col("_then") & is_win()).alias("bw"))
    known = F.col("kind") != "unknown"
    agg = (agg.filter(F.col("rows_now") > 0)
           .withColumn("bn", F.when(known, F.col("bn")).otherwise(F.lit(0)))
           .withColumn("bw", F.when(known, F.col("bw")).otherwise(F.lit(0))))
    usable = known & (F.col("bn") >= min_history) & (F.col("cn") > 0)
    gap = 100 * (F.col("cw") / F.col("cn") - F.col("bw") / F.col("bn"))
    return agg.select(*keys, *STRATUM, *rate_columns("cw", "cn", "current"), *rate_columns("bw", "bn", "baseline"),
                      F.when(usable, F.round(gap, 1)).alias("delta_pp"), usable.alias("usable"),
                      (F.col("cn") < 20).alias("small_sample"))


def _comparable() -> list[Column]:
    use = F.col("usable")
    n, bn = F.col("current_n"), F.col("baseline_n")
    zero = F.lit(0)
    return [
        F.sum("current_n").alias("total_decided"), F.sum("current_wins").alias("total_wins"),
        F.coalesce(F.sum(F.when(use, n)), zero).alias("covered"),
        F.coalesce(F.sum(F.when(use, F.col("current_wins"))), zero).alias("covered_wins"),
        F.coalesce(F.sum(F.when(use, n * F.col("baseline_wins") / bn)), F.lit(0.0)).alias("expected"),
        F.coalesce(F.sum(F.when(use, bn)), zero).alias("baseline_n"),
    ]


def adjusted(strata: DataFrame, keys: list[str]) -> DataFrame:
    """Overall gap weighted by the current mix, over the comparable part."""
    agg = strata.groupBy(*keys).agg(*_comparable())
    gap = F.when(F.col("covered") > 0, F.round(100 * (F.col("covered_wins") - F.col("expected")) / F.col("covered"), 1))
    return agg.select(*keys, "covered", "total_decided", gap.alias("adjusted_delta_pp"))


def by_event(strata: DataFrame, keys: list[str]) -> DataFrame:
    """Event and mode roll-up: only strata that passed the rules feed the gap; headline flags the largest."""
    agg = strata.groupBy(*keys, F.coalesce("event", F.lit("")).alias("event"), "mode").agg(*_comparable())
    gap = F.when(F.col("covered") > 0, F.round(100 * (F.col("covered_wins") - F.col("expected")) / F.col("covered"), 1))
    items = agg.withColumn("delta_pp", gap)
    # largest gap, then more comparable matches, then the first event key
    best = (items.filter("delta_pp is not null").groupBy(*keys)
            .agg(F.min(F.struct((-F.abs("delta_pp")).alias("a"), (-F.col("covered")).alias("b"), "event", "mode"))
                 .alias("h")).select(*keys, F.col("h.event").alias("event"), F.col("h.mode").alias("mode"),
                                     F.lit(True).alias("headline")))
    status = (F.when(F.col("delta_pp").isNull(), "no_baseline").when(F.col("delta_pp") >= 5, "higher")
              .when(F.col("delta_pp") <= -5, "lower").otherwise("similar"))
    return items.join(best, [*keys, "event", "mode"], "left").select(
        *keys, "event", "mode", *rate_columns("total_wins", "total_decided"), F.col("covered").alias("comparable_n"),
        "baseline_n", "delta_pp", status.alias("status"), (F.col("total_decided") < 20).alias("small_sample"),
        F.coalesce("headline", F.lit(False)).alias("headline"))


def window_periods(today: date, days: int) -> tuple[Column, Column]:
    """(last ``days`` calendar days including today, everything before); undated rows are in neither."""
    start = F.lit(today - timedelta(days=days - 1))
    return F.col("play_day") >= start, F.col("play_day") < start


def side_balance(rows: DataFrame, keys: list[str]) -> DataFrame:
    play, draw = count_where(F.col("play_draw") == "play"), count_where(F.col("play_draw") == "draw")
    agg = rows.groupBy(*keys).agg(play.alias("play"), draw.alias("draw"))
    p = fair_binomial_two_sided("play", F.col("play") + F.col("draw"))
    return agg.withColumn("p", p).withColumn("score", p_to_score("p"))


def mulligan_shift(enriched: DataFrame, keys: list[str], today: date, days: int) -> DataFrame:
    now, then = window_periods(today, days)
    known = F.col("mulligan").isNotNull()
    agg = enriched.groupBy(*keys).agg(
        count_where(now & F.col("mulligan")).alias("now_yes"), count_where(now & known).alias("now_n"),
        count_where(then & F.col("mulligan")).alias("before_yes"), count_where(then & known).alias("before_n"))
    return agg.withColumn("chi2", two_proportion_chi2("now_yes", "now_n", "before_yes", "before_n"))


def opponent_mix_shift(enriched: DataFrame, keys: list[str], today: date, days: int) -> DataFrame:
    """Chi-square homogeneity of opposing card sets, current against before; invalid under five expected."""
    now, then = window_periods(today, days)
    sets = (enriched.filter(F.size("commanders") > 0).withColumn("cards", F.array_join("commanders", ","))
            .groupBy(*keys, "cards").agg(count_where(now).alias("a"), count_where(then).alias("b"))
            .filter(F.col("a") + F.col("b") > 0))
    totals = sets.groupBy(*keys).agg(F.sum("a").alias("now_n"), F.sum("b").alias("before_n"))
    share = F.col("now_n") / (F.col("now_n") + F.col("before_n"))
    both = F.col("a") + F.col("b")
    cells = sets.join(totals, keys).withColumn("ea", both * share).withColumn("eb", both * (1 - share))
    part = F.pow(F.col("a") - F.col("ea"), 2) / F.col("ea") + F.pow(F.col("b") - F.col("eb"), 2) / F.col("eb")
    agg = cells.groupBy(*keys).agg(F.first("now_n").alias("now_n"), F.first("before_n").alias("before_n"),
                                   F.count(F.lit(1)).alias("kinds"), F.sum(part).alias("stat"),
                                   F.min(F.least("ea", "eb")).alias("least_expected"))
    valid = (F.col("least_expected") >= 5) & (F.col("kinds") > 1)
    return agg.select(*keys, "now_n", "before_n", "kinds", F.when(valid, F.col("stat")).alias("chi2"),
                      F.when(valid, F.col("kinds") - 1).alias("df"))


def window_report(enriched: DataFrame, loss: DataFrame, keys: list[str], today: date, days: int = 30,
                  min_sample: int = 20) -> DataFrame:
    """One row per key: side balance, mulligan and opponent shifts with p values where they may be judged.

    ``loss`` carries the current window's longest losing streak. Shifts are judged only when the rows
    share one event, one deck and one known version.
    """
    now, then = window_periods(today, days)
    rows = enriched.filter(now | then)
    nothing = F.lit("")
    uniform = rows.groupBy(*keys).agg(
        F.count(F.when(now, 1)).alias("n"),
        ((F.min(F.coalesce("event_key", nothing)) == F.max(F.coalesce("event_key", nothing)))
         & (F.min(F.coalesce("my_deck_tag", nothing)) == F.max(F.coalesce("my_deck_tag", nothing)))
         & (F.min(F.coalesce("my_deck_version", nothing)) == F.max(F.coalesce("my_deck_version", nothing)))
         & (F.min(F.coalesce("my_deck_version", nothing)) != "")).alias("comparable"))
    sides = side_balance(rows.filter(now), keys).select(
        *keys, "play", "draw", F.col("p").alias("side_p"))
    mull = mulligan_shift(rows, keys, today, days)
    mix = opponent_mix_shift(rows, keys, today, days).select(
        *keys, F.col("now_n").alias("card_n"), F.col("before_n").alias("card_before_n"),
        F.col("chi2").alias("card_chi2"), F.col("df").alias("card_df"))
    out = (uniform.join(sides, keys, "left").join(mull, keys, "left").join(mix, keys, "left")
           .join(loss, keys, "left"))
    mull_ok = F.col("comparable") & (F.col("before_n") >= min_sample) & (F.col("now_n") >= min_sample)
    mix_ok = F.col("comparable") & (F.col("card_n") >= min_sample) & (F.col("card_before_n") >= min_sample)
    enough = (F.col("play") + F.col("draw")) >= min_sample
    zero = F.lit(0)
    return out.select(
        *keys, "n", "comparable", "play", "draw", F.when(enough, F.col("side_p")).alias("side_p"),
        F.when(enough, p_to_score("side_p")).alias("side_score"),
        F.coalesce("now_n", zero).alias("mulligan_n"), F.coalesce("now_yes", zero).alias("mulligan_yes"),
        F.when(mull_ok, chi2_tail("chi2", F.lit(1.0))).alias("mulligan_p"),
        F.coalesce("card_n", zero).alias("card_n"),
        F.when(mix_ok, chi2_tail("card_chi2", F.col("card_df").cast("double"))).alias("card_p"),
        F.coalesce("max_loss_streak", zero).alias("max_loss_streak"))
