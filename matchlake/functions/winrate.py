"""Win-rate columns: share with a Wilson 95% interval, in percent with one decimal."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

Z95 = 1.959963984540054  # fixed value: two-sided 95% normal quantile


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def count_where(cond: Column) -> Column:
    """Row count under a condition as bigint (0, not NULL, on empty groups)."""
    return F.count(F.when(cond, F.lit(1)))


def is_win(col="my_result") -> Column:
    return F.col(col) == "win"


def is_loss(col="my_result") -> Column:
    return F.col(col) == "loss"


def is_decided(col="my_result") -> Column:
    return F.col(col).isin("win", "loss")


def pct(part, whole, digits: int = 1) -> Column:
    part, whole = as_col(part), as_col(whole)
    return F.when(whole > 0, F.round(F.lit(100.0).cast("double") * part / whole, digits))


def wilson_low(wins, n) -> Column:
    return _bound(as_col(wins), as_col(n), -1)


def wilson_high(wins, n) -> Column:
    return _bound(as_col(wins), as_col(n), 1)


def _bound(wins: Column, n: Column, sign: int) -> Column:
    z = F.lit(Z95)
    nn = n.cast("double")
    p = wins / nn
    centre = (p + z * z / (2 * nn)) / (1 + z * z / nn)
    half = z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / (1 + z * z / nn)
    if sign < 0:
        clamped = F.when(wins == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half))
    else:
        clamped = F.when(wins == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + half))
    return F.when(n > 0, F.round(clamped * 100, 1)).otherwise(F.lit(0.0))


def rate_columns(wins, n, prefix: str = "") -> list[Column]:
    """``n, wins, wr, lo, hi`` with an optional prefix; an empty sample has no rate and 0/0 bounds."""
    wins, n = as_col(wins), as_col(n)
    name = (lambda s: f"{prefix}_{s}") if prefix else (lambda s: s)
    return [
        n.alias(name("n")), wins.alias(name("wins")), pct(wins, n).alias(name("wr")),
        wilson_low(wins, n).alias(name("lo")), wilson_high(wins, n).alias(name("hi")),
    ]


def side_counts() -> list[Column]:
    """The conditional counts every side split needs, from one pass over the rows."""
    play, draw = F.col("play_draw") == "play", F.col("play_draw") == "draw"
    return [
        F.count(F.lit(1)).alias("n"),
        count_where(is_win()).alias("wins"),
        count_where(is_loss()).alias("losses"),
        count_where(play).alias("play"),
        count_where(draw).alias("draw"),
        count_where(play & is_win()).alias("play_wins"),
        count_where(draw & is_win()).alias("draw_wins"),
        count_where(play & is_decided()).alias("play_decided"),
        count_where(draw & is_decided()).alias("draw_decided"),
    ]
