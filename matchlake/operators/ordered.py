"""Order-dependent building blocks that survive one key owning a large share of the rows.

A window partitioned by player alone would put a heavy player's whole history into one task. Here every
group with more than ``target_rows`` rows is cut into consecutive chunks of about that many rows, the
window runs per (key, chunk), and only a few edge rows per chunk are stitched together afterwards.

Cuts are made in exact row counts per minute, cumulated within the group, so bursts and outlier times
make no chunk larger than the target plus one minute. Undated rows form chunks of their own in front: one, or, where a
tie-breaker is named, consecutive ones of at most about the target. Counts are exact, so the cut is the same on every
evaluation. All sizes travel by ordinary joins.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored

TARGET_ROWS = 1_000_000
MINUTE = 60_000
CHUNK = "_chunk"
CHUNKS = "_chunks"


def _same(left_keys: list[str], right_keys: list[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left_keys, right_keys):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def chunked(df: DataFrame, keys: list[str], time: str, target_rows: int | None = None, tie: str | None = None) -> DataFrame:
    """Add ``_chunk`` (monotone in ``time`` within the key, 0 for ordinary groups) and ``_chunks``.

    With ``tie`` the undated rows of a group, which have no other order, are cut in the order of that column.
    """
    target = target_rows or TARGET_ROWS
    undated = F.col(time).isNull() | (F.col(time) <= 0)  # stand-ins for a missing time are not positive
    cell = F.when(undated, F.lit(-1)).otherwise(F.floor(F.col(time) / MINUTE)).cast("bigint")
    names = [f"_h_{k}" for k in keys]
    hot = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > target)
           .select(*[F.col(k).alias(n) for k, n in zip(keys, names)]))
    if tie:
        places = _undated_places(df.filter(undated).join(hot, _same(keys, names), "left_semi").select(*keys, tie), keys, tie, target)
        if places is not None:
            df = df.join(places, _same([*keys, tie], [*names, "_h_tie"]), "left").drop(*names, "_h_tie")
            cell = F.when(undated, F.coalesce("_place", F.lit(-1))).otherwise(cell).cast("bigint")
    counts = df.join(hot, _same(keys, names), "left_semi").groupBy(*keys, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = F.sum("_n").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    late = F.coalesce(F.sum(F.when(F.col("_cell") < 0, F.col("_n"))).over(whole), F.lit(0))
    number = F.row_number().over(whole.orderBy("_cell"))
    first = F.coalesce(F.max(F.when(F.col("_cell") < 0, F.col("_number"))).over(whole), F.lit(0))
    chunk = F.when(F.col("_cell") < 0, F.col("_number") - 1).otherwise(first + F.floor((before - late) / target)).cast("bigint")
    cuts = counts.withColumn("_number", number).withColumn(CHUNK, chunk).withColumn(CHUNKS, F.max(CHUNK).over(whole) + 1).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_cell").alias("_h_cell"), CHUNK, CHUNKS)
    return (df.withColumn("_cell", cell).join(cuts, _same([*keys, "_cell"], [*names, "_h_cell"]), "left")
            .withColumn(CHUNK, F.coalesce(CHUNK, F.lit(0).cast("bigint"))).withColumn(CHUNKS, F.coalesce(CHUNKS, F.lit(1).cast("bigint")))
            .drop("_cell", "_h_cell", "_place", *names))


def _undated_places(rows: DataFrame, keys: list[str], tie: str, target: int) -> DataFrame | None:
    """(keys, tie) of the undated rows of large groups -> a negative place that grows with the tie, at most about ``target`` rows
    to a place; None if they are few. The rows are range-partitioned, and the partition is written with them, since another
    evaluation may draw other bounds."""
    total = rows.count()
    if total <= target:
        return None
    parts = -(-2 * total // target)
    ranged = rows.repartitionByRange(parts, *keys, tie).withColumn("_place", F.spark_partition_id() - parts)
    names = {**{k: f"_h_{k}" for k in keys}, tie: "_h_tie"}
    return stored(ranged.withColumnsRenamed(names).distinct(), "undated-places")


def mark_ties(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """``_tied``: another row of the key has the same time. Equal times always share a chunk."""
    w = Window.partitionBy(*keys, CHUNK).orderBy(time, tie)
    same_prev = F.lag(time).over(w) == F.col(time)
    same_next = F.lead(time).over(w) == F.col(time)
    return df.withColumn("_tied", F.coalesce(same_prev, F.lit(False)) | F.coalesce(same_next, F.lit(False)))


def islands(df: DataFrame, keys: list[str], time: str, tie: str, state: str,
            attrs: tuple[str, ...] = (), flags: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Maximal runs of equal ``state`` in (time, tie) order, over a chunked frame.

    One row per run: keys, state, ``len``, ``head`` and ``tail`` structs (time, tie, *attrs of the first
    and last row) and the maximum of each boolean flag. NULL is a state of its own. With ``weight`` the
    length is the sum of that column (runs of runs).
    """
    w = Window.partitionBy(*keys, CHUNK).orderBy(time, tie)
    changed = ~F.lag(state).over(w).eqNullSafe(F.col(state)) | (F.row_number().over(w) == 1)
    row = F.struct(F.col(time).alias("time"), F.col(tie).alias("tie"), *attrs)
    marked = df.withColumn("_change", changed.cast("int")).withColumn("_island", F.sum("_change").over(w))
    local = marked.groupBy(*keys, CHUNK, "_island", state).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("len"), F.min(row).alias("head"), F.max(row).alias("tail"),
        *[F.max(f).alias(f) for f in flags])
    chunk_only = Window.partitionBy(*keys, CHUNK)
    edge = (F.col("_island") == 1) | (F.col("_island") == F.max("_island").over(chunk_only))
    # inner runs are final; edge runs of all chunks of a key meet in one small window
    local = local.withColumn("_lane", F.when(edge, F.lit(None)).otherwise(F.col(CHUNK)))
    lane = Window.partitionBy(*keys, "_lane").orderBy("head")
    joins_previous = (F.col("_lane").isNull() & (F.lag(CHUNK).over(lane) != F.col(CHUNK))
                      & F.lag(state).over(lane).eqNullSafe(F.col(state)))
    stitched = local.withColumn("_fresh", F.when(F.coalesce(joins_previous, F.lit(False)), 0).otherwise(1))
    stitched = stitched.withColumn("_run", F.sum("_fresh").over(lane))
    return stitched.groupBy(*keys, "_lane", "_run", state).agg(
        F.sum("len").alias("len"), F.min("head").alias("head"), F.max("tail").alias("tail"),
        *[F.max(f).alias(f) for f in flags]).drop("_lane", "_run")


def running(df: DataFrame, keys: list[str], chunk: str, order: list[str], sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, mins: dict[str, Column] | None = None) -> DataFrame:
    """Inclusive running sums / last non-NULL values / minima over (chunk, order) within the key.

    (keys, chunk, order) must identify a row. Only those columns and the inputs are scanned: they are
    written once, windowed per (key, chunk), and corrected by a second window over one row per chunk, so
    no task holds a whole heavy key. The results are joined back to the wide rows on the row's identity.
    """
    sums, lasts, mins = sums or {}, lasts or {}, mins or {}
    named = {**sums, **lasts, **mins}
    ident = [*keys, chunk, *order]
    narrow = stored(df.select(*ident, *[c.alias(f"_v_{n}") for n, c in named.items()]), "running-narrow")
    w = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = narrow.select(
        *ident,
        *[F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0)).alias(f"_l_{n}") for n in sums],
        *[F.last(f"_v_{n}", ignorenulls=True).over(w).alias(f"_l_{n}") for n in lasts],
        *[F.min(f"_v_{n}").over(w).alias(f"_l_{n}") for n in mins])
    pos = F.struct(*order)
    totals = narrow.groupBy(*keys, chunk).agg(
        *[F.coalesce(F.sum(f"_v_{n}"), F.lit(0)).alias(f"_t_{n}") for n in sums],
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), pos)).alias(f"_t_{n}") for n in lasts],
        *[F.min(f"_v_{n}").alias(f"_t_{n}") for n in mins])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, chunk,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
        *[F.min(f"_t_{n}").over(before).alias(f"_c_{n}") for n in mins])
    out = local.join(carried, [*keys, chunk]).select(
        *ident,
        *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in lasts],
        *[F.least(f"_l_{n}", f"_c_{n}").alias(n) for n in mins])
    if set(df.columns) <= set(ident):
        return out
    return df.join(out, ident)


def running_rows(df: DataFrame, keys: list[str], chunk: str, order: list[str], sums: dict[str, Column] | None = None,
                 lasts: dict[str, Column] | None = None, by: str | None = None) -> DataFrame:
    """As ``running``, for wide rows that many readers use: the rows are windowed where they lie by (key, chunk) and written once
    with their local values; a table of one row per chunk, written too, corrects them. No join on the identity of rows. With
    ``by`` (a column of few values) every value gets files of its own, so that readers of one leave the others unread."""
    sums, lasts = sums or {}, lasts or {}
    w = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = stored(df.select(
        "*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_l_{n}") for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(w).alias(f"_l_{n}") for n, c in lasts.items()]), "running", by)
    totals = local.groupBy(*keys, chunk).agg(*[F.max_by(f"_l_{n}", F.struct(*order)).alias(f"_t_{n}") for n in [*sums, *lasts]])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = stored(totals.select(
        *keys, chunk, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts]), "carried")
    return local.join(carried, [*keys, chunk]).select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in lasts])
