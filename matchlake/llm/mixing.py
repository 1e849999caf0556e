"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree over source blocks."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, Window

from .common import WORD, free_name, written

WEIGHTS = (5, 2, 1)     # by source in code-point order, repeating
SHARE = 1.5             # of all words
MOST = 2.0              # times a source's own words
BLOCKS = 1024           # hash blocks of a source
SHARDS = 16


def split_tree(counts, capacity: list[int], seed: int) -> np.ndarray:
    """Blocks of each source for each shard: exact quotas, drawn without replacement by halving the shards.

    counts: blocks by source; capacity: blocks by shard, with the same total. Result: shards x sources, whose
    columns add up to ``counts`` and rows to ``capacity``.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((len(capacity), len(counts)), np.int64)

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(have, sum(capacity[lo:mid]), method="marginals")
        split(lo, mid, left)
        split(mid, hi, have - left)

    split(0, len(capacity), np.asarray(counts, np.int64))
    return out


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                       F.xxhash64("doc_id", text).alias("h"))


def source_targets(rows: DataFrame) -> DataFrame:
    """(skey, source_size, target): weighted water level with a cap of MOST times the source, one row per source."""
    by_source = rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    w = by_source.withColumn("weight", pick).withColumn("cap", MOST * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    up_to, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = (w.withColumn("spent", F.coalesce(F.sum("cap").over(up_to), F.lit(0.0)))
         .withColumn("gone", F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
         .withColumn("level", (SHARE * F.sum("source_size").over(everything) - F.col("spent"))
                     / (F.sum("weight").over(everything) - F.col("gone")))
         .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
         .withColumn("water", F.min(F.when(F.col("fits"), F.struct(
             (F.col("cap") / F.col("weight")).alias("ratio"), "skey", "level"))).over(everything)["level"]))
    return w.select("skey", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("water"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, seed: int = 17, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """Every row with its source's target, how often it is taken, and the output shard of each copy.

    Whole passes take all blocks of a source; the rest of the target takes blocks in permuted order until it is met, the
    block that crosses it by documents, so a source misses its target by at most half a document. Copies of blocks are
    dealt to ``shards`` by the splitting tree (disjoint stretches of the permuted list); ``copies`` holds
    (shard, order key), the order key being the local shuffle. Deterministic in (doc_id, text, seed).
    NULL source is a source of its own, sorted last; NULL or empty text has size 0 and taken 0; repeated rows are
    separate rows. The driver sees one number per source.
    """
    spark = docs.sparkSession
    rows = written(sized(docs).withColumn("block", F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(blocks))), "mix-rows")
    targets = written(source_targets(rows), "mix-targets")
    stats = rows.groupBy("skey", "block").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("skey").orderBy(F.xxhash64("skey", "block", F.lit(seed)), "block")
    plan = (stats.join(targets, "skey")
            .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
            .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
            .withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("rank", F.row_number().over(order) - 1)
            .withColumn("n_blocks", F.count(F.lit(1)).over(Window.partitionBy("skey")))
            .withColumn("left", F.col("rest") - (F.col("upto") - F.col("words")))
            .withColumn("drawn", F.col("left") > 0)
            .select("skey", "block", "source_size", "target", "passes", "rank", "n_blocks", "left", "drawn",
                    (F.col("left") < F.col("words")).alias("edge")))
    plan = written(plan, "mix-blocks")
    counts = sorted(plan.groupBy("skey").agg(
        (F.max("n_blocks") * F.max("passes") + F.sum(F.col("drawn").cast("long"))).cast("long").alias("n")).collect())
    total = sum(r.n for r in counts)
    capacity = [total * (k + 1) // shards - total * k // shards for k in range(shards)]
    quota = split_tree([r.n for r in counts], capacity, seed) if counts else np.zeros((shards, 0), np.int64)
    ends = quota.cumsum(axis=0)
    cuts = spark.createDataFrame([(r.skey, [int(x) for x in ends[:, i]]) for i, r in enumerate(counts)],
                                 "skey string, ends array<bigint>")
    joined = rows.join(plan, ["skey", "block"]).join(F.broadcast(cuts), "skey")
    inside = Window.partitionBy("skey", "block").orderBy(F.xxhash64("h", F.lit(seed + 1)), "h", "doc_id", "size")
    crossing = (joined.filter("drawn and edge")
                .withColumn("so_far", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("extra", (F.col("so_far") - F.col("size") / 2 < F.col("left")).cast("int")).drop("so_far"))
    plain = joined.filter("not (drawn and edge)").withColumn("extra", F.col("drawn").cast("int"))
    times = F.col("passes").cast("int") + F.col("extra")
    copies = F.expr("""transform(if(times > 0, sequence(0, times - 1), array()), e -> named_struct(
        'shard', cast(size(filter(ends, x -> x <= e * n_blocks + rank)) as int), 'place', xxhash64(h, e, %d)))""" % seed)
    return (plain.unionByName(crossing).withColumn("times", times).withColumn("copies", copies)
            .select("doc_id", "h", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"),
                    "times", F.expr("transform(copies, c -> c.shard)").alias("shards"), "copies"))


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Document rows repeated as the mix takes them (columns of ``docs``), by output shard and in shuffled order within each.

    NULL texts have no words and are taken like empty ones; rows that agree in id and text are all taken as often as the one
    taken most; an empty table gives an empty result. ``docs`` may have columns of any names.
    """
    key = F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))
    h, copies, copy = (free_name(docs, n) for n in ("mix_h", "mix_copies", "mix_copy"))
    plan = mix(docs, seed).filter("times > 0").groupBy("h").agg(F.max_by("copies", "times").alias("copies"))
    plan = plan.toDF(h, copies)
    repeated = docs.withColumn(h, key).join(plan, h).withColumn(copy, F.explode(copies))
    place = [F.col(copy)["shard"], F.col(copy)["place"]]
    return repeated.repartitionByRange(*place).sortWithinPartitions(*place).select(*docs.columns)
