"""Resharding by minimum-cost flow: from the old shard sizes and the new capacities, the block transfers that move the
fewest bytes, then new shards and slots for every row (and, on request, the rewritten files of affected shards)."""
from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F, Window

from .common import written

OVERHEAD = 16         # bytes a row counts beside its text
BLOCKS_PER_SHARD = 200
SLOT_ROWS = 50_000    # rows numbered together


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest shipment of all supply into the demand (both non-negative; demand in total at least supply).

    Successive shortest paths over the dense bipartite graph of shards: its size depends on shard counts alone.
    """
    n, m = len(supply), len(demand)
    left, room = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    pot_l, pot_r = [0] * n, [0] * m
    while any(left):
        dist_l = [0 if left[i] else None for i in range(n)]
        dist_r: list = [None] * m
        via_r, via_l = [None] * m, [None] * n
        heap = [(0, 0, i) for i in range(n) if left[i]]
        while heap:
            d, side, v = heapq.heappop(heap)
            if side == 0:
                if d > dist_l[v]:
                    continue
                for j in range(m):
                    e = d + cost(v, j) + pot_l[v] - pot_r[j]
                    if dist_r[j] is None or e < dist_r[j]:
                        dist_r[j], via_r[j] = e, v
                        heapq.heappush(heap, (e, 1, j))
            else:
                if d > dist_r[v]:
                    continue
                for i in range(n):
                    if flow.get((i, v)):
                        e = d - cost(i, v) + pot_r[v] - pot_l[i]
                        if dist_l[i] is None or e < dist_l[i]:
                            dist_l[i], via_l[i] = e, v
                            heapq.heappush(heap, (e, 0, i))
        open_ = [j for j in range(m) if room[j] and dist_r[j] is not None]
        if not open_:
            raise ValueError("capacities are smaller than the data")
        end = min(open_, key=lambda j: (dist_r[j] + pot_r[j], j))
        path, j = [], end
        while True:
            i = via_r[j]
            path.append((i, j, 1))
            if via_l[i] is None:
                break
            j = via_l[i]
            path.append((i, j, -1))
        amount = min([left[i], room[end]] + [flow[(a, b)] for a, b, s in path if s < 0])
        for a, b, s in path:
            flow[(a, b)] = flow.get((a, b), 0) + s * amount
        left[i] -= amount
        room[end] -= amount
        far = max(d for d in dist_l + dist_r if d is not None)
        pot_l = [p + (far if d is None else d) for p, d in zip(pot_l, dist_l)]
        pot_r = [p + (far if d is None else d) for p, d in zip(pot_r, dist_r)]
    return {k: v for k, v in flow.items() if v}


def plan_transfers(blocks: list[tuple], old_shards: int, new_shards: int, cost=lambda i, j: 1) -> dict:
    """blocks: (block key, old shard, bytes) -> {block key: new shard}. Old shard i continues as new shard i if it exists;
    equal capacities. Flow decides how many bytes go where, blocks are then dealt to the flows, largest first."""
    total = sum(b for _, _, b in blocks)
    capacity = [total * (s + 1) // new_shards - total * s // new_shards for s in range(new_shards)]
    old = [0] * old_shards
    own: list[list] = [[] for _ in range(old_shards)]
    for key, s, b in blocks:
        old[s] += b
        own[s].append((b, key))
    have = [old[s] if s < old_shards else 0 for s in range(new_shards)]
    gone = [old[s] if s >= new_shards else 0 for s in range(old_shards)]
    supply = [gone[s] or max(0, old[s] - capacity[s]) for s in range(old_shards)]
    demand = [max(0, capacity[s] - have[s]) for s in range(new_shards)]
    flow = min_cost_flow(supply, demand, cost)
    to, load = {}, [0] * new_shards
    for s in range(old_shards):
        wants = {j: f for (i, j), f in flow.items() if i == s}
        stay = capacity[s] if s < new_shards else 0
        for b, key in sorted(own[s], key=lambda x: (-x[0], str(x[1]))):
            j = max(wants, key=lambda j: (wants[j], -j), default=None)
            if j is not None and (s >= new_shards or wants[j] >= b or (wants[j] * 2 >= b and stay < b)):
                to[key] = j
                wants[j] -= b
            elif j is not None and stay < b and wants[j] > stay:
                to[key] = j
                wants[j] -= b
            else:
                to[key] = j = s
                stay -= b
            load[to[key]] += b
    # even out what whole blocks left over: fullest to emptiest while that helps
    held: list[list] = [[] for _ in range(new_shards)]
    for key, s, b in blocks:
        held[to[key]].append((b, str(key), key))
    for h in held:
        h.sort(reverse=True)
    for _ in range(20 * new_shards):
        hi, lo = max(range(new_shards), key=load.__getitem__), min(range(new_shards), key=load.__getitem__)
        gap = load[hi] - load[lo]
        move = next((x for x in held[hi] if 0 < x[0] < gap and x[0] <= gap * 3 // 4), None)
        if move is None:
            break
        held[hi].remove(move)
        held[lo].append(move)
        held[lo].sort(reverse=True)
        to[move[2]] = lo
        load[hi] -= move[0]
        load[lo] += move[0]
    return to


def reshard(rows: DataFrame, old_shards: int, new_shards: int, blocks_per_shard: int = BLOCKS_PER_SHARD,
            cost=lambda i, j: 1) -> DataFrame:
    """rows(doc_id, size, h, old_shard, ...) -> the same with shard and slot.

    A block is a bucket of text hashes inside an old shard, so equal texts stay together; a group of equal texts beyond the
    grain (one ``blocks_per_shard``-th of a shard) is cut into pieces of the grain by id. There are at most
    3 * new_shards * blocks_per_shard blocks whatever the input, which bounds what the driver plans and what is broadcast.
    NULL ids and repeated rows are ordinary rows; ties in a block are ordered by (doc_id, h), equal rows being alike.
    An empty table gives an empty table.
    """
    spark = rows.sparkSession
    groups = rows.groupBy("old_shard", "h").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    grain = max(1, total // (new_shards * blocks_per_shard))
    hot = groups.filter(F.col("bytes") > grain).select(
        "old_shard", "h", F.ceil(F.col("bytes") / grain).cast("long").alias("pieces"))
    buckets = -(-new_shards * blocks_per_shard // old_shards)
    placed = (rows.join(F.broadcast(hot), ["old_shard", "h"], "left")
              .withColumn("block", F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("h"), F.lit(buckets))).otherwise(F.col("h")))
              .withColumn("piece", F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(
                  F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).cast("long")).drop("pieces"))
    key = ["old_shard", "block", "piece"]
    stats = placed.groupBy(*key).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    to = plan_transfers([((r.old_shard, r.block, r.piece), r.old_shard, r.bytes) for r in stats], old_shards, new_shards, cost)
    made = [(*k, s, max(1, -(-n // SLOT_ROWS))) for k, s, n in
            ((k, to[k], r.n) for r in stats for k in [(r.old_shard, r.block, r.piece)])]
    moves = spark.createDataFrame(made, "old_shard int, block long, piece long, shard int, parts long")
    routed = (placed.join(F.broadcast(moves), key)
              .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts"))).drop("parts"))
    part = ["shard", *key, "part"]
    before = Window.partitionBy("shard").orderBy(*key, "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (routed.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
               .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    place = F.row_number().over(Window.partitionBy(*part).orderBy("doc_id", "h"))
    return (routed.withColumn("place", place).join(offsets, part)
            .withColumn("slot", (F.col("offset") + F.col("place") - 1).cast("long"))
            .drop("place", "offset", "part", "block", "piece"))


def sized(docs: DataFrame, old_shards: int) -> DataFrame:
    """Narrow rows of documents: size in bytes, checksum, text hash and the old shard, which text decides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")
                       ).withColumn("old_shard", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(old_shards)).cast("int"))


def sharded_documents(docs: DataFrame, old_shards: int = 32, new_shards: int = 40) -> DataFrame:
    """All documents moved from ``old_shards`` text-hash shards to ``new_shards`` of equal bytes (law ``bytes``)."""
    rows = written(sized(docs, old_shards), "reshard-rows")
    return reshard(rows, old_shards, new_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def rewrite_affected(docs: DataFrame, plan: DataFrame, out_dir: str) -> DataFrame:
    """Write the shards that gain or lose rows below ``out_dir``/shard=k (documents with unique ids); returns the shard list.

    Untouched shards keep their files; a column of ``docs`` called shard or slot gives way to the new one. ``plan`` is the result of :func:`sharded_documents`.
    """
    moved = plan.filter(F.col("shard") != F.col("old_shard"))
    affected = moved.select(F.col("shard")).union(moved.select(F.col("old_shard"))).distinct()
    rows = docs.drop("shard", "slot").join(plan.join(F.broadcast(affected), "shard").select("doc_id", "shard", "slot"), "doc_id")
    (rows.repartition("shard", F.floor(F.col("slot") / SLOT_ROWS)).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").mode("overwrite").parquet(out_dir))
    return affected
