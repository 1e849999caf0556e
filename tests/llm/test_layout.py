"""Sharding and mixing: laws, exact quotas, awkward rows."""
import random
import zlib
from collections import Counter

import pytest

from matchlake.llm import mixing, sharding

DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, shard int, block long, skey string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 7, 7, 7, 7, "x") for i, t, s in rows], DDL)


def rows_of(n, seed=0):
    r = random.Random(seed)
    out = [(i, "w " * r.randint(1, 60), r.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(n)]
    return out + [(n, None, "a"), (n + 1, "", "b"), (None, "null id", "c"), (3, "w w w", "a"), (3, "w w w", "a"), (n + 2, "y " * 9000, "b")]


def test_shards_are_even_gapless_and_move_little(spark):
    rows = rows_of(4000) + [(10_000 + i, "same text in many rows " * 3, "a") for i in range(1500)]
    got = sharding.sharded_documents(docs(spark, rows), 5, 8).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    load, slots, moved, old = Counter(), {}, 0, Counter()
    for r in got:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        old[r.old_shard] += r.size
        moved += r.size * (r.shard != r.old_shard)
    total = sum(load.values())
    assert set(load) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.02 * total / 8
    least = sum(max(0, b - total // 8) for b in old.values())
    assert moved <= least + 0.02 * total


def test_min_cost_flow_is_optimal():
    cost = [[4, 1, 9], [2, 8, 3]]
    flow = sharding.min_cost_flow([5, 4], [3, 4, 4], lambda i, j: cost[i][j])
    best = min(sum(cost[i][j] * x for (i, j), x in f.items()) for f in (
        {(0, 0): a, (0, 1): b, (0, 2): 5 - a - b, (1, 0): c, (1, 1): d, (1, 2): 4 - c - d}
        for a in range(6) for b in range(6 - a) for c in range(5) for d in range(5 - c))
        if all(x >= 0 for x in f.values()) and f[0, 0] + f[1, 0] <= 3 and f[0, 1] + f[1, 1] <= 4 and f[0, 2] + f[1, 2] <= 4)
    assert sum(cost[i][j] * x for (i, j), x in flow.items()) == best
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [3], lambda i, j: 1)


def test_rewrites_only_affected_shards(spark, tmp_path):
    rows = [(i, f"text {i} " * 5, "a") for i in range(300)]
    d = docs(spark, rows)
    plan = sharding.sharded_documents(d, 3, 4)
    out = str(tmp_path / "shards")
    affected = {r[0] for r in sharding.rewrite_affected(d, plan, out).collect()}
    written = spark.read.parquet(out)
    assert {r.shard for r in written.select("shard").distinct().collect()} == affected & {r.shard for r in plan.collect()}
    want = {r.doc_id for r in plan.collect() if r.shard in affected}
    assert {r.doc_id for r in written.collect()} == want


def water(sizes):
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {k: mixing.WEIGHTS[i % 3] for i, k in enumerate(keys)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(keys)
    while open_:
        level = left / sum(weight[k] for k in open_)
        over = [k for k in open_ if weight[k] * level > 2 * sizes[k]]
        if not over:
            return target | {k: weight[k] * level for k in open_}
        for k in over:
            target[k] = 2.0 * sizes[k]
            left -= target[k]
            open_.remove(k)
    return target


def test_mix_meets_targets(spark):
    rows = rows_of(3000, 2)
    got = mixing.mix(docs(spark, rows)).collect()
    again = mixing.mix(docs(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    count = lambda t: len((t or "").split())
    source = {i: s for i, t, s in rows}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += count(t)
        largest[s] = max(largest[s], count(t))
    want = water(sizes)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size) and len(r.shards) == r.times
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_splitting_tree_has_exact_margins():
    counts, capacity = [70, 5, 0, 25], [13, 12, 25, 50]
    out = mixing.split_tree(counts, capacity, 9)
    assert out.sum(axis=0).tolist() == counts and out.sum(axis=1).tolist() == capacity and (out >= 0).all()


def test_mixed_rows_repeat_as_taken(spark):
    rows = rows_of(400, 3)
    d = docs(spark, rows)
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == d.columns
    times = Counter()
    for r in mixing.mix(d).collect():
        times[r.doc_id] += r.times
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in times.items() if v})


def test_mixed_rows_come_by_shard_in_their_shuffled_order(spark):
    d = docs(spark, [(i, f"{t} w{i}", s) for i, t, s in rows_of(400, 3)])
    want = sorted((c.shard, c.place, r.doc_id) for r in mixing.mix(d).collect() for c in r.copies)
    assert len({shard for shard, _, _ in want}) == mixing.SHARDS
    assert [r.doc_id for r in mixing.mixed_documents(d).collect()] == [i for _, _, i in want]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert sharding.sharded_documents(none).collect() == []
    assert mixing.mix(none).collect() == []
    assert mixing.mixed_documents(none).collect() == []


def test_stages_keep_columns_of_any_name(spark):
    from matchlake.llm import decontamination, mixing
    docs = spark.createDataFrame([(i, f"word{i} " * 9, "s", [i], "h", 1.5, "x") for i in range(20)],
                                 "doc_id long, text string, source string, llm_hits array<int>, mix_h string, mix_copies double, MIX_COPY string")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {(r.doc_id, r.mix_h, r.mix_copies, r.MIX_COPY) for r in mixed.collect()} <= {(i, "h", 1.5, "x") for i in range(20)}
    bench = spark.createDataFrame([(7, "word3 " * 9)], "item_id long, text string")
    clean = decontamination.decontaminated(docs, bench, keep_columns=True)
    assert clean.columns == docs.columns and sorted((r.doc_id, r.llm_hits) for r in clean.collect()) == [(i, [i]) for i in range(20) if i != 3]
