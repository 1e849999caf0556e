"""Suffix-array dedup and n-gram Jaccard join against brute force, with the awkward inputs."""
import collections
import hashlib
import os
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from matchlake.llm import jaccard, suffixes

WIDE = "doc_id long, text string, lang string, source string, n_chars long, size long, sid long, h long, comp long, dk long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1, 2, 3, 4, 5, 6) for i, t in rows], WIDE)


def brute_bytes(rows, w=200):
    seen = collections.Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[k:k + w] for k in range(len(b) - w + 1))
    out = []
    for i, b in data:
        hit = bytearray(len(b))
        for k in range(len(b) - w + 1):
            if seen[b[k:k + w]] > 1:
                hit[k:k + w] = b"\1" * w
        kept = bytes(x for x, m in zip(b, hit) if not m)
        out.append((i, len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_sets(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def sample_rows(seed, n=160):
    r = random.Random(seed)
    words = ["w%d" % k for k in range(400)] + ["größe", "año", "Élan"]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, long_one = text(70), text(3000)
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE two"), (None, text(90)), (1005, "ab" * 900),
            (1006, "x" * 199), (1007, "x" * 200), (1008, "x" * 201), (1009, long_one), (1010, long_one[:9000] + text(200))]
    base = [text(r.randint(5, 160)) for _ in range(12)]
    for k in range(n):
        t = r.choice(base).split(" ")
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice(words)
        if r.random() < 0.3:
            t.insert(r.randrange(len(t)), passage)
        rows.append((k, " ".join(t)))
    rows += [rows[20], rows[20], (2000, rows[30][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_equal_brute_force(spark, seed):
    rows = sample_rows(seed)
    got = suffixes.deduplicated(docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute_bytes(rows)


def test_divided_grams_are_merged(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_SEGMENTS", 3)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 2_000)
    rows = sample_rows(3)
    got = suffixes.deduplicated(docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute_bytes(rows)


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(5)
    for n in (1, 2, 77, 2500):
        d = r.integers(97, 99, n).astype(np.uint8)
        if n > 1000:
            d[1500:1900], d[2000:2400] = d[100:500], 97
        b, sa = d.tobytes(), suffixes.suffix_array(d)
        assert list(sa) == sorted(range(n), key=lambda i: b[i:])
        lcp = suffixes.common_prefixes(d, sa)
        assert all(lcp[j] == min(200, len(os.path.commonprefix([b[sa[j]:], b[sa[j - 1]:]]))) for j in range(1, n))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = sample_rows(seed)
    assert sorted(map(tuple, jaccard.grouped(docs(spark, rows)).collect()), key=str) == brute_sets(rows)


def test_components_with_frequent_shingles_and_small_blocks(spark, monkeypatch):
    for name, value in (("FREQUENT", 2), ("LOCAL", 2), ("BLOCK", 3), ("PIECE", 4)):
        monkeypatch.setattr(jaccard, name, value)
    rows = sample_rows(4)
    assert sorted(map(tuple, jaccard.grouped(docs(spark, rows)).collect()), key=str) == brute_sets(rows)


def test_components_with_long_lists_and_held_back_pairs(spark, monkeypatch):
    for name, value in (("SHORT", 2), ("HELD", 5), ("ROUNDS", (1, 2, None)), ("TURNS", 1), ("BLOCK", 4), ("FEW_IDS", 3)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    rows = sample_rows(5) + near_copies(120)
    assert sorted(map(tuple, jaccard.grouped(docs(spark, rows)).collect()), key=str) == brute_sets(rows)


def near_copies(n):
    """Copies of one text, each with some words replaced and some with the end cut off."""
    r = random.Random(8)
    base = ["v%d" % r.randrange(3000) for _ in range(80)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(r.randint(0, 5)):
            t[r.randrange(80)] = "x%d" % r.randrange(10 ** 6)
        rows.append((5000 + i, " ".join(t[:80 - r.choice((0, 0, 0, 4, 8, 12))])))
    return rows


def test_pairs_of_near_copies_grow_with_the_group(spark, monkeypatch):
    counts = []
    cut = jaccard.written
    listed = lambda df, name: (lambda out: (name == "cross-pairs" and counts.append(out.count()), out)[1])(cut(df, name))
    monkeypatch.setattr(jaccard, "written", listed)
    rows = near_copies(600)
    assert sorted(map(tuple, jaccard.grouped(docs(spark, rows)).collect()), key=str) == brute_sets(rows)
    assert sum(counts) < 4 * len(rows)


def test_votes_for_leaders_do_not_grow_with_lists_or_tasks(spark, monkeypatch):
    made, stars = spark.sparkContext.accumulator(0), jaccard.stars

    def counted(turn):
        run = stars(turn)

        def counting(batches):
            for b in run(batches):
                made.add(b.num_rows)
                yield b
        return counting

    monkeypatch.setattr(jaccard, "stars", counted)
    r = random.Random(11)
    shingles = [r.randrange(-2 ** 63, 2 ** 63) for _ in range(80)]
    known = [(sid, 240, 61, r.sample(shingles, 61), sid) for sid in range(1, 201)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        pairs = jaccard.star_pairs(spark.createDataFrame(known, "sid long, n int, k int, hs array<long>, comp long"), 0).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 0 < made.value <= 8 * len(known)
    assert len({p.b for p in pairs}) == len(pairs) >= len(known) - 1 and all(p.a != p.b for p in pairs)


def test_postings_are_dealt_by_shingle_once_a_turn(spark, monkeypatch):
    plans, cut = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), cut(df, name))[1])
    rows = sample_rows(7) + long_texts()
    assert sorted(map(tuple, jaccard.grouped(docs(spark, rows)).collect()), key=str) == brute_sets(rows)
    dealt = {name: len(re.findall(r"Exchange hashpartitioning\(h#", plan)) for name, plan in plans.items()}
    assert dealt["star-pairs"] == dealt["crossing"] == 1 and dealt["cross-pairs"] == 0


def long_texts():
    """Chains of texts of about as many words as sets that carry no parities have, linked and not quite linked."""
    r, rows = random.Random(9), []
    for k, words in enumerate((500, 620, 645, 800, 1000)):
        base = ["l%d" % r.randrange(10 ** 6) for _ in range(words)]
        for i, changes in enumerate((0, words // 40, words // 36, words // 30, words // 20)):
            t = list(base[:words - 25 * i])
            for at in r.sample(range(len(t)), changes):
                t[at] = "y%d" % r.randrange(10 ** 6)
            rows.append((8000 + 10 * k + i, " ".join(t)))
    return rows


def test_memory_of_making_sets_does_not_follow_the_batch():
    r = np.random.default_rng(4)
    words = np.array(["w%d" % i for i in range(5000)])
    texts = [" ".join(words[r.integers(0, 5000, 400)]) for _ in range(1600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1600)), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        list(jaccard.describe([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, texts)) > 3_000_000 and peak < 80e6


def test_hash_cells_never_exceed_the_difference():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 400, r.integers(0, 300)).astype(np.uint64)) for _ in range(40)]
    at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    marks = jaccard.parities(np.concatenate(sets), at)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            cells = sum((int(m[i] ^ m[j]) & (1 << 64) - 1).bit_count() for m in marks)
            assert cells <= len(np.setxor1d(x, y)) and (i != j or cells == 0)


def test_one_of_each_keeps_columns_and_lone_rows(spark):
    rows = sample_rows(6)
    kept = jaccard.one_of_each(docs(spark, rows))
    groups = {g for _, _, g in brute_sets(rows)}
    assert kept.columns == docs(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == groups


def test_empty_tables(spark):
    none = docs(spark, [])
    assert suffixes.deduplicated(none).collect() == []
    assert jaccard.grouped(none).collect() == []
    assert jaccard.one_of_each(none).collect() == []
