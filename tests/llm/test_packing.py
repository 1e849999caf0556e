"""Packing: ids against the tokenizer, the plan's laws, pieces put together again."""
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from matchlake.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    return packing.Encoder(PATH)


def same(encode, text):
    assert encode.ids(text).tolist() == encode.exact.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab 'stE1.\n\t é漢", max_size=60))
def test_ids_of_any_text(encode, text):
    same(encode, text)


def test_ids_of_special_and_long_texts(encode, monkeypatch):
    assert encode.fast is not None and encode.ids(None).tolist() == []
    for text in ("a <|endoftext|> b", "x" * 5000, " " * 5000, "word " * 2000, "é" * 3000 + " a", "\n" * 2500):
        same(encode, text)
    monkeypatch.setattr(packing, "PIECE", 50)
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice(["don't ", "a b", "  ", "word", " É", "\n", "12 ", "...", " x"]) for _ in range(200))
        assert "".join(packing.pieces(text)) == text
        same(encode, text)


def test_ids_of_every_vocabulary_entry(encode):
    words = [w for i in range(50256) if "�" not in (w := encode.exact.decode([i]))]
    for lo in range(0, len(words), 1000):
        exact = [e.ids for e in encode.exact.encode_batch(words[lo:lo + 1000], add_special_tokens=False)]
        assert [encode.fast.encode_ordinary(w) for w in words[lo:lo + 1000]] == exact


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(0, 40), max_size=12))
def test_plan_fills_every_pack(histogram):
    placed, packs = packing.patterns(histogram, 32)
    filled = {}
    plan = packing.Plan(placed)
    for length, m in histogram.items():
        for rank in range(m):
            parts = list(plan.of(length, rank))
            assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts[:-1]]).tolist() and sum(p[1] for p in parts) == length
            for _, size, pack, offset in parts:
                filled.setdefault(pack, []).append((offset, size))
    assert sorted(filled) == list(range(packs))
    for spans in filled.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:]))
        assert (total := sum(spans[-1])) <= 32 and total & (total - 1) == 0
    assert sum(sum(s[-1]) == 32 for s in filled.values()) == sum(k * m for k, m in histogram.items()) // 32


def test_plan_size_does_not_follow_the_counts():
    rng = np.random.default_rng(1)
    small = {n: int(rng.integers(1, 100)) for n in range(1, 2048)}
    assert len(packing.patterns({n: m * 10**9 for n, m in small.items()})[0]) < 2 * len(packing.patterns(small)[0]) + 1000


def laws(spark, rows, most, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, part int").repartition(parts)
    pieces = packing.packed(df, PATH, most)
    got = pieces.collect()
    exact = packing.Encoder(PATH).exact
    docs = [(i, exact.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    assert sum(r.length for r in got) == sum(len(d) for _, d in docs)
    by_sequence = {}
    for r in got:
        assert len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    lengths = []
    for rs in by_sequence.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == np.cumsum([0] + [r.length for r in rs[:-1]]).tolist()
        lengths.append(sum(r.length for r in rs))
    assert all(n <= most and n & (n - 1) == 0 for n in lengths)
    # every document's ids are there, once for each of its rows
    want, have = {}, {}
    for i, ids in docs:
        for k, x in enumerate(ids):
            want[i, len(ids), k, x] = want.get((i, len(ids), k, x), 0) + 1
    for r in got:
        for k, x in enumerate(np.frombuffer(r.ids, "<u4").tolist()):
            key = (r.doc_id, r.doc_tokens, r.start + k, x)
            have[key] = have.get(key, 0) + 1
    assert have == want
    for s in packing.sequences(pieces, most, 7).collect():
        ids = np.frombuffer(s.ids, "<u4")
        assert len(ids) in (most, s.n_tokens)
    digests = {(r.sequence_id, r.offset): r.ids_crc32 for r in packing.digests(pieces).collect()}
    assert all(digests[r.sequence_id, r.offset] == zlib.crc32(r.ids) for r in got)


def test_pieces_make_up_the_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "é"]) for _ in range(rng.choice([1, 5, 20, 300])))) for i in range(60)]
    laws(spark, rows + rows[:9] + [(100, None), (101, ""), (None, "lost"), (None, None)], 64)
    laws(spark, [(i, "the same text " * 9) for i in range(50)], 64, parts=7)
    laws(spark, [(1, "word " * 3000)], 32)
    laws(spark, [], 64)
