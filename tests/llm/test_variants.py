"""Spelling variants: reduced neighbourhoods against plain strings, the operator against brute force."""
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from matchlake.llm import variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    out, form = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = [n[w], len(others)]
    rows = []
    for w, (k, m) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, k, m, n[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def compared(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(parts)
    got = variants.grouped(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcÀÿ", min_size=1, max_size=7), min_size=2, max_size=2), st.integers(2, 5))
def test_neighbourhoods_meet(pair, symbols):
    found = []
    for w in pair:
        own, keys, at = variants.edits(variants.reduced([w], symbols), symbols)
        assert len(set(keys.tolist())) == len(keys) and at.tolist() == [0, len(keys)]
        found.append((own[0], set(keys.tolist())))
    (a, near_a), (b, near_b) = found
    if near(*pair):
        assert a in near_b or b in near_a
        assert a == b or (a in near_b) != (b in near_a)


def test_rows_of_one_length_do_not_mix():
    words = ["abcdefg", "gfedcba", "aaaaaaa"]
    own, keys, at = variants.edits(variants.reduced(words, 4), 4)
    for i, w in enumerate(words):
        one, single, _ = variants.edits(variants.reduced([w], 4), 4)
        assert own[i] == one[0] and keys[at[i]:at[i + 1]].tolist() == single.tolist()


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdeé"), rng.integers(7, 10))) for _ in range(25)]
    rows = []
    for i in range(120):
        words = []
        for w in rng.choice(base, 40, p=np.arange(25, 0, -1) / 325):
            if rng.random() < 0.1:
                k = rng.integers(len(w))
                w = w[:k] + rng.choice(["", "a", "xé", w[k].upper()]) + w[k + rng.integers(2):]
            words.append(w)
        rows.append((i, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    compared(spark, rows)


def test_chains_of_forms(spark):
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx"]
    texts = [(i, f"{chain[0]} " * 40 + f"{chain[1]} " * 2) for i in range(100)] + [(500 + i, f"{chain[2]} ") for i in range(18)] + [(700, f"{chain[3]} {chain[3]}")]
    compared(spark, texts)
    got = {r.word: r for r in variants.grouped(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[chain[2]].root == chain[0] and got[chain[2]].form == chain[1]


def test_odd_inputs(spark):
    long_word = "ab" * 4000
    compared(spark, [])
    compared(spark, [(1, None), (2, ""), (None, "Letters letters LETTERS lettres lettres"), (None, None)])
    compared(spark, [(3, f"{long_word} {long_word} {long_word}c {long_word}c {long_word[1:]}"), (3, f"{long_word[1:]}"), (4, "ÀÈÌÒÙÂÊ àèìòùâê ÀÈÌÒÙÂÊ àèìòùâê×÷")])
    compared(spark, [(5, "samples samples simples simples semples semples")] * 3)    # repeated rows, ties


def test_symbols_grow_slowly():
    assert [variants.symbols_for(n) for n in (0, 10, 10**6, 10**9)] == [4, 4, 8, 20]
