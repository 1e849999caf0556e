"""Spelling variants of the words of a corpus, by reduced-alphabet generation.

Letters are hashed to a few symbols, so that a word becomes a short string over a small alphabet whose whole one-edit
neighbourhood can be written down. If two words differ by one edit, their reduced words are equal or differ by one edit too:
the neighbourhoods are joined with the reduced vocabulary and the pairs are verified on the original strings. An edit is
generated from one side only (a deletion from the longer word, a replacement towards the larger symbol), so each pair of words
meets at most once. Reduced words travel as 64-bit polynomial hashes, whose one-edit neighbours follow from prefix sums;
equal strings have equal hashes, so nothing is lost, and the verification drops what collides.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import M1, M2, mix, written

LEAST_LENGTH, LEAST_TIMES = 7, 2
DAMAGE = 31                 # one run in so many loses a letter
FACTOR = 10                 # a form is so many times as frequent as its variant
FLUSH = 200_000             # words a task counts before it passes them on
RUN = re.compile("[A-Za-zÀ-ÿ]{7,}")


def runs_of(text: str) -> Counter:
    """Maximal runs of letters long enough to become words, A-Z in lower case."""
    return Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))


def word_counts(batches):
    """(word, n): words of the task's documents, damaged as the rule asks, counted in parts."""
    held: Counter = Counter()
    for b in batches:
        for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            text = text.as_py()
            if not text:
                continue
            of_doc = zlib.crc32(f"{'' if i is None else i}:".encode())
            for run, n in runs_of(text).items():
                h = zlib.crc32(run.encode(), of_doc)
                if h % DAMAGE == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1:]
                    if len(run) < LEAST_LENGTH:
                        continue
                held[run] += n
            if len(held) > FLUSH:
                yield counted(held)
                held = Counter()
    yield counted(held)


def counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of words with at least LEAST_TIMES occurrences in all documents."""
    return (docs.select("doc_id", "text").mapInArrow(word_counts, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TIMES))


def symbols_for(words: int) -> int:
    """Size of the reduced alphabet: it grows slowly with the vocabulary, so that there are at least as many reduced words of the
    least length as words."""
    return max(4, int(np.ceil(max(words, 1) ** (1 / LEAST_LENGTH))))


def neighbourhoods(symbols: int, around: bool = True):
    """(word, n) -> (word, n, keys): the hash of the reduced word, then (``around``) those of its one-edit neighbours on its side."""
    def run(batches):
        for b in batches:
            lengths = pc.utf8_length(b.column("word")).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                same = b.filter(pa.array(lengths == length))
                step = max(1, 2_000_000 // (length * symbols))
                for lo in range(0, len(same), step):
                    part = same.slice(lo, step)
                    own, keys, at = edits(reduced(part.column("word").to_pylist(), symbols), symbols if around else 1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("word"), part.column("n"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys))]
                        if around else [part.column("word"), part.column("n"), pa.array(own)], ["word", "n", "keys" if around else "own"])
    return run


def reduced(words: list[str], symbols: int) -> np.ndarray:
    """Symbols 1 .. ``symbols`` of the code points of words of one length, a row each."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(words), -1)
    return mix(codes) % np.uint64(symbols) + np.uint64(1)


def edits(r: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of reduced words, and (flat, offsets) of the hashes of each one, its deletions and its replacements by larger
    symbols. The strings hashed for one word are distinct: of a run of equal symbols only the first is deleted."""
    m, n = r.shape
    sized = lambda h, length: mix(h + np.array([length], np.uint64) * M2)
    power = np.full(n, M1, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    none = np.zeros((m, 1), np.uint64)
    before = np.concatenate((none, np.cumsum(r * power, axis=1, dtype=np.uint64)), axis=1)
    # without symbol i, those behind it stand one place earlier
    earlier = np.concatenate((none, np.cumsum(r[:, 1:] * power[:-1], axis=1, dtype=np.uint64)), axis=1)
    whole = before[:, -1:]
    steps = np.arange(1, symbols, dtype=np.uint64)
    raised = whole[:, :, None] + power[None, :, None] * steps
    first = np.concatenate((np.ones((m, 1), bool), r[:, 1:] != r[:, :-1]), axis=1)
    allowed = r[:, :, None] + steps <= symbols
    own = sized(whole, n)
    keys = np.concatenate((own, sized(before[:, :-1] + earlier[:, -1:] - earlier, n - 1), sized(raised, n).reshape(m, -1)), axis=1)
    some = np.concatenate((np.ones((m, 1), bool), first, allowed.reshape(m, -1)), axis=1)
    at = np.concatenate(([0], np.cumsum(some.sum(axis=1))))
    return own[:, 0].view(np.int64), keys[some].view(np.int64), at


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): every pair of words that differ by one inserted, deleted or replaced code point, once."""
    symbols = symbols_for(words.count())
    left = words.mapInArrow(neighbourhoods(symbols), "word string, n long, keys array<long>").select(
        F.col("word").alias("a"), F.col("n").alias("na"), F.posexplode("keys").alias("at", "own")).select(
        "a", "na", "own", (F.col("at") == 0).alias("whole"))
    right = words.mapInArrow(neighbourhoods(symbols, around=False), "word string, n long, own long").select(
        F.col("word").alias("b"), F.col("n").alias("nb"), "own")
    # equal reduced words meet from both sides: one of them is enough
    return left.join(right, "own").filter(
        (~F.col("whole") | (F.col("a") < F.col("b")))
        & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last of the chain. A form is FACTOR times as frequent as its variant, so
    chains have at most 18 steps; each round doubles the steps taken."""
    chains = written(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = written(chains.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"),
                                                                   F.col("beyond").isNotNull().alias("moved")), "chains")
        chains = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return chains


def grouped(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents.

    NULL and empty texts have no words; a NULL doc_id is written as nothing where ids decide which run loses a letter.
    Repeated rows count as often as they occur; of equally frequent near words the smallest is the form. An empty table gives
    an empty result. Other columns are not read.
    """
    words = written(vocabulary(docs), "vocabulary")
    pairs = near_pairs(words)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.m") >= FACTOR * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n"))).alias("f"))
    known = written(known.select("word", "n", "n_near", "f.form", "f.form_n"), "variants")
    found = roots(known.filter("form is not null"))
    return known.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
