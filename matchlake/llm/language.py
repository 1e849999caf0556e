"""Language identification with word-first backoff: known words by per-language log frequency, unseen words by the
longest known character n-grams."""
from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from .common import held_out, learnable

DOCS_PER_LANGUAGE = 3000   # bound of the labelled sample
WORDS_PER_LANGUAGE = 20_000
GRAMS_PER_LANGUAGE = 20_000
LONGEST = 5
LETTERS = re.compile(r"[^\W\d_]+")
FLOOR = math.log(1e-9)


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


def count_words(batches):
    """Batches of (text, lang) -> (lang, word, count), summed within a batch."""
    for b in batches:
        by: dict[str, Counter] = {}
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            if text:
                by.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        rows = [(l, w, n) for l, c in by.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> dict:
    """Word and n-gram tables from at most about ``per_language`` learnable documents of each language, picked by a hash
    of the id. Their size is bounded by the parameters, so they may travel to every task."""
    known = docs.filter(learnable() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    pick = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) * F.col("size") < per_language * 1_000_000
    sample = known.join(F.broadcast(sizes), "lang").filter(pick).select("text", "lang")
    counts = sample.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = Window.partitionBy("lang")
    top = (counts.withColumn("total", F.sum("n").over(totals))
           .withColumn("r", F.row_number().over(totals.orderBy(F.desc("n"), "word"))).filter(F.col("r") <= WORDS_PER_LANGUAGE))
    rows = top.select("lang", "word", "n", "total").collect()
    langs = sorted({r.lang for r in rows})
    at = {l: i for i, l in enumerate(langs)}
    words: dict[str, list] = {}
    freq = [[Counter() for _ in langs] for _ in range(LONGEST + 1)]
    for r in rows:
        words.setdefault(r.word, [FLOOR] * len(langs))[at[r.lang]] = math.log(r.n / r.total)
        for n in range(1, LONGEST + 1):
            c = freq[n][at[r.lang]]
            for g in grams(r.word, n):
                c[g] += 1
    table: dict[str, list] = {}
    for n in range(1, LONGEST + 1):
        for i, c in enumerate(freq[n]):
            whole = sum(c.values())
            for g, k in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:GRAMS_PER_LANGUAGE]:
                table.setdefault(g, [FLOOR] * len(langs))[i] = math.log(k / whole)
    return {"langs": langs, "words": words, "grams": table}


def unseen(word: str, table: dict, n_langs: int) -> list:
    """Mean log frequency of the word's longest known n-grams; all zero when not even a letter is known."""
    for n in range(LONGEST, 0, -1):
        found = [table[g] for g in grams(word, n) if g in table and (n > 1 or g not in "<>")]
        if found:
            return [sum(v) / len(found) for v in zip(*found)]
    return [0.0] * n_langs


def predict_text(text: str | None, model: dict, cache: dict) -> tuple[str, float]:
    """(language, posterior) of a text; ('und', 0.0) without a letter or without a model."""
    seen = Counter(LETTERS.findall(text.lower())) if text else None
    if not seen or not model["langs"]:
        return "und", 0.0
    known, vectors, times = model["words"], [], []
    for w, k in seen.items():
        v = known.get(w) or cache.get(w)
        if v is None:
            v = unseen(w, model["grams"], len(model["langs"]))
            if len(cache) < 200_000:
                cache[w] = v
        vectors.append(v)
        times.append(k)
    score = np.array(times, float) @ np.array(vectors)
    best = int(score.argmax())
    return model["langs"][best], float(1.0 / np.exp(score - score[best]).sum())


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; whole texts, NULL or letterless ones are ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        cache: dict = {}
        for b in batches:
            got = [predict_text(t.as_py(), shared.value, cache) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
