"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted lists, distance-weighted votes,
isotonic calibration, and the nearest examples as evidence."""
from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, learnable

EXAMPLES = 3000     # bound of the labelled sample, per class
TERMS = 500         # bound of the vocabulary
NEAREST = 25
BLOCK = 64          # examples of a block in the inverted lists
PRIOR = 0.5         # weight of the vote that stands for no neighbour
WORDS = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> Counter:
    """Lower-case words, and beginnings of four to six letters of longer ones (marked by a star)."""
    out: Counter = Counter()
    for w, n in Counter(WORDS.findall(text.lower())).items() if text else ():
        out[w] += n
        for k in (4, 5, 6):
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


def sample_of(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(text, y, doc_id): up to about ``per_class`` learnable documents of each class, picked by a hash of the id."""
    marked = labels.filter(F.col("toxic").isNotNull() & learnable()).select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    sizes = marked.groupBy("y").agg(F.count(F.lit(1)).alias("size"))
    pick = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) * F.col("size") < per_class * 1_000_000
    few = marked.join(F.broadcast(sizes), "y").filter(pick)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def train(docs: DataFrame, labels: DataFrame, per_class: int = EXAMPLES, n_terms: int = TERMS) -> dict:
    """Vocabulary, examples and calibration; everything that reaches the driver is bounded by the parameters."""
    sample = sample_of(docs, labels, per_class)

    def vectors(batches):
        for b in (x.slice(k, 200) for x in batches for k in range(0, len(x), 200)):  # a row for each term of few texts at a time
            rows = [(i, y, s, t, n) for i, y, s, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "size", "text")))
                    for t, n in terms_of(text).items()]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()))],
                                             ["doc_id", "y", "size", "term", "n"])

    sizes = {(r.y): (r.docs, r.size) for r in sample.groupBy("y").agg(
        F.count(F.lit(1)).alias("docs"), F.max("size").alias("size")).collect()}
    if set(sizes) != {0, 1}:
        return {"terms": {}, "base": 0.0 if 1 not in sizes else 1.0, "steps": None}
    from .common import written
    occurrences = written(sample.select(F.col("doc_id").cast("long"), "y", "size", "text").mapInArrow(
        vectors, "doc_id long, y int, size long, term string, n long"), "toxic-terms")
    n1, n0 = sizes[1][0], sizes[0][0]
    a, b = F.sum("y"), F.sum(1 - F.col("y"))
    need = max(3, math.ceil(0.01 * n1))
    chosen = (occurrences.groupBy("term").agg(a.alias("a"), b.alias("b"))
              .withColumn("odds", ((F.col("a") + 0.5) / n1) / ((F.col("b") + 0.5) / n0))
              .filter((F.col("a") >= need) & (F.col("odds") >= 8)).orderBy(F.desc("a"), "term").limit(n_terms))
    vocabulary = chosen.select("term", (F.col("a") + F.col("b")).alias("df"))
    rows = vocabulary.collect()
    idf = {r.term: math.log(1 + (n1 + n0) / r.df) for r in rows}
    index = {t: i for i, t in enumerate(sorted(idf))}
    hits = occurrences.join(F.broadcast(vocabulary), "term").select("doc_id", "y", "term", "n").collect()
    found: dict[tuple[int, int], dict[int, float]] = {}
    for r in sorted(hits):
        found.setdefault((r.doc_id, r.y), {})[index[r.term]] = (1 + math.log(r.n)) * idf[r.term]
    ids, ys = [k[0] for k in found], [k[1] for k in found]
    postings: list[list] = [[] for _ in index]
    for e, v in enumerate(found.values()):
        norm = math.sqrt(sum(x * x for x in v.values()))
        for t, x in v.items():
            postings[t].append((e, x / norm))
    n_blocks = -(-len(ids) // BLOCK)
    top = np.zeros((len(index), n_blocks))
    lists = []
    for t, p in enumerate(postings):
        e, x = np.array([q[0] for q in p], np.int64), np.array([q[1] for q in p])
        np.maximum.at(top[t], e // BLOCK, x)
        lists.append((e, x, np.searchsorted(e, np.arange(n_blocks + 1) * BLOCK)))
    scale = {1: sizes[1][1] / n1, 0: sizes[0][1] / n0}   # what one example stands for
    model = {"terms": {t: (i, idf[t]) for t, i in index.items()}, "lists": lists, "top": top, "ids": np.array(ids, np.int64),
             "y": np.array(ys, float), "weight": np.array([scale[y] for y in ys]),
             "base": 0.0, "steps": None}
    raw = [vote(dict(v), model, skip=e)[0] for e, v in enumerate(unit(found.values()))]
    silent = {y: sizes[y][0] - sum(1 for z in ys if z == y) for y in (0, 1)}
    points = [(r, y, scale[y]) for r, y in zip(raw, ys)]
    rest = silent[0] * scale[0] + silent[1] * scale[1]
    model["base"] = silent[1] * scale[1] / rest if rest else 0.0
    model["steps"] = isotonic(points)
    return model


def unit(vectors):
    for v in vectors:
        norm = math.sqrt(sum(x * x for x in v.values()))
        yield {t: x / norm for t, x in v.items()}


def isotonic(points: list[tuple[float, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (raw, label, weight): thresholds and calibrated values."""
    merged: dict[float, list[float]] = {}
    for r, y, w in points:
        m = merged.setdefault(round(r, 9), [0.0, 0.0])
        m[0] += w * y
        m[1] += w
    pools: list[list[float]] = []
    for r in sorted(merged):
        pools.append([r, *merged[r]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, s, w = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += w
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def vote(query: dict[int, float], model: dict, skip: int = -1, k: int = NEAREST) -> tuple[float, list[int]]:
    """Raw score and nearest examples of a unit vector. Blocks are visited by falling upper bound (sum of query weight times
    the block's largest weight) until no block can beat the k-th neighbour: the k nearest are exact."""
    bound = np.zeros(model["top"].shape[1])
    for t, x in query.items():
        bound += x * model["top"][t]
    best_s, best_e, kth = np.zeros(0), np.zeros(0, np.int64), 0.0
    for b in np.argsort(-bound, kind="stable"):
        if bound[b] <= 0 or (len(best_s) >= k and bound[b] < kth):
            break
        sims = np.zeros(BLOCK)
        for t, x in query.items():
            if model["top"][t, b]:
                e, w, at = model["lists"][t]
                lo, hi = at[b], at[b + 1]
                sims[e[lo:hi] - b * BLOCK] += x * w[lo:hi]
        if 0 <= skip - b * BLOCK < BLOCK:
            sims[skip - b * BLOCK] = 0
        some = np.flatnonzero(sims)
        best_s, best_e = np.concatenate((best_s, sims[some])), np.concatenate((best_e, some + b * BLOCK))
        if len(best_s) > k:
            order = np.lexsort((best_e, -best_s))[:k]
            best_s, best_e = best_s[order], best_e[order]
        kth = best_s.min() if len(best_s) >= k else 0.0
    if not len(best_s):
        return 0.0, []
    order = np.lexsort((best_e, -best_s))
    best_s, best_e = best_s[order], best_e[order]
    w = best_s * model["weight"][best_e]
    return float((w * model["y"][best_e]).sum() / (w.sum() + PRIOR)), best_e[:3].tolist()


def known_terms(text: str | None, terms: dict, cache: dict) -> dict[int, float]:
    """TF-IDF weights of the vocabulary terms in a text; ``cache`` remembers the terms of each word."""
    times: dict[str, int] = {}
    if text and terms:
        for w, n in Counter(WORDS.findall(text.lower())).items():
            of = cache.get(w)
            if of is None:
                of = tuple(t for t in terms_of(w) if t in terms)
                if len(cache) < 500_000:
                    cache[w] = of
            for t in of:
                times[t] = times.get(t, 0) + n
    return {terms[t][0]: (1 + math.log(n)) * terms[t][1] for t, n in times.items()}


def score_text(text: str | None, model: dict, cache: dict) -> tuple[float, list[int]]:
    """(calibrated score, example ids). A text without any term of the vocabulary has the rate of such examples."""
    found = known_terms(text, model["terms"], cache)
    if not found or model["steps"] is None:
        return float(model["base"]), []
    raw, near = vote(next(unit([found])), model)
    at, value = model["steps"]
    if not near or not len(at):
        return float(model["base"]), []
    return float(value[max(0, int(np.searchsorted(at, raw + 1e-9, "right")) - 1)]), [int(model["ids"][e]) for e in near]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row and its whole text; NULL and empty texts get the base rate."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        cache: dict = {}
        for b in batches:
            got = [score_text(t.as_py(), shared.value, cache) for t in b.column("text")]
            s = np.array([g[0] for g in got])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()),
                                              pa.array((s >= 0.5).astype(np.int32)), pa.array([g[1] for g in got], pa.list_(pa.int64()))],
                                             ["doc_id", "held_out", "score", "predicted", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        scored, f"doc_id {kind}, held_out boolean, score double, predicted int, evidence array<long>")


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text is not predicted toxic (all their columns)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches):
        cache: dict = {}
        for b in batches:
            ok = [score_text(t.as_py(), model.value, cache)[0] < 0.5 for t in b.column("text")]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
