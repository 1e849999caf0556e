"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised (lower case, words of letters and digits joined by one blank). An item of m characters may
differ from a stretch of a document by k = floor(m * budget) edits. It is cut into k + 1 pieces, one of which must survive
k edits unchanged; exact piece hits (one automaton over all pieces) give candidate places, and Myers' bit-parallel
distance decides them.
"""
from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name

BUDGET = 0.08
ITEMS_PER_BLOCK = 20_000     # benchmark items matched in one pass over the documents
LEAST = 12                   # shorter items (normalised characters) are matched whole and between word ends
WORDS = re.compile(r"\w+")


def normal(text: str | None) -> str:
    return " ".join(WORDS.findall(text.lower())) if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 disjoint pieces of nearly equal length that cover the item: (start, piece)."""
    n = len(item)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(item: str, masks: dict[str, int], text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the stretch of ``text`` nearest to ``item``, if within ``most`` edits: Myers' bit vectors, the
    item down the column, its start free in the text."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """Items ready to be searched for: the automaton of all pieces, the masks of each item."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        import ahocorasick
        self.items, where = {}, defaultdict(list)
        for key, text in items:
            s = normal(text)
            if not s:
                continue
            if len(s) < LEAST:
                where[f" {s} "].append((key, -1))
                self.items[key] = (s, 0, {})
                continue
            k = int(len(s) * budget)
            masks: dict[str, int] = {}
            for i, c in enumerate(s):
                masks[c] = masks.get(c, 0) | 1 << i
            self.items[key] = (s, k, masks)
            for start, p in pieces(s, k):
                where[p].append((key, start))
        self.automaton = ahocorasick.Automaton()
        for p, of in where.items():
            self.automaton.add_word(p, (len(p), of))
        self.automaton.make_automaton()
        self.any = bool(where)

    def hits(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalised text) of every item found in the whole text."""
        s = f" {normal(text)} "
        if not self.any or len(s) < 3:
            return []
        seen = defaultdict(set)
        for end, (length, of) in self.automaton.iter(s):
            for key, start in of:
                seen[key].add(end + 1 - length - start if start >= 0 else -1)
        out = []
        for key, starts in seen.items():
            item, k, masks = self.items[key]
            if not masks:
                out.append((key, 0, -1))
                continue
            found, windows = None, []
            for a in sorted(starts):
                lo, hi = max(0, a - k), a + len(item) + k
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], hi)
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                exact = s.find(item, lo, hi)
                got = (0, exact + len(item) - lo) if exact >= 0 else best_match(item, masks, s[lo:hi], k)
                if got and (found is None or got[0] < found[0]):
                    found = (got[0], lo + got[1])
            if found:
                out.append((key, *found))
        return sorted(out)


def item_blocks(benchmark: DataFrame, size: int):
    """The benchmark's items block by block (id, text), each block small enough for one automaton."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(
        F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    n = max(1, -(-rows.count() // size))
    for b in range(n):
        yield [(r.item_id, r.text) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def decontaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block: int = ITEMS_PER_BLOCK,
                   keep_columns: bool = False) -> DataFrame:
    """(doc_id, contaminated, items, distances) of every row; with ``keep_columns`` the clean rows with all their columns.

    NULL and empty texts are clean; NULL and wordless items match nothing; repeated rows are judged alike; several texts of
    one item id each count for it. Every block of items passes over all documents, without shuffling them.
    """
    sc = docs.sparkSession.sparkContext
    hit = "array<struct<item:bigint,distance:int>>"
    found = docs if keep_columns else docs.select("doc_id", "text")
    hits = free_name(found, "llm_hits")
    found = found.withColumn(hits, F.array().cast(hit))
    kind = found.schema
    for items in item_blocks(benchmark, block):
        shared = sc.broadcast(items)

        def search(batches, shared=shared):
            matcher = None
            for b in batches:
                matcher = matcher or Matcher([(i, t) for i, (_, t) in enumerate(shared.value)], budget)
                old = b.column(hits).to_pylist()
                new = [o + [{"item": shared.value[k][0], "distance": d} for k, d, _ in matcher.hits(t.as_py())]
                       for o, t in zip(old, b.column("text"))]
                at = b.schema.get_field_index(hits)
                yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

        found = found.mapInArrow(search, kind)
    if keep_columns:
        return found.filter(F.size(hits) == 0).select(*docs.columns)
    items = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["item"])))
    return found.select("doc_id", (F.size(hits) > 0).alias("contaminated"), items.alias("items"),
                        F.transform(items, lambda i: F.array_min(F.transform(F.filter(
                            hits, lambda h: h["item"] == i), lambda h: h["distance"]))).alias("distances"))
