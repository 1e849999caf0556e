"""Packing documents into token sequences: shortest-pack-first over the histogram of lengths.

A document's ids are cut into full sequences and a rest. Only the histogram of the rests (at most ``most`` numbers) reaches
the driver. There, lengths are placed longest first, each into the emptiest packs; packs of equal filling are one pattern
with a count, so a step places many rests at once. A rest that does not fit the emptiest pack is cut: its head fills the
pack, the tail returns to the histogram under its own length. The packs are opened beforehand: as many full ones as all
tokens need, and one for each power of two in what is left, so that nothing is padded. The patterns then meet the documents by
rank within their length.
"""
from __future__ import annotations

import heapq
import json
import re
import sys
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import written

MOST = 2048
END = 1                    # id after each document
PIECE = 200_000            # characters encoded in one call, where a text allows a cut
SOLID = 1_000              # a block of so many characters without a blank, or of blanks only, goes the exact way
RUN = 1_024                # full sequences of one document in one row
BREAK = re.compile("[A-Za-z] [A-Za-z]")


# ---- ids of a text ------------------------------------------------------------------------------
class Encoder:
    """Ids by a tokenizer file. A plain byte-level BPE is also loaded as ranks, whose encoder is about three times as fast
    and gives the same ids; texts that hold a special token or very long words go through the tokenizer itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.path = path
        self.special = [t["content"] for t in described.get("added_tokens") or []]
        self.fast = ranked(described)

    @cached_property
    def exact(self):
        """The tokenizer itself, loaded when a text needs it."""
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None or any(s in text for s in self.special):
            return self.exactly(text)
        return np.concatenate([self.exactly(p) if solid(p) else self.fast.encode_to_numpy(p, disallowed_special=())
                               for p in pieces(text)]).astype(np.uint32)

    def exactly(self, text: str) -> np.ndarray:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(text: str):
    """Parts of a long text, cut before a single blank between two letters, where a new word always begins."""
    at = 0
    while len(text) - at > PIECE:
        cut = BREAK.search(text, at + PIECE)
        if not cut:
            break
        yield text[at:cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


def solid(text: str) -> bool:
    """A run of 2 SOLID characters without a blank, or of blanks, covers one of these blocks."""
    return any(text.find(" ", i, i + SOLID) < 0 or text[i:i + SOLID].isspace() for i in range(0, len(text) - SOLID + 1, SOLID))


def ranked(described: dict):
    """A rank encoder of the same vocabulary; None if the file is anything but a plain byte-level BPE in merge order."""
    model, before = described["model"], described.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not described.get("normalizer") and before.get("type") == "ByteLevel"
             and before.get("use_regex", True) and not before.get("add_prefix_space")
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                "byte_fallback", "ignore_merges")))
    if not plain:
        return None
    vocabulary = model["vocab"]
    merged = [vocabulary["".join(m.split(" ")) if isinstance(m, str) else "".join(m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    # a printable byte stands for itself, the others for the characters from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in described.get("added_tokens") or []}
    import tiktoken
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"   # fixed: words of a byte-level BPE
    return tiktoken.Encoding("ranks", pat_str=pattern, special_tokens={}, mergeable_ranks={
        bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special})


def encoder(path: str | None) -> Encoder:
    """One encoder by file and Python worker, kept over tasks."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    kept = sys.modules["builtins"].__dict__.setdefault("_token_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


# ---- rows of full sequences and rests ----------------------------------------------------------------
def cut_rows(path: str | None, most: int, kind: str, end: int):
    """Documents -> (doc_id, doc_tokens, start, r, part, local, ids): full sequences (r = -1, ``local`` counts sequences) and
    a rest of r ids (``local`` counts rests of that length in the task)."""
    schema = f"doc_id {kind}, doc_tokens long, start long, r int, part int, local long, ids binary"

    def run(batches):
        from pyspark import TaskContext
        encode, part, seen = encoder(path).ids, TaskContext.get().partitionId(), {}

        def row(i, ids, lo, hi, r):
            at = seen.get(r, 0)
            seen[r] = at + ((hi - lo) // most if r < 0 else 1)
            return i, len(ids), lo, r, part, at, ids[lo:hi].tobytes()

        for b in batches:
            rows, size = [], 0
            for i, text in enumerate(b.column("text")):
                ids = np.append(encode(text.as_py()), np.uint32(end)).astype("<u4")
                full = len(ids) // most * most
                for lo in range(0, full, RUN * most):
                    rows.append(row(i, ids, lo, min(full, lo + RUN * most), -1))
                if full < len(ids):
                    rows.append(row(i, ids, full, len(ids), len(ids) - full))
                size += len(ids)
                if size > 1_000_000:
                    yield batch(b, rows)
                    rows, size = [], 0
            if rows:
                yield batch(b, rows)

    def batch(b, rows):
        of, *cols = zip(*rows)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of))] + [pa.array(c, k) for c, k in zip(cols, kinds)],
                                          ["doc_id", "doc_tokens", "start", "r", "part", "local", "ids"])

    return run, schema


# ---- patterns --------------------------------------------------------------------------------------
def patterns(histogram: dict[int, int], most: int = MOST) -> tuple[np.ndarray, int]:
    """Placements and the number of packs. A placement (length, start, size, rank, count, pack, offset) says: of the rests of
    this length with ranks rank .. rank + count - 1, the ids from ``start`` on, ``size`` many, go to the packs from ``pack`` on,
    one each, at this offset. Filling adds up exactly; each step ends a pattern or a run of equal rests."""
    tokens = sum(length * m for length, m in histogram.items())
    open_, packs = [], 0                                    # (-room, first pack, packs, offset): the emptiest first
    for size, m in [(most, tokens // most)] + [(1 << bit, 1) for bit in reversed(range(most.bit_length())) if tokens % most >> bit & 1]:
        if m:
            heapq.heappush(open_, (-size, packs, m, 0))
            packs += m
    runs: dict[int, list] = {length: [(length, 0, 0, m)] for length, m in histogram.items() if m}
    placed = []
    for length in range(max(runs, default=0), 0, -1):
        for origin, start, rank, left in runs.pop(length, ()):
            while left:
                room, first, m, offset = heapq.heappop(open_)
                k, size = min(m, left), min(length, -room)
                placed.append((origin, start, size, rank, k, first, offset))
                if m > k:
                    heapq.heappush(open_, (room, first + k, m - k, offset))
                if -room > size:
                    heapq.heappush(open_, (room + size, first, k, offset + size))
                if size < length:
                    runs.setdefault(length - size, []).append((origin, start + size, rank, k))
                rank, left = rank + k, left - k
    return np.array(sorted(placed), np.int64).reshape(-1, 7), packs


class Plan:
    """Looks up the pieces of a rest by length and rank."""

    def __init__(self, placed: np.ndarray):
        self.placed = placed
        ends = np.flatnonzero(np.append(np.any(placed[1:, :2] != placed[:-1, :2], axis=1), True)) + 1 if len(placed) else []
        self.at = {}
        lo = 0
        for hi in ends:
            # a length and start may hold pieces of several sizes: search among them by rank
            by_rank = placed[lo:hi][np.argsort(placed[lo:hi, 3], kind="stable")]
            self.at[tuple(placed[lo, :2].tolist())] = by_rank
            lo = hi

    def of(self, length: int, rank: int):
        start = 0
        while start < length:
            rows = self.at[length, start]
            _, _, size, first, _, pack, offset = rows[np.searchsorted(rows[:, 3], rank, "right") - 1].tolist()
            yield start, size, pack + rank - first, offset
            start += size


# ---- the operator -------------------------------------------------------------------------------------
def packed(docs: DataFrame, path: str | None = None, most: int = MOST, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece; ``ids`` are little-endian unsigned 32-bit.

    ``path`` is a tokenizer file (default: the 50k byte-level BPE of the installed public tokenizers), ``end`` the id after each
    document. NULL and empty texts hold that id only. Repeated rows and NULL ids are packed like any other row; an empty table
    gives an empty result. Other columns are not read. Sequence ids count from 0 without gaps.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    run, schema = cut_rows(path, most, kind, end)
    rows = written(docs.select("doc_id", "text").mapInArrow(run, schema), "token-rows")
    weight = F.when(F.col("r") < 0, F.floor(F.length("ids") / (4 * most))).otherwise(1)
    counts = written(rows.groupBy("r", "part").agg(F.sum(weight).cast("long").alias("m")), "length-counts")
    histogram = {r.r: r.m for r in counts.groupBy("r").agg(F.sum("m").alias("m")).collect()}   # at most ``most`` rows
    histogram.pop(-1, None)
    placed, packs = patterns(histogram, most)
    plan = spark.sparkContext.broadcast(Plan(placed))
    before = F.sum("m").over(Window.partitionBy("r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = written(counts.select("r", "part", F.coalesce(before, F.lit(0)).alias("base")), "length-bases")

    def placing(batches):
        for b in batches:
            of, cols = [], []
            for i, (start, r, local, base, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in ("start", "r", "local", "base", "ids")))):
                if r < 0:
                    found = ((k * most, most, packs + base + local + k, 0) for k in range(len(ids) // (4 * most)))
                else:
                    found = plan.value.of(r, base + local)
                for at, size, sequence, offset in found:
                    of.append(i)
                    cols.append((start + at, size, ids[4 * at:4 * (at + size)], sequence, offset))
            start, size, ids, sequence, offset = zip(*cols) if cols else ((),) * 5
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(at), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()),
                 b.column("doc_tokens").take(at), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return rows.join(bases, ["r", "part"]).select("doc_id", "doc_tokens", "start", "r", "local", "base", "ids").mapInArrow(
        placing, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, most: int = MOST, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): whole sequences, padded to ``most`` ids unless their length is a power of two."""
    parts = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    padding = F.lit(int(pad).to_bytes(4, "little"))
    missing = F.when(F.bit_count("n_tokens") > 1, most - F.col("n_tokens")).otherwise(0).cast("int")
    joined = F.aggregate("p", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return parts.select("sequence_id", "n_tokens", F.concat(joined, F.aggregate(
        F.array_repeat(padding, missing), F.lit(b""), lambda done, x: F.concat(done, x))).alias("ids"))


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
