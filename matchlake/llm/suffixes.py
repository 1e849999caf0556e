"""Suffix-array dedup of byte strings: every byte covered by a 200-byte string that also starts elsewhere is removed.

1. Each document is cut into segments: the windows (200-byte strings) that share their minimal 24-byte gram. Equal windows
   have equal grams, so a window can only repeat inside the set of segments of one gram. Segments with a gram of their own
   are done; segments that occur twice byte for byte repeat in every window (most copies end here, in the task or in one
   shuffle of segment hashes).
2. The remaining segments of a gram are contested. Their bytes go to shards (a gram of very many segments is dealt to
   several); a shard builds one suffix array over its bytes, by Larsson-Sadakane refinement in numpy up to 200 bytes, and
   Kasai's common prefixes in lanes; windows with a common prefix of 200 bytes repeat.
3. Shards of one gram are merged: each cuts its sorted window hashes at fixed splitters, and where the slices meet, windows
   are looked up in the other shards' lists by binary search.
4. The byte ranges of all three are merged per document.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, mix, utf8, written

WINDOW = 200
GRAM = 24
SHARD_SEGMENTS = 20_000     # contested segments of one gram in one shard
SHARD_BYTES = 2_000_000     # bytes of one suffix array (whole grams are added up to it)
STEP = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))


# ---- segments -------------------------------------------------------------------------------
def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on (the last GRAM - 1 positions are cut off)."""
    h = mix((data.astype(np.uint64) + np.uint64(1)) * STEP)
    size = 8
    for k in (1, 2, 4):
        h = h[:-k] * STEP + h[k:]
    h = mix(h)
    return mix(h[:-2 * size] * STEP * STEP + h[size:-size] * STEP + h[2 * size:])


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values (block-wise running minima from both sides)."""
    n = len(x)
    whole = -(-n // w) * w
    padded = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def segments(data: np.ndarray, at: np.ndarray, window: int = WINDOW):
    """(doc, start, count, gram, hash) of the segments of all documents; start counts from the document's first byte."""
    none = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    if len(data) < window:
        return none
    h = gram_hashes(data)
    bits = max(24, int(len(h)).bit_length())
    low = np.uint64((1 << bits) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    least = (sliding_min(key, window - GRAM + 1) & low).astype(np.int64)   # leftmost smallest gram of each window
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[:len(least)]
    inside = at[doc + 1] - np.arange(len(least)) >= window
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(new & inside)
    if not len(starts):
        return none
    ends = np.append(starts[1:], len(least))
    ends = np.minimum(ends, at[doc[starts] + 1] - window + 1)
    count = ends - starts
    n = len(data)
    power, back = powers(n, STEP), powers(n, INVERSE)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(7)) * power, out=sums[1:])
    value = mix((sums[ends + window - 1] - sums[starts]) * back[starts])
    return doc[starts], starts - at[doc[starts]], count, h[least[starts]], value


def cut(batches):
    """(dk, s, c, g, v, kind): segments of a batch. kind 0: one segment of each content, to be met with other batches;
    kind 1: a segment whose content occurs twice or more in this batch, so that all of it repeats."""
    for b in batches:
        keys = b.column("dk").to_numpy()
        data, at = utf8(b.column("text"))
        held = [[] for _ in range(5)]
        for i, j in chunks(at, 3_000_000):
            for to, part in zip(held, segments(data[at[i]:at[j]], at[i:j + 1] - at[i])):
                to.append(part + i if to is held[0] else part)
        if not held[0]:
            continue
        doc, s, c, g, v = (np.concatenate(x) for x in held)
        order = np.lexsort((c, v, g))
        doc, s, c, g, v = doc[order], s[order], c[order], g[order], v[order]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1]) | (c[1:] != c[:-1])
        size = np.diff(np.append(np.flatnonzero(first), len(g)))
        twice = np.repeat(size > 1, size)
        for kind, take in ((0, first), (1, twice)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[doc[take]]), pa.array(s[take]), pa.array(c[take].astype(np.int32)), pa.array(g[take].view(np.int64)),
                 pa.array(v[take].view(np.int64)), pa.array(np.full(int(take.sum()), kind, np.int32))], ["dk", "s", "c", "g", "v", "kind"])


SEGMENT = "dk long, s long, c int, g long, v long, kind int"


def meet(batches):
    """Segments of whole grams -> kind 1: content found in two batches; kind 2: contested (the gram has other contents),
    result wanted; kind 3: contested, known to repeat, needed as a partner only."""
    parts = [[b.column(c).to_numpy() for c in ("dk", "s", "c", "g", "v")] for b in batches]
    if not parts:
        return
    dk, s, c, g, v = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((c, v, g))
    dk, s, c, g, v = dk[order], s[order], c[order], g[order], v[order]
    gram = np.ones(len(g), bool)
    gram[1:] = g[1:] != g[:-1]
    first = gram.copy()
    first[1:] |= (v[1:] != v[:-1]) | (c[1:] != c[:-1])
    size = np.diff(np.append(np.flatnonzero(first), len(g)))
    twice = np.repeat(size > 1, size)
    contents = np.add.reduceat(first.astype(np.int64), np.flatnonzero(gram)) if len(g) else np.zeros(0, np.int64)
    several = np.repeat(contents > 1, np.diff(np.append(np.flatnonzero(gram), len(g))))
    for kind, take in ((1, twice), (2, several & ~twice), (3, several & twice & first)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(dk[take]), pa.array(s[take]), pa.array(c[take]), pa.array(g[take]), pa.array(v[take]),
             pa.array(np.full(int(take.sum()), kind, np.int32))], ["dk", "s", "c", "g", "v", "kind"])


# ---- suffix arrays --------------------------------------------------------------------------
def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes in order (the end counts as smaller): groups of equal beginnings are refined by the rank of the suffix that
    starts where the compared bytes end, which doubles them; only groups of several suffixes are sorted again."""
    n = len(data)
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)))
    rank = np.zeros(n, np.uint64)
    for k in range(7):                       # seven 9-bit digits: the end of the text is a digit of its own
        rank = (rank << np.uint64(9)) | padded[k:k + n]
    sa = np.argsort(rank, kind="stable")
    head = np.ones(n, bool)
    head[1:] = rank[sa[1:]] != rank[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.flatnonzero(head)[np.cumsum(head) - 1]
    done = 7
    while True:
        group = np.diff(np.append(np.flatnonzero(head), n))
        slots = np.flatnonzero(np.repeat(group > 1, group))
        if not len(slots):
            break
        open_ = sa[slots]
        beyond = open_ + done
        later = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = (rank[open_] << 31) | later
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        sa[slots] = open_
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        head[slots] = new
        rank[open_] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        done *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, depth: int = WINDOW, lanes_of: int = 64) -> np.ndarray:
    """Length (at most ``depth``) of the prefix each suffix of the array shares with the one before it: Kasai's rule - a
    position's value is at least its left neighbour's less one - followed in many lanes of the text at once."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    text = np.concatenate((data, np.zeros(1, np.uint8)))
    out = np.zeros(n, np.int64)
    lane = np.arange(0, n, lanes_of)
    length = np.zeros(len(lane), np.int64)
    for k in range(lanes_of):
        at = lane + k
        live = at < n
        at, length = at[live], np.maximum(length[live] - 1, 0)
        lane = lane[live]
        other = before[at]
        length[other < 0] = 0
        run = np.flatnonzero((other >= 0) & (length < depth))
        while len(run):
            x, y = at[run] + length[run], other[run] + length[run]
            same = (x < n) & (y < n) & (text[np.minimum(x, n)] == text[np.minimum(y, n)])
            run = run[same]
            length[run] += 1
            run = run[length[run] < depth]
        out[at] = length
    result = np.zeros(n, np.int64)
    result[:] = out[sa]
    return result


def repeats(blobs: list[bytes], counts: np.ndarray, window: int = WINDOW):
    """For the concatenated segments: (segment, offset, group, repeated) of every window."""
    data = np.frombuffer(b"".join(blobs), np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(x) for x in blobs])))[:-1]
    sa = suffix_array(data)
    joined = common_prefixes(data, sa, window) >= window
    group = np.empty(len(data), np.int64)
    group[sa] = np.cumsum(~joined)
    seg = np.repeat(np.arange(len(blobs)), counts)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
    own = group[begin[seg] + offset]
    times = np.bincount(own)
    return data, seg, offset, begin[seg] + offset, own, times[own] > 1


def runs(mask: np.ndarray, seg: np.ndarray):
    """Maximal runs of true values inside a segment: first and last index."""
    edge = np.ones(len(mask), bool)
    edge[1:] = (seg[1:] != seg[:-1])
    first = np.flatnonzero(mask & (edge | ~np.append(False, mask[:-1])))
    last = np.flatnonzero(mask & (np.append(edge[1:], True) | ~np.append(mask[1:], False)))
    return first, last


def settle(batches):
    """Contested segments (g, shard, shards, dk, s, c, kind, bytes), whole shards together, sorted -> byte ranges
    (dk, s, e), and windows of divided grams (g, slice, shard, wh, dk, s): one per content and shard."""
    def solve(rows):
        blobs = [r[7] for r in rows]
        counts = np.array([r[5] for r in rows], np.int64)
        data, seg, offset, at, own, twice = repeats(blobs, counts)
        dk, s = np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
        wanted = np.array([r[6] == 2 for r in rows])
        first, last = runs(twice & wanted[seg], seg)
        plain = pa.nulls(len(first), pa.int64())
        out = [[pa.array(dk[seg[first]]), pa.array(s[seg[first]] + offset[first]),
                pa.array(s[seg[first]] + offset[last] + WINDOW), plain, plain, plain, plain]]
        parts = np.array([r[2] for r in rows], np.int64)
        if (parts > 1).any():
            again = parts[seg] > 1
            pick = np.flatnonzero(again)
            hashes = np.array([int.from_bytes(hashlib.blake2b(data[p:p + WINDOW].tobytes(), digest_size=8).digest(), "little", signed=True)
                               for p in at[pick]], np.int64)
            g = np.array([r[0] for r in rows], np.int64)
            shard = np.array([r[1] for r in rows], np.int64)
            ask = wanted[seg[pick]] & ~twice[pick]
            _, keep = np.unique(np.stack((g[seg[pick]], hashes, ask.astype(np.int64)), axis=1), axis=0, return_index=True)
            pick, hashes = pick[keep], hashes[keep]
            # fixed splitters cut the sorted hashes into as many slices as the gram has shards
            cutter = (hashes.view(np.uint64) ^ np.uint64(1 << 63)).astype(np.float64) / 2.0 ** 64
            slices = np.minimum((cutter * parts[seg[pick]]).astype(np.int64), parts[seg[pick]] - 1)
            minus = np.where(ask[keep], s[seg[pick]] + offset[pick], -1)
            out.append([pa.array(x) for x in (dk[seg[pick]], minus, minus + WINDOW, g[seg[pick]], slices, shard[seg[pick]], hashes)])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out)], ["dk", "s", "e", "g", "slice", "shard", "wh"])

    held, size, key = [], 0, None
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("g", "shard", "shards", "dk", "s", "c", "kind", "bytes"))):
            if held and r[:2] != key and size >= SHARD_BYTES:
                yield solve(held)
                held, size = [], 0
            held.append(r)
            size += len(r[7])
            key = r[:2]
    if held:
        yield solve(held)


SETTLED = "dk long, s long, e long, g long, slice long, shard long, wh long"


def merge_shards(batches):
    """Slices of window hashes of divided grams, sorted by (g, slice, shard, wh): each shard's list is looked up in the others'."""
    def solve(cols):
        dk, s, e, shard, wh = cols
        found = np.zeros(len(wh), bool)
        lists = {k: np.sort(wh[shard == k]) for k in np.unique(shard)}
        for k in lists:
            mine = np.flatnonzero((shard == k) & (s >= 0))
            for j, other in lists.items():
                if j != k and len(mine):
                    at = np.minimum(np.searchsorted(other, wh[mine]), len(other) - 1)
                    found[mine] |= other[at] == wh[mine]
        return pa.RecordBatch.from_arrays([pa.array(dk[found]), pa.array(s[found]), pa.array(e[found])], ["dk", "s", "e"])

    names = ("g", "slice", "dk", "s", "e", "shard", "wh")
    held = None
    for b in batches:
        cols = [b.column(c).to_numpy() for c in names]
        cols = cols if held is None else [np.concatenate((a, c)) for a, c in zip(held, cols)]
        if not len(cols[0]):
            continue
        cuts = np.flatnonzero(np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
        for lo, hi in zip(cuts, cuts[1:]):
            yield solve([c[lo:hi] for c in cols[2:]])
        held = [c[cuts[-1]:] for c in cols]
    if held is not None:
        yield solve(held[2:])


# ---- documents ------------------------------------------------------------------------------
def fetch(batches):
    """Documents with their contested segments -> the segments' bytes."""
    for b in batches:
        data, at = utf8(b.column("text"))
        raw = data.tobytes()
        rows = [(x["g"], x["shard"], x["shards"], dk, x["s"], x["c"], x["kind"], raw[at[i] + x["s"]:at[i] + x["s"] + x["c"] + WINDOW - 1])
                for i, (dk, many) in enumerate(zip(b.column("dk").to_pylist(), b.column("parts").to_pylist())) for x in many]
        cols = list(zip(*rows)) or [[]] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         ["g", "shard", "shards", "dk", "s", "c", "kind", "bytes"])


def covered(ranges: list[dict]) -> list[list[int]]:
    """Union of byte ranges; ranges that touch are one run."""
    out: list[list[int]] = []
    for s, e in sorted((r["s"], r["e"]) for r in ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def remove(batches):
    for b in batches:
        data, at = utf8(b.column("text"))
        raw = data.tobytes()
        rows = []
        for i, ranges in enumerate(b.column("ranges").to_pylist()):
            text, spans, pos, kept = raw[at[i]:at[i + 1]], covered(ranges or []), 0, []
            for s, e in spans:
                kept.append(text[pos:s])
                pos = e
            kept.append(text[pos:])
            rows.append((len(text), sum(e - s for s, e in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), spans))
        cols = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(c, k) for c, k in zip(cols, kinds)],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """rows(dk, text) -> (dk, s, e): byte ranges covered by windows that also start elsewhere."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = written(rows.mapInArrow(cut, SEGMENT), "segments")
    met = written(cuts.filter("kind = 0").drop("kind").repartition(n, "g").mapInArrow(meet, SEGMENT), "segments-met")
    whole = cuts.filter("kind = 1").unionByName(met.filter("kind = 1")).select("dk", "s", (F.col("s") + F.col("c") + (WINDOW - 1)).alias("e"))
    contested = met.filter("kind > 1")
    sizes = contested.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / SHARD_SEGMENTS).cast("long").alias("shards"))
    asked = (contested.join(sizes, "g").withColumn("shard", F.pmod(F.xxhash64("dk", "s"), F.col("shards")))
             .groupBy("dk").agg(F.collect_list(F.struct("g", "shard", "shards", "s", "c", "kind")).alias("parts")))
    settled = written(rows.join(asked, "dk").mapInArrow(fetch, "g long, shard long, shards long, dk long, s long, c int, kind int, bytes binary")
                      .repartition(n, "g", "shard").sortWithinPartitions("g", "shard").mapInArrow(settle, SETTLED), "settled")
    inside = settled.filter("g is null").select("dk", "s", "e")
    across = (settled.filter("g is not null").repartition(n, "g", "slice").sortWithinPartitions("g", "slice")
              .mapInArrow(merge_shards, "dk long, s long, e long"))
    return whole.unionByName(inside).unionByName(across)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row.

    NULL text is empty; texts under 200 bytes have nothing removed; repeated rows are separate documents (so they remove each
    other) with equal results; a NULL doc_id is kept; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text).withColumn("dk", F.xxhash64("doc_id", "text"))
    long_rows = rows.filter(F.octet_length("text") >= WINDOW).select("dk", "text")
    ranges = repeated_ranges(long_rows).groupBy("dk").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(ranges, "dk", "left").select("doc_id", "text", "ranges").mapInArrow(
        remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
