"""Exact n-gram Jaccard join with set-relation skipping, and the groups of documents it links.

Word shingles become 64-bit hashes; a document is its sorted set of them, and equal sets are one class from the start.
Candidates come from prefix lists: under one global order of shingles (rare before frequent, then by hash) two sets with
Jaccard of 3/4 share one of their first n - ceil(3n/4) + 1 shingles. Two relations keep the lists from turning into pairs:

* within a list, sets are sorted by size and cut into blocks; a block whose size and position bound cannot reach the
  threshold with the probing set is skipped whole;
* for a few turns each set is compared with one leader (the set that leads most of a few of its lists, drawn by hash so that
  near copies draw mostly the same; a list is led by a set that shares much of its prefix, the middle of a group of near
  copies). Sets linked to a leader are one component, so their pairs need no look; for the others the first leader's computed
  distance d decides by the triangle inequality:
  |d(x, leader) - d(y, leader)| > 1/4 rules a pair out.

Each set also carries the parities of its shingles in 256 hash cells. Two sets differ in at least as many shingles as cells,
which rules out most pairs of a group of near copies that lie a little too far apart.

Only pairs of different components that survive both are compared. One link joins two components, so a list first gives the
closest pairs of every two components, and what these join is not looked at again; the last round holds every pair still
open, which finds every component exactly.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, mix, shingle_sets, utf8, written
from .components import components

THRESHOLD = 75          # per cent
LOCAL = 4               # a shingle in so many different sets of one chunk of a task is reported ...
FREQUENT = 64           # ... and is frequent if the reports add up to this much
MOST_FREQUENT = 1 << 20  # bound of the table of frequent shingles that every task receives
SHORT = 32              # sets of lists that are paired many lists at once
BLOCK = 128             # sets of a block in a list
CLASSES = 8             # of sets by the share of their prefix that others have; a list's leader is of its highest class
VOTES = 8               # lists by which a set finds its leader in a turn
TURNS = 2               # rounds of comparisons with leaders before pairs are listed
ROUNDS = (2, None)      # pairs that a list gives of every two components, round by round; the last round gives all
MARKS = ("m0", "m1", "m2", "m3")  # 256 parity bits of a set
HELD = 200_000          # pairs of a list that are held before the closest are chosen
PIECE = 2048            # sets compared with one leader in one task
FEW_IDS = 1_000_000     # ids (of documents, sets or lists) that may be broadcast with a label
MARKED = 640            # sets of so many shingles carry no parities: linked ones may differ in more cells than any two do
PART = 1_000_000        # bytes of text whose shingles are made at once; some fifty times as much memory


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - (THRESHOLD * n + 99) // 100 + 1, 0)


def set_ids(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit id of each set from its members (0 for the empty set)."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0xA0761D6478BD642F)))))
    n = np.diff(at)
    return np.where(n > 0, mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64)), np.uint64(0)).view(np.int64)


def sets_of(batch: pa.RecordBatch, most: int = PART):
    """(first row, last row, hashes, offsets, n, set ids) for parts of a batch."""
    data, at = utf8(batch.column("text"))
    for i, j in chunks(at, most):
        hashes, ends = shingle_sets(data[at[i]:at[j]], at[i:j + 1] - at[i])
        yield i, j, hashes, ends, np.diff(ends), set_ids(hashes, ends)


def parities(hashes: np.ndarray, at: np.ndarray) -> list:
    """For each set 256 bits in four columns: whether an odd number of its members falls into the cell."""
    cell = mix(hashes ^ np.uint64(0xE7037ED1A0B428DB))
    bit = np.uint64(1) << (cell & np.uint64(63))
    some = np.flatnonzero(np.diff(at))
    out = []
    for k in range(len(MARKS)):
        word = np.zeros(len(at) - 1, np.uint64)
        if len(some):
            word[some] = np.bitwise_xor.reduceat(np.where((cell >> np.uint64(6)) % np.uint64(len(MARKS)) == k, bit, np.uint64(0)), at[some])
        out.append(word.view(np.int64))
    return out


def describe(batches):
    """(doc_id, n, sid, parities): one row per document."""
    for b in batches:
        cols = [np.zeros(len(b), np.int64) for _ in range(2 + len(MARKS))]
        for i, j, hashes, ends, size, ids in sets_of(b):
            for c, part in zip(cols, (size, ids, *parities(hashes, ends))):
                c[i:j] = part
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, cols)], ["doc_id", "n", "sid", *MARKS])


def report(batches):
    """(h, times): shingles of at least LOCAL different sets of a part of the task."""
    for b in batches:
        seen: set = set()
        held = [hashes[np.repeat(fresh(ids, seen), n)] for _, _, hashes, ends, n, ids in sets_of(b)]
        held = np.concatenate(held) if held else np.zeros(0, np.uint64)
        held.sort()
        at = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1], [True]))) if len(held) else np.zeros(1, np.int64)
        found, times = held[at[:-1]], np.diff(at)
        often = times >= LOCAL
        yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(times[often].astype(np.int64))], ["h", "times"])


def fresh(ids: np.ndarray, seen: set) -> np.ndarray:
    out = np.zeros(len(ids), bool)
    for k, s in enumerate(ids.tolist()):
        if s and s not in seen:
            seen.add(s)
            out[k] = True
    return out


def postings_of(frequent: np.ndarray):
    """Batches of documents -> (h, sid, n, pos) of every prefix shingle, each set once per batch."""
    def run(batches):
        for b in batches:
            seen: set = set()
            for _, _, hashes, ends, n, ids in sets_of(b):
                keep = fresh(ids, seen)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
                    late = frequent[at] == hashes
                    for d in np.flatnonzero(np.add.reduceat(np.append(late, False), np.minimum(ends[:-1], len(late))) > 0) if len(late) else ():
                        lo, hi = ends[d], ends[d + 1]
                        if hi > lo:
                            part, last = hashes[lo:hi].copy(), late[lo:hi]
                            hashes[lo:hi] = np.concatenate((part[~last], part[last]))
                take = np.where(keep, prefix_length(n), 0)
                pos = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                where = np.repeat(ends[:-1], take) + pos
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[where].view(np.int64)), pa.array(np.repeat(ids, take)),
                     pa.array(np.repeat(n, take).astype(np.int32)), pa.array(pos.astype(np.int32))], ["h", "sid", "n", "pos"])
    return run


POSTING = "h long, sid long, n int, pos int"


def stacked(batches, names):
    """All rows of a task as numpy columns."""
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches]
    return [np.concatenate(c) for c in zip(*parts)] if parts else None


def drop_singles(batches):
    """Postings of a shuffle partition without repeats and without shingles of a single set."""
    cols = stacked(batches, ("h", "sid", "n", "pos"))
    if cols is None:
        return
    order = np.lexsort((cols[1], cols[0]))
    h, sid, n, pos = (c[order] for c in cols)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
    h, sid, n, pos = h[new], sid[new], n[new], pos[new]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    shared = same[1:] | same[:-1]
    yield pa.RecordBatch.from_arrays([pa.array(c[shared]) for c in (h, sid, n, pos)], ["h", "sid", "n", "pos"])


def gathered(batches):
    """Postings of a shuffle partition -> one row per set: its k shared prefix shingles (hs) and their positions (ps)."""
    cols = stacked(batches, ("sid", "n", "pos", "h"))
    if cols is None or not len(cols[0]):
        return
    order = np.lexsort((cols[2], cols[0]))
    sid, n, pos, h = (c[order] for c in cols)
    at = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1], [True])))
    ends, first = pa.array(at.astype(np.int32)), at[:-1]
    yield pa.RecordBatch.from_arrays(
        [pa.array(sid[first]), pa.array(n[first]), pa.array(np.diff(at).astype(np.int32)),
         pa.ListArray.from_arrays(ends, pa.array(h)), pa.ListArray.from_arrays(ends, pa.array(pos))], ["sid", "n", "k", "hs", "ps"])


def reachable(na, ka, nb, kb):
    """The sizes of two sets and the numbers of their shared prefix shingles leave the threshold within reach (as in
    ``plausible``; two sets share at most the fewer of them)."""
    least, most = np.minimum(na, nb).astype(np.int64), np.maximum(na, nb).astype(np.int64)
    beyond = (THRESHOLD * most + 99) // 100 - 1
    return (100 * least >= THRESHOLD * most) & ((100 + THRESHOLD) * (np.minimum(ka, kb) + beyond) >= THRESHOLD * (least + most))


def stars(turn: int):
    """Whole lists of the sets that drew them (h, sid, n, k, comp) -> (sid, leader, times): how many lists of each set are led by
    a set of another component to which it may be linked."""
    def run(batches):
        cols = stacked(batches, ("h", "sid", "n", "k", "comp"))
        if cols is None or not len(cols[0]):
            return
        key = mix(cols[1].view(np.uint64) + np.array([turn], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.lexsort((key, CLASSES * cols[3] // np.maximum(prefix_length(cols[2].astype(np.int64)), 1), cols[0]))
        h, sid, n, k, comp = (c[order] for c in cols)
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
        lead = np.repeat(at[1:] - 1, np.diff(at))
        ok = (comp != comp[lead]) & reachable(n, k, n[lead], k[lead])
        sid, lead = sid[ok], sid[lead[ok]]
        order = np.lexsort((lead, sid))
        sid, lead = sid[order], lead[order]
        if len(sid):
            at = np.flatnonzero(np.concatenate(([True], (sid[1:] != sid[:-1]) | (lead[1:] != lead[:-1]), [True])))
            yield pa.RecordBatch.from_arrays([pa.array(sid[at[:-1]]), pa.array(lead[at[:-1]]), pa.array(np.diff(at))], ["sid", "leader", "times"])
    return run


def cross_pairs(batches, most: int | None = None):
    """Sorted postings (h, sid, n, pos, comp, leader, far, k, parities) -> (a, b, lists held back): pairs of different components
    that may be linked. With ``most``, each list gives so many of the closest pairs of every two components; the shingles of
    lists that had more come along."""
    for cols, cuts in lists(batches):
        mixed = np.minimum.reduceat(cols[4], cuts[:-1]) != np.maximum.reduceat(cols[4], cuts[:-1])
        if not mixed.any():
            continue
        if not mixed.all():  # lists of one component need no look
            size = np.diff(cuts)
            cols = [c[:cuts[-1]][np.repeat(mixed, size)] for c in cols]
            cuts = np.concatenate(([0], np.cumsum(size[mixed])))
        short = np.diff(cuts) <= SHORT
        for size in np.unique(np.diff(cuts)[short]):
            if size < 2:
                continue
            i, j = np.triu_indices(size, 1)
            starts = cuts[:-1][np.diff(cuts) == size]
            i, j = (starts[:, None] + i).ravel(), (starts[:, None] + j).ravel()
            n, pos = cols[2], cols[3]
            swap = (n[j] < n[i]) | ((n[j] == n[i]) & (pos[j] < pos[i]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            keep = early(n, pos)[i]
            best = Closest(most)
            best.add(*likely(cols, i[keep], j[keep]))
            yield from best.pairs()
        for lo, hi in zip(cuts[:-1][~short], cuts[1:][~short]):
            best = Closest(most)
            for found in blocks([c[lo:hi] for c in cols]):
                best.add(*found)
                if most is None:
                    yield from best.pairs()
            yield from best.pairs()


def early(n, pos):
    """Of a pair, the set of fewer shingles must share one of its first n - ceil(2t/(1+t) n) + 1."""
    return pos <= n - (2 * THRESHOLD * n.astype(np.int64) + 99 + THRESHOLD) // (100 + THRESHOLD)


def likely(cols, i, j):
    """(list, components, unlikeness, ids) of the pairs (i, j) of postings of one list that no bound rules out; i is the set
    of fewer shingles."""
    t = THRESHOLD / 100
    h, sid, n, pos, comp, leader, far, k, *marks = cols
    shared = np.minimum(n[j] - pos[j], n[i] - pos[i])
    ok = (comp[j] != comp[i]) & (n[j] * t <= n[i]) & (shared >= (n[i] + n[j]) * t / (1 + t) - 1e-6)
    ok &= (leader[j] != leader[i]) | (np.abs(far[j] - far[i]) <= 1 - t + 1e-9)
    ok &= (leader[j] != sid[i]) & (sid[j] != leader[i]) & reachable(n[i], k[i], n[j], k[j])
    i, j, shared = i[ok], j[ok], shared[ok]
    # linked sets of sizes p and q differ in at most (1-t)/(1+t) (p+q) shingles
    unlike = sum((np.bitwise_count((m[j] ^ m[i]).view(np.uint64)).astype(np.int64) for m in marks), np.zeros(len(i), np.int64))
    ok = (np.maximum(n[i], n[j]) >= MARKED) | ((100 + THRESHOLD) * unlike <= (100 - THRESHOLD) * (n[j].astype(np.int64) + n[i]))
    i, j, shared = i[ok], j[ok], shared[ok]
    score = shared / np.maximum(n[i] + n[j] - shared, 1) + (n[j] - pos[j]) / n[j] / 1000
    return (h[i], np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j]), -score,
            np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j]))


def blocks(cols):
    """``likely`` pairs of one long list: each early set against the blocks of larger sets that are not skipped."""
    t = THRESHOLD / 100
    order = np.lexsort((cols[3], cols[2]))
    cols = [c[order] for c in cols]
    n, pos = cols[2], cols[3]
    starts = np.arange(0, len(n), BLOCK)
    smallest = n[starts]
    room = np.maximum.reduceat(n - pos, starts)      # what a block's sets can still share from this shingle on
    for i in np.flatnonzero(early(n, pos)):
        near = np.arange(i // BLOCK, np.searchsorted(smallest * t, n[i], "right"))  # sizes only grow
        # blocks with a position that leaves enough shared shingles
        near = near[np.minimum(n[i] - pos[i], room[near]) >= (n[i] + smallest[near]) * t / (1 + t) - 1e-6]
        j = (starts[near][:, None] + np.arange(BLOCK)).ravel()
        j = j[(j > i) & (j < len(n))]
        if len(j):
            yield likely(cols, np.full(len(j), i), j)


def lists(batches):
    """(columns, cuts) of whole lists, one after another, from batches sorted by shingle."""
    held = None
    for b in batches:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "sid", "n", "pos", "comp", "leader", "far", "k", *MARKS)]
        if held is not None:
            cols = [np.concatenate((a, c)) for a, c in zip(held, cols)]
        h = cols[0]
        if not len(h):
            continue
        cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        if len(cuts) > 1:
            yield cols, cuts
        held = [c[cuts[-1]:] for c in cols]
    if held is not None:
        yield held, np.array([0, len(held[0])])


class Closest:
    """The ``most`` closest pairs of every two components in each list (None: all of them)."""

    def __init__(self, most):
        self.most, self.parts, self.size, self.more = most, [], 0, []

    def add(self, *cols):
        if len(cols[0]):
            self.parts.append(cols)
            self.size += len(cols[0])
        if self.size > HELD and self.most is not None:
            self.choose()

    def choose(self):
        cols = [np.concatenate(c) for c in zip(*self.parts)]
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))
        head = np.flatnonzero(new)
        keep = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order)))) < self.most
        self.more += np.unique(cols[0][~keep]).tolist()
        self.parts, self.size = [[c[keep] for c in cols]], 0  # counts what comes on top

    def pairs(self):
        if self.parts:
            if self.most is not None:
                self.choose()
            yield np.concatenate([p[4] for p in self.parts]), np.concatenate([p[5] for p in self.parts]), sorted(set(self.more))
            self.parts, self.size = [], 0


def emit_cross(most: int | None = None):
    """Postings -> (a, b) as ``cross_pairs`` gives them; (NULL, shingle) of each list that held pairs back."""
    def run(batches):
        a, b, size = [], [], 0
        for x, y, more in cross_pairs(batches, most):
            a.append(x)
            b.append(y)
            size += len(x)
            if more:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(more), pa.int64()), pa.array(more, pa.int64())], ["a", "b"])
            if size > 100_000:
                yield pair_batch(a, b)
                a, b, size = [], [], 0
        if size:
            yield pair_batch(a, b)
    return run


def pair_batch(a, b):
    pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def compare(batches):
    """Texts sorted by (a, piece, leader first): the set of each against its leader's -> (a, b, both, na, nb).

    A text whose set is not ``a`` leads nothing (a repeated id may have other texts); any other comparison is true of its sets."""
    key, lead = None, None
    for batch in batches:
        a, piece, role = (batch.column(c).to_numpy() for c in ("a", "piece", "role"))
        out = []
        for i, _, hashes, ends, n, sids in sets_of(batch):
            for d in range(len(n)):
                at, s = (a[i + d], piece[i + d]), hashes[ends[d]:ends[d + 1]]
                if role[i + d] == 0:
                    if sids[d] == at[0]:
                        key, lead = at, s.copy()
                elif key == at and len(s) and sids[d] != at[0]:
                    out.append((at[0], sids[d], shared_members(s, lead), len(lead), len(s)))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "both", "na", "nb"])


def shared_members(x: np.ndarray, y: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def verified(pairs: DataFrame, texts: DataFrame, described: DataFrame) -> DataFrame:
    """(a, b) pairs of set ids -> (a, b, both, na, nb). The text of one document of each set travels to the leader ``a``, where
    the sets are made again (a text takes less room in a shuffle than its hashes); a leader of many pairs is repeated for every
    PIECE of them, so no task holds more than one piece of a hot leader.

    The ids of these documents are broadcast with their leaders while they are few (checked), so that only texts on their way
    leave the scan; beyond that, texts and ids meet in a shuffle."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    pieces = sizes.select("a", F.ceil(F.col("m") / PIECE).cast("int").alias("pieces"))
    members = pairs.join(pieces, "a").select("a", F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int").alias("piece"), F.col("b").alias("sid"), F.lit(1).alias("role"))
    leaders = pieces.select("a", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("a").alias("sid"), F.lit(0).alias("role"))
    # of a set without any id but NULL, one row is enough: rows of NULL ids are all tried
    holders = described.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("holder"))
    ways = few(written(members.unionByName(leaders).join(holders, "sid").select("holder", "a", "piece", "role").distinct(), "ways"))
    rows = texts.join(ways, texts["doc_id"].eqNullSafe(ways["holder"])).select("a", "piece", "role", "text")
    return (rows.repartition(n, "a", "piece").sortWithinPartitions("a", "piece", "role")
            .mapInArrow(compare, "a long, b long, both long, na long, nb long").distinct())


def few(rows: DataFrame) -> DataFrame:
    """Written rows, broadcast in joins while they are few (counted)."""
    return F.broadcast(rows) if rows.count() <= FEW_IDS else rows


def plausible(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shared prefix shingles leave the threshold within reach: beyond the shorter of two prefixes at most
    ceil(3/4 of the larger set) - 1 shingles can be common, and 3/7 of both sizes must be."""
    of_a = prefixes.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("hs").alias("ha"))
    of_b = prefixes.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("hs").alias("hb"))
    counted = pairs.join(of_b, "b").join(of_a, "a").withColumn("both", F.size(F.array_intersect("ha", "hb")))
    beyond = F.floor((THRESHOLD * F.greatest("na", "nb") + 99) / 100) - 1
    return counted.filter((100 + THRESHOLD) * (F.col("both") + beyond) >= THRESHOLD * (F.col("na") + F.col("nb"))).select("a", "b")


def linked(v: DataFrame) -> DataFrame:
    return v.filter(100 * F.col("both") >= THRESHOLD * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def with_components(prefixes: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Sets with their components (a set without links is its own)."""
    if comp is None:
        return prefixes.withColumn("comp", F.col("sid"))
    return prefixes.join(few(comp), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))


def star_pairs(known: DataFrame, turn: int) -> DataFrame:
    """(a, b): each set with one leader of another component, the one that leads most of the lists it draws. A list's leader is
    the set of its highest class that is largest under a hash that changes from turn to turn, so the pairs are at most as many
    as the sets.

    A set draws the lists of its VOTES shingles that are smallest under another such hash: its lists lie in as many tasks as
    there are, where hardly any of their leaders could be counted together. The draw only decides which pairs are tried first;
    the lists of ``cross_pairs`` are whole."""
    n = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = F.array_sort(F.transform("hs", lambda h: F.struct(F.xxhash64(h, F.lit(turn)).alias("key"), h.alias("h"))))
    star = (known.select(F.explode(F.slice(keyed, 1, VOTES)["h"]).alias("h"), "sid", "n", "k", "comp").repartition(n, "h")
            .mapInArrow(stars(turn), "sid long, leader long, times long").groupBy("sid", "leader").agg(F.sum("times").alias("times")))
    return star.groupBy("sid").agg(F.max_by("leader", F.struct("times", "leader")).alias("leader")).select(
        F.col("leader").alias("a"), F.col("sid").alias("b"))


def set_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n, sid), (sid, comp)): every document's set and the component of every set that has a link."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = written(texts.mapInArrow(describe, f"doc_id {kind}, n long, sid long, " + ", ".join(f"{m} long" for m in MARKS)), "sets")
    reports = written(texts.mapInArrow(report, "h long, times long").groupBy("h").agg(F.sum("times").alias("times")), "frequent")
    least = max(FREQUENT, (described.agg(F.sum("n")).first()[0] or 0) // MOST_FREQUENT)
    rows = reports.filter(F.col("times") >= least).select("h").toArrow()
    frequent = spark.sparkContext.broadcast(np.sort(rows.column("h").to_numpy().view(np.uint64)))
    postings = written(texts.mapInArrow(lambda b: postings_of(frequent.value)(b), POSTING).repartition(n, "h")
                       .mapInArrow(drop_singles, POSTING), "postings")
    # one row per set from here on: joins by set move no posting
    marks = described.filter("n > 0").groupBy("sid").agg(*[F.when(F.min("n") < MARKED, F.min(m)).otherwise(0).alias(m) for m in MARKS])
    prefixes = written(postings.repartition(n, "sid").mapInArrow(gathered, "sid long, n int, k int, hs array<long>, ps array<int>")
                       .join(marks, "sid"), "prefixes")
    comp, links, far = None, None, None
    for turn in range(TURNS):
        pairs = written(plausible(star_pairs(with_components(prefixes, comp), turn), prefixes), "star-pairs")
        if turn and pairs.isEmpty():
            break
        near = written(verified(pairs, texts, described), "star-verified")
        links = linked(near) if links is None else links.unionByName(linked(near))
        if far is None:
            far = written(near.groupBy(F.col("b").alias("sid")).agg(F.min_by(F.struct(F.col("a").alias("leader"), (
                1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("far")), "a").alias("x")).select("sid", "x.*"), "far")
        comp = components(links).toDF("sid", "comp")
    tried, held_back = None, None
    for most in ROUNDS:
        rest = with_components(prefixes, comp).join(few(far), "sid", "left")
        rest = rest.select(F.inline(F.arrays_zip(F.col("hs").alias("h"), F.col("ps").alias("pos"))), "sid", "n", "comp",
                           F.coalesce("leader", "sid").alias("leader"), F.coalesce("far", F.lit(0.0)).alias("far"), "k", *MARKS)
        if held_back is not None:
            rest = rest.join(few(held_back), "h", "left_semi")  # the other lists gave every pair
        crossing = written(rest.repartition(n, "h").sortWithinPartitions("h").mapInArrow(emit_cross(most), "a long, b long").distinct(), "crossing")
        fresh_ = crossing.filter("a is not null")
        if tried is not None:
            fresh_ = fresh_.join(tried, ["a", "b"], "left_anti")
        pairs = written(plausible(fresh_, prefixes), "cross-pairs")
        more = linked(written(verified(pairs, texts, described), "cross-verified"))
        links = links.unionByName(more)
        comp = components(links).toDF("sid", "comp")
        held_back = crossing.filter("a is null").select(F.col("b").alias("h"))
        if held_back.isEmpty():
            break
        tried = fresh_ if tried is None else tried.unionByName(fresh_)
    return described.select("doc_id", "n", "sid"), comp


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id among the documents reachable by links.

    NULL texts are empty: no shingles, linked with nothing, their own component. Repeated rows and equal texts are one
    class (a NULL doc_id counts as larger than any other). An empty table gives an empty result.
    """
    described, comp = set_components(docs)
    labelled = described.join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    classes = labelled.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return (labelled.join(classes, "comp", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies (the one with the smallest id), all columns kept."""
    from pyspark.sql import Window
    heads = grouped(docs).filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("llm_id")).distinct()
    kept = docs.join(heads, docs["doc_id"].eqNullSafe(heads["llm_id"]), "left_semi")
    return kept
