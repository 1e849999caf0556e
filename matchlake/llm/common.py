"""Small helpers of the operators: reading, intermediate tables, folds, byte and word views of Arrow text columns."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"  # a word of the contracts: a run of bytes other than ASCII blanks
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the folder the session shares and read back."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it (names differ without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold():
    """crc32 of the id as text modulo five; NULL for a NULL id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def held_out():
    return F.coalesce(fold() == 0, F.lit(False))


def learnable():
    return F.coalesce(fold() != 0, F.lit(False))


# ---- columns of UTF-8 text as numpy arrays --------------------------------------------------
def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without copying the bytes; NULL counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = 4_000_000):
    """Ranges of whole documents of about ``most`` bytes each (a longer document stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """64-bit hash of every word and the index of its document; words never cross documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_BLANK[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:n]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    where = np.flatnonzero(solid)
    head = np.searchsorted(where, starts)
    length = np.diff(np.append(head, len(where)))
    inside = np.arange(len(where)) - np.repeat(head, length)
    power = np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    letters = (_LOWER[data[where]] if lower else data[where]).astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(letters * power[inside], head)
    doc = np.searchsorted(offsets, starts, "right") - 1
    return mix(sums + length.astype(np.uint64) * M2), doc


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5):
    """Distinct word shingles of each document as sorted 64-bit hashes: (hashes, offsets by document).

    A document with fewer words than ``width`` has its whole word sequence as its only shingle, one without words has none.
    """
    words, doc = word_hashes(data, offsets)
    n_docs = len(offsets) - 1
    count = np.bincount(doc, minlength=n_docs)
    begin = np.concatenate(([0], np.cumsum(count)))
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * M1) | np.uint64(1)
    padded = np.concatenate((words, np.zeros(width - 1, np.uint64)))
    total = np.zeros(len(words), np.uint64)
    for k in range(width):
        total += padded[k:k + len(words)] * factors[k]
    left = begin[doc + 1] - np.arange(len(words))
    keep = left >= width
    hashes, of = mix(total[keep]), doc[keep]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = np.array([mix(np.add.reduce(words[begin[d]:begin[d + 1]] * factors[:count[d]], keepdims=True)
                              + count[d:d + 1].astype(np.uint64) * M1)[0] for d in short], np.uint64)
        hashes, of = np.concatenate((hashes, whole)), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n_docs))))
    for d in range(n_docs):
        hashes[ends[d]:ends[d + 1]].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[fresh], of[fresh]
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n_docs))))
