"""Document fingerprints: bottom-k sketches of word-shingle hashes, in SQL functions only.

A sketch is the sorted array of the ``k`` smallest 64-bit hashes of a text's distinct five-word shingles (fewer words: the
whole sequence is one shingle; no words: an empty sketch). Sketches of parts merge into the sketch of the union.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

K = 128
WIDTH = 5
BLANKS = " \t\n\x0b\x0c\r"


def with_sketch(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """``df`` with the sketch of column ``text``. The word hashes become a column first, so that they are computed once."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+"))
    hashed = df.withColumn(f"{out}_w", F.transform(words, lambda w: F.xxhash64(w)))
    w = F.col(f"{out}_w")
    many = F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*[w[i + d] for d in range(WIDTH)]))
    shingles = F.when(w.isNull(), F.array().cast("array<bigint>")).when(
        F.size(w) < WIDTH, F.array(F.xxhash64(w, F.size(w)))).otherwise(many)
    return hashed.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop(f"{out}_w")


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def shared(a: Column, b: Column, k: int = K) -> Column:
    """How many of the ``k`` smallest hashes of the union both sketches hold."""
    return F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard resemblance; exact while the union has at most ``k`` shingles. Two empty sketches are alike (1)."""
    size = F.size(merge(a, b, k))
    return F.when(size == 0, F.lit(1.0)).otherwise(shared(a, b, k) / size).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    last = (F.element_at(a, -1).cast("double") + 2.0 ** 63) / 2.0 ** 64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has as well (1 for an empty ``a``)."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """Big-endian hashes in order, as base64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def with_next(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text) with ``next_text`` of the row that follows by falling doc_id (ties: falling text; NULL ids last);
    the last row is followed by the first.

    Ids are cut into cells of about sqrt(rows) rows; a cell that holds far more is cut again (fewer than sqrt(rows) / 4 such
    cells can exist, so their list may be broadcast). Texts are shuffled once, by cell; the first text of each cell is handed
    to the cell before it.
    """
    lo, hi, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    target = max(500, math.isqrt(n or 0))
    lo, hi = (lo, hi) if lo is not None else (0, 0)
    width = max(1, -(-(hi - lo + 1) * target // max(1, n)))
    cell = F.coalesce(F.floor((F.col("doc_id") - lo) / width), F.lit(-1)).cast("long")
    spread = rows.select("doc_id").withColumn("cell", cell).groupBy("cell").agg(
        F.min("doc_id").alias("cell_lo"), F.max("doc_id").alias("cell_hi"), F.count(F.lit(1)).alias("cell_n"))
    fine = spread.filter(F.col("cell_n") > 4 * target).withColumn("pieces", F.ceil(F.col("cell_n") / target)).select(
        "cell", "cell_lo", "pieces", ((F.col("cell_hi") - F.col("cell_lo")) / F.col("pieces") + 1e-9).alias("step"))
    inside = F.when(F.col("pieces").isNull(), F.lit(0)).when(
        F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.col("pieces"))).otherwise(
        F.floor((F.col("doc_id") - F.col("cell_lo")) / F.col("step"))).cast("long")
    placed = rows.withColumn("cell", cell).join(F.broadcast(fine), "cell", "left").withColumn("sub", inside).select(
        "doc_id", "text", "cell", "sub")
    here = Window.partitionBy("cell", "sub").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    led = placed.withColumns({"follower": F.lead("text").over(here), "place": F.row_number().over(here)})
    heads = led.filter("place = 1").select(F.col("cell").alias("to_cell"), F.col("sub").alias("to_sub"), F.col("text").alias("head"))
    cells = Window.orderBy(F.desc("cell"), F.desc("sub"))
    whole = cells.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.struct("cell", "sub")
    links = placed.select("cell", "sub").distinct().select("cell", "sub", F.coalesce(
        F.lead(at).over(cells), F.first(at).over(whole)).alias("to"))
    ahead = links.select("cell", "sub", F.col("to.cell").alias("to_cell"), F.col("to.sub").alias("to_sub")).join(
        heads, ["to_cell", "to_sub"]).select("cell", "sub", "head")
    return led.join(ahead, ["cell", "sub"]).select("doc_id", "text", F.coalesce("follower", "head").alias("next_text"))


def fingerprinted(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text (NULL: empty) and of its edited text: the last third of its code points gives way to the
    start of the next document's. Repeated rows follow one another; an empty table gives an empty result."""
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited)
    # shuffling a sketch would cost more than making it again from the next text
    for text, out in (("text", "sketch"), ("edited", "edited_sketch"), ("next_text", "next_sketch")):
        rows = with_sketch(rows, text, out, k)
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(a).alias("fingerprint"),
        as_text(b).alias("edited_fingerprint"), resemblance(a, b, k).alias("near_edited"), resemblance(a, c, k).alias("near_next"),
        distinct_shingles(a, k).alias("shingles"), containment(a, b, k).alias("contained"))
