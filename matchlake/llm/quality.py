"""Quality by an interpolated modified Kneser-Ney n-gram model of characters, trained on trusted text of each language.

Counts come from all trusted documents; every n-gram that occurs anywhere in the corpus gets its probability by joins of
the count tables sharded by (language, n-gram) or (language, context). Documents are then scored against those resolved
n-grams, block by block of bounded size, and kept between language-specific quantiles of trusted perplexities.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, mix, utf8, word_hashes, written

ORDER = 5
SHARD_GRAMS = 2_000_000      # resolved n-grams in one pass over the documents (24 bytes each)
LOW, HIGH = 0.01, 0.99       # quantiles of trusted perplexity; HIGH also of trusted word repetition
NEAR = 4                     # words before a word that it may repeat
FEW_IDS = 1_000_000          # trusted ids that may be broadcast (8 MB)
PAD = "\x02"                 # before the first character
SCORED = 200_000             # bytes of text scored at once, whose arrays stay in the processor's cache
SLOTS = 20                   # bits of the direct-mapped tables of n-grams in a task


def code_points(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All texts padded in front, as one array of code points, and the offsets of the texts."""
    joined = [PAD * (ORDER - 1) + (t or "") for t in texts]
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(j) for j in joined])))


def gram_keys(points: np.ndarray, offsets: np.ndarray, salts: np.ndarray):
    """64-bit key of the n-gram that ends at each real character, its start, and its document."""
    factors = mix(np.arange(11, 11 + ORDER, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    length = np.diff(offsets) - (ORDER - 1)
    doc = np.repeat(np.arange(len(length)), length)
    start = np.arange(len(doc)) + doc * (ORDER - 1)
    wide = points.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(max(len(points) - ORDER + 1, 0), np.uint64)
    for d in range(ORDER):  # at every place, also across texts; the places of real characters are taken after that
        sums += wide[d:d + len(sums)] * factors[d]
    return mix(sums[start] + np.repeat(salts, length)), start, doc


def lang_salt(langs: list) -> np.ndarray:
    import hashlib
    made = {l: int.from_bytes(hashlib.md5((l or "").encode()).digest()[:8], "little") for l in set(langs)}
    return np.array([made[l] for l in langs], np.uint64)


def text_chunks(batch: pa.RecordBatch, most: int = 1_500_000):
    """Parts of a batch of about ``most`` bytes of text: (first row, last row, texts, languages)."""
    _, at = utf8(batch.column("text"))
    for i, j in chunks(at, most):
        yield i, j, batch.column("text").slice(i, j - i).to_pylist(), batch.column("lang").slice(i, j - i).to_pylist()


def count_grams(batches):
    """(lang, gram, key, n) summed over parts of batches."""
    for b in batches:
        for _, _, texts, langs in text_chunks(b):
            points, at = code_points(texts)
            key, start, doc = gram_keys(points, at, lang_salt(langs))
            found, first, n = np.unique(key, return_index=True, return_counts=True)
            yield gram_rows(points, start, doc, langs, found, first, n)


def gram_rows(points, start, doc, langs, key, first, n):
    joined = points[start[first][:, None] + np.arange(ORDER)].tobytes().decode("utf-32-le", "surrogatepass")
    grams = [joined[s:s + ORDER] for s in range(0, len(joined), ORDER)]
    return pa.RecordBatch.from_arrays(
        [pa.array([langs[d] or "" for d in doc[first]], pa.string()), pa.array(grams, pa.string()),
         pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "key", "n"])


def new_grams(batches):
    """(lang, gram, key, n): each n-gram at least once per task, most of them only once."""
    seen = np.zeros(1 << SLOTS, np.uint64)
    for b in batches:
        for _, _, texts, langs in text_chunks(b):
            points, at = code_points(texts)
            key, start, doc = gram_keys(points, at, lang_salt(langs))
            fresh = np.flatnonzero(seen[key >> np.uint64(64 - SLOTS)] != key)
            found, first = np.unique(key[fresh], return_index=True)
            seen[found >> np.uint64(64 - SLOTS)] = found
            yield gram_rows(points, start, doc, langs, found, fresh[first], np.ones(len(found)))


GRAM = "lang string, gram string, key long, n long"


def count_tables(trusted: DataFrame) -> DataFrame:
    """(lang, o, gram, n) for orders 1..ORDER: raw counts at the top, numbers of distinct left neighbours below."""
    level = trusted.mapInArrow(count_grams, GRAM).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    out = level = written(level.withColumn("o", F.lit(ORDER)), "kn-counts")
    for o in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.substring("gram", 2, o).alias("gram")).agg(F.count(F.lit(1)).alias("n")).withColumn("o", F.lit(o))
        out = out.unionByName(level)
    return written(out, "kn-orders")


def with_discounts(counts: DataFrame) -> DataFrame:
    """The discount of each count, from the numbers of n-grams seen one to four times in that language and order."""
    def seen(i):
        return F.sum((F.col("n") == i).cast("double"))

    n = counts.groupBy("lang", "o").agg(*[seen(i).alias(f"n{i}") for i in range(1, 5)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    d = [F.coalesce(F.greatest(F.lit(0.05), F.lit(float(i)) - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))),
                    F.lit(0.5)).alias(f"d{i}") for i in (1, 2, 3)]
    n = n.select("lang", "o", *[F.least(x, F.lit(float(i))).alias(f"d{i}") for i, x in enumerate(d, 1)])
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return counts.join(F.broadcast(n), ["lang", "o"]).select("lang", "o", "gram", "n", cut.alias("cut"))


def with_keys(batches):
    """(key, logp) of rows of (lang, gram, p)."""
    for b in batches:
        if not b.num_rows:
            continue
        points = np.frombuffer("".join(b.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.arange(b.num_rows + 1) * ORDER
        salts = lang_salt(b.column("lang").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(gram_keys(points, at, salts)[0].view(np.int64)),
                                          pa.array(np.log(b.column("p").to_numpy()))], ["key", "logp"])


def resolved(corpus_grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, logp) of every n-gram of the corpus: each order's n-grams meet their own count, the total and freed mass of
    their context, and what the order below gives their ending; the lower orders hold each ending only once."""
    table = with_discounts(counts)
    level = {ORDER: corpus_grams.select("lang", "gram", F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("cut"))}
    for o in range(ORDER, 0, -1):  # the join with the own counts is the same shuffle that makes the n-grams distinct
        own = table.filter(F.col("o") == o).select("lang", "gram", "n", "cut")
        level[o] = written(level[o].unionByName(own).groupBy("lang", "gram").agg(F.max("n").alias("n"), F.max("cut").alias("cut")), "kn-seen")
        level[o - 1] = level[o].select("lang", F.expr(f"right(gram, {o - 1})").alias("gram"), F.lit(None).cast("long").alias("n"),
                                       F.lit(None).cast("double").alias("cut"))
    sizes = counts.filter("o = 1").groupBy("lang").agg(F.count(F.lit(1)).alias("letters"))
    below = None
    for o in range(1, ORDER + 1):
        ctx = (table.filter(F.col("o") == o).groupBy("lang", F.expr(f"left(gram, {o - 1})").alias("ctx"))
               .agg(F.sum("n").alias("total"), F.sum("cut").alias("freed")))
        p = level[o].withColumns({"ctx": F.expr(f"left(gram, {o - 1})"), "tail": F.expr(f"right(gram, {o - 1})")})
        if o == 1:  # both tables have one row per language
            p = (p.join(F.broadcast(sizes), "lang", "left").join(F.broadcast(ctx), ["lang", "ctx"], "left")
                 .withColumn("p", 1.0 / (F.coalesce("letters", F.lit(0)) + 1)))
        else:
            p = p.join(ctx, ["lang", "ctx"], "left").join(below, ["lang", "tail"])
        p = p.select("lang", "gram", F.when(F.col("total").isNull(), F.col("p")).otherwise(
            F.coalesce((F.col("n") - F.col("cut")) / F.col("total"), F.lit(0.0)) + F.col("freed") / F.col("total") * F.col("p")).alias("p"))
        below = written(p, "kn-below").withColumnRenamed("gram", "tail") if o < ORDER else p
    return below.mapInArrow(with_keys, "key long, logp double")


def bucket_starts(keys: np.ndarray) -> np.ndarray:
    """First place in the sorted ``keys`` of each value of their SLOTS leading bits, and the end."""
    return np.concatenate(([0], np.cumsum(np.bincount((keys >> np.uint64(64 - SLOTS)).astype(np.int64), minlength=1 << SLOTS))))


def positions(keys: np.ndarray, begin: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in the sorted ``keys``, -1 if it is not there: a walk through the few keys of its bucket."""
    bucket = (wanted >> np.uint64(64 - SLOTS)).astype(np.int64)
    at, end = begin[bucket], begin[bucket + 1]
    out = np.full(len(wanted), -1)
    open_ = np.flatnonzero(at < end)
    while len(open_):
        here = at[open_]
        hit = keys[here] == wanted[open_]
        out[open_[hit]] = here[hit]
        at[open_] += 1
        open_ = open_[~hit & (here + 1 < end[open_])]
    return out


def echoes(texts: pa.Array) -> np.ndarray:
    """Share of the words of each text that repeat one of the NEAR words before; zero without words."""
    word, doc = word_hashes(*utf8(texts))
    again = np.zeros(len(word), bool)
    for lag in range(1, NEAR + 1):
        again[lag:] |= (word[lag:] == word[:-lag]) & (doc[lag:] == doc[:-lag])
    return np.bincount(doc, again, len(texts)) / np.maximum(np.bincount(doc, minlength=len(texts)), 1)


def perplexities(docs: DataFrame, grams: DataFrame, block: int = SHARD_GRAMS) -> DataFrame:
    """(doc_id, lang, chars, ppl, echo): exp of the mean negative log probability of a character (NULL for texts without
    characters), and the share of words that repeat one just before.

    Each pass adds what one block of the resolved n-grams contributes; passes are chained without a shuffle.
    """
    spark = docs.sparkSession
    grams = written(grams, "kn-resolved")
    n_blocks = max(1, -(-grams.count() // block))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text", "lang", F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("chars"),
                      F.lit(0.0).alias("echo"))
    for k in range(n_blocks):
        rows = grams.filter(F.pmod("key", F.lit(n_blocks)) == k).toArrow()
        key = rows.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        shared = spark.sparkContext.broadcast((key[order], rows.column("logp").to_numpy()[order]))

        def add(batches, shared=shared, first=k == 0):
            keys, logp = shared.value
            bits = np.uint64(64 - SLOTS)
            slot = np.zeros(1 << SLOTS, np.uint64)
            value = np.zeros(1 << SLOTS)
            begin = bucket_starts(keys)
            if len(keys):
                slot[keys >> bits], value[keys >> bits] = keys, logp
            for b in batches:
                total = b.column("total").to_numpy().copy()
                chars = b.column("chars").to_numpy().copy()
                echo = b.column("echo").to_numpy().copy()
                for i, j, texts, langs in text_chunks(b, SCORED):
                    points, at = code_points(texts)
                    key, _, doc = gram_keys(points, at, lang_salt(langs))
                    where = key >> bits
                    got = value[where]
                    other = np.flatnonzero(slot[where] != key)
                    got[other] = 0.0
                    if len(keys):
                        found = positions(keys, begin, key[other])
                        got[other[found >= 0]] = logp[found[found >= 0]]
                    total[i:j] += np.bincount(doc, got, minlength=j - i)
                    if first:
                        chars[i:j] = np.bincount(doc, minlength=j - i)
                        echo[i:j] = echoes(b.column("text").slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "text", "lang")] + [
                    pa.array(total), pa.array(chars, pa.int64()), pa.array(echo)], b.schema.names)

        out = out.mapInArrow(add, f"doc_id {kind}, text string, lang string, total double, chars long, echo double")
    return out.select("doc_id", "lang", "chars", F.when(F.col("chars") > 0, F.exp(-F.col("total") / F.col("chars"))).alias("ppl"), "echo")


def judged(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, lang, perplexity, low, high, keep) of every row.

    Trusted: documents that ``labels`` marks quality 1. A text is kept if its perplexity lies between the quantiles of
    trusted perplexity in its language (NULL is a language of its own) and its words repeat those just before them no more
    often than the upper quantile of trusted text. Texts without characters and languages without
    trusted text are kept: nothing speaks against them. Without trusted text at all everything is kept.
    """
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    lang = F.coalesce("lang", F.lit("")).alias("lang")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang)
    good = written(good, "kn-trusted")
    # while the trusted ids are few (checked), only they travel; beyond that, texts and ids meet in a shuffle
    few = F.broadcast(good) if good.count() <= FEW_IDS else good
    counts = count_tables(rows.join(few, "doc_id", "left_semi").select("text", "lang"))
    seen = rows.select("text", "lang").mapInArrow(new_grams, GRAM)
    scored = written(perplexities(rows, resolved(seen, counts)), "kn-scored")
    limits = scored.join(good, "doc_id", "left_semi").filter(F.col("ppl").isNotNull()).groupBy("lang").agg(
        F.percentile_approx("ppl", F.array(F.lit(low), F.lit(high)), 10_000).alias("q"),
        F.percentile_approx("echo", F.lit(high), 10_000).alias("most"))
    limits = limits.select("lang", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "most")
    inside = F.coalesce((F.col("ppl") >= F.col("low")) & (F.col("ppl") <= F.col("high")) & (F.col("echo") <= F.col("most")), F.lit(True))
    return scored.join(F.broadcast(limits), "lang", "left").select(  # one row per language
        "doc_id", F.nullif("lang", F.lit("")).alias("lang"), F.col("ppl").alias("perplexity"), "low", "high", inside.alias("keep"))
