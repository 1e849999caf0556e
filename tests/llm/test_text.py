"""Decontamination, HTML text, quality, toxicity, fingerprints, language: brute force, held-out accuracy, awkward rows."""
import hashlib
import html
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from matchlake.llm import decontamination as dec, fingerprints as fp, html_text, language, quality, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
DDL = "doc_id long, text string, lang string, source string, n_chars long, sketch string, keep int, size long, llm_x int"


def docs(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 0, "q", 1, 2, 3) for i, t in rows], DDL)


# ---- decontamination ------------------------------------------------------------------------
def near(item, text):
    """Least edit distance of item to any stretch of text, by the plain table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        prev, row = row, [0]
        for i, x in enumerate(item):
            row.append(min(prev[i] + (x != c), prev[i + 1] + 1, row[i] + 1))
        best = min(best, row[-1])
    return best


def test_matches_equal_brute_force(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 7))) for _ in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, text(r.randint(6, 30))) for k in range(12)] + [(90, None), (91, ""), (92, "?!"), (93, "abc"), (5, text(9))]
    rows = [(100, None), (101, ""), (102, "abc"), (103, "ABC, abcd"), (None, items[0][1])]
    for k in range(60):
        t = list(r.choice(items[:12])[1])
        for _ in range(r.randint(0, 10)):
            at = r.randrange(len(t))
            t[at:at + r.randint(0, 1)] = r.choice(["", "x", "zz"])
        rows.append((k, text(20) + " " + "".join(t).upper() + " " + text(20)))
    rows += [rows[10], rows[10]]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, llm_hits int")
    got = dec.decontaminated(docs(spark, rows), bench).collect()
    want = []
    for i, t in rows:
        s, found = dec.normal(t), set()
        for key, item in items:
            n = dec.normal(item)
            if n and (f" {n} " in f" {s} " if len(n) < dec.LEAST else near(n, f" {s} ") <= int(len(n) * dec.BUDGET)):
                found.add(key)
        want.append((i, bool(found), sorted(found)))
    assert sorted(((r.doc_id, r.contaminated, r.items) for r in got), key=str) == sorted(want, key=str)
    blocks = dec.decontaminated(docs(spark, rows), bench, block=4).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))
    kept = dec.decontaminated(docs(spark, rows), bench, keep_columns=True)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, bad, _ in want if not bad)
    assert dec.decontaminated(docs(spark, rows), bench.limit(0)).filter("contaminated").count() == 0


# ---- HTML -----------------------------------------------------------------------------------
def test_pages_give_their_articles(spark):
    got = html_text.extracted(spark.read.parquet(f"{SF}/pages.parquet"))
    for r, page in ((r, p) for r in got.collect() for p in PAGES(spark)[r.page_id]):
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        body = re.sub(r"</?(h1|p)>", "\0", re.sub("<br>", " ", body))
        lines = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>?", "", body).split("\0"))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def PAGES(spark, seen={}):
    if not seen:
        for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
            seen.setdefault(r.page_id, []).append(r.html)
    return seen


def test_furniture_goes_and_text_stays(spark):
    page = """<!doctype html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1></header>
      <div class="cookie-notice">We use cookies on this site to give you the best service</div>
      <nav><a href="/">Home</a> <a href="/x">News</a></nav>
      <main><article><header><h1>The head &amp; line</h1></header><p>First   para<b>graph</b> with a <a href="q">link</a>.</p>
      <div class="ad">Buy now! The best offer of the year, only today</div><p>Second one &lt;here&gt;&nbsp;ends.</p>
      <script>var t = "<p>no</p>";</script><form><label>Mail</label><input><button>Send</button></form><ul><li>a point<li>b point</ul>
      <section id="comments"><p>A reader says that this is a very long and friendly comment about it.</p></section>
      </article></main><aside>Related stories and more</aside><footer>&copy; 2024 site</footer><!-- <p>gone</p>"""
    rows = [(1, "u", page, 0), (2, None, None, 0), (3, "u", "", 0), (None, "u", "<p>", 0), (1, "u", page, 0),
            (4, "u", "plain words only, not a single tag in sight, but quite a few of them", 0)]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    want = "The head & line\nFirst paragraph with a link.\nSecond one <here> ends.\na point\nb point"
    by = defaultdict(list)
    for r in got.collect():
        by[r.page_id].append((r.text, r.n_chars))
    assert by[1] == [(want, len(want))] * 2 and by[2] == by[3] == by[None] == [("", 0)]
    assert by[4][0][0].startswith("plain words")
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_scripts_end_at_their_own_closing_tag():
    tree = html_text.grow(html_text.LABELLED)
    text = "An article of enough words to stand as the main text of this page, told in one paragraph."
    for script in ("<script>for(i=0;i<n;i++){x()}</script>", "<SCRIPT>if (a<b && c) '</p>'</Script >", "<style><!-- a<b </style>",
                   '<script>s = "it\'s <b"</script>'):
        page = f"{script}<article><p>{text}</p></article><script>y()</script>"
        assert html_text.main_text(page, tree) == text, script
    assert html_text.main_text(f"<article><p>{text}</p><script>a<b </scripts> never closed", tree) == text


def test_names_with_main_or_article_in_them_hide_nothing():
    tree = html_text.grow(html_text.LABELLED)
    first, second = ("The %s paragraph of the page has enough words to be taken for main text without the help of any mark, "
                     "since neighbours and links speak for it as well." % w for w in ("first", "second"))
    body = f'<div class="content"><p>{first}</p><p>{second}</p></div>'
    menu = '<ul class="main-menu"><li><a href="/">Home</a><li><a href="/n">News</a></ul>'
    for extra in (menu, '<div id="main-nav"><a href="/">Home</a></div>', '<aside class="article-teaser"><p>More to read</p></aside>',
                  '<aside><article><p>More to read</p></article></aside>', '<article><p>Short</p></article>'):
        got = html_text.main_text(extra + body, tree)
        assert first in got and second in got and "Home" not in got and "More" not in got, extra
    assert html_text.main_text('<div class="page main"><p>Few words</p></div>', tree) == "Few words"


# ---- quality --------------------------------------------------------------------------------
def brute_kneser_ney(trusted, texts):
    """The same model from its definition, by dictionaries."""
    n, pad = quality.ORDER, quality.PAD * (quality.ORDER - 1)
    top = Counter(s[i:i + n] for s in (pad + t for t in trusted) for i in range(len(s) - n + 1))
    counts = {n: top}
    for o in range(n - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    cut = {}
    for o, c in counts.items():
        k = Counter(c.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else None
        cut[o] = [min(float(i), max(0.05, i - (i + 1) * y * k[i + 1] / k[i]) if y is not None and k[i] else 0.5) for i in (1, 2, 3)]

    def p(g):
        out = 1 / (len(counts[1]) + 1)
        for o in range(1, n + 1):
            own = {x: c for x, c in counts[o].items() if x[:-1] == g[n - o:-1]}
            if own:
                part = g[n - o:]
                freed = sum(cut[o][min(c, 3) - 1] for c in own.values())
                c = own.get(part, 0)
                out = ((c - cut[o][min(c, 3) - 1]) if c else 0) / sum(own.values()) + freed / sum(own.values()) * out
        return out

    return {t: math.exp(-sum(math.log(p((pad + t)[i:i + n])) for i in range(len(t))) / len(t)) for t in texts if t}


def test_perplexity_equals_definition(spark):
    r = random.Random(3)
    text = lambda: " ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 12)))
    rows = [(i, text()) for i in range(30)] + [(40, None), (41, ""), (42, "zzz unseen"), (5, "repeated"), (5, "repeated")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(2, 1, 0), (25, 0, 0), (None, 1, 0), (26, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.judged(docs(spark, rows), labels).collect()
    trusted = [t for i, t in rows if i is not None and i < 20 and t]
    want = brute_kneser_ney(trusted, {t for _, t in rows})
    assert len(got) == len(rows)
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    for i, t in rows:
        for x in by[i]:
            if not t:
                assert x.perplexity is None and x.keep
            elif i != 5:
                assert math.isclose(x.perplexity, want[t], rel_tol=1e-9), t
    assert not by[42][0].keep
    assert all(x.keep for x in quality.judged(docs(spark, rows), labels.limit(0)).collect())
    assert quality.judged(docs(spark, []), labels).collect() == []


def test_blocks_of_grams_add_up(spark):
    rows = [(i, "abc abd " * (i % 4) + "xyz") for i in range(12)]
    d = docs(spark, rows).select("doc_id", "text", "lang")
    counts = quality.count_tables(d.select("text", "lang"))
    seen = d.select("text", "lang").mapInArrow(quality.new_grams, quality.GRAM).select("lang", "gram", "key").distinct()
    table = quality.resolved(seen, counts)
    one, many = quality.perplexities(d, table), quality.perplexities(d, table, block=5)
    a, b = ({r.doc_id: r.ppl for r in x.collect()} for x in (one, many))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_order_sees_more_than_four_characters():
    """Two texts with the same four-character n-grams, only one of which has the five-character ones of the other."""
    import numpy as np
    points, at = quality.code_points(["xabcdy", "zabcdy"])
    key, _, doc = quality.gram_keys(points, at, np.zeros(2, np.uint64))
    assert quality.ORDER >= 5 and key[doc == 0][4] != key[doc == 1][4]


def test_lower_orders_shuffle_each_ending_once(spark):
    """An ending shared by many n-grams is resolved once, and every n-gram still gets its probability."""
    d = docs(spark, [(i, f"{c}bcde") for i, c in enumerate("aaxyzw")]).select("text", "lang")
    seen = d.mapInArrow(quality.new_grams, quality.GRAM)
    table = quality.resolved(seen, quality.count_tables(d.limit(2))).collect()
    assert len(table) == len({r.key for r in table}) == seen.select("key").distinct().count() and all(r.logp < 0 for r in table)


def test_low_quality_goes_and_trusted_text_stays(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    echo = docs(spark, [(900_001, "The " * 800), (900_002, "In. and " * 300)]).select(*d.columns)
    got = quality.judged(d.unionByName(echo), labels)
    assert got.filter("doc_id > 900000 and keep").count() == 0
    share = {r.quality: r.kept for r in got.join(labels.select("doc_id", "quality").distinct(), "doc_id").groupBy("quality").agg(
        F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert share[0] <= 0.03 and share[1] >= 0.93


# ---- toxicity -------------------------------------------------------------------------------
def test_votes_equal_exhaustive_neighbours():
    r = random.Random(8)
    import numpy as np
    vectors = list(toxicity.unit([{t: r.random() for t in r.sample(range(40), r.randint(1, 6))} for _ in range(500)]))
    blocks = -(-500 // toxicity.BLOCK)
    top, lists = np.zeros((40, blocks)), []
    for t in range(40):
        e = np.array([i for i, v in enumerate(vectors) if t in v], np.int64)
        x = np.array([vectors[i][t] for i in e])
        np.maximum.at(top[t], e // toxicity.BLOCK, x)
        lists.append((e, x, np.searchsorted(e, np.arange(blocks + 1) * toxicity.BLOCK)))
    y = np.array([r.random() < 0.3 for _ in vectors], float)
    model = {"top": top, "lists": lists, "y": y, "weight": np.ones(500)}
    for q in vectors[:60]:
        sims = sorted(((-sum(x * v.get(t, 0) for t, x in q.items()), i) for i, v in enumerate(vectors)))
        best = [(-s, i) for s, i in sims[:toxicity.NEAREST] if s < 0]
        want = sum(s * y[i] for s, i in best) / (sum(s for s, _ in best) + toxicity.PRIOR)
        assert math.isclose(toxicity.vote(q, model)[0], want, rel_tol=1e-6)


def test_held_out_accuracy_and_awkward_rows(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    extra = docs(spark, [(900_001, None), (900_002, ""), (None, "you idiot loser scum"), (900_003, "fine words " * 20_000)]).select(*d.columns)
    rows = toxicity.scored_documents(d.unionByName(extra), labels)
    got = rows.join(labels.select("doc_id", "toxic").distinct(), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert right >= 0.95 * len(got)
    assert rows.count() == d.count() + 4
    odd = {r.doc_id: r for r in rows.filter("doc_id >= 900001").collect()}
    assert all(0 <= r.score < 0.5 for r in odd.values())
    assert all((r.predicted == 1) == (r.score >= 0.5) for r in rows.collect())
    assert toxicity.scored_documents(d.limit(0), labels.limit(0)).collect() == []
    assert all(r.predicted == 0 for r in toxicity.scored_documents(d.limit(20), labels.limit(0)).collect())


# ---- fingerprints ---------------------------------------------------------------------------
def test_fingerprints(spark):
    r = random.Random(4)
    words = ["añb%d" % k for k in range(900)]
    rows = [(7 * k, " ".join(r.choice(words) for _ in range(r.randint(0, 260)))) for k in range(80)]
    rows += [(5, None), (6, ""), (None, "a b c"), (None, "d"), (14, rows[2][1]), (9_000_000, rows[3][1]), (8, "x " * 9000), (9, " a  b\tc ")]
    got = fp.fingerprinted(docs(spark, rows)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), tuple(-c for c in x[1].encode()) + (1,)))
    want, by_text = {}, {}
    for k, (i, t) in enumerate(order):
        after, m = order[(k + 1) % len(order)][1], len(t) // 3
        edited = t[:len(t) - m] + after[:m]
        want.setdefault(i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, after))
    text = dict()
    assert len(got) == len(rows)
    sets = lambda t: ({tuple(t.split()[j:j + 5]) for j in range(len(t.split()) - 4)} or ({tuple(t.split())} if t.split() else set()))
    for row in got:
        if row.doc_id in (14, None):
            continue
        (n, sha, t, edited, after), = want[row.doc_id]
        assert (row.n_chars, row.edited_sha256) == (n, sha)
        for a, b, est in ((t, edited, row.near_edited), (t, after, row.near_next)):
            x, y = sets(a), sets(b)
            true = len(x & y) / len(x | y) if x | y else 1.0
            assert abs(est - true) <= (0.2 if len(x | y) > fp.K else 1e-9)
        assert abs(row.shingles - len(sets(t))) <= 0.35 * len(sets(t))
        text.setdefault(t, set()).add(row.fingerprint)
    assert all(len(v) == 1 for v in text.values())
    assert fp.fingerprinted(docs(spark, [])).collect() == []
    assert fp.fingerprinted(docs(spark, [(1, "a b c d e f g")])).first().near_next == 1.0


def test_sketches_merge_and_contain(spark):
    d = spark.createDataFrame([(" ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(200)))], "a string, b string")
    d = fp.with_sketch(fp.with_sketch(d, "a", "sa"), "b", "sb")
    a, b = F.col("sa"), F.col("sb")
    row = d.select(fp.merge(a, b).alias("m"), a, fp.containment(b, a).alias("c"), fp.resemblance(a, b).alias("r")).first()
    assert row.m == row.sa and row.c > 0.85 and abs(row.r - 196 / 396) < 0.15


# ---- language -------------------------------------------------------------------------------
def test_languages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs(spark, [(900_001, None), (900_002, "12 34 !?"), (None, "the of and"), (900_003, "")], None).select(*d.columns)
    got = language.identified(d.unionByName(extra))
    right = got.join(d.select("doc_id", "lang"), "doc_id").filter("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    odd = {r.doc_id: r for r in got.filter("doc_id >= 900001").collect()}
    assert all(r.lang_pred == "und" and r.score == 0.0 for r in odd.values())
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert {r.lang_pred for r in language.identified(extra).collect()} == {"und"}
    assert language.identified(d.limit(0)).collect() == []


def test_unseen_words_fall_back_to_grams():
    model = {"langs": ["a", "b"], "words": {"known": [-1.0, -5.0]}, "grams": {"xyz": [-9.0, -1.0], "x": [-1.0, -3.0]}}
    assert language.predict_text("known", model, {})[0] == "a"
    assert language.predict_text("wxyzw", model, {})[0] == "b"
    assert language.predict_text("qx", model, {})[0] == "a"


def test_keys_are_found_in_their_buckets():
    import numpy as np
    r = np.random.default_rng(4)
    keys = np.unique(np.concatenate((r.integers(0, 1 << 64, 3000, np.uint64), np.uint64(7 << 44) + r.integers(0, 500, 200, np.uint64),
                                     np.array([0, (1 << 64) - 1], np.uint64))))
    wanted = np.concatenate((keys[::2], keys[1::3] + np.uint64(1), r.integers(0, 1 << 64, 100, np.uint64)))
    for held in (keys, keys[:0]):
        place = {k: i for i, k in enumerate(held.tolist())}
        found = quality.positions(held, quality.bucket_starts(held), wanted)
        assert found.tolist() == [place.get(w, -1) for w in wanted.tolist()]


def test_gram_rows_keep_every_character():
    import numpy as np
    texts = ["a\x00b\x00", "", "\U0001f600é\x00", "abcdefgh"]
    points, at = quality.code_points(texts)
    key, start, doc = quality.gram_keys(points, at, np.arange(4).astype(np.uint64))
    rows = quality.gram_rows(points, start, doc, ["x", "x", "y", None], key, np.arange(len(key)), np.ones(len(key)))
    padded = [quality.PAD * (quality.ORDER - 1) + t for t in texts]
    assert rows.column("gram").to_pylist() == [p[k:k + quality.ORDER] for p, t in zip(padded, texts) for k in range(len(t))]
