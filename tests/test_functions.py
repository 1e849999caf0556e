from datetime import date

import pytest
from pyspark.sql import functions as F

from matchlake.functions import classify as C, event_labels as L
from matchlake.functions.tests_of_chance import _tail, fair_binomial_two_sided, p_to_score
from matchlake.functions.winrate import rate_columns
from matchlake.functions.tests_of_chance import no_run_probability
from matchlake.scope import Scope, range_bounds


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_win_rate_known_values(spark):
    r = one(spark, *rate_columns(F.lit(7), F.lit(10)))
    assert (r.wr, r.lo, r.hi) == (70.0, 39.7, 89.2)
    r = one(spark, *rate_columns(F.lit(0), F.lit(0)))
    assert (r.wr, r.lo, r.hi) == (None, 0.0, 0.0)
    r = one(spark, *rate_columns(F.lit(4), F.lit(4)))
    assert r.hi == 100.0 and r.lo > 50


def test_range_bounds():
    today = date(2024, 1, 20)
    assert range_bounds("week", today) == (date(2024, 1, 15), today)
    assert range_bounds("month", today)[0] == date(2024, 1, 1)
    assert range_bounds("all", today) is None
    with pytest.raises(ValueError):
        range_bounds("sometime", today)
    with pytest.raises(ValueError):
        Scope(range="week").selection()


def test_rank_scores(spark):
    cases = [("Bronze", 4, 1), ("Bronze", 1, 4), ("Silver", 4, 5), ("Diamond", 1, 20), ("Mythic", 9, 21),
             ("Gold", 5, None), ("Nope", 1, None)]
    df = spark.createDataFrame(cases, "c string, l int, want int")
    assert all(r.got == r.want for r in df.withColumn("got", C.rank_score("c", "l")).collect())


def test_event_rules(spark):
    cases = {
        "MWM_Pauper_20240101": ("weekly", True, "unknown"), "MWM_Momir_1": ("weekly", False, "unknown"),
        "Play_Brawl_Historic": ("brawl", False, "BO1"), "QuickDraft_X_1": ("draft", False, "BO1"),
        "TradDraft_X_1": ("draft", False, "BO3"), "Traditional_Ladder": ("ladder", True, "BO3"),
        "Historic_Play": ("play", True, "unknown"), "Constructed_Event_2": ("constructed", True, "unknown"),
        "Decathlon2024_1_Standard": ("other", True, "unknown"), "Constructed_BestOf3": ("other", True, "BO3"),
        "": ("other", False, "unknown"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "event_key string")
    got = df.select("event_key", C.event_family(), C.is_constructed_event(), C.match_mode()).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in got} == cases


def test_event_labels(spark):
    cases = {
        "Ladder": "标准排位", "Traditional_Historic_Play": "传统史迹自由对战",
        "PickTwoDraft_HOB_20260811": "选两张轮抽 · 霍比特人 · 2026-08-11",
        "Decathlon2024_3_MOMConstructed_20240102": "十项全能 2024 · 第 3 项 · 邪军压境构筑 · 2024-01-02",
        "Explorer_Event": "探险构筑赛", "Unknown_Thing": "Unknown_Thing", "(unknown)": "赛事未记录",
    }
    df = spark.createDataFrame([(k,) for k in cases], "event_key string")
    assert {r[0]: r[1] for r in df.select("event_key", L.friendly_event()).collect()} == cases
    over = spark.createDataFrame([("Ladder", " mine ")], "event_key string, label string")
    assert L.with_event_labels(df, over).filter("event_key = 'Ladder'").first().event_label == "mine"


def test_run_bands(spark):
    df = spark.createDataFrame([(7, 7, 4), (6, 7, 6), (4, 7, 4), (2, 7, 4), (0, 7, 4)], "w int, c int, e int")
    assert [r[0] for r in df.select(C.run_band("w", "c", "e")).collect()] == ["cap", "near", "even", "low", "bust"]


def test_names_and_cells(spark):
    df = spark.createDataFrame([("A-Foo // Bar",), ("Foo /// Bar",), ("a- x",), ("Foo",)], "n string")
    assert [r[0] for r in df.select(C.front_face("n")).collect()] == ["Foo", "Foo", "x", "Foo"]
    df = spark.createDataFrame([("=1",), ("\u200b+1",), (" ok ",), ("-",), (None,)], "v string")
    assert [r[0] for r in df.select(C.csv_safe("v")).collect()] == ["'=1", "'+1", "ok", "'-", ""]


def no_run_reference(length, streak):
    """Brute force over all sequences."""
    hit = sum("1" * streak in format(x, f"0{length}b") for x in range(2 ** length))
    return 1 - hit / 2 ** length


def test_csv_safe_strips_unicode_blanks(spark):
    from matchlake.functions.classify import csv_safe
    for blank in (" ", "\u3000", "\u00a0", "\t"):
        assert one(spark, csv_safe(F.lit(blank + "=1+1" + blank)).alias("v")).v == "'=1+1"


def test_scan_probability(spark):
    cases = [(n, k) for n in range(1, 13) for k in range(1, 8)]
    df = spark.createDataFrame(cases, "n int, k int")
    got = df.withColumn("q", no_run_probability(F.col("n"), F.col("k"))).collect()
    for r in got:
        assert r.q == pytest.approx(no_run_reference(r.n, r.k) if r.k <= r.n else 1.0, abs=1e-12)
    assert 1 - one(spark, no_run_probability(F.lit(8), F.lit(7)).alias("q")).q == pytest.approx(3 / 256)
    # extension past the exact steps agrees with the plain recurrence
    q = [1.0] * 9 + [1 - 0.5 ** 9]
    for _ in range(10, 5001):
        q.append(q[-1] - 0.5 ** 10 * q[-10])
    assert one(spark, no_run_probability(F.lit(5000), F.lit(9)).alias("q")).q == pytest.approx(q[5000], rel=1e-9)


def test_binomial_and_tails(spark):
    from math import comb
    df = spark.createDataFrame([(3, 10), (0, 5), (40, 100), (5, 10), (480, 1000)], "k long, n long")
    for r in df.withColumn("p", fair_binomial_two_sided("k", "n")).collect():
        low = min(r.k, r.n - r.k)
        want = min(1.0, 2 * sum(comb(r.n, i) for i in range(low + 1)) / 2 ** r.n)
        assert r.p == pytest.approx(want, rel=1e-9)
    assert _tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert _tail(5.991464547107979, 2) == pytest.approx(0.05, rel=1e-9)
    assert _tail(11.070497693516351, 5) == pytest.approx(0.05, rel=1e-9)
    scores = one(spark, p_to_score(F.lit(0.2)).alias("a"), p_to_score(F.lit(1e-5)).alias("b"),
                 p_to_score(F.lit(0.01)).alias("c"))
    assert (scores.a, scores.b, scores.c) == (50.0, 100.0, 66.7)
