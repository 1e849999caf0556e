"""Streaks, runs and curves: known values, and equality of the chunked and the plain path."""
import random

import pytest
from pyspark.sql import functions as F

from helpers import BASE, DAY_MS, as_set, matches, results, row, sides
from matchlake.operators import ordered as OR, runs as R, sequences as S

P = ["player_id"]


def test_side_streak_values(spark):
    r = S.side_streaks(sides(spark, "PP?PDDD"), P).first()
    assert (r.longest_play, r.longest_draw, r.current_side, r.current_n) == (2, 3, "draw", 3)
    r = S.side_streaks(sides(spark, "PP?"), P).first()
    assert (r.current_side, r.current_n, r.reason) == (None, 0, "last side unknown")


def test_ties_and_unknown_dates(spark):
    rows = [row(0), row(1), row(2, start_time=BASE + 60_000), row(3)]
    r = S.side_streaks(matches(spark, rows), P).first()
    assert (r.longest_play, r.ambiguous_order) == (1, True)
    r = S.side_streaks(matches(spark, rows + [row(9, start_time=None)]), P).first()
    assert r.longest_play is None and r.reason == "undated rows"


def test_streak_observation_probability(spark):
    obs = {r.side: r for r in S.streak_observations(sides(spark, "PPP?DDD"), P).collect()}
    assert obs["play"].scan == pytest.approx(15 / 64) and obs["play"].blocks == 2
    assert (obs["draw"].length, obs["draw"].known) == (3, 6)


def test_loss_streak(spark):
    assert S.loss_streaks(results(spark, "wll?lllw"), P).first().max_loss_streak == 3


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        rows.append(row(i, player_id=1 if i % 3 else 2 + i % 5, start_time=BASE + rng.randrange(20 * DAY_MS),
                        play_draw=rng.choice(["play", "draw", "play", None]),
                        my_result=rng.choice(["win", "win", "loss", None]),
                        event_key=rng.choice(["QuickDraft_A_1", "PickTwoDraft_B_2", "Ladder"]),
                        my_deck_id=rng.choice(["x", None]), my_deck_version=rng.choice(["v1", "v2", "v2", None])))
    return matches(spark, rows).cache()


@pytest.mark.parametrize("target", [7, 60, 500])
def test_chunked_equals_plain(history, target):
    for make in (lambda n: S.side_streaks(history, P, n), lambda n: S.loss_streaks(history, P, n),
                 lambda n: S.version_changes(history, P, n)):
        assert as_set(make(target)) == as_set(make(10**9))


def test_chunked_observations_equal_plain(history):
    cols = ["player_id", "side", "length", "first_id", "last_id", "blocks", "known", F.round("scan", 9)]
    assert as_set(S.streak_observations(history, P, 3, 50).select(*cols)) == as_set(
        S.streak_observations(history, P, 3, 10**9).select(*cols))


def brute_runs(rows):
    from collections import defaultdict
    caps = {"QuickDraft_A_1": (7, 3), "PickTwoDraft_B_2": (4, 2)}
    state, out = defaultdict(lambda: [0, 0, 0]), []
    for r in sorted(rows, key=lambda r: (r.start_time, r.match_id)):
        if r.event_key not in caps or r.my_result is None:
            continue
        key = (r.player_id, r.event_key, r.my_deck_id or "")
        s = state[key]
        s[0] += r.my_result == "win"
        s[1] += r.my_result == "loss"
        if s[0] >= caps[r.event_key][0] or s[1] >= caps[r.event_key][1]:
            s[2] += 1
            out.append((*key, s[2], s[0], s[1], r.match_id))
            s[0] = s[1] = 0
    return sorted(map(str, out))


@pytest.mark.parametrize("fold,block", [(20_000, 1000), (9, 4), (40, 2)])
def test_capped_runs_equal_brute_force(history, fold, block):
    got = R.capped_runs(history, fold, block).select(*R.KEYS, "run_no", "wins", "losses", "end_match").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_runs(history.collect())


def test_capped_run_members_are_complete(history):
    plain = as_set(R.capped_run_members(history))
    assert as_set(R.capped_run_members(history, 11, 3)) == plain
    sizes = R.capped_run_members(history).groupBy(*R.KEYS, "run_no").count()
    both = sizes.join(R.capped_runs(history), [*R.KEYS, "run_no"])
    assert both.filter("count <> n").count() == 0 and both.count() == sizes.count()


def test_known_runs(spark):
    rows = results(spark, "wwlwwlwww" + "wlll", event_key="QuickDraft_A_1")
    got = [(r.wins, r.losses, r.band) for r in R.capped_runs(rows).orderBy("run_no").collect()]
    assert got == [(7, 2, "cap"), (1, 3, "low")]


def test_rank_curve(spark):
    data = [("Gold", 4), ("Gold", 4), ("Gold", 2), ("Nope", 1), ("Mythic", 1), ("Gold", 4)]
    df = spark.createDataFrame([(i, 1, 1000 + i, c, l, None, None) for i, (c, l) in enumerate(data)],
                               "id long, player_id long, ts long, constructed_class string, constructed_level int, "
                               "limited_class string, limited_level int")
    for target in (2, 10**9):
        assert [r.score for r in S.rank_curve(df, target_rows=target).orderBy("ts").collect()] == [9, 11, 21, 9]


def test_running_scan_matches_plain_window(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([("f", i // 13, i, rng.randrange(-3, 4)) for i in range(400)],
                               "file string, chunk long, pos long, v int")
    out = OR.running(df, ["file"], "chunk", ["pos"], sums={"s": F.col("v")}, mins={"m": F.col("v")},
                     lasts={"l": F.when(F.col("v") > 2, F.col("v"))}).orderBy("pos").collect()
    total, low, last = 0, 99, None
    for r in out:
        total, low, last = total + r.v, min(low, r.v), r.v if r.v > 2 else last
        assert (r.s, r.m, r.l) == (total, low, last)


def test_chunks_are_cut_by_rows(spark):
    """One undated row, a far outlier and a burst: no chunk holds more than twice the target, order is kept."""
    from matchlake.operators.ordered import CHUNK, chunked
    day = 86_400_000
    times = [0, 5 * day, *[19_000 * day + i * 1000 for i in range(6000)], *[19_001 * day + i * 3_600_000 for i in range(500)]]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)] + [(2, i, i) for i in range(20)], "k long, id long, t long")
    got = chunked(df, ["k"], "t", 200).filter("k = 1").orderBy("t").select("t", CHUNK).collect()
    sizes = {}
    for r in got:
        sizes[r[1]] = sizes.get(r[1], 0) + 1
    assert sizes[0] == 1 and max(sizes.values()) <= 400 and len(sizes) >= len(times) // 400
    assert [r[1] for r in got] == sorted(r[1] for r in got)
    assert chunked(df, ["k"], "t", 200).filter(f"k = 2 and {CHUNK} <> 0").count() == 0


def test_undated_rows_are_cut_evenly(spark):
    """All rows of a heavy player undated, a light player beside: consecutive chunks of at most twice the target."""
    rng = random.Random(9)
    rows = [row(i, start_time=None if i % 3 else 0, my_result=rng.choice(["win", "loss"]), event_key="QuickDraft_A_1") for i in range(600)]
    rows += [row(1000 + i, player_id=2, start_time=None, event_key="QuickDraft_A_1") for i in range(20)]
    rows += [row(2000 + i, my_result="win", event_key="QuickDraft_A_1") for i in range(30)]
    df = matches(spark, rows)
    cut = OR.chunked(df, P, "start_time", 60, "match_id")
    got = {(r.player_id, r[OR.CHUNK]): (r.n, r.lo, r.hi, r.dated) for r in cut.groupBy("player_id", OR.CHUNK).agg(
        F.count(F.lit(1)).alias("n"), F.min("match_id").alias("lo"), F.max("match_id").alias("hi"), F.max(F.coalesce("start_time", F.lit(0))).alias("dated")).collect()}
    heavy = [v for k, v in sorted(got.items()) if k[0] == 1]
    assert max(v[0] for v in heavy) <= 120 and sum(v[0] for v in heavy) == 630 and got[2, 0][0] == 20
    assert [k[1] for k in sorted(got) if k[0] == 1] == list(range(len(heavy)))
    assert all(a[2] < b[1] for a, b in zip(heavy, heavy[1:])) and [v[3] > 0 for v in heavy] == [False] * (len(heavy) - 1) + [True]
    names = [*R.KEYS, "run_no", "wins", "losses", "end_match"]
    assert as_set(R.capped_runs(df, 60, 3).select(*names)) == as_set(R.capped_runs(df).select(*names))
