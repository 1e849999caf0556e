from datetime import date

import pytest

from helpers import BASE, DAY_MS, as_set, matches, results, row, sides
from matchlake.operators import compare as P, facts as X, report as RP
from matchlake.operators.matchups import match_set_summary
from matchlake.operators.sequences import loss_streaks


def kinds(df):
    return {r.kind: r for r in df.collect()}


def test_comparison_needs_history(spark):
    then = [row(i, start_time=BASE + i * 1000) for i in range(20)]
    now = [row(100 + i, start_time=BASE + 40 * DAY_MS + i * 1000, my_result="loss") for i in range(3)]
    rows = matches(spark, then + now)
    cur, old = P.window_periods(date(2024, 2, 10), 5)
    r = P.stratified(rows, cur, old, ["player_id"]).first()
    assert (r.delta_pp, r.usable, r.baseline_n) == (-100.0, True, 20)
    r = P.stratified(rows.filter("match_id <> 0"), cur, old, ["player_id"]).first()
    assert (r.delta_pp, r.usable) == (None, False)
    item = P.by_event(P.stratified(rows, cur, old, ["player_id"]), ["player_id"]).first()
    assert (item.status, item.headline) == ("lower", True)


def scenario(player, rows):
    return [dict(r, player_id=player, match_id=player * 1000 + r["match_id"]) for r in rows]


SIDE = {"P": "play", "D": "draw"}
RESULT = {"w": "win", "l": "loss"}
PAST = [row(i, start_time=BASE + i * DAY_MS, my_result="loss", opponent_name="Ann", commanders=["7"]) for i in range(3)]
TODAY = [row(50 + i, start_time=BASE + 300 * DAY_MS + i * 1000, my_result=r, opponent_name="Ann", commanders=["7"])
         for i, r in enumerate(["win", "loss"])]
SCENARIOS = {
    1: [row(0)],
    2: [row(i, play_draw=SIDE[c]) for i, c in enumerate("DDDD")],
    3: [row(i, play_draw=SIDE[c]) for i, c in enumerate("DDPDD")],
    4: [row(i, my_result="win" if i % 4 else "loss", play_draw="play" if i % 3 else "draw") for i in range(20)],
    5: [row(i, my_result=RESULT[c], duration_sec=30.0) for i, c in enumerate("lllwww")],
    6: PAST + TODAY,
    7: TODAY,
    8: [row(i, start_time=BASE + (i // 99) * DAY_MS + i) for i in range(102)],
    9: [row(i, opponent_name="Bob", commanders=["9"]) for i in range(3)],
}


@pytest.fixture(scope="module")
def told(spark):
    """All scenarios in one job: player -> day -> kind -> row."""
    rows = [r for p, rs in SCENARIOS.items() for r in scenario(p, rs)]
    out = {}
    for r in X.fact_candidates(matches(spark, rows)).collect():
        out.setdefault(r.player_id, {}).setdefault(str(r.play_day), {})[r.kind] = r
    return out


def test_single_match_day(told):
    got = told[1]["2024-01-01"]
    assert set(got) == {"single"} and got["single"].detail == "win"


def test_hot_day_and_side_streak(told):
    got = told[2]["2024-01-01"]
    assert got["hot_wr"].level == "legendary" and got["play_draw_streak"].n == 4
    assert "pd_skew" not in got  # the streak already covers it
    assert told[3]["2024-01-01"]["pd_skew"].n == 4


def test_marathon_drops_weak_signals(told):
    got = told[4]["2024-01-01"]
    assert got["volume"].level == "legendary" and "hot_wr" not in got and "pd_skew" not in got


def test_arc_and_blitz(told):
    got = told[5]["2024-01-01"]
    assert got["arc"].detail == "comeback:3:3" and got["blitz"].n == 6


def test_history_facts_use_only_earlier_days(told):
    got = told[6]["2024-10-27"]
    assert "revenge" in got and "nemesis" in got and got["rare_commander"].detail == "298"
    assert 7 not in told  # the same day without a past tells nothing


def test_milestone(told):
    assert {d: k["milestone"].detail for d, k in told[8].items() if "milestone" in k} == {"2024-01-02": "100"}


def test_repeat_opponent_and_card_run(told):
    got = told[9]["2024-01-01"]
    assert got["repeat_opponent"].detail == "Bob"
    assert (got["repeat_commander"].level, got["repeat_commander"].n) == ("legendary", 3)


def test_slots_and_freshness(spark):
    busy = scenario(1, [row(i, play_draw="draw", opponent_name="Bob", commanders=["9"]) for i in range(6)])
    week = scenario(2, [row(d * 10 + i, start_time=BASE + d * DAY_MS + i * 1000) for d in range(9) for i in range(4)])
    picked = X.daily_facts(matches(spark, busy + week)).collect()
    mine = [r for r in picked if r.player_id == 1]
    assert len(mine) == 2 and len({r.theme for r in mine}) == 2
    seen = {str(r.play_day): r.seen for r in picked if r.player_id == 2 and r.kind == "hot_wr"}
    assert seen["2024-01-01"] == 0 and seen["2024-01-02"] == 1 and seen["2024-01-09"] == 7


def test_summary_invariants(spark):
    rows = results(spark, "wl?wwl", mulligan=True)
    s = match_set_summary(rows, loss_streaks(rows, ["player_id"]), ["player_id"]).first()
    assert s.play + s.draw + s.unknown_side == s.matches == 6
    assert (s.wins, s.losses, s.unknown_result, s.mulligan_yes) == (3, 2, 1, 6)
    assert s.lo <= s.wr <= s.hi


def test_range_report_has_no_facts(spark):
    rows = results(spark, "wlw")
    assert "facts" not in RP.day_report(rows, date(2024, 1, 1), date(2024, 1, 2))
    assert "facts" in RP.day_report(rows, date(2024, 1, 1), date(2024, 1, 1))
