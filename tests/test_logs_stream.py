import base64
import json

import pytest
from pyspark.sql import functions as F

from helpers import as_set
from matchlake.operators import sessions as SE
from matchlake.sources import deckcodes as DC, logs as LG
from matchlake.streaming.ingest import FactLog, start_ingest

P = LG.PREFIX
ME, OPP = "MEMEME", "OTHER"


def start(mid, ts, event="Play_Brawl_Historic", me=1):
    players = [{"systemSeatId": me, "teamId": me, "playerName": "Tester", "userId": ME},
               {"systemSeatId": 3 - me, "teamId": 3 - me, "playerName": "Rival", "platformId": "PC", "userId": OPP}]
    return P + "==> " + json.dumps({"timestamp": str(ts), "matchGameRoomStateChangedEvent": {"gameRoomInfo": {
        "state": "MatchGameRoomStateType_Playing",
        "gameRoomConfig": {"matchId": mid, "eventId": event, "reservedPlayers": players}}}})


def turn(n, active, **more):
    return P + json.dumps({"greToClientEvent": {"greToClientMessages": [
        {"gameStateMessage": {"turnInfo": {"turnNumber": n, "activePlayer": active}, **more}}]}})


def result(entries, mid=None):
    body = {"resultList": [{"scope": f"MatchScope_{s}", "winningTeamId": w, "reason": "ResultReason_Concede"}
                           for s, w in entries]}
    return P + json.dumps({"finalMatchResult": {**({"matchId": mid} if mid else {}), **body}})


def done(ts):
    return P + json.dumps({"timestamp": str(ts), "matchGameRoomStateChangedEvent": {"gameRoomInfo": {
        "state": "MatchGameRoomStateType_MatchCompleted"}}})


def mull(kind):
    return P + json.dumps({"mulliganResp": {"decision": f"MulliganOption_{kind}"}})


T = 1788599000000


def facts(spark, lines, chunk=3):
    rows = [("f", i // chunk, i, t) for i, t in enumerate("\n".join(lines).split("\n"))]
    df = spark.createDataFrame(rows, "file string, chunk long, pos long, text string")
    p = LG.parse_payloads(LG.assemble_records(df)).withColumn("owner", F.lit("o"))
    return {k: v.collect() for k, v in SE.rebuild_facts(p).items() if k in (
        "matches", "games", "mulligans", "commanders", "ranks", "orphans")}


@pytest.mark.parametrize("chunk", [2, 100])
def test_best_of_three(spark, chunk):
    f = facts(spark, [start("m", T, "Traditional_Ladder"), turn(1, 2), turn(2, 1), result([("Game", 2)], "m"), turn(1, 1),
                      turn(2, 2), result([("Game", 1)], "m"), result([("Match", 1)], "m"), done(T + 9000)], chunk)
    m = f["matches"][0]
    assert (m.my_result, m.play_draw, m.total_turns, m.duration_sec, m.opponent_name) == ("win", "draw", 2, 9.0, "Rival")
    assert sorted((g.game_no, g.result, g.play_draw) for g in f["games"]) == [(1, "loss", "draw"), (2, "win", "play")]


def test_game_that_ends_on_turn_one_opens_the_next(spark):
    f = facts(spark, [start("m", T), turn(1, 1), result([("Game", 1)], "m"), turn(1, 2), done(T)])
    assert sorted((g.game_no, g.play_draw) for g in f["games"]) == [(1, "play"), (2, "draw")]


def test_results_follow_their_id(spark):
    f = facts(spark, [start("a", T), turn(1, 1), done(T + 1), start("b", T + 2), result([("Match", 2)], "a"),
                      result([("Match", 2)], "a"), result([("Match", 1)], "b"), done(T + 5), result([("Match", 1)], "zz")])
    assert {m.match_id: m.my_result for m in f["matches"]} == {"a": "loss", "b": "win"}
    assert [o.match_id for o in f["orphans"]] == ["zz"]


def test_legacy_result_goes_to_last_closed_if_undecided(spark):
    f = facts(spark, [start("a", T), done(T + 1), result([("Match", 1)])])
    assert f["matches"][0].my_result == "win"
    f = facts(spark, [start("a", T), result([("Match", 2)]), done(T + 1), result([("Match", 1)])])
    assert f["matches"][0].my_result == "loss"


def test_late_legacy_block_is_ignored_once_decided(spark):
    f = facts(spark, [start("a", T), turn(1, 1), result([("Match", 1), ("Game", 1)]), done(T + 1), result([("Match", 2), ("Game", 2)])])
    assert f["matches"][0].my_result == "win"
    assert [(g.game_no, g.result) for g in f["games"]] == [(1, "win")]


def test_two_players_in_one_match(spark):
    lines = {"A": [start("m", T), turn(1, 1), result([("Match", 1)], "m"), done(T + 1)],
             "B": [start("m", T, me=2), turn(1, 1), result([("Match", 1)], "m"), done(T + 1)]}
    rows = [(o, 0, i, x, o) for o, ls in lines.items() for i, x in enumerate(ls)]
    df = spark.createDataFrame(rows, "file string, chunk long, pos long, text string, owner string")
    p = LG.parse_payloads(LG.assemble_records(df)).withColumn("owner", F.col("file"))
    out = SE.rebuild_facts(p, spark.createDataFrame([("A", ME), ("B", ME)], "owner string, my_user string"))
    assert {(m.player_id, m.my_result) for m in out["matches"].collect()} == {("A", "win"), ("B", "loss")}
    assert {(g.player_id, g.play_draw) for g in out["games"].collect()} == {("A", "play"), ("B", "draw")}


def test_unclosed_records_keep_every_line(spark, monkeypatch):
    text = [P + '{"broken": [1,', '"timestamp": "1788599000123",', '"userId": "ME",', "tail", P + '{"ok":1}']
    df = spark.createDataFrame([("f", i // 2, i, x) for i, x in enumerate(text)], "file string, chunk long, pos long, text string")
    rec = {r.pos: r for r in LG.assemble_records(df).collect()}
    assert rec[0].text == "\n".join(text[:4]) and not rec[0].closed and rec[0].lines == 4
    assert {r.pos: r.ts for r in LG.carry_timestamps(LG.assemble_records(df)).collect()}[4] == 1788599000123
    monkeypatch.setattr(LG, "UNCLOSED_LINES", 3)
    cut = sorted((r.pos, r.text) for r in LG.assemble_records(df).filter("not closed").collect())
    assert cut == [(0, "\n".join(text[:3])), (3, "tail")]


def test_mulligans_and_commanders(spark):
    zone = {"zones": [{"type": "ZoneType_Command", "ownerSeatId": 2, "objectInstanceIds": [1, 2, 3]}],
            "gameObjects": [{"instanceId": 1, "grpId": 10, "type": "GameObjectType_Card"}, {"instanceId": 2, "grpId": 11},
                            {"instanceId": 3, "grpId": 2, "type": "GameObjectType_Emblem"}]}
    f = facts(spark, [start("m", T), mull("Mulligan"), mull("Mulligan"), mull("AcceptHand"), turn(1, 1, **zone),
                      turn(2, 2, **zone), done(T)])
    assert [(r.game_no, r.seat, r.kept_on) for r in f["mulligans"]] == [(1, 1, 2)]
    assert sorted((c.seat, c.grp_id, c.partner_idx) for c in f["commanders"]) == [(2, "10", 0), (2, "11", 1)]


def test_records_resynchronise(spark):
    text = [P + '{"a": {', '  "s": "brace } in string {"', "}}", P + '{"broken": [', "tail", P + '{"ok":1}', "}", "  ", "plain"]
    rows = [("f", i // 2, i, t) for i, t in enumerate(text)]
    rec = LG.assemble_records(spark.createDataFrame(rows, "file string, chunk long, pos long, text string"))
    got = [(r.pos, r.lines, r.closed) for r in rec.orderBy("pos").collect()]
    assert got == [(0, 3, True), (3, 2, False), (5, 1, True), (6, 1, True), (8, 1, True)]


def test_several_objects_in_one_record(spark):
    rows = [("f", 0, 0, 'x {"a":1} and {"constructedClass":"Gold","constructedLevel":2}'), ("f", 0, 1, "{bad json}")]
    p = LG.parse_payloads(spark.createDataFrame(rows, "file string, chunk long, pos long, text string")).collect()
    assert [x.p.constructedClass for x in p if x.pos == 0] == [None, "Gold"]
    assert [x.bad for x in p if x.pos == 1] == [True]


def test_deck_code_rejects(spark):
    ok = "AAIBBQEDAAAAAAA"
    codes = [None, "", "!!!", ok[:-3], ok + "AA", "AQIA", ok, "x" * 100_001]
    got = {r.code: r.cards for r in DC.decode_codes(spark.createDataFrame([(c,) for c in codes], "code string"), "code").collect()}
    assert [tuple(c) for c in got.pop(ok)] == [("commanders", 0, 5, 1), ("main", 1, 3, 1)]
    assert len(got) == 6 and set(got.values()) == {None}


def test_long_deck_codes_are_read_in_one_pass(spark):
    number = lambda n: bytes([n % 128 + 128]) + number(n // 128) if n > 127 else bytes([n])
    singles = [0, 2, 0, 700, *[3] * 700, 0, 0, 0, 0, 0]
    code = base64.urlsafe_b64encode(b"".join(map(number, singles))).decode().rstrip("=")
    got = {r.code: r.cards for r in DC.decode_codes(spark.createDataFrame([(code,), ("A" * 40_000,), ("_" * 40_000,)], "code string"), "code").collect()}
    assert [(c.section, c.pos, c.title_id, c.qty) for c in got[code]] == [("main", i, 3 * i + 3, 1) for i in range(700)]
    assert got["A" * 40_000] is None and got["_" * 40_000] is None


def test_copies_are_told_by_owner_and_contents(spark, tmp_path):
    texts = {"a/live/x.log": "one\ntwo\n", "a/kept/x.log": "one\ntwo\n", "b/live/x.log": "two\none\n", "b/kept/x.log": "six\none\n",
             "c/live/x.log": "one\ntwo\n", "c/live/y.log": "one\ntwo\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    dirs = [f"{tmp_path}/*/live", f"{tmp_path}/*/kept"]
    owner = F.regexp_extract("path", "/([abc])/(live|kept)/", 1)
    lines = LG.distinct_logs(spark, dirs, owner)
    got = lines.select(F.regexp_extract("file", "/([abc]/.*)$", 1).alias("f"), "text").collect()
    assert sorted({r.f for r in got}) == ["a/live/x.log", "b/kept/x.log", "b/live/x.log", "c/live/x.log", "c/live/y.log"]
    assert len(got) == 10
    alone = LG.distinct_logs(spark, [f"{tmp_path}/c/live"], owner)
    assert alone.count() == 4


def test_stream_late_result_and_restart(spark, tmp_path):
    landing, root, cp = tmp_path / "in", tmp_path / "facts", tmp_path / "cp"
    landing.mkdir()

    def run():
        start_ingest(spark, str(landing), str(root), str(cp), F.lit("o")).awaitTermination()
        return FactLog(spark, str(root))

    (landing / "1.log").write_text("\n".join([start("a", T), turn(1, 1), done(T + 1000), P + '{"broken": [']) + "\n")
    log = run()
    assert [(r.match_id, r.my_result) for r in log.current()["matches"].collect()] == [("a", None)]
    (landing / "2.log").write_text("\n".join([result([("Match", 1)], "a"), start("b", T + 5000), done(T + 6000)]) + "\n")
    log = run()
    want = {"a": "win", "b": None}
    assert {r.match_id: r.my_result for r in log.current()["matches"].collect()} == want
    before = as_set(log.current()["matches"])
    assert as_set(run().current()["matches"]) == before  # nothing new, nothing changed
    log.compact()
    assert log.snapshot() == 1 and {r.match_id: r.my_result for r in log.current()["matches"].collect()} == want
    assert spark.read.parquet(f"{root}/quarantine").count() == 1


def parsed(spark, lines):
    df = spark.createDataFrame([("f", 0, i, t) for i, t in enumerate(lines)], "file string, chunk long, pos long, text string")
    return LG.parse_payloads(LG.assemble_records(df)).withColumn("owner", F.lit("o"))


def test_events_leave_their_text_behind_and_lie_by_kind(spark):
    events = SE.segment(parsed(spark, [start("m", T), turn(1, 1), done(T + 9), P + '{"constructedClass":"Gold"}']))
    assert "text" not in events.columns
    assert {f.split("kind=")[1].split("/")[0] for f in events.inputFiles() if "kind=" in f} == {
        str(sum(SE.BITS[n] for n in names)) for names in (["start", "roster"], ["state"], ["completion"], ["rank"])}
    assert [r.user_id for r in SE.votes_from(events).orderBy("user_id").collect()] == [ME, OPP]


def test_very_long_strings_are_read(spark):
    long = 'a{\\"' * 60_000
    row = parsed(spark, [P + '{"finalMatchResult":{"matchId":"m","resultList":[]}} {"note":"%s"}' % long]).orderBy("part").collect()
    assert [(r.part, r.bad) for r in row][0] == (0, False) and row[0].p.finalMatchResult.matchId == "m"


@pytest.mark.parametrize("text, body, several", [
    ('a {"x":1} b', '{"x":1}', False), ("} {", "", False), ("none", "", False), ('{"a":"}x{"}', '{"a":"}x{"}', False),
    ('{"a":1} {"b":2}', '{"a":1} {"b":2}', True), ('é{"a":{"b":1},"c":"é}y"} z', '{"a":{"b":1},"c":"é}y"}', False), (None, None, None)])
def test_braced_texts(spark, text, body, several):
    row = spark.createDataFrame([(text,)], "t string").select(LG.braced(F.col("t")).alias("b")).select("b", LG.has_several(F.col("b")).alias("s")).first()
    assert (row.b, row.s) == (body, several)


@pytest.mark.parametrize("chunk", [1, 2, 3, 50])
def test_depths_follow_the_lines_one_by_one(spark, chunk):
    import random

    rng = random.Random(7)
    lines = [rng.choice([P, P, ""]) + rng.choice(["{", "}", "{}", "{{", "}}", "x", '"{"', "}{"]) + str(i) for i in range(120)]
    want, current, depth = [], [], 0
    for i, t in enumerate(lines):
        if t.startswith(P) and current:
            want.append((current[0], len(current), False))
            current, depth = [], 0
        bare = t.replace('"{"', "")
        depth = max(0, depth + bare.count("{") - bare.count("}"))
        current.append(i)
        if depth == 0:
            want.append((current[0], len(current), True))
            current = []
    want += [(current[0], len(current), False)] if current else []
    df = spark.createDataFrame([("f", i // chunk, i, t) for i, t in enumerate(lines)], "file string, chunk long, pos long, text string")
    got = LG.assemble_records(df).select("pos", "lines", "closed").collect()
    assert sorted(tuple(r) for r in got) == want


def most_tasks(spark, group, work):
    """Tasks of the largest stage of the work."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    out = work()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds]
    return max((s.numTasks for s in stages if s), default=0), out


def test_many_small_logs_are_read_by_few_tasks(spark, tmp_path):
    for i in range(90):
        (tmp_path / f"owner={i}").mkdir()
        (tmp_path / f"owner={i}" / "a.log").write_text(start(f"m{i}", T) + "\n")
    tasks, records = most_tasks(spark, "many-logs", lambda: LG.assemble_records(
        LG.distinct_logs(spark, [f"{tmp_path}/*"], F.regexp_extract("path", "owner=([^/]+)/", 1))))
    assert tasks <= 16 and records.count() == 90
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_a_stream_reads_many_small_logs_by_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / "in" / f"owner={i}").mkdir(parents=True)
        (tmp_path / "in" / f"owner={i}" / "a.log").write_text(start(f"m{i}", T) + "\n")
    query = start_ingest(spark, f"{tmp_path}/in/*", f"{tmp_path}/facts", f"{tmp_path}/checkpoint", F.regexp_extract("file", "owner=([^/]+)/", 1))
    query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 16
    assert FactLog(spark, f"{tmp_path}/facts").raw("starts").count() == 60
