"""Session-log queries: log text is rendered from ``events``, read back through the pipeline, and the
recovered facts are compared with ``events`` itself."""
from pyspark.sql import functions as F

from ..operators import sessions as SE
from ..sources import logs as LG
from ..session import scratch_dir, stored
from .catalog import CNT, cnt, query
from .views import DUCK, EVENTS_DUCK, SPARK, match_columns

_BO3 = "(event_key='Traditional_Ladder' and my_result is not null and play_draw is not null)"
_LATE = "(match_id%9=0 and match_id%17<>0)"
_P = LG.PREFIX

_W = "(case my_result when 'win' then 1 else 2 end)"
_WHY = "(case when K%8=0 then 'Concede' else 'Game' end)"
_ID = "case when match_id%17=0 then '' else concat('\"matchId\":\"', match_id, '\",') end"
_FINAL = (f"concat('{_P}{{\"finalMatchResult\":{{', {_ID}, '\"resultList\":[{{\"scope\":\"MatchScope_Match\",\"winningTeamId\":', {_W}, "
          f"',\"reason\":\"ResultReason_', {_WHY}, '\"}}', case when {_BO3} then '' else concat(',{{\"scope\":\"MatchScope_Game\","
          f"\"winningTeamId\":', {_W}, ',\"reason\":\"ResultReason_', {_WHY}, '\"}}') end, ']}}}}')")
_TURN = (f"concat('{_P}{{\"greToClientEvent\":{{\"greToClientMessages\":[{{\"gameStateMessage\":{{\"turnInfo\":{{\"turnNumber\":', {{n}}, "
         f"',\"activePlayer\":', {{a}}, '}}', {{more}}, '}}}}]}}}}')")
_ZONES = ("case when contains(event_key,'Brawl') then concat(',\"zones\":[{\"type\":\"ZoneType_Hand\",\"ownerSeatId\":1},{\"type\":"
          "\"ZoneType_Command\",\"objectInstanceIds\":[101,102,103]}],\"gameObjects\":[{\"instanceId\":101,\"grpId\":', K%40, "
          "',\"ownerSeatId\":2,\"type\":\"GameObjectType_Card\"},{\"instanceId\":102,\"grpId\":2,\"ownerSeatId\":2,\"type\":"
          "\"GameObjectType_Emblem\"},{\"instanceId\":103,\"grpId\":', K%30+100, ',\"ownerSeatId\":1}]') else '' end")


def _turn(n, a, more="''"):
    return _TURN.replace("{n}", n).replace("{a}", a).replace("{more}", more)


def _lines_expr():
    """(condition, offset, text) of every line a match may leave in its log."""
    p = _P
    start = (f"concat('{p}1/1/2024 ==> {{', case when match_id%7<>0 then concat('\"timestamp\":\"', start_time, '\",') else '' end, "
             "'\"matchGameRoomStateChangedEvent\":{\"gameRoomInfo\":{\"state\":\"MatchGameRoomStateType_Playing\",\"gameRoomConfig\":"
             "{\"matchId\":\"', match_id, '\",\"eventId\":\"', event_key, '\",\"reservedPlayers\":[{\"systemSeatId\":1,\"teamId\":1,"
             "\"playerName\":\"Me\",\"userId\":\"', case when my_seat is null then 'X' else concat('U', player_id) end, "
             "'\"},{\"systemSeatId\":2,\"teamId\":2,\"playerName\":\"', opponent_name, '\",\"platformId\":\"PC\",\"userId\":\"O', K%20, "
             "'\"}]}}}}')")
    start = start.replace("{{", "{")
    bo3_game = (f"'{p}{{\"finalMatchResult\":{{\"matchId\":\"', match_id, '\",\"resultList\":[{{\"scope\":\"MatchScope_Game\","
                "\"winningTeamId\":{w},\"reason\":\"ResultReason_{r}\"}}]}}}}'")
    g1 = "concat(" + bo3_game.replace("{w}", "2").replace("{r}", "Concede").replace("{{", "{").replace("}}", "}") + ")"
    g2 = "concat(" + bo3_game.replace("{w}", "', " + _W + ", '").replace("{r}", "Game").replace("{{", "{").replace("}}", "}") + ")"
    decision = f"'{p}{{\"mulliganResp\":{{\"decision\":\"MulliganOption_%s\"}}}}'"
    return [
        ("match_id%4=0", "0", f"'{p}<== EventGetCourses {{'"),
        ("match_id%4=0", "1", "concat('  \"InternalEventName\": \"', event_key, '\", \"CourseDeckSummary\": {\"Name\": \"deck{', "
                              "match_id%10, '\", \"DeckId\": \"d', match_id, '\"},')"),
        ("match_id%4=0", "2", "'  \"CourseDeck\": {\"MainDeck\": [{\"cardId\": 1, \"quantity\": 4}], \"CommandZone\": "
                              "[{\"cardId\": 555, \"quantity\": 1}, {\"cardId\": 556, \"quantity\": 0}]}}'"),
        ("true", "10", start),
        ("match_id%5<>0 and match_id%3>0", "12", decision % "Mulligan"),
        ("match_id%5<>0 and match_id%3>1", "13", decision % "Mulligan"),
        ("match_id%5<>0", "15", decision % "Keep"),
        ("play_draw is not null", "20", _turn("1", "(case play_draw when 'play' then 1 else 2 end)", _ZONES)),
        ("total_turns is not null", "40", _turn("total_turns", "2")),
        (_BO3, "50", g1), (_BO3, "55", _turn("1", "2")), (_BO3, "57", _turn("5", "1")), (_BO3, "60", g2),
        ("my_result is not null", f"(case when {_LATE} then 5071 else 70 end)", _FINAL),
        ("my_result is not null and match_id%6=0", f"(case when {_LATE} then 5076 else 75 end)",
         _FINAL),
        ("match_id%13<>0", "90", f"concat('{p}{{\"timestamp\":\"', start_time+60000, '\",\"matchGameRoomStateChangedEvent\":"
                                 "{\"gameRoomInfo\":{\"state\":\"MatchGameRoomStateType_MatchCompleted\"}}}')".replace("{{", "{")),
        ("match_id%50=3", "95", f"'{p}{{\"broken\": [{{\"unclosed\": 1'".replace("{{", "{")),
        ("match_id%3=1", "96", "'plain line without braces'"),
        ("match_id%3=1", "97", "'   '"),
        ("match_id%20=9", "98", f"concat('{p}{{\"a\":\"x}}{{\"}} {{\"constructedClass\":\"Gold\",\"constructedLevel\":', 1+match_id%4, '}}')"
         .replace("{{", "{").replace("}}", "}")),
        ("match_id%100=5", "99", f"'{p}{{\"finalMatchResult\":{{\"matchId\":\"gone\",\"resultList\":[{{\"scope\":\"MatchScope_Match\","
                                 "\"winningTeamId\":1}]}}'".replace("{{", "{")),
    ]


def _rows(t):
    cols = match_columns(SPARK, null_times=False)
    return t.events.selectExpr(*cols, "K")


def log_lines(t):
    """file, chunk, pos, text, owner - one log file per player, cut into small chunks."""
    parts = ", ".join(f"if({c}, named_struct('off', cast({o} as bigint), 'text', cast({x} as string)), null)"
                      for c, o, x in _lines_expr())
    # the matches of a piece come together while they are narrow; their lines are written once, packed, and stand in for log
    # files on disk
    rows = _rows(t).repartition("player_id", F.expr("match_id div 1000")).select(
        "match_id", "player_id", F.explode(F.expr(f"array_compact(array({parts}))")).alias("l"))
    pos = F.col("match_id") * 100 + F.col("l.off")
    return stored(rows.select(F.concat(F.lit("UTC_Log_"), "player_id").alias("file"),
                              F.floor(pos / 100000).alias("chunk"), pos.alias("pos"), F.col("l.text").alias("text")), "log-lines")


# a folder for every log: files without a checksum file beside each, as a game leaves them
BARE_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def landing_tasks(spark) -> int:
    """Tasks that lay out log files. Opening a file costs more than its text, so small ones are not put together."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def payloads(t, lines=None):
    records = LG.assemble_records(log_lines(t) if lines is None else lines)
    return LG.parse_payloads(records).withColumn("owner", F.regexp_replace("file", "^.*UTC_Log_", ""))


def _facts(t):
    return SE.rebuild_facts(payloads(t))


_ML = "ml as (select " + ", ".join(match_columns(DUCK, null_times=False)) + f", K from {EVENTS_DUCK})"
_STAMPS = """stamps as (select player_id, match_id*100+10 as pos, start_time as ts from ml where match_id%7<>0
    union all select player_id, match_id*100+90, start_time+60000 from ml where match_id%13<>0)"""
_DECK = """dk as (select player_id, event_key, match_id as did from ml where match_id%4=0),
  md0 as (select ml.*, (select max(did) from dk where dk.player_id=ml.player_id and dk.event_key=ml.event_key
      and did<=ml.match_id) as deck_then, (select min(did) from dk where dk.player_id=ml.player_id
      and dk.event_key=ml.event_key) as firstd from ml),
  mdk as (select *, coalesce(deck_then, firstd) as deckno from md0)"""
_REC = f"""{_ML}, {_STAMPS}, {_DECK},
  st as (select mdk.*, (select arg_max(ts, pos) from stamps s where s.player_id=mdk.player_id and s.pos<=mdk.match_id*100+10) as s0,
    case when match_id%13<>0 then start_time+60000 end as e0 from mdk),
  fact as (select cast(match_id as varchar) as match_id, cast(player_id as varchar) as player_id, event_key,
    coalesce(s0, e0) as start_time, e0 as end_time, case when e0>=coalesce(s0, e0) then (e0-coalesce(s0, e0))/1000.0::double end
    as duration_sec, my_seat, case when my_seat is not null then opponent_name end as opponent_name,
    case when my_seat is not null then play_draw end as play_draw, case when my_seat is not null then my_result end as my_result,
    case when my_result is not null then {_WHY} end as end_reason,
    greatest(case when play_draw is not null then 1 end, total_turns, case when {_BO3} then 5 end) as total_turns,
    'deck{{' || deckno%10 as my_deck_tag, 'd' || deckno as my_deck_id from st)""".replace("{{", "{")
_FACT_COLS = ["match_id", "player_id", "event_key", "start_time", "end_time", "duration_sec", "my_seat", "opponent_name",
              "play_draw", "my_result", "end_reason", "total_turns", "my_deck_tag", "my_deck_id"]


@query("log_matches", f"with {_REC} select * from fact", ())
def _(t):
    return _facts(t)["matches"].select(*_FACT_COLS)


@query("log_wrapped_payloads", f"with {_REC} select * from fact", ())
def _(t):
    """Rosters, results and decks lie one to four levels below foreign keys and lists."""
    lines, match = log_lines(t), F.floor(F.col("pos") / 100)
    deep = F.regexp_replace("text", r"^([^{]*)(\{.*\})$", '$1{"v":1,"outer":{"list":[0,{"deep":$2}]}}')
    flat = F.regexp_replace("text", r"^([^{]*)(\{.*\})$", '$1{"outer":$2}')
    whole = F.col("text").contains("finalMatchResult") | F.col("text").contains("_Playing")
    deck = F.col("text").contains("EventGetCourses"), F.col("text").contains('"CourseDeck": ')
    wrapped = (F.when(whole & (match % 4 == 1), flat).when(whole & (match % 4 != 3), deep)
               .when(deck[0] & (match % 8 == 0), F.concat("text", F.lit('"a":{"b":[{'))).when(deck[1] & (match % 8 == 0), F.concat("text", F.lit(']}}')))
               .otherwise(F.col("text")))
    read = stored(payloads(t, lines.withColumn("text", wrapped)), "log-payloads")
    return SE.rebuild_facts(LG.unwrapped(read))["matches"].select(*_FACT_COLS)


_FLIP = "case my_result when 'win' then 'loss' when 'loss' then 'win' end"


@query("log_shared_matches", f"""with {_REC} select match_id, player_id, my_result from fact
  union all select match_id, 'B' || player_id, {_FLIP} from fact""", ())
def _(t):
    """Both sides of every match leave a log: the same match ids, the seats and so the results exchanged."""
    lines = log_lines(t)
    seat = lambda n: f'"systemSeatId":{n},"teamId":{n}'
    swapped = F.replace(F.replace(F.replace("text", F.lit(seat(1)), F.lit("<one>")), F.lit(seat(2)), F.lit(seat(1))), F.lit("<one>"), F.lit(seat(2)))
    other = lines.withColumn("text", swapped).withColumn("file", F.replace("file", F.lit("UTC_Log_"), F.lit("UTC_Log_B")))
    return SE.rebuild_facts(payloads(t, lines.unionByName(other)))["matches"].select("match_id", "player_id", "my_result")


@query("log_unclosed_records", f"""with {_ML} select 'UTC_Log_' || player_id as file, cast(match_id*100+95 as bigint) as pos,
  '{_P}{{"broken": [{{"unclosed": 1' || case when match_id%3=1 then chr(10) || 'plain line without braces' || chr(10) || '   ' else '' end as text
  from ml where match_id%50=3""".replace("{{", "{"), ())
def _(t):
    """Unclosed records keep all their lines."""
    return LG.assemble_records(log_lines(t)).filter("not closed").select("file", "pos", "text")


@query("log_files_roundtrip", f"with {_REC} select * from fact", ())
def _(t):
    """The same through real text files: written, listed, scanned in splits, rebuilt."""
    folder = scratch_dir(t.spark, "logs")
    lines = log_lines(t).withColumn("owner", F.regexp_replace("file", "UTC_Log_", "UTC_Log_"))
    (lines.repartition(landing_tasks(t.spark), "owner").sortWithinPartitions("owner", "pos").select("owner", "text")
     .write.options(**BARE_FILES).partitionBy("owner").text(folder))
    owner = lambda column: F.regexp_extract(column, "owner=UTC_Log_([^/]+)/", 1)
    read = LG.distinct_logs(t.spark, [f"{folder}/*"], owner("path"), "*.txt")
    got = payloads(t, read).withColumn("owner", owner("file"))
    return SE.rebuild_facts(got)["matches"].select(*_FACT_COLS)


@query("log_games", f"""with {_ML}, x as (select cast(match_id as varchar) as match_id, my_seat, my_result, play_draw, {_WHY} as why,
    {_BO3} as bo3 from ml)
  select match_id, 1 as game_no, case when my_seat is null then null when bo3 then 'loss' else my_result end as result,
    case when bo3 then 'Concede' when my_result is not null then why end as reason,
    case when my_seat is not null then play_draw end as play_draw from x
  union all select match_id, 2, case when my_seat is not null then my_result end, 'Game',
    case when my_seat is not null then 'draw' end from x where bo3""", ())
def _(t):
    return _facts(t)["games"].drop("player_id")


@query("log_mulligans", f"""with {_ML} select cast(match_id as varchar) as match_id, 1 as game_no, my_seat as seat,
  cast(match_id%3 as int) as kept_on from ml where match_id%5<>0""", ())
def _(t):
    return _facts(t)["mulligans"].drop("player_id")


@query("log_commanders", f"""with {_ML}, {_DECK} select cast(match_id as varchar) as match_id, 2 as seat, cast(K%40 as varchar) as grp_id,
    0 as partner_idx from mdk where contains(event_key,'Brawl') and play_draw is not null
  union all select cast(match_id as varchar), 1, cast(K%30+100 as varchar), 0 from mdk where contains(event_key,'Brawl')
    and play_draw is not null
  union all select cast(match_id as varchar), 1, '555', 0 from mdk where contains(event_key,'Brawl') and my_seat is not null
    and deck_then is not null""", ())
def _(t):
    return _facts(t)["commanders"].drop("player_id")


@query("log_ranks", f"""with {_ML}, {_STAMPS} select cast(player_id as varchar) as player_id, (select arg_max(ts, pos) from stamps s
  where s.player_id=ml.player_id and s.pos<=match_id*100+98) as ts, 'Gold' as constructed_class,
  cast(1+match_id%4 as int) as constructed_level from ml where match_id%20=9""", ())
def _(t):
    return _facts(t)["ranks"].select(F.col("owner").alias("player_id"), "ts", "constructed_class", "constructed_level")


@query("log_orphan_results", f"""with {_ML} select distinct cast(player_id as varchar) as player_id, 'gone' as match_id,
  'MatchScope_Match' as scope, 1 as winning_team from ml where match_id%100=5""", ())
def _(t):
    return _facts(t)["orphans"].select("player_id", "match_id", "scope", "winning_team")


@query("log_identity", f"""with {_ML}, u as (select player_id, case when my_seat is null then 'X' else 'U' || player_id end as u from ml
    union all select player_id, 'O' || K%20 from ml), k as (select player_id, u, count(*) as n from u group by 1,2)
  select cast(player_id as varchar) as owner, u as my_user from k
  qualify row_number() over (partition by player_id order by n desc, u)=1""", ())
def _(t):
    records = LG.assemble_records(log_lines(t)).withColumn("owner", F.regexp_replace("file", "UTC_Log_", ""))
    return LG.detect_identity(records)


_COUNTS = {
    "records": ["match_id%4=0", "true", "match_id%5<>0 and match_id%3>0", "match_id%5<>0 and match_id%3>1", "match_id%5<>0",
                "play_draw is not null", "total_turns is not null", _BO3, _BO3, _BO3, _BO3, "my_result is not null",
                "my_result is not null and match_id%6=0", "match_id%13<>0", "match_id%50=3", "match_id%3=1", "match_id%20=9",
                "match_id%100=5"],
}


@query("log_records", f"""with {_ML} select 'UTC_Log_' || player_id as file,
  cast({' + '.join(f"count(*) filter (where {c})" for c in _COUNTS['records'])}
    - count(*) filter (where match_id%50=3 and match_id%3=1) as bigint) as records,
  {cnt('match_id%4=0')} as three_line_records, {cnt('match_id%50=3')} as unclosed from ml group by player_id""", ())
def _(t):
    rec = LG.assemble_records(log_lines(t))
    return rec.groupBy("file").agg(
        F.count(F.lit(1)).alias("records"),
        F.count(F.when(F.col("closed") & (F.col("lines") == 3), 1)).alias("three_line_records"),
        F.count(F.when(~F.col("closed"), 1)).alias("unclosed"))


@query("log_timestamps", f"""with {_ML}, {_STAMPS}, e as (select 'UTC_Log_' || player_id as file, match_id,
    (select arg_max(ts, pos) from stamps s where s.player_id=ml.player_id and s.pos<=match_id*100+10) as ts from ml)
  select file, {CNT} as starts, {cnt('ts is null')} as undated, cast(sum(ts) as bigint) as ts_sum from e group by 1""", ())
def _(t):
    rec = LG.carry_timestamps(LG.assemble_records(log_lines(t))).filter(F.col("text").contains("_Playing"))
    return rec.groupBy("file").agg(F.count(F.lit(1)).alias("starts"), F.count(F.when(F.col("ts").isNull(), 1)).alias("undated"),
                                   F.sum("ts").alias("ts_sum"))


@query("log_line_numbers", f"""with {_ML} select 'UTC_Log_' || player_id as file, cast({' + '.join(
  f"count(*) filter (where {c})" for c, _, _ in _lines_expr())} as bigint) as line_count, 1 as first_line,
  cast({' + '.join(f"count(*) filter (where {c})" for c, _, _ in _lines_expr())} as bigint) as distinct_numbers
  from ml group by player_id""", ())
def _(t):
    return LG.number_lines(log_lines(t)).groupBy("file").agg(
        F.max("line_no").alias("line_count"), F.min("line_no").cast("int").alias("first_line"),
        F.countDistinct("line_no").alias("distinct_numbers"))


@query("ingest_audit", f"""with {_ML} select 'UTC_Log_' || player_id as file, {cnt('match_id%50=3')} as unreadable,
  {CNT} as rebuilt, {cnt('match_id%3<>0')} as new, {cnt('match_id%3=0')} as updated, false as skipped
  from ml group by player_id
  union all select 'old_' || player_id, 0, 0, 0, 0, true from ml group by player_id""", ())
def _(t):
    got = stored(payloads(t), "log-payloads")
    facts = SE.open_matches(SE.segment(got), LG.detect_identity(got))
    known = t.m.filter("match_id%3=0").select(F.col("match_id").cast("string").alias("match_id"))
    skipped = t.m.select(F.concat(F.lit("old_"), "player_id").alias("file")).distinct()
    return LG.ingest_audit(got, facts, known, skipped).select(
        "file", "unreadable", "rebuilt", "new", "updated", "skipped")


@query("unchanged_files", """with f as (select '/logs/' || event_id%500 as path, max(event_id) as size, max(event_id)*10 as modified
    from events group by 1)
  select path, size, modified from f where size%3<>0""", ())
def _(t):
    files = t.raw("events").groupBy(F.expr("concat('/logs/', event_id%500)").alias("path")).agg(
        F.max("event_id").alias("size"), (F.max("event_id") * 10).alias("modified"))
    manifest = files.withColumn("modified", F.expr("case when size%3=1 then modified-1 else modified end")).filter(
        "size%3<>2")
    return LG.changed_files(files, manifest)


@query("duplicate_log_files", """with f as (select 'f' || event_id%300 as name, event_id%2 as size, event_id as path from events)
  select name, cast(size as bigint) as size, min(path) as path from f group by 1,2""", ())
def _(t):
    files = t.raw("events").select(
        F.expr("concat('f', event_id%300)").alias("name"), F.expr("event_id%2").alias("size"),
        F.col("event_id").alias("path"), F.lit(0).alias("dir_rank"))
    return LG.drop_copies(files).select("name", "size", "path")
