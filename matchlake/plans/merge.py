"""Merge, maintenance, tagging, diff, scan and report queries with their oracles."""
from datetime import date

from pyspark.sql import functions as F

from ..operators import matchups as M, merge as U, report as RP
from .catalog import CNT, ORACLES, VISIBLE, cnt, pct_sql, query, rate_sql
from .facts import RARE, RARE_LEGENDARY
from .compare import ADJUSTED, BY_EVENT, BY_EVENT_OUT, _ENR, strata_sql
from .overview import ALL, DAY, summary_sql
from .sequences import _SIDED, islands_sql

# two overlapping snapshots of the match table plus a second late record of some matches
_OLD = """match_id, player_id, case when match_id%5=0 then null else event_key end as event_key, start_time, my_seat,
  opponent_name, case when match_id%4=0 then null else play_draw end as play_draw,
  case when match_id%4=1 then null else my_result end as my_result, end_reason, total_turns,
  case when match_id%6=0 then '' else my_deck_tag end as my_deck_tag, my_deck_id, my_deck_version, 'old' as source"""
_NEW = """match_id, player_id, event_key, case when match_id%8=0 then null else start_time+1 end as start_time, my_seat,
  case when match_id%5=1 then null else concat(opponent_name,'x') end as opponent_name, play_draw,
  case when match_id%7=0 then null else 'win' end as my_result, case when match_id%2=0 then null else 'New' end as end_reason,
  cast(total_turns+match_id%3-1 as int) as total_turns, 'newdeck' as my_deck_tag,
  case when match_id%3=1 then null else 'newid' end as my_deck_id, nullif('v','v') as my_deck_version, 'log' as source"""
_NEW2 = """match_id, player_id, null as event_key, null as start_time, null as my_seat, null as opponent_name, 'play' as play_draw,
  'loss' as my_result, null as end_reason, 99 as total_turns, 'third' as my_deck_tag, null as my_deck_id, 'v9' as my_deck_version,
  'late' as source"""
_TYPES = {"start_time": "bigint", "my_seat": "int", "total_turns": "int"}


def _old(t):
    return t.m.filter("match_id%3<>2").selectExpr(*_split(_OLD))


def _split(text):
    out, depth, cur = [], 0, ""
    for part in text.replace("\n", " ").split(","):
        cur = f"{cur},{part}" if cur else part
        depth = cur.count("(") - cur.count(")")
        if depth == 0:
            out.append(cur.strip())
            cur = ""
    return out


def _new(t):
    a = t.m.filter("match_id%3<>0").selectExpr(*_split(_NEW), "1L as arrival")
    b = t.m.filter("match_id%9=1").selectExpr(*_split(_NEW2), "2L as arrival")
    for c in a.columns:
        b = b.withColumn(c, F.col(c).cast(a.schema[c].dataType))
    return a.unionByName(b)


_MERGE = f"""o as (select {_OLD} from m where match_id%3<>2), a as (select {_NEW} from m where match_id%3<>0),
  b as (select {_NEW2} from m where match_id%9=1),
  step1 as (select coalesce(o.match_id, a.match_id) as match_id, coalesce(a.player_id, o.player_id) as player_id,
    {', '.join(f'coalesce(a.{c}, o.{c}) as {c}' for c in ('event_key', 'start_time', 'my_seat', 'opponent_name', 'play_draw',
                                                         'my_result', 'end_reason', 'my_deck_id', 'my_deck_version'))},
    coalesce(nullif(o.my_deck_tag,''), a.my_deck_tag) as my_deck_tag, coalesce(a.source, o.source) as source,
    case when o.match_id is null then a.total_turns when a.match_id is null then o.total_turns
      else greatest(coalesce(a.total_turns,0), coalesce(o.total_turns,0)) end as total_turns
    from o full join a on o.match_id=a.match_id),
  step2 as (select s.match_id, s.player_id,
    {', '.join(f'coalesce(b.{c}, s.{c}) as {c}' for c in ('event_key', 'start_time', 'my_seat', 'opponent_name', 'play_draw',
                                                         'my_result', 'end_reason', 'my_deck_id', 'my_deck_version'))},
    coalesce(nullif(s.my_deck_tag,''), b.my_deck_tag) as my_deck_tag, coalesce(b.source, s.source) as source,
    case when b.match_id is null then s.total_turns else greatest(99, coalesce(s.total_turns,0)) end as total_turns
    from step1 s left join b on b.match_id=s.match_id)"""


@query("merge_shared_matches", """select match_id, player_id, my_result, start_time from m union all select match_id, player_id+1000000,
  case my_result when 'win' then 'loss' when 'loss' then 'win' end, start_time from m""")
def _(t):
    """Two players with the same match ids and opposite results, merged twice."""
    mine = t.m.selectExpr(*_split(_OLD)).drop("my_result").join(t.m.select("match_id", "my_result"), "match_id")
    flip = F.when(F.col("my_result") == "win", "loss").when(F.col("my_result") == "loss", "win")
    both = mine.unionByName(mine.withColumn("player_id", F.col("player_id") + 1_000_000).withColumn("my_result", flip))
    once = U.merge_matches(None, both)
    return U.merge_matches(once.drop("is_abnormal"), both).select("match_id", "player_id", "my_result", "start_time")


@query("merge_matches", f"with {_MERGE} select * replace (nullif(my_deck_tag,'') as my_deck_tag), 0 as is_abnormal from step2")
def _(t):
    return U.merge_matches(_old(t), _new(t))


_G_OLD = "select match_id, game_no, case when match_id%2=0 then null else result end as result, play_draw from g where game_no<3"
_G_NEW = "select match_id, game_no, result, case when match_id%3=0 then null else 'draw' end as play_draw from g where match_id%5<3"


@query("merge_games", f"""with o as ({_G_OLD}), a as ({_G_NEW}) select match_id, game_no, coalesce(a.result, o.result) as result,
  coalesce(a.play_draw, o.play_draw) as play_draw from o full join a using (match_id, game_no)""", ("g",))
def _(t):
    old, new = (t.spark.sql(q.replace("from g", "from {g}"), g=t.g) for q in (_G_OLD, _G_NEW))
    return U.merge_games(old, new)


_MU_NEW = "select match_id, game_no, cast(null as int) as seat, kept_on+1 as kept_on from mu where match_id%4<2"


@query("merge_mulligans", f"""with x as (select * from mu union all {_MU_NEW}) select match_id, game_no, coalesce(seat, my_seat) as seat,
  max(kept_on) as kept_on from x left join (select match_id, my_seat from m) using (match_id) group by 1,2,3""", ("m", "mu"))
def _(t):
    new = t.spark.sql(_MU_NEW.replace("from mu", "from {mu}"), mu=t.mu)
    return U.merge_mulligans(t.mu, new, t.m)


_C_NEW = "select match_id, seat, grp_id, 1 as partner_idx from c where match_id%4<2 union all " \
         "select match_id, seat, '77', 0 from c where match_id%10=0"


@query("merge_commanders", f"""with o as (select *, 0 as partner_idx from c), a as (select distinct * from ({_C_NEW}))
  select match_id, seat, grp_id, min(coalesce(o.partner_idx, a.partner_idx)) as partner_idx from o full join a
  using (match_id, seat, grp_id) group by 1,2,3""", ("c",))
def _(t):
    new = t.spark.sql(_C_NEW.replace("from c", "from {c}"), c=t.c)
    return U.merge_commanders(t.c.withColumn("partner_idx", F.lit(0)), new)


@query("refresh_modes", """with k as (select match_id, count(distinct game_no) as n from g group by 1)
  select match_id, event_key, case when coalesce(n,0)>1 then 'BO3' else match_mode end as match_mode from m left join k
  using (match_id)""", ("m", "g"))
def _(t):
    return U.refresh_modes(t.m, t.g).select("match_id", "event_key", "match_mode")


@query("tag_bot_decks", """select player_id, cast(sum(case when my_deck_tag in ('deck1','deck3') then 1 else is_bot end) as bigint)
  as bots from m group by 1""")
def _(t):
    return U.tag_bot_decks(t.m, ["DECK1", " k3 ", ""]).groupBy("player_id").agg(
        F.sum("is_bot").cast("bigint").alias("bots"))


@query("clean_mulligans", """select match_id, game_no, coalesce(seat, my_seat) as seat, kept_on from mu
  left join (select match_id, my_seat from m) using (match_id) where kept_on is not null""", ("m", "mu"))
def _(t):
    return U.clean_mulligans(t.mu, t.m)


@query("clean_commanders", "select * from c where grp_id<>'2'", ("c",))
def _(t):
    return U.clean_commanders(t.c)


@query("clear_abnormal", f"select match_id, player_id, 0 as is_abnormal, my_result from m", ("m",))
def _(t):
    """Every abnormal flag taken back, nothing else touched."""
    return U.clear_abnormal(t.m).select("match_id", "player_id", "is_abnormal", "my_result")


@query("dedupe_ranks", """with x as (select *, case when id%3=0 then null else ts//86400000 end as t2 from r)
  select player_id, t2 as ts, constructed_class, constructed_level, limited_class, limited_level, min(id) as id from x
  group by all""", ("r",))
def _(t):
    return U.dedupe_ranks(t.r.withColumn("ts", F.expr("case when id%3=0 then null else ts div 86400000 end")))


_RES = """select match_id, 1 as entry_no, 'MatchScope_Game' as scope, cast(1+match_id%2 as int) as winning_team,
    'ResultReason_Game' as reason from m where match_id%2=0
  union all select match_id, 2, 'MatchScope_Game', cast(1+match_id%3 as int), 'ResultReason_Concede' from m where match_id%4=0
  union all select match_id, 3, 'MatchScope_Match', case when match_id%11=0 then null else cast(1+match_id%2 as int) end,
    'ResultReason_Timeout' from m where match_id%2=0"""


def _orphans(t):
    return U.apply_orphan_results(t.m, t.g.withColumn("reason", F.lit(None).cast("string")),
                                  t.spark.sql(_RES.replace("from m", "from {m}"), m=t.m))


@query("orphan_results", f"""with res as ({_RES}) select m.match_id, case when m.my_result is not null then m.my_result
    when my_seat is not null and winning_team is not null then case when winning_team=my_seat then 'win' else 'loss' end end
  as my_result, case when m.my_result is null and my_seat is not null and winning_team is not null
    then coalesce(end_reason,'Timeout') else end_reason end as end_reason
  from m left join (select * from res where scope='MatchScope_Match') r using (match_id)""")
def _(t):
    return _orphans(t)[0].select("match_id", "my_result", "end_reason")


@query("orphan_game_results", f"""with res as ({_RES}), u as (select r.match_id, case when winning_team=my_seat then 'win' else 'loss' end as o,
    replace(reason,'ResultReason_','') as why, row_number() over (partition by r.match_id order by entry_no) as k
    from res r join m using (match_id) where my_result is null and my_seat is not null and scope='MatchScope_Game'
    and winning_team is not null),
  sl as (select match_id, game_no, row_number() over (partition by match_id order by game_no) as k from g where result is null),
  sz as (select match_id, max(game_no) as top, {cnt('result is null')} as free from g group by 1),
  pl as (select u.match_id, cast(coalesce(sl.game_no, coalesce(top,0)+u.k-coalesce(free,0)) as int) as game_no, o, why from u
    left join sl using (match_id, k) left join sz using (match_id))
  select match_id, game_no, coalesce(o, result) as result, why as reason from g full join pl using (match_id, game_no)""", ("m", "g"))
def _(t):
    return _orphans(t)[1].select("match_id", "game_no", "result", "reason")


# ---- tagging --------------------------------------------------------------------------------
_REQ = [("grpId:3", "Ramp, Combo,Ramp", 1), ("grpId:13", "Bogus", 2), ("grpId:23", "", 3), ("grpId:99", "Aggro", 4)]


def _profiles(t):
    return t.spark.createDataFrame([], "player_id bigint, card_name string, archetype_user string")


def _named_cards(t):
    """Unique names (the part names repeat)."""
    return t.cards.withColumn("name", F.concat("name", F.lit("#"), "grp_id"))


def _tagged(t):
    reqs = F.array(*[F.struct(F.lit(a).alias("card_name"), F.lit(b).alias("tag"), F.lit(c).alias("req_no"))
                     for a, b, c in _REQ])
    by_name = _named_cards(t).filter("grp_id = '5'").select("name").first()["name"]
    players = t.m.select("player_id").distinct()
    requests = players.select("player_id", F.explode(F.concat(reqs, F.array(F.struct(
        F.lit(by_name).alias("card_name"), F.lit("Control").alias("tag"), F.lit(5).alias("req_no"))))).alias("r"))
    return U.apply_profile_tags(t.m, t.c, _named_cards(t), _profiles(t), requests.select("player_id", "r.*"))


@query("tag_by_card_name", """with h as (select distinct m.match_id, grp_id from m join c on c.match_id=m.match_id and c.seat<>m.my_seat
    where grp_id in ('3','23','99','5')),
  t as (select match_id, arg_max(case grp_id when '3' then 'Ramp,Combo' when '23' then '' when '99' then 'Aggro' else 'Control' end,
    case grp_id when '3' then 1 when '23' then 3 when '99' then 4 else 5 end) as tag from h group by 1)
  select match_id, case when t.match_id is not null then nullif(t.tag,'') else opp_archetype_tag end as opp_archetype_tag
  from m left join t using (match_id)""", ("m", "c"))
def _(t):
    return _tagged(t)["matches"].select("match_id", "opp_archetype_tag")


@query("tag_profiles", """with p as (select distinct player_id from m), k(grp_id, tag) as (values ('3','Ramp,Combo'),('23',null),
    ('99','Aggro'),('5','Control'))
  select player_id, coalesce(name || '#' || k.grp_id, 'grpId:' || k.grp_id) as card_name, tag as archetype_user
  from p cross join k left join cards on cards.grp_id=k.grp_id""", ("m", "cards"))
def _(t):
    return _tagged(t)["profiles"].select("player_id", "card_name", "archetype_user")


_ONE = "select match_id*2 as match_id, case match_id%5 when 0 then 'Bad' when 1 then '' when 2 then 'Aggro,Ramp' else 'Midrange' end " \
       "as tag, match_id as req_no from m where match_id%40<9"


def _single(t):
    return U.tag_single_matches(t.m, t.c, _named_cards(t), _profiles(t),
                                t.spark.sql(_ONE.replace("from m", "from {m}"), m=t.m))


@query("tag_single_rejects", f"""with q as ({_ONE}), oc as (select distinct m.match_id from m join c on c.match_id=m.match_id
    and c.seat<>m.my_seat)
  select q.match_id, req_no, case when tag in ('Bad','Aggro,Ramp') then 'invalid tag' when m.match_id is null then 'match not found'
    when not contains(event_key,'Brawl') then 'event takes no opponent type' else 'no opposing card recorded' end as reason
  from q left join m on m.match_id=q.match_id left join oc on oc.match_id=q.match_id
  where tag in ('Bad','Aggro,Ramp') or m.match_id is null or (event_key not in ('Ladder','Traditional_Ladder')
    and (not contains(event_key,'Brawl') or oc.match_id is null))""", ("m", "c"))
def _(t):
    return _single(t)["rejects"]


@query("tag_single_matches", f"""with q as ({_ONE}), ok as (select q.match_id, q.req_no, nullif(tag,'') as tag, player_id, event_key
    from q join m using (match_id) where tag not in ('Bad','Aggro,Ramp')),
  oc as (select distinct m.player_id, m.match_id, grp_id from m join c on c.match_id=m.match_id and c.seat<>m.my_seat),
  d as (select match_id, tag from ok where event_key in ('Ladder','Traditional_Ladder')),
  f as (select ok.player_id, req_no, ok.tag, min(grp_id) as grp_id from ok join oc on oc.match_id=ok.match_id
    where contains(event_key,'Brawl') group by 1,2,3),
  b as (select oc.match_id, arg_max(coalesce(f.tag,''), req_no) as tag from f join oc on oc.player_id=f.player_id and oc.grp_id=f.grp_id
    group by 1)
  select m.match_id, case when b.match_id is not null then nullif(b.tag,'') when d.match_id is not null then d.tag
    else opp_archetype_tag end as opp_archetype_tag from m left join b using (match_id) left join d using (match_id)""", ("m", "c"))
def _(t):
    return _single(t)["matches"].select("match_id", "opp_archetype_tag")


# ---- fingerprints, counters, diff, scan -----------------------------------------------------
_SECT = """select l_orderkey as match_id, case l_linenumber%4 when 1 then 'main' when 2 then 'side' when 3 then 'commanders'
  else 'companions' end as section, l_partkey%60 as card_id, cast(l_quantity as int) as quantity from lineitem"""
_TITLES = "select distinct p_partkey%60 as card_id, (p_partkey%60){div}3 as title_id from part where p_partkey%60<55"


@query("deck_fingerprints", f"""with s as ({_SECT}), t as ({_TITLES.format(div='//')}), r as (select s.*, title_id from s left join t
    using (card_id)),
  pt as (select match_id, section, title_id, sum(quantity) as q, max(case when title_id is null or quantity not between 1 and 1000
    then 1 else 0 end) as bad from r group by 1,2,3),
  net as (select a.match_id, a.section, a.title_id, a.bad, greatest(0, a.q-coalesce(b.q,0)) as q from pt a left join pt b
    on b.match_id=a.match_id and b.title_id=a.title_id and ((a.section='main' and b.section='commanders')
    or (a.section='side' and b.section='companions')))
  select match_id, case when max(bad)=0 and count(*) filter (where section='main')>0 then 'fp1:' || substr(sha256(
    string_agg(section || ':' || title_id || '=' || q, ';' order by section, title_id) filter (where q>0)),1,24) end as fingerprint
  from net group by 1""", ())
def _(t):
    sections = t.spark.sql(_SECT.replace("from lineitem", "from {l}"), l=t.raw("lineitem"))
    mapping = t.spark.sql(_TITLES.format(div=" div ").replace("from part", "from {p}"), p=t.raw("part"))
    return U.deck_fingerprints(sections, mapping)


@query("store_counters", f"""select 'matches' as counter, {CNT} as n from m union all select 'with_result', {cnt('my_result is not null')}
  from m union all select 'abnormal', {cnt('is_abnormal=1')} from m union all select 'games', {CNT} from g
  union all select 'mulligans', {CNT} from mu union all select 'with_commanders', cast(count(distinct match_id) as bigint) from c
  union all select 'ranks', {CNT} from r""", ("m", "g", "mu", "c", "r"))
def _(t):
    return U.store_counters(t.m, t.g, t.mu, t.c, t.r)


def _diff(t):
    games = t.g.withColumn("reason", F.lit(None).cast("string"))
    old = {"matches": t.m.filter("match_id%50<>7"), "games": games, "commanders": t.c}
    new = {"matches": t.m.filter("match_id%50<>8").withColumn("my_result", F.expr(
        "case when match_id%10=3 then 'win' when match_id%10=4 then null else my_result end")).withColumn(
        "play_draw", F.expr("case when match_id%20=5 then 'play' else play_draw end")),
        "games": games.filter("not (match_id%25=1 and game_no=2)"),
        "commanders": t.c.filter("not (match_id%30=2 and grp_id<'2')")}
    return U.snapshot_diff(old, new)


_DIFF = f"""n as (select match_id, case when match_id%10=3 then 'win' when match_id%10=4 then null else my_result end as my_result,
    case when match_id%20=5 then 'play' else play_draw end as play_draw from m where match_id%50<>8),
  gd as (select distinct match_id from g where match_id%25=1 and game_no=2),
  cd as (select distinct match_id from c where match_id%30=2 and grp_id<'2'),
  x as (select o.match_id as oid, n.match_id as nid, o.my_result as r1, n.my_result as r2, o.play_draw as p1, n.play_draw as p2
    from (select * from m where match_id%50<>7) o full join n on n.match_id=o.match_id),
  df as (select coalesce(oid, nid) as match_id, case when nid is null then 'only_old' when oid is null then 'only_new' else 'changed' end
    as status, concat_ws(',', case when r1 is distinct from r2 then 'my_result' end, case when p1 is distinct from p2
    then 'play_draw' end, case when gd.match_id is not null then 'games' end, case when cd.match_id is not null then 'cards' end) as parts,
    case when r1 is distinct from r2 then coalesce(r1,'NULL') || '->' || coalesce(r2,'NULL') end as result_flip,
    case when p1 is distinct from p2 then coalesce(p1,'NULL') || '->' || coalesce(p2,'NULL') end as side_flip
    from x left join gd on gd.match_id=coalesce(oid,nid) left join cd on cd.match_id=coalesce(oid,nid)),
  d2 as (select match_id, status, case when status='changed' then parts end as parts, case when status='changed' then result_flip end
    as result_flip, case when status='changed' then side_flip end as side_flip from df where status<>'changed' or parts<>'')"""


@query("snapshot_diff", f"with {_DIFF} select * from d2", ("m", "g", "c"))
def _(t):
    return _diff(t)


@query("snapshot_flips", f"""with {_DIFF} select 'result' as what, result_flip as flip, {CNT} as n from d2 where result_flip is not null
  group by 1,2 union all select 'side', side_flip, {CNT} from d2 where side_flip is not null group by 1,2""", ("m", "g", "c"))
def _(t):
    return U.flip_counts(_diff(t))


_WORDS = ["password", "secret"]


def _scan_sql(table, key, col):
    uu = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    words = " union all ".join(f"select {key}, line_no, 'blocked word' as label, '***' as hit from ln where contains(line,'{w}')"
                               for w in _WORDS)
    return f"""with parts as (select {key}, unnest(string_split_regex({col}, '\\r\\n|\\n|\\r')) as line,
    generate_subscripts(string_split_regex({col}, '\\r\\n|\\n|\\r'), 1) as i from {table}),
  ln as (select {key}, cast(i as int) as line_no, line from parts),
  pt(label, pattern) as (values ('uuid', '{uu}'), ('user id', '\\b[A-Z0-9]{{20,}}\\b'),
    ('user path', '(?i)C:\\\\Users\\\\[^\\\\"''\\s]+')),
  h as (select {key}, line_no, label, regexp_extract(line, pattern) as hit from ln cross join pt)
  select {key}, line_no, label, substr(hit, 1, 40) as hit from h where hit<>'' and not contains(hit,'<') union all {words}"""


# every text gets two more lines with made-up identifiers, so that each rule has something to find
_EXTRA = {
    "d": "concat({c}, '{nl}', upper(md5({c})), ' x', '{nl}', substr(md5({c}),1,8), '-', substr(md5({c}),9,4), '-', "
         "substr(md5({c}),13,4), '-', substr(md5({c}),17,4), '-', substr(md5({c}),21,12), case when length({c})%3=0 "
         "then ' C:{bs}Users{bs}me ' else ' C:{bs}Users{bs}<name> ' end)",
}


def _extra(col, engine):
    spark = engine == "spark"
    nl = "\\n" if spark else "' || chr(10) || '"
    bs = "\\\\" if spark else "\\"
    return _EXTRA["d"].format(c=col, nl=nl, bs=bs)


for _table, _key, _col in (("documents", "doc_id", "text"), ("pages", "page_id", "html"),
                           ("conversations", "row_id", "text")):
    _src = "select conv_id*1000+turn as row_id, text from conversations" if _table == "conversations" else \
        f"select {_key}, {_col} from {_table}"

    @query(f"sensitive_lines_{_table}", _scan_sql(
        f"(select {_key}, {_extra(_col, 'duck')} as {_col} from ({_src}))", _key, _col), ())
    def _(t, _table=_table, _key=_key, _col=_col, _src=_src):
        rows = t.spark.sql(_src.replace(f"from {_table}", "from {x}"), x=t.raw(_table))
        return U.sensitive_lines(rows.withColumn(_col, F.expr(_extra(_col, "spark"))), _key, _col, _WORDS)


# ---- day and range report -------------------------------------------------------------------
_LO, _HI = date(2024, 1, 15), date(2024, 1, 20)
_IN = "play_day between date '2024-01-15' and date '2024-01-20'"
_W = f"w as (select * from md where {VISIBLE})"


def _enriched(t):
    return M.enriched_matches(ALL.apply(t.md), t.mu, t.c)


@query("report_summary_by_event", f"""with {_W}, {_ENR}, sel as (select * from rec where {_IN})
  select player_id, event_key, {CNT} as matches, {cnt("my_result='loss'")} as losses, {cnt('my_result is null')} as unknown_result,
  {rate_sql(cnt("my_result='win'"), cnt('my_result is not null'))}, {cnt('mulligan is not null')} as mulligan_known,
  {cnt('mulligan')} as mulligan_yes, {cnt('contains(event_key,' + "'Brawl')")} as card_eligible, round(sum(duration_sec),3) as duration_total
  from sel group by 1,2""", ("md", "mu", "c"))
def _(t):
    return RP.selected_summary(_enriched(t), _LO, _HI, ["event_key"]).select(
        "player_id", "event_key", "matches", "losses", "unknown_result", "n", "wins", "wr", "lo", "hi", "mulligan_known",
        "mulligan_yes", "card_eligible", "duration_total")


_RSRC = f"""w as (select *, {_IN} as now_, play_day between date '2023-12-16' and date '2024-01-14' as then_ from md where {VISIBLE})"""


@query("report_comparison", f"with {_RSRC}, {strata_sql('w', where='now_ or then_')} {ADJUSTED.format(keys='player_id')}", ("md",))
def _(t):
    from ..operators.compare import adjusted
    return adjusted(RP.range_strata(ALL.apply(t.md), _LO, _HI), ["player_id"])


@query("report_comparison_by_event", f"""with {_RSRC}, {strata_sql('w', where='now_ or then_')}, {BY_EVENT.format(keys='player_id')}
  select player_id, {BY_EVENT_OUT} from ev1""", ("md",))
def _(t):
    return RP.day_report(_enriched(t), _LO, _HI)["comparison_by_event"]


@query("report_numbers", f"""with d as (select player_id, cast(count(distinct play_day) as bigint) as active_days from md
  where {VISIBLE} and {_IN} group by 1), s as ({summary_sql('player_id', 'md', VISIBLE + ' and ' + _IN)})
  select s.*, active_days from s join d using (player_id)""", ("md",))
def _(t):
    return RP.range_numbers(ALL.apply(t.md), _LO, _HI)


@query("report_opponent_types", f"""select player_id, coalesce(nullif(opp_archetype_tag,''),'(untagged)') as tag, {CNT} as n from md
  where {VISIBLE} and {_IN} and event_key in ('Ladder','Traditional_Ladder') group by 1,2""", ("md",))
def _(t):
    return RP.tag_counts(ALL.apply(t.md), _LO, _HI)


@query("report_history_streaks", f"""with s0 as (select * from md where {VISIBLE} and play_day<=date '2024-01-20'),
  {_SIDED.format(name='s', keys='player_id', src='s0')}, {islands_sql('i', 's', 'player_id', 'side')}
  select player_id, coalesce(max(len) filter (where state='play'),0) as longest_play,
  coalesce(max(len) filter (where state='draw'),0) as longest_draw, max(last_time) as last_time from i group by 1""", ("md",))
def _(t):
    return RP.day_report(_enriched(t), _LO, _HI)["history_streaks"].select(
        "player_id", "longest_play", "longest_draw", "last_time")


@query("report_day_facts", f"""select player_id, cast(play_day as varchar) as play_day, slot, kind, level, n
  from ({ORACLES['daily_facts']}) where play_day = date '{DAY}'""", ())
def _(t):
    return RP.day_report(_enriched(t), DAY, DAY, RARE, RARE_LEGENDARY)["facts"].select(
        "player_id", F.col("play_day").cast("string").alias("play_day"), "slot", "kind", "level", "n")
