"""Streak, run, curve and change-point queries with their oracles."""
from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import runs as R, sequences as S
from .catalog import CNT, VISIBLE, cnt, query
from .overview import ALL

# islands by difference of row numbers; ties and unknown sides are NULL states
_SIDED = """{name} as (select *, case when play_draw in ('play','draw') and count(*) over (partition by {keys}, start_time)=1
    then play_draw end as side, count(*) over (partition by {keys}, start_time)>1 as tied,
    row_number() over (partition by {keys} order by start_time, match_id) as rn from {src} where start_time is not null)"""


def islands_sql(out, src, keys, state, order="start_time, match_id"):
    return f"""{out} as (select {keys}, {state} as state, {CNT} as len, min(start_time) as first_time,
    max(start_time) as last_time, arg_min(match_id, rn2) as first_id, arg_max(match_id, rn2) as last_id,
    min(rn2) as first_rn, max(rn2) as last_rn
    from (select *, row_number() over (partition by {keys} order by {order}) as rn2,
      row_number() over (partition by {keys} order by {order})
      - row_number() over (partition by {keys}, {state} order by {order}) as grp from {src})
    group by {keys}, {state}, grp)"""


def _streaks(src, where="true"):
    return f"""with s0 as (select * from {src} where {where}), {_SIDED.format(name='s', keys='player_id', src='s0')},
  {islands_sql('i', 's', 'player_id', 'side')},
  a as (select player_id, coalesce(max(len) filter (where state='play'),0) as lp,
    coalesce(max(len) filter (where state='draw'),0) as ld, arg_max(coalesce(state,'?'), last_rn) as cs,
    arg_max(len, last_rn) as cl, max(last_time) as lt from i group by 1),
  b as (select player_id, bool_or(tied) as amb, arg_max(tied, rn) as lasttied from s group by 1),
  t as (select player_id, {CNT} as n, {cnt('start_time is null')} as undated from s0 group by 1)
  select player_id, n, case when undated=0 then lp end as longest_play, case when undated=0 then ld end as longest_draw,
  case when undated=0 then nullif(cs,'?') end as current_side, case when undated=0 and cs<>'?' then cl else 0 end as current_n,
  case when undated=0 then lt end as last_time, case when undated>0 then 'undated rows' when lasttied
  then 'last rows share one time' when cs='?' then 'last side unknown' end as reason,
  case when undated=0 then amb end as ambiguous_order from t left join a using (player_id) left join b using (player_id)"""


@query("side_streaks", _streaks("m", VISIBLE))
def _(t):
    return S.side_streaks(ALL.apply(t.m), ["player_id"])


@query("side_streaks_with_ties", _streaks("tied"), ("tied",))
def _(t):
    return S.side_streaks(t.tied, ["player_id"])


def observations_sql(src, keys, where="true", min_len=3):
    """CTE text ending in relation ``obs``."""
    on = keys.replace(" ", "")
    return f"""s00 as (select * from {src} where {where}),
  s0 as (select * from s00 anti join (select distinct {keys} from s00 where start_time is null) z using ({on})),
  {_SIDED.format(name='s', keys=keys, src='s0')},
  {islands_sql('i', 's', keys, 'side')},
  sb as (select *, side is not null as sided from s),
  {islands_sql('ib', 'sb', keys, 'sided')},
  best as (select {keys}, state as side, len as length, first_time, first_id, last_time, last_id from i where state is not null
    qualify row_number() over (partition by {keys}, state order by len desc, last_time desc)=1 and len>={min_len}),
  bl as (select {keys}, len as block, {CNT} as times from ib where state group by {keys}, len),
  mx as (select max(block) as mb from bl),
  dp(k, n, qs) as (select distinct length as k, length as n, list_concat(list_transform(range(0,length), lambda x: 1.0::double),
      [1.0::double - power(0.5::double, length)]) as qs from best
    union all select k, n+1, list_append(qs, qs[n+1] - power(0.5::double, k+1)*qs[n-k+1]) from dp, mx where n<mb),
  q as (select k, n, qs[n+1] as q from dp where n=(select mb from mx)),
  full_q as (select k, qs from dp, mx where n=mb),
  sc as (select {', '.join('best.' + x for x in on.split(','))}, side, sum(times) as blocks, sum(times*block) as known,
    1-exp(sum(times*ln(case when block<length then 1.0::double else qs[block+1] end))) as scan
    from best join bl using ({on}) left join full_q on full_q.k=length group by {', '.join('best.' + x for x in on.split(','))}, side),
  obs as (select best.*, cast(blocks as bigint) as blocks, cast(known as bigint) as known, scan,
    case when scan*100<0.1 then round(scan*100,3) when scan*100<1 then round(scan*100,2) else round(scan*100,1) end as scan_percent,
    case when power(0.5,length)*100<0.1 then round(power(0.5,length)*100,3) when power(0.5,length)*100<1
      then round(power(0.5,length)*100,2) else round(power(0.5,length)*100,1) end as fixed_percent,
    case when scan<0.01 then 'legendary' when scan<0.05 then 'rare' when scan<0.15 then 'unusual' else 'notable' end as level
    from best join sc using ({on}, side))"""


@query("streak_observations", f"with recursive {observations_sql('m', 'player_id', VISIBLE)} select * from obs")
def _(t):
    return S.streak_observations(ALL.apply(t.m), ["player_id"])


@query("streak_observations_with_ties",
       f"with recursive {observations_sql('tied', 'player_id', min_len=2)} select * from obs", ("tied",))
def _(t):
    return S.streak_observations(t.tied, ["player_id"], min_length=2)


@query("streak_evidence", f"""with recursive {observations_sql('m', 'player_id', VISIBLE)}
  select s00.player_id, obs.side, s00.match_id, s00.start_time from s00 join obs on obs.player_id=s00.player_id
  and s00.start_time between first_time and last_time""")
def _(t):
    rows = ALL.apply(t.m)
    return S.streak_evidence(rows, S.streak_observations(rows, ["player_id"]), ["player_id"])


@query("loss_streaks", f"""with s as (select *, coalesce(my_result,'')='loss' as lost from m where {VISIBLE}),
  {islands_sql('i', 's', 'player_id', 'lost', 'coalesce(start_time,-1), match_id')}
  select player_id, coalesce(max(len) filter (where state),0) as max_loss_streak from i group by 1""")
def _(t):
    return S.loss_streaks(ALL.apply(t.m), ["player_id"])


def _curve(track):
    return f"""with s as (select player_id, ts as start_time, id as match_id, {track}_class as class, {track}_level as level,
    case when {track}_class='Mythic' then 21 when {track}_level between 1 and 4 then cast(list_position(
      ['Bronze','Silver','Gold','Platinum','Diamond'], {track}_class)*4+1-{track}_level as int) end as score from r
    where ts is not null),
  p as (select *, lag(score) over (partition by player_id order by start_time, match_id) as before from s where score is not null)
  select player_id, start_time as ts, class, level, score, case when score>=21 then 'Mythic' else class || ' ' || level end as label
  from p where before is null or before<>score"""


@query("rank_curve", _curve("constructed"), ("r",))
def _(t):
    return S.rank_curve(t.r)


@query("rank_curve_limited", _curve("limited"), ("r",))
def _(t):
    return S.rank_curve(t.r, "limited")


RUNS_SQL = """rr0 as (select player_id, event_key, coalesce(my_deck_id,'') as deck_id, coalesce(start_time,0) as start_time,
    match_id, case when my_result='win' then 1 else 0 end as won,
    case when starts_with(event_key,'PickTwoDraft_') then 'picktwo' when starts_with(event_key,'QuickDraft_') then 'quick'
      else 'sealed' end as kind, case when starts_with(event_key,'PickTwoDraft_') then 4 else 7 end as cap,
    case when starts_with(event_key,'PickTwoDraft_') then 2 else 3 end as cl,
    case when starts_with(event_key,'PickTwoDraft_') then 2 when starts_with(event_key,'QuickDraft_') then 4 else 6 end as be
    from {src} where my_result is not null and (starts_with(event_key,'PickTwoDraft_') or starts_with(event_key,'QuickDraft_')
      or starts_with(event_key,'Sealed_'))),
  rr1 as (select *, row_number() over (partition by player_id, event_key, deck_id order by start_time, match_id) as rn from rr0),
  rf as (select player_id, event_key, deck_id, rn, won as w, 1-won as l, 1::bigint as run_no,
      (won>=cap or 1-won>=cl) as ended from rr1 where rn=1
    union all select n.player_id, n.event_key, n.deck_id, n.rn, case when f.ended then n.won else f.w+n.won end,
      case when f.ended then 1-n.won else f.l+1-n.won end, case when f.ended then f.run_no+1 else f.run_no end,
      (case when f.ended then n.won else f.w+n.won end)>=cap or (case when f.ended then 1-n.won else f.l+1-n.won end)>=cl
    from rf f join rr1 n on n.player_id=f.player_id and n.event_key=f.event_key and n.deck_id=f.deck_id and n.rn=f.rn+1),
  runs as (select player_id, event_key, deck_id, run_no, kind, w as wins, l as losses, cap, be as break_even,
    case when w>=cap then 'cap' when w=cap-1 then 'near' when w<=0 then 'bust' when w>=be then 'even' else 'low' end as band,
    l=0 as perfect, start_time as end_time, match_id as end_match, w+l as n
    from rf join rr1 using (player_id, event_key, deck_id, rn) where ended)"""
BEST_RUN_SQL = """bestrun as (select player_id, cast(make_timestamp(end_time*1000) as date) as play_day, event_key, deck_id, run_no,
    kind, wins, losses, band, perfect, end_time, n from runs qualify row_number() over (partition by player_id,
    cast(make_timestamp(end_time*1000) as date) order by list_position(['cap','near','even','low','bust'], band), wins desc,
    end_time desc, event_key desc, deck_id desc)=1)"""


@query("capped_runs", f"with recursive {RUNS_SQL.format(src='m')} select * from runs")
def _(t):
    return R.capped_runs(t.m)


@query("capped_run_members", f"""with recursive {RUNS_SQL.format(src='m')} select rf.player_id, rf.event_key, rf.deck_id,
  rf.run_no, rr1.match_id from rf join rr1 using (player_id, event_key, deck_id, rn)
  semi join runs on runs.player_id=rf.player_id and runs.event_key=rf.event_key and runs.deck_id=rf.deck_id
  and runs.run_no=rf.run_no""")
def _(t):
    return R.capped_run_members(t.m)


@query("best_run_per_day", f"""with recursive {RUNS_SQL.format(src='md')}, {BEST_RUN_SQL}
  select * replace (cast(play_day as varchar) as play_day) from bestrun""", ("md",))
def _(t):
    return R.best_run_per_day(R.capped_runs(t.md)).withColumn("play_day", F.col("play_day").cast("string"))


ARC_SQL = """arcs as (select player_id, play_day, case when hs='loss' then 'comeback' else 'collapse' end as arc, decided, first_len,
    last_len from (select player_id, play_day, cast(sum(len) as bigint) as decided, arg_min(state, first_rn) as hs,
    arg_max(state, last_rn) as ts, arg_min(len, first_rn) as first_len, arg_max(len, last_rn) as last_len from arci group by 1,2)
    where decided>=6 and hs<>ts and first_len>=3 and last_len>=3 and first_len+last_len<=decided)"""


@query("day_arcs", f"""with sd as (select * from md where {VISIBLE} and my_result is not null),
  {islands_sql('arci', 'sd', 'player_id, play_day', 'my_result')}, {ARC_SQL}
  select * replace (cast(play_day as varchar) as play_day) from arcs""", ("md",))
def _(t):
    return S.result_arcs(ALL.apply(t.md), ["player_id", "play_day"]).withColumn(
        "play_day", F.col("play_day").cast("string"))


@query("card_runs_per_day", f"""with s as (select md.*, exists(select 1 from c where c.match_id=md.match_id and c.grp_id='7')
    as hit from md where {VISIBLE}), {islands_sql('i', 's', 'player_id, play_day', 'hit')}
  select player_id, cast(play_day as varchar) as play_day, len as run, first_time as run_first, last_time as run_last from i
  where state qualify row_number() over (partition by player_id, play_day order by len desc, first_time)=1""", ("md", "c"))
def _(t):
    hit = t.c.filter("grp_id = '7'").select("match_id").distinct().withColumn("hit", F.lit(True))
    rows = ALL.apply(t.md).join(hit, "match_id", "left")
    return S.longest_true_run(rows, ["player_id", "play_day"], "hit").withColumn(
        "play_day", F.col("play_day").cast("string"))


CHANGES_SQL = """vs as (select *, lag(my_deck_version) over (partition by {keys} order by start_time, match_id) as before
    from {src} where start_time is not null and my_deck_version<>''),
  marks as (select {keys}, play_day, my_deck_version as version, match_id from vs where before is null or before<>my_deck_version)"""


@query("version_changes", f"""with v as (select * from m where {VISIBLE} and my_deck_id is not null),
  {CHANGES_SQL.format(keys='player_id, my_deck_id', src='v')}
  select k.player_id, k.my_deck_id, cast(k.play_day as varchar) as day, version, k.match_id, {CNT} as n_after,
  {cnt("x.my_result='win'")} as wins_after, {cnt("x.my_result='loss'")} as losses_after from marks k join vs x
  on x.player_id=k.player_id and x.my_deck_id=k.my_deck_id and x.my_deck_version=version and x.play_day>=k.play_day
  group by 1,2,3,4,5""")
def _(t):
    rows = ALL.apply(t.m).filter("my_deck_id is not null")
    return S.version_changes(rows, ["player_id", "my_deck_id"])
