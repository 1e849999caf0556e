"""Daily fact queries with their oracles (dense players, so that every kind occurs)."""
from pyspark.sql import functions as F

from ..operators import facts as X, matchups as M, runs as R
from ..session import cut_lineage
from .catalog import CNT, VISIBLE, cnt, query
from .compare import _ENR
from .overview import ALL
from .sequences import ARC_SQL, BEST_RUN_SQL, RUNS_SQL, islands_sql, observations_sql

RARE, RARE_LEGENDARY = 6, 12
D = "player_id, play_day"


def _rows(t):
    return cut_lineage(M.enriched_matches(ALL.apply(t.md).filter("start_time is not null"), t.mu, t.c))


def _show(df):
    return df.select("player_id", F.col("play_day").cast("string").alias("play_day"), "kind", "level", "n",
                     "denominator", "side",
                     F.when(F.col("kind") != "play_draw_streak", F.col("detail")).alias("detail"))


_ROWS = f"w as (select * from md where {VISIBLE}), {_ENR}"
_BASE = f"""base as (select *, coalesce(cast(sum(n) over (partition by player_id order by play_day
    rows between unbounded preceding and 1 preceding) as bigint),0) as total_before from (
    select {D}, {CNT} as n, {cnt("my_result='win'")} as wins, {cnt('my_result is not null')} as decided,
      {cnt("play_draw='play'")} as play, {cnt("play_draw='draw'")} as draw, sum(coalesce(duration_sec,0)) as seconds,
      {cnt('duration_sec>0 and duration_sec<60')} as blitz, {cnt('len(commanders)>0')} as identified,
      max(my_result) as any_result, max(play_draw) as any_side from rec group by 1,2)),
  sk as (select *, case when play+draw<3 then null when play::double/(play+draw)>=0.7 then 'play'
    when draw::double/(play+draw)>=0.7 then 'draw' end as sside from base),
  simple as (
    select {D}, 'single' as kind, cast(null as varchar) as level, n, n as denominator, any_side as side,
      coalesce(any_result,'unknown') as detail from base where n=1
    union all select {D}, 'volume', case when n>=15 then 'legendary' else 'rare' end, n, n, null,
      case when seconds>0 then cast(cast(round(seconds/3600) as int) as varchar) end from base where n>=10
    union all select {D}, 'hot_wr', case when wins::double/decided>=0.95 or (decided>=4 and wins=decided)
      or (wins::double/decided>=0.8 and decided>=10) then 'legendary' else 'rare' end, decided, n, null, null from base
      where n>1 and ((decided=3 and wins=3) or (decided>=4 and wins::double/decided>=0.7))
    union all select {D}, 'pd_skew', null, case sside when 'play' then play else draw end, n, sside, null from sk
      where n>1 and sside is not null
    union all select {D}, 'blitz', null, blitz, n, null, null from base where n>1 and blitz>=3
    union all select {D}, 'milestone', 'legendary', n, n, null, cast(min(mark) as varchar) from base
      join (select unnest([{', '.join(map(str, X.MILESTONES))}]) as mark) on mark>total_before and mark<=total_before+n
      where n>1 group by {D}, n)"""
_STREAK = f"""{observations_sql('rec', D)},
  stf as (select {D}, 'play_draw_streak' as kind, level, length as n, base.n as denominator, side, cast(null as varchar) as detail
    from obs join base using ({D}) where base.n>1),
  simple2 as (select s.* from simple s left join stf k on s.kind='pd_skew' and k.player_id=s.player_id and k.play_day=s.play_day
    and k.side=s.side where k.n is null or k.n<s.n)"""
_CARDS = f"""cd as (select *, max(lt) over (partition by player_id, grp_id order by play_day rows between unbounded preceding
    and 1 preceding) as seen_before from (select {D}, grp_id, {CNT} as met, max(start_time) as lt from
    (select {D}, start_time, unnest(commanders) as grp_id from rec) group by 1,2,3)),
  topc as (select {D}, grp_id as top_card, met from cd qualify row_number() over (partition by {D} order by met desc, grp_id)=1
    and met>=3),
  cflag as (select rec.*, list_contains(commanders, top_card) as hit from rec join topc using ({D})),
  {islands_sql('ci', 'cflag', D, 'hit')},
  crun as (select {D}, max(len) as run from ci where state group by 1,2),
  cardf as (select {D}, 'repeat_commander' as kind, case when run>=3 then 'legendary' end as level,
      case when run>=3 then run else met end as n, case when identified>0 then identified else base.n end as denominator,
      cast(null as varchar) as side, top_card as detail from topc join base using ({D}) left join crun using ({D}) where base.n>1
    union all select {D}, 'rare_commander', case when max((lt-seen_before)//86400000)>={RARE_LEGENDARY} then 'legendary' else 'rare' end,
      1, base.n, null, cast(max((lt-seen_before)//86400000) as varchar) from cd join base using ({D})
      where base.n>1 and seen_before is not null and (lt-seen_before)//86400000>={RARE} group by {D}, base.n)"""
_OPPO = f"""op as (select *, coalesce(cast(sum(w) over b as bigint),0) as pw, coalesce(cast(sum(l) over b as bigint),0) as pl from (
    select {D}, trim(opponent_name) as opponent, {CNT} as met, min((start_time, match_id)) filter (where my_result='win') as fw,
      min((start_time, match_id)) filter (where my_result='loss') as fl, {cnt("my_result='win'")} as w, {cnt("my_result='loss'")} as l
      from rec where trim(opponent_name)<>'' and is_bot=0 group by 1,2,3)
    window b as (partition by player_id, opponent order by play_day rows between unbounded preceding and 1 preceding)),
  oppf as (
    select {D}, 'repeat_opponent' as kind, 'legendary' as level, met as n, base.n as denominator, cast(null as varchar) as side,
      opponent as detail from op join base using ({D}) where base.n>1
      qualify row_number() over (partition by {D} order by met desc, opponent)=1 and met>=3
    union all select {D}, 'revenge', null, 1, base.n, null, opponent from op join base using ({D})
      where base.n>1 and fw is not null and pl>=2 and pl>pw qualify row_number() over (partition by {D} order by pl desc, fw)=1
    union all select {D}, 'nemesis', null, 1, base.n, null, opponent from op join base using ({D})
      where base.n>1 and fl is not null and pl>=3 and pw=0 qualify row_number() over (partition by {D} order by pl desc, fl)=1)"""
_ARC = f"""sd as (select * from rec where my_result is not null), {islands_sql('arci', 'sd', D, 'my_result')}, {ARC_SQL},
  arcf as (select {D}, 'arc' as kind, case when arc='comeback' then 'legendary' else 'rare' end as level, arcs.decided as n,
    base.n as denominator, cast(null as varchar) as side, arc || ':' || first_len || ':' || last_len as detail
    from arcs join base using ({D}) where base.n>1)"""
_RUN = f"""{RUNS_SQL.format(src='rec')}, {BEST_RUN_SQL},
  runf as (select {D}, 'limited_run' as kind, case band when 'cap' then 'legendary' when 'near' then 'rare' end as level,
    cast(bestrun.n as bigint) as n, base.n as denominator, cast(null as varchar) as side, band as detail
    from bestrun join base using ({D}) where base.n>1)"""
_VIEWS = ("md", "mu", "c")
_DAY_TEXT = "* replace (cast(play_day as varchar) as play_day)"


@query("facts_from_day_totals", f"with {_ROWS}, {_BASE} select {_DAY_TEXT} from simple", _VIEWS)
def _(t):
    return _show(X.simple_facts(X.day_totals(_rows(t))))


@query("facts_side_streaks", f"with recursive {_ROWS}, {_BASE}, {_STREAK} select {_DAY_TEXT} from stf", _VIEWS)
def _(t):
    rows = _rows(t)
    return _show(X.streak_facts(rows, X.day_totals(rows)))


@query("facts_side_skew", f"""with recursive {_ROWS}, {_BASE}, {_STREAK} select {_DAY_TEXT} from simple2
  where kind='pd_skew'""", _VIEWS)
def _(t):
    rows = _rows(t)
    base = X.day_totals(rows)
    return _show(X.drop_covered_skew(X.simple_facts(base), X.streak_facts(rows, base)).filter("kind='pd_skew'"))


@query("facts_cards", f"with {_ROWS}, {_BASE}, {_CARDS} select {_DAY_TEXT} from cardf", _VIEWS)
def _(t):
    rows = _rows(t)
    return _show(X.card_facts(rows, X.cards_per_day(rows), X.day_totals(rows), RARE, RARE_LEGENDARY))


@query("facts_opponents", f"with {_ROWS}, {_BASE}, {_OPPO} select {_DAY_TEXT} from oppf", _VIEWS)
def _(t):
    rows = _rows(t)
    return _show(X.opponent_facts(X.opponents_per_day(rows), X.day_totals(rows)))


@query("facts_arcs", f"with {_ROWS}, {_BASE}, {_ARC} select {_DAY_TEXT} from arcf", _VIEWS)
def _(t):
    rows = _rows(t)
    return _show(X.arc_facts(rows, X.day_totals(rows)))


@query("facts_capped_runs", f"with recursive {_ROWS}, {_BASE}, {_RUN} select {_DAY_TEXT} from runf", _VIEWS)
def _(t):
    rows = _rows(t)
    return _show(X.run_facts(rows, X.day_totals(rows)))


@query("history_context_opponents", f"""with {_ROWS}, {_OPPO.split('oppf as')[0].rstrip().rstrip(',')}
  select player_id, cast(play_day as varchar) as play_day, opponent, met, pw as prior_wins, pl as prior_losses from op""", _VIEWS)
def _(t):
    return X.opponents_per_day(_rows(t)).select(
        "player_id", F.col("play_day").cast("string").alias("play_day"), "opponent", "met", "prior_wins", "prior_losses")


@query("history_context_cards", f"""with {_ROWS}, {_CARDS.split('topc as')[0].rstrip().rstrip(',')}
  select player_id, cast(play_day as varchar) as play_day, grp_id, met, seen_before from cd""", _VIEWS)
def _(t):
    return X.cards_per_day(_rows(t)).select(
        "player_id", F.col("play_day").cast("string").alias("play_day"), "grp_id", "met", "seen_before")


_ALL = f"""{_ROWS}, {_BASE}, {_STREAK}, {_CARDS}, {_OPPO}, {_ARC}, {_RUN},
  cand as (select c.* from (select * from simple2 union all select * from stf union all select * from cardf
    union all select * from oppf union all select * from arcf union all select * from runf) c join base using ({D})
    where not (base.n>=15 and (kind='pd_skew' or (kind in ('hot_wr','play_draw_streak') and coalesce(level,'')<>'legendary'))))"""


@query("daily_fact_candidates", f"with recursive {_ALL} select {_DAY_TEXT} from cand", _VIEWS)
def _(t):
    return _show(X.fact_candidates(_rows(t), RARE, RARE_LEGENDARY))


def _case(table):
    return "case kind " + " ".join(f"when '{k}' then {v!r}" for k, v in table.items()) + " end"


_W = f"""case when kind='limited_run' then case detail {' '.join(f"when '{k}' then {v}" for k, v in X.RUN_WEIGHTS.items())} end
  else coalesce({_case(X.WEIGHTS)}, 0.5) end"""
_SEQ = "case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(X.ORDER)) + " end"


def _assembled(name, src, seen):
    return f"""{name}0 as (select *, ({_W})::double * (1+0.12*ln(1+n)) / (1+0.6*least({seen},3))
      * case when level='legendary' then 1.4 else 1.0 end as score, coalesce({_case(X.THEMES)}, 'other') as theme from {src}),
  {name}1 as (select *, row_number() over (partition by {D} order by kind='volume', score desc, n desc, {_SEQ}, detail nulls first,
      side nulls first) as rk from {name}0),
  {name}2 as (select *, first(theme) over d as lt, first(score) over d as ls from {name}1
      window d as (partition by {D} order by rk)),
  {name}3 as (select *, min(case when rk>1 and theme<>lt and score>=0.3*ls then rk end) over (partition by {D}) as nx from {name}2),
  {name} as (select * exclude (rk, lt, ls, nx), case when rk=1 then 1 else 2 end as slot from {name}3 where rk=1 or rk=nx)"""


@query("daily_facts", f"""with recursive {_ALL},
  past as (select * from cand where kind not in ('milestone','revenge','nemesis','rare_commander')),
  {_assembled('told', 'past', '0')},
  cand2 as (select c.*, (select count(*) from told t where t.player_id=c.player_id and t.kind=c.kind
    and t.play_day between c.play_day-7 and c.play_day-1) as seen from cand c),
  {_assembled('final', 'cand2', 'seen')}
  select player_id, cast(play_day as varchar) as play_day, slot, kind, level, n, theme, cast(seen as bigint) as seen,
  round(score,6) as score from final""", _VIEWS)
def _(t):
    return X.daily_facts(_rows(t), RARE, RARE_LEGENDARY).select(
        "player_id", F.col("play_day").cast("string").alias("play_day"), "slot", "kind", "level", "n", "theme", "seen",
        F.round("score", 6).alias("score"))
