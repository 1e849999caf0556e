"""Scope, overview, trend and option queries with their oracles."""
from datetime import date

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.winrate import rate_columns
from ..operators import overview as O
from ..scope import Scope, range_filter
from .catalog import CNT, DECIDED, VISIBLE, cnt, family_sql, pct_sql, query, rate_sql
from .views import TODAY

DAY = date.fromisoformat(TODAY)
ALL = Scope()


def _totals_sql(p, cond):
    n, w = cnt(cond), cnt(f"{cond} and my_result='win'")
    out = []
    for side in ("play", "draw"):
        out.append(f"{cnt(f'{cond} and play_draw={chr(39)}{side}{chr(39)}')} as {p}{side}_c, "
                   f"{cnt(f'''{cond} and play_draw='{side}' and my_result='win' ''')} as {p}{side}_w")
    return f"{n} as {p}n_c, {w} as {p}w_c, {', '.join(out)}"


def _totals_out(p):
    pre = f"{p}_" if p else ""
    return f"""{rate_sql(f'{p}w_c', f'{p}n_c', p)}, {rate_sql(f'{p}play_w', f'{p}play_c', f'{pre}on_play')},
      {rate_sql(f'{p}draw_w', f'{p}draw_c', f'{pre}on_draw')}, {p}n_c-{p}play_c-{p}draw_c as {pre}side_unknown,
      {pct_sql(f'{p}play_c', f'{p}play_c+{p}draw_c')} as {pre}play_rate,
      {pct_sql(f'{p}draw_c', f'{p}play_c+{p}draw_c')} as {pre}draw_rate"""


def _totals(rng):
    return f"""with a as (select player_id, {_totals_sql('', f'({rng}) and {VISIBLE}')},
      {_totals_sql('today', f"play_day=date '{TODAY}' and {VISIBLE}")},
      {cnt(f'({rng}) and (is_abnormal=1 or is_bot=1)')} as hidden
      from m where my_result is not null group by player_id)
      select player_id, hidden, {_totals_out('')}, {_totals_out('today')} from a"""


@query("overview_totals", _totals("true"))
def _(t):
    return O.overview_totals(t.m, ALL, DAY)


@query("overview_totals_week", _totals("play_day between date '2024-01-15' and date '2024-01-20'"))
def _(t):
    return O.overview_totals(t.m, Scope(range="week", today=DAY), DAY)


@query("winrate_by_event", f"""with a as (select player_id, coalesce(event_key,'(unknown)') as key, {CNT} as c,
  {cnt("my_result='win'")} as w from m where {DECIDED} group by 1,2)
  select player_id, key, {rate_sql('w', 'c')} from a""")
def _(t):
    return O.rate_by(t.m, ALL, O.event_bucket())


@query("winrate_by_deck", f"""with a as (select player_id, coalesce(nullif(my_deck_tag,''),'(unlabelled)') as key,
  {CNT} as c, {cnt("my_result='win'")} as w from m where {DECIDED} group by 1,2)
  select player_id, key, {rate_sql('w', 'c')} from a""")
def _(t):
    return O.rate_by(t.m, ALL, O.deck_bucket())


@query("trend_daily", f"""with a as (select player_id, cast(play_day as varchar) as key, {CNT} as c,
  {cnt("my_result='win'")} as w from m where {DECIDED} and start_time is not null group by 1,2)
  select player_id, key, {rate_sql('w', 'c')} from a""")
def _(t):
    return O.rate_by(t.m, ALL, F.col("play_day").cast("string"))


_WEEK = "cast(play_day - cast(dayofweek(play_day) as integer) as date)"


@query("trend_weekly", f"""with a as (select player_id, cast({_WEEK} as varchar) as key, {CNT} as c,
  {cnt("my_result='win'")} as w from m where {DECIDED} and start_time is not null group by 1,2)
  select player_id, key, {rate_sql('w', 'c')} from a""")
def _(t):
    return O.rate_by(t.m, ALL, O.week_sunday().cast("string"))


@query("overview_sections", f"""with a as (
  select player_id, 'event' as section, coalesce(event_key,'(unknown)') as key, my_result from m where {DECIDED}
  union all select player_id, 'deck', coalesce(nullif(my_deck_tag,''),'(unlabelled)'), my_result from m where {DECIDED}
  union all select player_id, 'day', cast(play_day as varchar), my_result from m where {DECIDED} and play_day is not null
  union all select player_id, 'week_sunday', cast({_WEEK} as varchar), my_result from m
    where {DECIDED} and play_day is not null),
  b as (select player_id, section, key, {CNT} as c, {cnt("my_result='win'")} as w from a group by 1,2,3)
  select player_id, section, key, {rate_sql('w', 'c')} from b""")
def _(t):
    return O.overview_groups(t.m, ALL)


@query("scope_family_deck_mode", f"""with a as (select player_id, {CNT} as c, {cnt("my_result='win'")} as w from m
  where {DECIDED} and event_key in (select distinct event_key from m where {family_sql()}='ladder')
  and my_deck_tag='deck2' and match_mode='BO1' group by 1) select player_id, {rate_sql('w', 'c')} from a""")
def _(t):
    scope = Scope(family="ladder", deck="deck2", mode="BO1")
    return (scope.decided(t.m).groupBy("player_id")
            .agg(F.count(F.lit(1)).alias("cnt"), F.count(F.when(F.col("my_result") == "win", 1)).alias("won"))
            .select("player_id", *rate_columns("won", "cnt")))


@query("scope_ranges", f"""with r(name, lo, hi) as (values ('today', date '2024-01-20', date '2024-01-20'),
  ('yesterday', date '2024-01-19', date '2024-01-19'), ('week', date '2024-01-15', date '2024-01-20'),
  ('month', date '2024-01-01', date '2024-01-20'), ('2024-01-05', date '2024-01-05', date '2024-01-05'))
  select player_id, name as range, {CNT} as n from m join r on play_day between lo and hi
  where {VISIBLE} group by 1,2""")
def _(t):
    names = ("today", "yesterday", "week", "month", "2024-01-05")
    hits = F.array_compact(F.array(*[F.when(range_filter(n, DAY), F.lit(n)) for n in names]))
    return (ALL.apply(t.m).filter(range_filter("month", DAY)).select("player_id", F.explode(hits).alias("range"))
            .groupBy("player_id", "range").agg(F.count(F.lit(1)).alias("n")))


@query("hidden_rows", f"""select player_id, {CNT} as total, {cnt(VISIBLE)} as shown,
  {cnt('is_abnormal=1 or is_bot=1')} as hidden from m group by 1""")
def _(t):
    return t.m.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(ALL.visible(), 1)).alias("shown"),
        F.count(F.when(ALL.hidden(), 1)).alias("hidden"))


@query("format_focus", f"""with f as (select player_id, {family_sql()} as family, {CNT} as n from m
  where play_day >= date '2023-12-21' and my_result is not null group by 1,2),
  x as (select *, row_number() over (partition by player_id order by n desc, family) as rn,
    cast(sum(n) over (partition by player_id) as bigint) as total from f)
  select player_id, family as "primary", n, total, {pct_sql('n', 'total')} as share, family='brawl' as show_commanders,
  family in ('ladder','draft','sealed') as show_rank,
  family in ('ladder','play','constructed','weekly') as show_opponent_types from x where rn=1""")
def _(t):
    return O.format_focus(t.m, DAY)


_ELIG = "event_key in ('Ladder','Traditional_Ladder')"


@query("opponent_types", f"""with a as (select player_id, opp_archetype_tag as tag, {CNT} as matches,
  {cnt("my_result='win'")} as w, {cnt("my_result='loss'")} as losses, {cnt("my_result is null")} as unknown_result,
  {cnt("play_draw='play'")} as play, {cnt("play_draw='draw'")} as draw from m
  where {VISIBLE} and {_ELIG} and opp_archetype_tag<>'' group by 1,2)
  select player_id, tag, coalesce(cast(list_position(['Aggro','Control','Combo','Ramp','Midrange','Other'], tag) as int),7)
  as tag_order, matches, losses, unknown_result, play, draw, {rate_sql('w', 'w+losses')} from a""")
def _(t):
    return O.opponent_types(t.m, ALL)


@query("opponent_types_by_tag", f"""with x as (select player_id, my_result, play_draw,
  unnest(string_split(opp_archetype_tag, ',')) as tag from m where {VISIBLE} and {_ELIG} and opp_archetype_tag<>''),
  a as (select player_id, tag, {CNT} as matches,
  {cnt("my_result='win'")} as w, {cnt("my_result='loss'")} as losses, {cnt("my_result is null")} as unknown_result,
  {cnt("play_draw='play'")} as play, {cnt("play_draw='draw'")} as draw from x group by 1,2)
  select player_id, tag, coalesce(cast(list_position(['Aggro','Control','Combo','Ramp','Midrange','Other'], tag) as int),7)
  as tag_order, matches, losses, unknown_result, play, draw, {rate_sql('w', 'w+losses')} from a""")
def _(t):
    return O.opponent_types(t.m, ALL, exploded=True)


@query("opponent_type_coverage", f"""select player_id, {CNT} as eligible, {cnt("opp_archetype_tag<>''")} as known,
  {cnt("coalesce(opp_archetype_tag,'')=''")} as unknown from m where {VISIBLE} and {_ELIG} group by 1""")
def _(t):
    return O.opponent_type_coverage(t.m, ALL)


@query("single_mode_events", """with k as (select m.*, case when n>1 then 'BO3' else match_mode end as mode2 from m
  left join (select match_id, count(distinct game_no) as n from g group by 1) using (match_id))
  select player_id, event_key from k group by 1,2 having count(distinct mode2)<=1""", ("m", "g"))
def _(t):
    from ..operators.merge import refresh_modes
    return O.single_mode_events(refresh_modes(t.m, t.g))


@query("repeat_opponents", f"""with a as (select player_id, opponent_name, {CNT} as n, {cnt("my_result='win'")} as wins,
  {cnt("my_result='loss'")} as losses, min(start_time) as first_time, max(start_time) as last_time,
  cast(count(distinct play_day) as bigint) as days from m where {VISIBLE} and opponent_name<>''
  and event_key not like '%BotMatch%' group by 1,2 having count(*)>=2),
  b as (select *, cast(row_number() over (partition by player_id order by n desc, last_time desc nulls last, opponent_name)
    as int) as rank, cast(count(*) over (partition by player_id) as bigint) as total from a)
  select * from b where rank<=12""")
def _(t):
    return O.repeat_opponents(t.m, ALL)


@query("filter_options", f"""with v as (select *, {family_sql()} as family from m where {VISIBLE})
  select player_id, 'family' as section, family as value, {CNT} as n, cast(null as bigint) as ids from v
    where event_key is not null group by 1,3
  union all select player_id, 'event', event_key, {CNT}, null from v where event_key is not null and family='draft' group by 1,3
  union all select player_id, 'deck', my_deck_tag, {CNT}, cast(count(distinct coalesce(my_deck_id,'')) as bigint) from v
    where my_deck_tag<>'' and family='draft' group by 1,3
  union all select p.player_id, 'mode', k.mode, {cnt('v.match_mode=k.mode')}, null
    from (select distinct player_id from v where family='draft') p cross join
    (values ('BO1'),('BO3'),('unknown')) k(mode) join v on v.player_id=p.player_id and v.family='draft' group by 1,3""")
def _(t):
    return O.filter_options(t.m, Scope(family="draft"))


@query("mulligan_distribution", f"""select player_id, kept_on, {CNT} as n from mu join m using (match_id)
  where {DECIDED} and (seat is null or seat=my_seat) group by 1,2""", ("m", "mu"))
def _(t):
    return O.mulligan_distribution(t.m, t.mu, ALL)


@query("winrate_by_mulligan", f"""with k as (select m.player_id, my_result, case
  when exists(select 1 from mu where mu.match_id=m.match_id and (seat is null or seat=my_seat) and kept_on>=1) then 'mulligan'
  when exists(select 1 from mu where mu.match_id=m.match_id and (seat is null or seat=my_seat) and kept_on is not null)
  then 'clean' else 'unknown' end as key from m where {DECIDED}),
  a as (select player_id, key, {CNT} as c, {cnt("my_result='win'")} as w from k group by 1,2)
  select player_id, key, {rate_sql('w', 'c')} from a""", ("m", "mu"))
def _(t):
    return O.rate_by_mulligan(t.m, t.mu, ALL)


def summary_sql(keys: str, source: str, where: str = "true") -> str:
    """Oracle of ``side_summary`` over any relation."""
    return f"""select {keys}, {CNT} as matches, {cnt("my_result='loss'")} as losses,
  {cnt("my_result is null")} as unknown_result, {cnt("play_draw='play'")} as play, {cnt("play_draw='draw'")} as draw,
  {cnt("play_draw is null")} as unknown_side,
  {pct_sql(cnt("play_draw='play'"), cnt("play_draw is not null"))} as play_rate,
  {pct_sql(cnt("play_draw='draw'"), cnt("play_draw is not null"))} as draw_rate,
  {rate_sql(cnt("my_result='win'"), cnt("my_result is not null"))},
  {rate_sql(cnt("my_result='win' and play_draw='play'"), cnt("my_result is not null and play_draw='play'"), 'on_play')},
  {rate_sql(cnt("my_result='win' and play_draw='draw'"), cnt("my_result is not null and play_draw='draw'"), 'on_draw')}
  from {source} where {where} group by {keys}"""


@query("side_distribution", summary_sql("player_id", "m", VISIBLE))
def _(t):
    return O.side_distribution(t.m, ALL)


@query("date_index", f"""select player_id, cast(play_day as varchar) as day, n, cast(latest as varchar) as latest_day,
  undated from (select player_id, play_day, {CNT} as n from m where {VISIBLE} and play_day is not null group by 1,2)
  join (select player_id, max(play_day) filter (where play_day<=date '{TODAY}') as latest,
    {cnt('play_day is null')} as undated from m where {VISIBLE} group by 1) using (player_id)""")
def _(t):
    return O.date_index(t.m, ALL, DAY)


@query("mode_counts", f"""select player_id, my_deck_id, match_mode as mode, {CNT} as n from m where {VISIBLE} group by 1,2,3""")
def _(t):
    return O.mode_counts(t.m, ALL, ["my_deck_id"])


_FMT = """case when contains(event_key,'Brawl') then 'brawl' when contains(event_key,'Draft')
  or contains(event_key,'Sealed') then 'limited' else 'constructed' end"""


def _matrix(key, where="true"):
    p, d = "play_draw='play'", "play_draw='draw'"
    return f"""with a as (select player_id, {key} as key, {cnt(p)} as pn, {cnt(f"{p} and my_result='win'")} as pw,
  {cnt(d)} as dn, {cnt(f"{d} and my_result='win'")} as dw from m where my_result is not null and {where} group by 1,2)
  select player_id, key, {rate_sql('pw', 'pn', 'on_play')}, {rate_sql('dw', 'dn', 'on_draw')},
  case when pn>0 and dn>0 then round(100.0::double*(pw::double/pn-dw::double/dn),1) end as delta_pp from a"""


@query("history_format_sides", _matrix(_FMT))
def _(t):
    return O.format_side_matrix(O.history_formats(t.m), "format_class")


@query("history_year_sides", _matrix("cast(year(play_day) as varchar)",
                                     "contains(event_key,'Brawl') and play_day is not null"))
def _(t):
    rows = O.history_formats(t.m).filter("format_class = 'brawl'").withColumn("year", F.year("play_day"))
    return O.format_side_matrix(rows, "year")


@query("history_top_decks", f"""with a as (select player_id, my_deck_tag, {CNT} as c, {cnt("my_result='win'")} as w,
  {cnt("play_draw='play'")} as pn, {cnt("play_draw='play' and my_result='win'")} as pw,
  {cnt("play_draw='draw'")} as dn, {cnt("play_draw='draw' and my_result='win'")} as dw
  from m where my_result is not null and my_deck_tag<>'' group by 1,2),
  b as (select *, cast(row_number() over (partition by player_id order by c desc, my_deck_tag) as int) as rank from a)
  select player_id, my_deck_tag, rank, {rate_sql('w', 'c')}, {rate_sql('pw', 'pn', 'on_play')},
  {rate_sql('dw', 'dn', 'on_draw')} from b where rank<=15""")
def _(t):
    return O.top_decks_by_side(t.m)


@query("history_sources", f"""select player_id, source, {CNT} as n, {cnt('my_result is not null')} as decided,
  min(start_time) as first_time, max(start_time) as last_time from m group by 1,2""")
def _(t):
    return O.source_counts(t.m)
