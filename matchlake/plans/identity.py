"""Deck identity and deck page queries with their oracles."""
from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import deck_detail as DD, decks as D, identity as I, sequences as S
from ..operators.overview import side_summary
from ..session import cut_lineage
from .catalog import CNT, VISIBLE, cnt, pct_sql, query, rate_sql
from .decks import LABELS
from .overview import ALL, DAY, summary_sql
from .sequences import CHANGES_SQL, observations_sql

# dense players whose decks share some builds: several identities per player
_DECKS = {
    "my_deck_id": "case when match_id%7=0 then null else concat('d', cast(match_id%6 as {S})) end",
    "my_deck_version": "case when start_time%10<2 then null when start_time%10<8 then concat('v', cast(match_id%6 as {S}), "
                       "'-', cast(start_time%3 as {S})) else concat('s', cast({HALF} as {S})) end",
}


def _decks(t):
    return t.md.withColumns({k: F.expr(v.format(S="string", HALF="(match_id%6) div 2")) for k, v in _DECKS.items()})


_DK = "dk as (select * replace (" + ", ".join(
    f"{v.format(S='varchar', HALF='(match_id%6)//2')} as {k}" for k, v in _DECKS.items()) + ") from md)"

_COMP = """ed as (select distinct player_id, 'i:' || {i} as a, 'v:' || {v} as b from {src} where {i} is not null and {v} is not null),
  bo as (select player_id, a as x, b as y from ed union select player_id, b, a from ed),
  reach(player_id, node, root) as (select distinct player_id, x, x from bo
    union select bo.player_id, bo.y, reach.root from reach join bo on bo.player_id=reach.player_id and bo.x=reach.node),
  comp as (select player_id, node, min(root) as label from reach group by 1,2)"""
_IDENT = f"""{_DK}, {_COMP.format(i='my_deck_id', v='my_deck_version', src='dk')},
  nd as (select *, coalesce('i:' || my_deck_id, 'v:' || my_deck_version, 'n:' || my_deck_tag) as node from dk),
  ri as (select nd.* exclude (node), coalesce(label, nd.node) as identity, not starts_with(coalesce(label, nd.node),'n:') as reliable
    from nd left join comp on comp.player_id=nd.player_id and comp.node=nd.node where nd.node is not null),
  vis as (select * from ri where {VISIBLE})"""
K = "player_id, identity"


def _rows(t):
    return cut_lineage(I.with_identity(_decks(t)))


@query("deck_components", f"with recursive {_DK}, {_COMP.format(i='my_deck_id', v='my_deck_version', src='dk')} select * from comp",
       ("md",))
def _(t):
    return I.components(I.deck_edges(_decks(t)))




@query("deck_components_chains", """with o as (select distinct o_orderkey as k from orders),
    r as (select k, k - row_number() over (order by k) as island from o),
    lab as (select island, min('i:' || cast(k//2 as varchar)) as label from r group by 1),
    nd as (select 'i:' || cast(k//2 as varchar) as node, island from r union select 'v:' || cast((k+1)//2 as varchar), island from r)
  select 1 as player_id, node, label from nd join lab using (island)""", ())
def _(t):
    """Consecutive orders share a node, so a gapless run of order keys is one chain, as long as the run."""
    edges = t.raw("orders").select(
        F.lit(1).alias("player_id"), F.expr("concat('i:', o_orderkey div 2)").alias("a"),
        F.expr("concat('v:', (o_orderkey+1) div 2)").alias("b"))
    return I.components(edges)


@query("deck_identity_summary", f"""with recursive {_IDENT} select player_id, identity, bool_and(reliable) as reliable, {CNT} as n,
  cast(count(distinct my_deck_id) as bigint) as deck_ids, cast(count(distinct my_deck_version) as bigint) as versions,
  cast(count(distinct my_deck_tag) as bigint) as names, arg_max(my_deck_tag, (start_time, match_id)) as title
  from ri group by 1,2""", ("md",))
def _(t):
    return I.identity_summary(_rows(t))


_SEEDS = """seeds as (select player_id, my_deck_tag as deck, arg_max(identity, (reliable, start_time, match_id)) as identity,
  bool_or(reliable) as reliable from ri where my_deck_tag<>'' group by 1,2)"""


@query("deck_seeds_by_name", f"with recursive {_IDENT}, {_SEEDS} select * from seeds", ("md",))
def _(t):
    return I.seeds_by_name(_rows(t))


@query("deck_seeds_by_key", f"""with recursive {_IDENT} select distinct player_id, identity from ri where my_deck_id='d2'
  and my_deck_version like 's%' and my_deck_version='s1'""", ("md",))
def _(t):
    return I.seeds_by_key(_rows(t), deck_id="d2", deck_version="s1")


@query("deck_unlinked_same_name", f"""with recursive {_IDENT}, {_SEEDS}, {LABELS.replace('from m where', 'from dk where')},
  dv as (select distinct ri.player_id, ri.identity from ri join lab on lab.player_id=ri.player_id
    and lab.my_deck_id=ri.my_deck_id where limited_label is not null)
  select s.player_id, s.deck, s.identity, (select {CNT} from vis where vis.player_id=s.player_id and vis.my_deck_tag=s.deck
    and vis.identity<>s.identity and not exists (select 1 from dv where dv.player_id=s.player_id and dv.identity=s.identity))
  as unlinked from seeds s where reliable""", ("md",))
def _(t):
    rows = _rows(t)
    return I.unlinked_same_name(rows, I.seeds_by_name(rows), D.deck_labels(_decks(t)), ALL)


_LAST20 = f"""sc as (select * from vis qualify row_number() over (partition by {K} order by start_time desc, match_id desc)<=20)"""


def _visible(t):
    return _rows(t).filter(ALL.visible())


@query("deck_summary_last20", f"with recursive {_IDENT}, {_LAST20} {summary_sql(K, 'sc')}", ("md",))
def _(t):
    from ..operators.overview import side_summary
    return side_summary(DD.apply_scope(_visible(t), "last20", DAY), DD.KEYS)


for _scope, _day in (("today", "2024-01-20"), ("yesterday", "2024-01-19")):
    @query(f"deck_summary_{_scope}", f"""with recursive {_IDENT} {summary_sql(K, 'vis', f"play_day = date '{_day}'")}""", ("md",))
    def _(t, scope=_scope):
        return side_summary(DD.apply_scope(_visible(t), scope, DAY), DD.KEYS)


@query("deck_summary_last7", f"""with recursive {_IDENT} {summary_sql(K, 'vis', "play_day between date '2024-01-14' and date '2024-01-20'")}""",
       ("md",))
def _(t):
    from ..operators.overview import side_summary
    return side_summary(DD.apply_scope(_visible(t), "last7", DAY), DD.KEYS)


@query("deck_versions", f"""with recursive {_IDENT}, v as (select {K}, my_deck_version as version, {CNT} as n, min(start_time) as first_time,
  max(start_time) as last_time, array_to_string(list_sort(list(distinct source)), ',') as sources from vis group by 1,2,3)
  select *, cast(case when version is null then 0 else row_number() over (partition by {K} order by version is null,
  last_time desc, version desc) end as int) as number from v""", ("md",))
def _(t):
    return DD.version_rows(_visible(t))


_EV = """case event_key when 'Play_Brawl_Historic' then '史迹争锋' when 'QuickDraft_MOM_20230428' then '快速轮抽 · 邪军压境 · 2023-04-28'
  when 'PickTwoDraft_HOB_20260811' then '选两张轮抽 · 霍比特人 · 2026-08-11' when 'Ladder' then '标准排位'
  when 'Traditional_Ladder' then '传统标准排位' when 'MWM_Momir_20240101' then '周中 · 莫秘维 · 2024-01-01'
  when 'Sealed_DMU_20220901' then '现开 · 多明纳里亚：众志成城 · 2022-09-01' end"""


@query("deck_journey", f"""with recursive {_IDENT}, a as ({summary_sql(K + ', play_day', 'vis')}),
  e as (select {K}, play_day, array_to_string(list_sort(list(distinct {_EV}))[1:4], ',') as events from vis group by 1,2,3),
  v0 as (select {K}, play_day, my_deck_version, min((start_time, match_id)) as first_at from vis where my_deck_version<>'' group by 1,2,3,4),
  v as (select {K}, play_day, string_agg(my_deck_version, ',' order by first_at) as versions from v0 group by 1,2,3)
  select {K}, cast(play_day as varchar) as play_day, matches, wins, losses, unknown_result, wr, play, draw, unknown_side, events,
  coalesce(versions,'') as versions from a join e using ({K}, play_day) left join v using ({K}, play_day)""", ("md",))
def _(t):
    return DD.journey_days(_visible(t)).withColumn("play_day", F.col("play_day").cast("string"))


@query("deck_journey_span", f"""with recursive {_IDENT} select {K}, cast(count(distinct play_day) as bigint) as day_count,
  cast(coalesce(max(play_day)-min(play_day)+1,0) as int) as span_days, {cnt('play_day is null')} as unknown_day from vis group by 1,2""",
       ("md",))
def _(t):
    return DD.journey_span(_visible(t))


@query("deck_version_changes", f"""with recursive {_IDENT}, {CHANGES_SQL.format(keys=K, src='vis')}
  select k.player_id, k.identity, cast(k.play_day as varchar) as day, version, k.match_id, {CNT} as n_after,
  {cnt("x.my_result='win'")} as wins_after, {cnt("x.my_result='loss'")} as losses_after from marks k join vs x
  on x.player_id=k.player_id and x.identity=k.identity and x.my_deck_version=version and x.play_day>=k.play_day
  group by 1,2,3,4,5""", ("md",))
def _(t):
    return S.version_changes(_visible(t), DD.KEYS)


_OC = """oc as (select distinct s.*, c.grp_id from {src} s join c on c.match_id=s.match_id and c.seat<>s.my_seat
  where contains(s.event_key,'Brawl'))"""


def _cov(src):
    return f"""{_OC.format(src=src)}, km as (select {K}, match_id, {CNT} as k from oc group by 1,2,3),
  kn as (select {K}, {CNT} as known, {cnt('k>1')} as multi from km group by 1,2),
  kd as (select {K}, cast(count(distinct grp_id) as bigint) as dc from oc group by 1,2),
  tot as (select {K}, {CNT} as matches, {cnt("contains(event_key,'Brawl')")} as eligible from {src} group by 1,2),
  cov as (select {K}, eligible, coalesce(known,0) as known, eligible-coalesce(known,0) as missing,
    matches-eligible as not_applicable, coalesce(multi,0) as multi_card_matches, coalesce(dc,0) as distinct_cards
    from tot left join kn using ({K}) left join kd using ({K}))"""


@query("deck_card_coverage", f"with recursive {_IDENT}, {_cov('vis')} select * from cov", ("md", "c"))
def _(t):
    return DD.card_table(_visible(t), t.c, DD.KEYS)[0]


def _card_rates():
    w = {s: (cnt(f"my_result='win' and play_draw='{s}'"), cnt(f"my_result is not null and play_draw='{s}'"))
         for s in ("play", "draw")}
    return f"""{rate_sql(cnt("my_result='win'"), cnt('my_result is not null'))}, {rate_sql(*w['play'], 'on_play')},
  {rate_sql(*w['draw'], 'on_draw')}"""


@query("deck_cards", f"""with recursive {_IDENT}, {_cov('vis')} select {K}, grp_id, {CNT} as met, {cnt("my_result='loss'")} as losses,
  {cnt('my_result is null')} as unknown_result, {cnt("play_draw='play'")} as play, {cnt("play_draw='draw'")} as draw,
  {cnt('play_draw is null')} as unknown_side, {pct_sql('count(*)', 'max(known)')} as share_known,
  {pct_sql('count(*)', 'max(eligible)')} as share_eligible, {_card_rates()}
  from oc join cov using ({K}) group by 1,2,3""", ("md", "c"))
def _(t):
    return DD.card_table(_visible(t), t.c, DD.KEYS)[1]


@query("deck_card_environment", f"""with recursive {_IDENT}, {_OC.format(src='vis')},
  kn as (select {K}, cast(count(distinct match_id) as bigint) as known from oc group by 1,2),
  ob as (select distinct s.player_id, s.match_id, c.grp_id from md s join c on c.match_id=s.match_id and c.seat<>s.my_seat
    where contains(s.event_key,'Brawl')),
  bc as (select player_id, grp_id, {CNT} as bn from ob group by 1,2),
  bk as (select player_id, cast(count(distinct match_id) as bigint) as bknown from ob group by 1),
  pc as (select {K}, grp_id, {CNT} as met, {_card_rates()} from oc group by 1,2,3
    qualify row_number() over (partition by {K} order by count(*) desc, grp_id)<=12)
  select pc.*, cast(row_number() over (partition by {K} order by met desc, grp_id) as int) as rank,
  {pct_sql('met', 'known')} as share_known, {pct_sql('coalesce(bn,0)', 'bknown')} as baseline_share,
  round(100.0::double*met/known - {pct_sql('coalesce(bn,0)', 'bknown')}, 1) as delta_pp
  from pc join kn using ({K}) left join bc using (player_id, grp_id) left join bk using (player_id)""", ("md", "c"))
def _(t):
    return DD.card_environment(_visible(t), t.md, t.c, DD.KEYS)


@query("deck_own_cards", f"""with recursive {_IDENT}, o as (select distinct s.player_id, s.identity, s.match_id, c.grp_id from vis s
  join c on c.match_id=s.match_id and c.seat=s.my_seat where contains(s.event_key,'Brawl'))
  select {K}, grp_id, {CNT} as n, cast(row_number() over (partition by {K} order by count(*) desc, grp_id) as int) as rank
  from o group by 1,2,3 qualify rank<=4""", ("md", "c"))
def _(t):
    return DD.own_cards(_visible(t), t.c, DD.KEYS)


@query("deck_observations", f"""with recursive {_IDENT}, {observations_sql('vis', K)}, {_cov('vis')},
  tc as (select {K}, grp_id, {CNT} as met, {cnt("my_result='win'")} as w, {cnt("my_result='loss'")} as l from oc group by 1,2,3
    qualify row_number() over (partition by {K} order by count(*) desc, grp_id)=1 and count(*)>=2),
  al as (select {K}, 'streak-' || side as key, 'play_draw_streak' as kind, level, length as n, scan, 0 as lane from obs
    union all select {K}, 'commander-' || grp_id, 'commander_matchup', case when w+l>=3 and (w=w+l or l=w+l) then 'strong'
      else 'notable' end, met, null, 1 from tc
    union all select {K}, 'range-summary', 'range_summary', 'neutral', {CNT}, null, 2 from vis group by 1,2),
  rk as (select *, cast(row_number() over (partition by {K} order by lane, scan, n desc, key) as int) as position from al)
  select {K}, key, kind, level, n, round(scan,6) as scan, position from rk where (lane<2 and position<=3) or (lane=2 and position=1)""",
       ("md", "c"))
def _(t):
    return DD.deck_observations(_visible(t), t.c).withColumn("scan", F.round("scan", 6))


@query("deck_records", f"""with recursive {_IDENT}, {_LAST20}, gm as (select match_id, string_agg(game_no || ':' ||
  coalesce(result,''), ' ' order by game_no) as games from g group by 1)
  select {K}, match_id, start_time, {_EV} as event_label, my_deck_version, match_mode, event_key in ('Ladder','Traditional_Ladder')
  as type_eligible, coalesce(games,'') as games, case when contains(event_key,'Brawl') then coalesce((select
    array_to_string(list_sort(list(distinct c.grp_id)),',') from c where c.match_id=sc.match_id and c.seat<>sc.my_seat),'')
  else '' end as opp_cards from sc left join gm using (match_id)""", ("md", "g", "c"))
def _(t):
    blocks = DD.deck_detail(_decks(t), t.g, t.c, ALL, DAY)
    games = F.array_join(F.transform("games", lambda g: F.concat_ws(
        ":", g.game_no.cast("string"), F.coalesce(g.result, F.lit("")))), " ")
    return blocks["records"].select(
        "player_id", "identity", "match_id", "start_time", "event_label", "my_deck_version", "match_mode",
        "type_eligible", F.coalesce(games, F.lit("")).alias("games"), F.array_join("opp_cards", ",").alias("opp_cards"))


@query("deck_records_against_card", f"""with recursive {_IDENT}, {_OC.format(src='vis')} select {K}, match_id, start_time from oc
  where grp_id='7'""", ("md", "c"))
def _(t):
    return DD.records_against(_visible(t), t.c, grp_id="7").select("player_id", "identity", "match_id", "start_time")


@query("deck_records_behind_streak", f"""with recursive {_IDENT}, {observations_sql('vis', K)}
  select vis.player_id, vis.identity, vis.match_id, vis.start_time from vis join obs on obs.player_id=vis.player_id
  and obs.identity=vis.identity and obs.side='play' and vis.start_time between first_time and last_time""", ("md",))
def _(t):
    rows = _visible(t)
    seen = S.streak_observations(rows, DD.KEYS).filter("side = 'play'")
    hit = S.streak_evidence(rows, seen, DD.KEYS)
    return DD.records_against(rows, t.c, evidence=hit).select("player_id", "identity", "match_id", "start_time")
