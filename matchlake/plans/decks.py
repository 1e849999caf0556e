"""Deck, card, match-up, page and export queries with their oracles."""
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import event_labels as L
from ..operators import cards as K, decks as D, matchups as M, overview as O
from ..scope import Scope
from ..session import cut_lineage
from .catalog import CNT, DECIDED, VISIBLE, cnt, family_sql, pct_sql, query, rate_sql
from .overview import ALL, DAY
from .views import TODAY

_MIN = "strftime(make_timestamp({}*1000), '%Y-%m-%d %H:%M')"
_BRAWL = "contains(event_key,'Brawl')"

LABELS = f"""lab0 as (select player_id, my_deck_id, arg_max(my_deck_tag, (coalesce(start_time,-1), match_id)) as tag,
    {CNT} as n, {cnt("contains(event_key,'Draft') or contains(event_key,'Sealed')")} as limited,
    {cnt("contains(event_key,'Draft')")} as draft, min(start_time) as first_time
    from m where my_deck_id<>'' group by 1,2),
  amb as (select player_id, my_deck_tag as tag from m where my_deck_id<>'' and my_deck_tag<>'' group by 1,2
    having count(distinct my_deck_id)>1),
  lab1 as (select l.*, case when limited::double/n<0.6 then null when draft*2>=limited then 'draft' else 'sealed' end as kind,
    a.tag is not null as ambiguous, coalesce({_MIN.format('first_time')}, 'time not recorded') as ft
    from lab0 l left join amb a using (player_id, tag)),
  lab as (select *, case when ambiguous and kind is not null then kind || ' · ' || ft end as limited_label,
    case when ambiguous then coalesce(kind || ' · ' || ft, 'since ' || ft) end as identity_label from lab1)"""


@query("deck_labels", f"""with {LABELS} select player_id, my_deck_id, tag, n, limited, draft, first_time, kind,
  ambiguous, limited_label, identity_label from lab""")
def _(t):
    return D.deck_labels(t.m)


@query("recent_decks", f"""with {LABELS}, a as (select player_id, coalesce(my_deck_id,'') as deck_id,
    case when coalesce(my_deck_id,'')='' then coalesce(my_deck_tag,'') else '' end as name_key,
    arg_max(coalesce(my_deck_tag,''), (coalesce(start_time,-1), match_id)) as deck, {CNT} as c,
    {cnt("my_result='win'")} as w, min(start_time) as first_time, max(start_time) as last_time,
    {cnt("play_draw='play'")} as play, {cnt("play_draw='draw'")} as draw from m where {DECIDED} group by 1,2,3),
  h as (select player_id, {cnt("deck_id<>'' or name_key<>''")} as total,
    cast(coalesce(sum(c) filter (where deck_id='' and name_key=''),0) as bigint) as unlabelled from a group by 1),
  b as (select a.*, coalesce(limited_label, nullif(deck,''), deck_id) as l1 from a
    left join lab on lab.player_id=a.player_id and lab.my_deck_id=a.deck_id where deck_id<>'' or name_key<>''),
  c as (select *, cast(row_number() over (partition by player_id order by last_time desc nulls last, l1, deck_id, name_key)
    as int) as position, count(*) over (partition by player_id, l1) as k1 from b),
  d as (select *, case when k1>1 then l1 || ' · since ' || coalesce({_MIN.format('first_time')}, 'time not recorded')
    else l1 end as l2 from c),
  e as (select *, count(*) over (partition by player_id, l2) as k2 from d)
  select player_id, position, deck, deck_id, case when k2>1 then l2 || ' · ' || case when deck_id<>''
    then substr(deck_id,1,6) else 'row ' || position end else l2 end as label, first_time, last_time, play, draw,
    {rate_sql('w', 'c')}, total, unlabelled from e join h using (player_id) where position<=12""")
def _(t):
    return D.recent_decks(t.m, ALL)


@query("recent_decks_in_focus", f"""with {LABELS}, f0 as (select player_id, {family_sql()} as family, {CNT} as n from m
  where play_day >= date '2023-12-21' and my_result is not null group by 1,2),
  f as (select player_id, family from (select *, row_number() over (partition by player_id order by n desc, family) as rn
    from f0) where rn=1)
  select player_id, coalesce(my_deck_id,'') as deck_id, {CNT} as n from m join f using (player_id)
  where {DECIDED} and {family_sql()}=f.family and (my_deck_id<>'' or my_deck_tag<>'')
  group by player_id, 2, case when coalesce(my_deck_id,'')='' then coalesce(my_deck_tag,'') else '' end""")
def _(t):
    focus = O.format_focus(t.m, DAY)
    return D.recent_decks(t.m, ALL, limit=None, focus=focus).select("player_id", "deck_id", "n")


@query("deck_identities_by_name", f"""with {LABELS}, a as (select player_id, coalesce(my_deck_tag,'') as deck,
    coalesce(my_deck_id,'') as deck_id, {CNT} as n from m where {VISIBLE} group by 1,2,3)
  select a.player_id, deck, deck_id, coalesce(identity_label, nullif(deck_id,''), 'deck id not recorded') as label, a.n
  from a left join lab on lab.player_id=a.player_id and lab.my_deck_id=a.deck_id where deck<>''""")
def _(t):
    return D.deck_identities(t.m, ALL)


@query("deck_kinds", f"""with a as (select player_id, my_deck_id, {CNT} as n, {cnt(_BRAWL)} as brawl,
  {cnt("contains(event_key,'Draft') or contains(event_key,'Sealed')")} as limited from m where {VISIBLE} group by 1,2)
  select *, case when limited::double/n>=0.6 then 'limited' when brawl::double/n>=0.6 then 'brawl' else 'constructed' end
  as kind from a""")
def _(t):
    return D.deck_kinds(t.m, ALL, ["player_id", "my_deck_id"])


# ---- event dimension: a wide set of keys derived from the rows ------------------------------
_WIDE = """case {k} when 0 then 'Ladder' when 1 then 'Traditional_Ladder' when 2 then 'Historic_Ladder'
  when 3 then 'Traditional_Explorer_Play' when 4 then 'PremierDraft_BLB_20240730' when 5 then 'QuickDraft_XYZ_20230428'
  when 6 then 'MWM_StandardPauper_20240101' when 7 then 'MWM_Momir_20240101' when 8 then 'Trad_Sealed_DMU_20220901'
  when 9 then 'Decathlon2024_3_MOMConstructed_20240102' when 10 then 'Explorer_Event_20240301'
  when 11 then 'Traditional_Standard_Challenge_Artisan' when 12 then 'AIBotMatch' when 13 then 'SomethingElse'
  when 14 then 'Constructed_BestOf3' when 15 then 'Jump_In_2024' when 16 then 'Brawl_Challenge_20240505' end"""
_WIDE_LABEL = """case event_key when 'Ladder' then '标准排位' when 'Traditional_Ladder' then '传统标准排位'
  when 'Historic_Ladder' then '史迹排位' when 'Traditional_Explorer_Play' then '传统探险自由对战'
  when 'PremierDraft_BLB_20240730' then '优选轮抽 · 斑隆洛 · 2024-07-30'
  when 'QuickDraft_XYZ_20230428' then '快速轮抽 · XYZ · 2023-04-28'
  when 'MWM_StandardPauper_20240101' then '周中 · 标准纯普 · 2024-01-01'
  when 'MWM_Momir_20240101' then '周中 · 莫秘维 · 2024-01-01'
  when 'Trad_Sealed_DMU_20220901' then '传统现开 · 多明纳里亚：众志成城 · 2022-09-01'
  when 'Decathlon2024_3_MOMConstructed_20240102' then '十项全能 2024 · 第 3 项 · 邪军压境构筑 · 2024-01-02'
  when 'Explorer_Event_20240301' then '探险构筑赛 · 2024-03-01'
  when 'Traditional_Standard_Challenge_Artisan' then '传统标准挑战赛 · 工匠' when 'AIBotMatch' then '机器人练习'
  when 'Constructed_BestOf3' then '传统构筑赛（BO3）' when 'Jump_In_2024' then 'Jump In／跳入对战 · 2024'
  when 'Brawl_Challenge_20240505' then '争锋挑战赛 · 2024-05-05' else event_key end"""
_WIDE_ELIG = """event_key in ('Ladder','Traditional_Ladder','Historic_Ladder','Traditional_Explorer_Play',
  'MWM_StandardPauper_20240101','Decathlon2024_3_MOMConstructed_20240102','Explorer_Event_20240301',
  'Traditional_Standard_Challenge_Artisan','Constructed_BestOf3')"""
_WIDE_MODE = """case when event_key like 'Traditional%' or event_key like 'Trad\\_%' escape '\\'
  or event_key='Constructed_BestOf3' then 'BO3' when event_key in ('Ladder') or event_key like 'QuickDraft%'
  or event_key like 'PremierDraft%' then 'BO1' else 'unknown' end"""


@query("event_dimension", f"""with w as (select {_WIDE.format(k='match_id%17')} as event_key from m)
  select event_key, {family_sql()} as family, {_WIDE_ELIG} as constructed_eligible, {_WIDE_MODE} as event_mode,
  {_WIDE_LABEL} as event_label, {CNT} as matches from w group by 1,2,3,4,5""")
def _(t):
    wide = t.m.select(F.expr(_WIDE.format(k="match_id%17")).alias("event_key"))
    counts = wide.groupBy("event_key").agg(F.count(F.lit(1)).alias("matches"))
    return counts.join(L.event_dimension(wide), "event_key")


@query("capped_run_specs", f"""select event_key, case when starts_with(event_key,'QuickDraft_') then 'quick'
    when starts_with(event_key,'PickTwoDraft_') then 'picktwo' when starts_with(event_key,'Sealed_') then 'sealed' end as kind,
  case when starts_with(event_key,'PickTwoDraft_') then 4 else 7 end as cap_wins,
  case when starts_with(event_key,'PickTwoDraft_') then 2 else 3 end as cap_losses,
  case when starts_with(event_key,'QuickDraft_') then 4 when starts_with(event_key,'PickTwoDraft_') then 2 else 6 end
  as break_even, {CNT} as matches from m where contains(event_key,'Draft') or contains(event_key,'Sealed') group by 1,2,3,4,5""")
def _(t):
    rows = t.m.withColumn("spec", C.run_spec()).filter("spec is not null")
    return (rows.groupBy("event_key", "spec").agg(F.count(F.lit(1)).alias("matches"))
            .select("event_key", "spec.*", "matches"))


@query("tag_normalisation", f"""with x as (select case match_id%5 when 0 then ' Ramp,Combo , Ramp' when 1 then 'aggro,Aggro'
    when 2 then '' when 3 then 'Other,Nonsense,Control' end as raw from m)
  select raw, case raw when ' Ramp,Combo , Ramp' then 'Ramp,Combo' when 'aggro,Aggro' then 'Aggro'
    when 'Other,Nonsense,Control' then 'Other,Control' else '' end as tags, {CNT} as matches from x group by 1,2""")
def _(t):
    raw = F.expr("case match_id%5 when 0 then ' Ramp,Combo , Ramp' when 1 then 'aggro,Aggro' when 2 then '' "
                 "when 3 then 'Other,Nonsense,Control' end")
    return (t.m.select(raw.alias("raw")).withColumn("tags", C.join_tags("raw"))
            .groupBy("raw", "tags").agg(F.count(F.lit(1)).alias("matches")))


@query("rank_scores", f"""with a as (select constructed_class as cls, constructed_level as level, {CNT} as n,
  case when constructed_class='Mythic' then 21 when constructed_level between 1 and 4 then cast(
    list_position(['Bronze','Silver','Gold','Platinum','Diamond'], constructed_class)*4-3+4-constructed_level as int) end
  as score from r group by 1,2)
  select *, case when score>=21 then 'Mythic' else cls || ' ' || level end as label from a where score is not null""", ("r",))
def _(t):
    rows = t.r.groupBy(F.col("constructed_class").alias("cls"), F.col("constructed_level").alias("level")).agg(
        F.count(F.lit(1)).alias("n"))
    return (rows.withColumn("score", C.rank_score("cls", "level")).filter("score is not null")
            .withColumn("label", C.score_label("score")))


@query("stable_slots", """select player_id, cast(('0x' || substr(sha1(opponent_name || '|' || event_key), 1, 8)) as bigint) % 7
  as slot, cast(count(*) as bigint) as n from m group by 1,2""")
def _(t):
    slot = C.stable_slot([F.col("opponent_name"), F.col("event_key")], 7)
    return t.m.groupBy("player_id", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query("scoop_notes", f"""select player_id, strftime(make_timestamp(start_time*1000), '%m-%d %H:%M') as time,
  'scoop' as note, match_id from m where play_draw is null and end_reason='Concede'""")
def _(t):
    return (t.m.withColumn("note", C.scoop_note()).filter("note is not null")
            .select("player_id", C.short_time("start_time").alias("time"), "note", "match_id"))


# ---- cards ----------------------------------------------------------------------------------
_CAT = """select p_partkey as k, cast(p_partkey as {S}) as grp_id,
  case when p_partkey%5=0 then concat('A-', p_name, ' // back') else p_name end as name,
  case when p_partkey%3=0 then null else concat('zh_', p_name) end as name_zh,
  case p_partkey%4 when 0 then 'client' when 1 then 'scryfall' end as source from part where p_partkey%17<>0"""
_CATALOGUE = """select cast(p_partkey as {S}) as grp_id, case when p_partkey%7=0 then 'stale' when p_partkey%5=0
  then concat('A-', p_name, ' // back') else p_name end as name_en, concat('cat_', p_name) as name_zh, 'cat' as source
  from part where p_partkey%6=0"""
_OVER = "select cast(p_partkey as {S}) as grp_id, 'mine' as name_zh from part where p_partkey%25=0"


@query("card_names", f"""with c0 as ({_CAT.format(S='varchar')}), k0 as ({_CATALOGUE.format(S='varchar')}),
  o0 as ({_OVER.format(S='varchar')}),
  j as (select coalesce(c0.grp_id, k0.grp_id, o0.grp_id) as grp_id, coalesce(c0.name, k0.name_en) as en, c0.name_zh as tz,
    c0.source as ts, case when c0.name is null or c0.name=k0.name_en then k0.name_zh end as cz, o0.name_zh as oz from c0
    full join k0 on c0.grp_id=k0.grp_id full join o0 on o0.grp_id=coalesce(c0.grp_id, k0.grp_id)),
  n as (select *, coalesce(oz, cz, tz) as zh, coalesce(oz, cz, tz, en) as full0 from j)
  select grp_id, coalesce(regexp_replace(split_part(full0, ' // ', 1), '^A-', ''), 'grpId:' || grp_id) as card_name,
  coalesce(full0, 'grpId:' || grp_id) as full_name, en as name_en, zh as name_zh,
  case when oz is not null then 'override' when cz is not null then 'cat' when tz is not null then 'cached'
  when en is not null and ts='client' then 'client, untranslated' when en is not null and ts='scryfall'
  then 'scryfall, untranslated' when en is not null then 'english, source not recorded' else 'missing' end as name_source
  from n""", ())
def _(t):
    def run(text):
        return t.spark.sql(text.format(S="string").replace("from part", "from {part}"), part=t.raw("part"))
    return K.display_names(run(_CAT), run(_CATALOGUE), run(_OVER))


@query("archetype_priors", """select p_name || '#' || p_partkey as card_name, case when p_partkey%3=0 then 'Ramp,Combo'
  when p_partkey%3=1 then 'Aggro' end as tags from part where p_partkey%3<2""", ())
def _(t):
    text = F.expr("concat('{\"_comment\":\"Ramp\",\"', p_name, '#', p_partkey, '\":', case p_partkey%3 when 0 then "
                  "'[\"Ramp\",\"Bogus\",\"Combo\"]' when 1 then '\"Aggro\"' else '\"nope\"' end, '}')")
    loaded = K.load_priors(t.raw("part").select(text.alias("value")))
    return loaded.select("card_name", F.array_join("tags", ",").alias("tags"))


_PRIOR = "select distinct name as card_name, 'Ramp' as tag from cards where cast(grp_id as int)%2=0"
_PROF = """select name as card_name, case when cast(grp_id as int)%3=0 then 'Control,Combo' end as archetype_user,
  'Midrange' as archetype_auto from cards where cast(grp_id as int)%4=0"""


def _archetypes(t):
    priors = t.cards.filter("cast(grp_id as int)%2=0").select(
        F.col("name").alias("card_name"), F.array(F.lit("Ramp")).alias("tags"))
    return K.archetype_map(priors, t.spark.sql(_PROF.replace("from cards", "from {cards}"), cards=t.cards))


_ARCH = f"""arch as (select card_name, coalesce(mine, tag) as tags from ({_PRIOR}) p full join
  (select card_name, max(coalesce(archetype_user, archetype_auto)) as mine from ({_PROF}) group by 1) q using (card_name))"""


@query("archetype_map", f"with {_ARCH} select card_name, tags from arch", ("cards",))
def _(t):
    return _archetypes(t).select("card_name", F.array_join("tags", ",").alias("tags"))


_OPP = """oc as (select distinct m.*, c.grp_id from m join c on c.match_id=m.match_id and c.seat<>m.my_seat)"""


@query("matchups", f"""with {_OPP}, {_ARCH}, a as (select player_id, grp_id, max(start_time) as last_time, {CNT} as c_,
    {cnt("my_result='win'")} as w, {cnt("play_draw='play'")} as pn, {cnt("play_draw='play' and my_result='win'")} as pw,
    {cnt("play_draw='draw'")} as dn, {cnt("play_draw='draw' and my_result='win'")} as dw from oc where {DECIDED} group by 1,2)
  select player_id, cast(row_number() over (partition by player_id order by c_ desc, last_time desc nulls last, grp_id) as int)
  as position, grp_id, coalesce(name_zh, name, 'grpId:' || grp_id) as card_name, coalesce(x.tags, y.tags, '') as archetype,
  last_time, {rate_sql('w', 'c_')}, {rate_sql('pw', 'pn', 'on_play')}, {rate_sql('dw', 'dn', 'on_draw')}
  from a left join cards using (grp_id) left join arch x on x.card_name=cards.name
  left join arch y on y.card_name=coalesce(name_zh, name)""", ("m", "c", "cards"))
def _(t):
    return M.matchups(t.m, t.c, K.display_names(t.cards), _archetypes(t), ALL)


@query("matchups_by_recency", f"""with {_OPP}, {_ARCH}, a as (select player_id, grp_id, max(start_time) as last_time, {CNT} as c_,
    {cnt("my_result='win'")} as w, {cnt("play_draw='play'")} as pn, {cnt("play_draw='play' and my_result='win'")} as pw,
    {cnt("play_draw='draw'")} as dn, {cnt("play_draw='draw' and my_result='win'")} as dw from oc where {DECIDED} group by 1,2)
  select player_id, cast(row_number() over (partition by player_id order by last_time desc nulls last, c_ desc, grp_id) as int)
  as position, grp_id, coalesce(name_zh, name, 'grpId:' || grp_id) as card_name, coalesce(x.tags, y.tags, '') as archetype,
  last_time, {rate_sql('w', 'c_')}, {rate_sql('pw', 'pn', 'on_play')}, {rate_sql('dw', 'dn', 'on_draw')}
  from a left join cards using (grp_id) left join arch x on x.card_name=cards.name
  left join arch y on y.card_name=coalesce(name_zh, name)""", ("m", "c", "cards"))
def _(t):
    return M.matchups(t.m, t.c, K.display_names(t.cards), _archetypes(t), ALL, sort="recent")


@query("commander_coverage", f"""with {_OPP}, k as (select distinct match_id from oc where {_BRAWL})
  select player_id, {cnt(_BRAWL)} as eligible, {cnt('k.match_id is not null')} as with_cards, {CNT} as all_total,
  min(start_time) filter (where k.match_id is not null) as first_time,
  max(start_time) filter (where k.match_id is not null) as last_time
  from m left join k using (match_id) where {DECIDED} group by 1""", ("m", "c"))
def _(t):
    return M.commander_coverage(t.m, t.c, ALL)


JO1 = f"""cards_by as (select match_id, list_sort(list(distinct grp_id)) as commanders from
    (select m.match_id, c.grp_id from m join c on c.match_id=m.match_id and c.seat<>m.my_seat where {_BRAWL}) group by 1),
  mull as (select m.match_id, max(case when kept_on>0 then 1 else 0 end)=1 as mulligan from mu join m using (match_id)
    where kept_on is not null and (seat is null or seat=my_seat) group by 1),
  rec as (select m.*, mulligan, coalesce(commanders, []) as commanders from m left join mull using (match_id)
    left join cards_by using (match_id))"""


@query("enriched_matches", f"""with {JO1} select match_id, player_id, mulligan,
  array_to_string(commanders, ',') as commanders, event_key, my_result from rec""", ("m", "mu", "c"))
def _(t):
    return M.enriched_matches(t.m, t.mu, t.c).select(
        "match_id", "player_id", "mulligan", F.array_join("commanders", ",").alias("commanders"), "event_key",
        "my_result")


# both players of every match keep a record: seats exchanged, results turned round
_SHARED = """mm as (select * from m union all select * replace (player_id+1000000 as player_id, 3-my_seat as my_seat,
    case my_result when 'win' then 'loss' when 'loss' then 'win' end as my_result) from m)"""


def _shared(t):
    flip = F.expr("case my_result when 'win' then 'loss' when 'loss' then 'win' end")
    return t.m.unionByName(t.m.withColumn("player_id", (F.col("player_id") + 1000000).cast(t.m.schema["player_id"].dataType)).withColumn(
        "my_seat", (3 - F.col("my_seat")).cast(t.m.schema["my_seat"].dataType)).withColumn("my_result", flip))


@query("shared_match_cards", f"""with {_SHARED}, cards_by as (select player_id, match_id, list_sort(list(distinct grp_id)) as commanders from
    (select mm.player_id, mm.match_id, c.grp_id from mm join c on c.match_id=mm.match_id and c.seat<>mm.my_seat where {_BRAWL}) group by 1,2),
  mull as (select player_id, match_id, max(case when kept_on>0 then 1 else 0 end)=1 as mulligan from mu join mm using (match_id)
    where kept_on is not null and (seat is null or seat=my_seat) group by 1,2)
  select mm.player_id, mm.match_id, mulligan, coalesce(array_to_string(commanders, ','), '') as commanders, my_result from mm
  left join mull using (player_id, match_id) left join cards_by using (player_id, match_id)""", ("m", "mu", "c"))
def _(t):
    """Two players in one match see each other's cards and their own mulligans."""
    return M.enriched_matches(_shared(t), t.mu, t.c).select(
        "player_id", "match_id", "mulligan", F.array_join("commanders", ",").alias("commanders"), "my_result")


@query("shared_match_page", f"""with {_SHARED}, p as (select *, cast(row_number() over (partition by player_id
    order by start_time desc nulls last, match_id desc) as int) as position from mm where {VISIBLE} qualify position between 3 and 12)
  select player_id, position, match_id, my_result, (select cast(sum(kept_on) as bigint) from mu where mu.match_id=p.match_id
    and (seat is null or seat=p.my_seat)) as kept_sum, case when contains(event_key,'Brawl') then coalesce((select array_to_string(
    list_sort(list(distinct c.grp_id)),',') from c where c.match_id=p.match_id and c.seat=p.my_seat),'') else '' end as my_cards,
  case when contains(event_key,'Brawl') then coalesce((select array_to_string(list_sort(list(distinct c.grp_id)),',') from c
    where c.match_id=p.match_id and c.seat<>p.my_seat),'') else '' end as opp_cards from p""", ("m", "mu", "c"))
def _(t):
    page = M.match_page(_shared(t), t.g, t.mu, t.c, ALL, limit=10, offset=2)
    return page.select("player_id", "position", "match_id", "my_result", "kept_sum", F.array_join("my_cards", ",").alias("my_cards"),
                       F.array_join("opp_cards", ",").alias("opp_cards"))


@query("nemeses", f"""with m as (select * from md), {_OPP}, a as (select player_id, grp_id, {CNT} as n, {cnt("my_result='win'")} as wins from oc
  where {_BRAWL} and my_result is not null group by 1,2 having n>=3 and wins::double/n<0.4),
  b as (select *, {pct_sql('wins', 'n')} as wr from a)
  select *, cast(row_number() over (partition by player_id order by wr, n desc, grp_id) as int) as rank from b
  qualify rank<=5""", ("md", "c"))
def _(t):
    return M.nemeses(t.md, t.c)


_CARDS_OF = ("case when contains(event_key,'Brawl') then coalesce((select array_to_string(list_sort(list(distinct c.grp_id)),',')"
             " from c where c.match_id=p.match_id and c.seat{op}p.my_seat),'') else '' end")


@query("match_page", f"""with {LABELS}, p as (select *, cast(row_number() over (partition by player_id
    order by start_time desc nulls last, match_id desc) as int) as position from m where {VISIBLE}
    qualify position between 6 and 25),
  gm as (select match_id, string_agg(game_no || ':' || coalesce(result,'') || ':' || coalesce(play_draw,'') , ' '
    order by game_no) as games from g group by 1)
  select p.player_id, position, match_id, event_key, start_time, duration_sec, opponent_name, play_draw,
  case when play_draw is null and end_reason='Concede' then 'scoop' end as side_note, my_result, p.my_deck_tag,
  coalesce(limited_label, nullif(p.my_deck_tag,'')) as deck_label, event_key in ('Ladder','Traditional_Ladder')
  as type_eligible, games,
  (select cast(sum(kept_on) as bigint) from mu where mu.match_id=p.match_id and (seat is null or seat=p.my_seat)) as kept_sum,
  {_CARDS_OF.format(op='=')} as my_cards, {_CARDS_OF.format(op='<>')} as opp_cards, true as mode_sole
  from p left join gm using (match_id) left join lab on lab.player_id=p.player_id and lab.my_deck_id=p.my_deck_id""",
       ("m", "g", "mu", "c"))
def _(t):
    page = M.match_page(t.m, t.g, t.mu, t.c, ALL, limit=20, offset=5)
    games = F.array_join(F.transform("games", lambda g: F.concat_ws(
        ":", g.game_no.cast("string"), F.coalesce(g.result, F.lit("")), F.coalesce(g.play_draw, F.lit("")))), " ")
    return page.select(
        "player_id", "position", "match_id", "event_key", "start_time", "duration_sec", "opponent_name", "play_draw",
        "side_note", "my_result", "my_deck_tag", "deck_label", "type_eligible", games.alias("games"), "kept_sum",
        F.array_join("my_cards", ",").alias("my_cards"), F.array_join("opp_cards", ",").alias("opp_cards"),
        "mode_sole")


@query("match_page_far", f"""select player_id, position, match_id from (select player_id, match_id, cast(row_number() over (
  partition by player_id order by start_time desc nulls last, match_id desc) as int) as position from m where {VISIBLE})
  where position between 31 and 5030""")
def _(t):
    """A page whose end lies far behind the first thousand rows."""
    return M.match_page(t.m, t.g, t.mu, t.c, ALL, limit=5000, offset=30).select("player_id", "position", "match_id")


@query("match_page_last", f"""select player_id, position, match_id, case when contains(event_key,'Brawl') then coalesce((select array_to_string(
    list_sort(list(distinct c.grp_id)),',') from c where c.match_id=p.match_id and c.seat<>p.my_seat),'') else '' end as opp_cards
  from (select *, cast(row_number() over (partition by player_id order by start_time desc nulls last, match_id desc) as int) as position
    from m where {VISIBLE}) p where position between 41 and 60""", ("m", "c"))
def _(t):
    """A page found by a kept index, whose last rows are undated for some players."""
    index = cut_lineage(M.page_index(ALL.apply(t.m)))
    page = M.match_page(t.m, t.g, t.mu, t.c, ALL, limit=20, offset=40, index=index)
    return page.select("player_id", "position", "match_id", F.array_join("opp_cards", ",").alias("opp_cards"))


@query("match_page_totals", f"""select player_id, {cnt(VISIBLE)} as total, {cnt('is_abnormal=1 or is_bot=1')} as hidden
  from m where match_mode='BO1' group by 1""")
def _(t):
    return M.page_totals(t.m, Scope(mode="BO1"))


@query("export_matches", f"""with p as (select *, '=' || opponent_name as opp2 from m where {VISIBLE}), nm as (select c.*,
    coalesce(name_zh, name, 'grpId:' || c.grp_id) as cn from c left join cards using (grp_id))
  select player_id, start_time, cast(match_id as varchar) as match, source, event_key as event, match_mode as mode,
  coalesce(strftime(make_timestamp(start_time*1000), '%m-%d %H:%M'), '') as time, duration_sec as seconds,
  '''' || opp2 as opponent, coalesce(play_draw,'') as side, coalesce(my_result,'') as result, coalesce(end_reason,'') as reason,
  total_turns as turns, 'no' as abnormal, coalesce(my_deck_tag,'') as deck, case when {_BRAWL} then coalesce((select
    string_agg(distinct cn, ' // ' order by cn) from nm where nm.match_id=p.match_id and seat=my_seat),'') else '' end as own_cards,
  coalesce(opp_archetype_tag,'') as opponent_type, (select cast(sum(kept_on) as bigint) from mu where mu.match_id=p.match_id
    and (seat is null or seat=p.my_seat)) as mulligans, case when {_BRAWL} then coalesce((select
    string_agg(distinct cn, ' // ' order by cn) from nm where nm.match_id=p.match_id and seat<>my_seat),'') else '' end
  as opponent_cards, 'no' as bot from p""", ("m", "mu", "c", "cards"))
def _(t):
    rows = t.m.withColumn("opponent_name", F.concat(F.lit("="), "opponent_name"))
    return M.export_matches(rows, t.mu, t.c, K.display_names(t.cards), ALL)


@query("export_ranks", """select player_id, ts as sort_ts, coalesce(strftime(make_timestamp(ts*1000), '%m-%d %H:%M'), '') as time,
  coalesce(constructed_class,'') as constructed_class, cast(constructed_level as varchar) as constructed_level,
  coalesce(limited_class,'') as limited_class, cast(limited_level as varchar) as limited_level from r""", ("r",))
def _(t):
    return M.export_ranks(t.r)


@query("name_coverage", f"""with u as (select distinct grp_id from c) select {CNT} as used,
  cast(count(cards.grp_id) as bigint) as named, {cnt('cards.grp_id is null')} as missing,
  (select string_agg(grp_id, ',' order by grp_id) from (select grp_id from u where grp_id not in (select grp_id from cards
    where cast(grp_id as int)%4<>1) order by grp_id limit 5)) as sample_missing
  from u left join (select * from cards where cast(grp_id as int)%4<>1) cards using (grp_id)""", ("c", "cards"))
def _(t):
    return K.name_coverage(t.c, t.cards.filter("cast(grp_id as int)%4<>1"))


@query("pending_cards", """select distinct grp_id from (select grp_id from c union all
  select cast(l_partkey as varchar) from lineitem) where grp_id not in (select grp_id from cards)""", ("c", "cards"))
def _(t):
    history = t.raw("lineitem").select(F.col("l_partkey").cast("string").alias("grp_id"))
    return K.pending_cards(t.c, t.cards, history)


@query("card_fill", """with k as (select cast(p_partkey as varchar) as grp_id, case when p_partkey%4=0 then null else p_name end
    as name, case when p_partkey%3=0 then null else 'zh' end as name_zh, case when p_partkey%5=0 then null else 'old' end as source
    from part where p_partkey%2=0), i as (select cast(p_partkey as varchar) as grp_id, 'new_' || p_name as name,
    'client' as source from part where p_partkey%3<>1)
  select grp_id, coalesce(k.name, i.name) as name, name_zh, coalesce(k.source, i.source) as source
  from k full join i using (grp_id)""", ())
def _(t):
    part = t.raw("part")
    key = F.col("p_partkey").cast("string").alias("grp_id")
    known = part.filter("p_partkey%2=0").select(
        key, F.expr("case when p_partkey%4=0 then null else p_name end").alias("name"),
        F.expr("case when p_partkey%3=0 then null else 'zh' end").alias("name_zh"),
        F.expr("case when p_partkey%5=0 then null else 'old' end").alias("source"))
    incoming = part.filter("p_partkey%3<>1").select(key, F.concat(F.lit("new_"), "p_name").alias("name"),
                                                    F.lit("client").alias("source"))
    return K.fill_cards(known, incoming)


@query("translation_worklist", """select cast(p_partkey as varchar) as grp_id, p_name as name from part
  where p_partkey%3=0 and p_partkey%4<>0""", ())
def _(t):
    cards = t.raw("part").select(
        F.col("p_partkey").cast("string").alias("grp_id"), F.col("p_name").alias("name"),
        F.expr("case when p_partkey%3=0 then null else 'zh' end").alias("name_zh"),
        F.expr("case when p_partkey%4=0 then 1L end").alias("tried_at"))
    return K.translation_worklist(cards)


_LOC = """select p_size as title_id, p_partkey%4 as formatted, case p_partkey%3
  when 0 then concat('<sprite="x" name="arena_a"><i>', p_name, '</i>') when 1 then concat('<b>', p_name, '</b>  x')
  else p_name end as text from part"""


@query("client_card_names", f"""with loc as ({_LOC}),
  b as (select title_id, arg_min(text, (formatted<>1, formatted, text)) as raw from loc group by 1)
  select cast(p_partkey as varchar) as grp_id, trim(regexp_replace(regexp_replace(replace(raw,
  '<sprite="x" name="arena_a">', 'A-'), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) as name
  from part join b on b.title_id=p_size""", ())
def _(t):
    loc = t.spark.sql(_LOC.replace("from part", "from {part}"), part=t.raw("part"))
    cards = t.raw("part").select(F.col("p_partkey").cast("string").alias("grp_id"),
                                 F.col("p_size").alias("title_id"))
    return K.load_card_names(loc, cards)


_RAWCARDS = """select p_partkey as grp_id, p_partkey // 3 as title_id, case when p_partkey%3=2 or p_partkey%12 in (6,7,8)
  then 1 else 0 end as is_secondary, case when p_partkey%30=0 then 1 else 0 end as is_token,
  case when p_partkey%12=6 then p_partkey-3 end as linked_id, (p_partkey // 3)+1 as interchangeable from part"""


@query("title_mapping", f"""with k as ({_RAWCARDS}), d as (select title_id,
    arg_min(grp_id, (case when grp_id%5=0 then 0 else 1 end, grp_id)) as card_id from k
    where is_secondary=0 and is_token=0 group by 1),
  o as (select k.*, coalesce((select title_id from k k2 where k2.grp_id=k.linked_id and k2.is_secondary=0), interchangeable)
    as target from k where is_token=0 and title_id not in (select title_id from d))
  select * from d union all select o.title_id, arg_min(d.card_id, o.grp_id) from o join d on d.title_id=o.target group by 1""", ())
def _(t):
    cards = t.raw("part").selectExpr(
        "p_partkey as grp_id", "p_partkey div 3 as title_id",
        "case when p_partkey%3=2 or p_partkey%12 in (6,7,8) then 1 else 0 end as is_secondary",
        "case when p_partkey%30=0 then 1 else 0 end as is_token",
        "case when p_partkey%12=6 then array(p_partkey-3) else array() end as linked",
        "(p_partkey div 3)+1 as interchangeable")
    preferred = t.raw("part").filter("p_partkey%5=0").select(F.col("p_partkey").alias("grp_id"))
    return K.card_mapping(cards, preferred)
