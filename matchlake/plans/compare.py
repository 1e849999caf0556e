"""Comparison and test queries with their oracles."""
from pyspark.sql import functions as F

from ..functions.tests_of_chance import chi2_tail, p_to_score
from ..operators import compare as P, matchups as M, sequences as S
from .catalog import CNT, VISIBLE, cnt, query, rate_sql
from .decks import JO1
from .overview import ALL, DAY
from .sequences import islands_sql

STRATA = """st0 as (select *, case when coalesce(event_key,'')='' or match_mode='unknown' then 'unknown'
    when contains(event_key,'Draft') or contains(event_key,'Sealed') then 'limited'
    when coalesce(my_deck_version,'')<>'' and coalesce(my_deck_tag,'')<>'' then 'deck' else 'unknown' end as kind
    from {src} where {where}),
  st1 as (select {keys}, event_key as event, match_mode as mode, kind, case when kind<>'limited' then my_deck_tag end as deck,
    case when kind='deck' then my_deck_version end as version, now_, then_, my_result from st0),
  st2 as (select {keys}, event, mode, kind, deck, version, {cn} as cn, {cw} as cw,
    case when kind='unknown' then 0 else {bn} end as bn, case when kind='unknown' then 0 else {bw} end as bw
    from st1 group by {keys}, event, mode, kind, deck, version having count(*) filter (where now_)>0),
  strata as (select *, kind<>'unknown' and bn>=20 and cn>0 as usable from st2)"""


def strata_sql(src, keys="player_id", where="true"):
    return STRATA.format(src=src, keys=keys, where=where, cn=cnt("now_ and my_result is not null"),
                         cw=cnt("now_ and my_result='win'"), bn=cnt("then_ and my_result is not null"),
                         bw=cnt("then_ and my_result='win'"))


STRATA_OUT = f"""event, mode, kind, deck, version, {rate_sql('cw', 'cn', 'current')}, {rate_sql('bw', 'bn', 'baseline')},
  case when usable then round(100*(cw::double/cn-bw::double/bn),1) end as delta_pp, usable, cn<20 as small_sample"""

_SRC = f"""w as (select *, play_day>=date '2024-01-11' as now_, play_day<date '2024-01-11' as then_ from md where {VISIBLE})"""


def _strata(t):
    now, then = P.window_periods(DAY, 10)
    return P.stratified(ALL.apply(t.md), now, then, ["player_id"])


@query("comparison_strata", f"with {_SRC}, {strata_sql('w')} select player_id, {STRATA_OUT} from strata", ("md",))
def _(t):
    return _strata(t)


ADJUSTED = """select {keys}, cast(coalesce(sum(cn) filter (where usable),0) as bigint) as covered,
  cast(sum(cn) as bigint) as total_decided,
  round(100*(sum(cw) filter (where usable)-sum(cn::double*bw/bn) filter (where usable))/sum(cn) filter (where usable),1)
  as adjusted_delta_pp from strata group by {keys}"""


@query("comparison_adjusted", f"with {_SRC}, {strata_sql('w')} {ADJUSTED.format(keys='player_id')}", ("md",))
def _(t):
    return P.adjusted(_strata(t), ["player_id"])


BY_EVENT = """ev0 as (select {keys}, coalesce(event,'') as event, mode, cast(sum(cn) as bigint) as tn, cast(sum(cw) as bigint) as tw,
    cast(coalesce(sum(cn) filter (where usable),0) as bigint) as comparable_n,
    cast(coalesce(sum(bn) filter (where usable),0) as bigint) as baseline_n,
    round(100*(sum(cw) filter (where usable)-sum(cn::double*bw/bn) filter (where usable))/sum(cn) filter (where usable),1)
    as delta_pp from strata group by {keys}, coalesce(event,''), mode),
  ev1 as (select *, row_number() over (partition by {keys} order by case when delta_pp is null then 1 else 0 end,
    abs(delta_pp) desc, comparable_n desc, event, mode) as rk from ev0)"""
BY_EVENT_OUT = f"""event, mode, {rate_sql('tw', 'tn')}, comparable_n, baseline_n, delta_pp, case when delta_pp is null
  then 'no_baseline' when delta_pp>=5 then 'higher' when delta_pp<=-5 then 'lower' else 'similar' end as status,
  tn<20 as small_sample, rk=1 and delta_pp is not null as headline"""


@query("comparison_by_event", f"""with {_SRC}, {strata_sql('w')}, {BY_EVENT.format(keys='player_id')}
  select player_id, {BY_EVENT_OUT} from ev1""", ("md",))
def _(t):
    return P.by_event(_strata(t), ["player_id"])


@query("side_balance_test", f"""with a as (select player_id, {cnt("play_draw='play'")} as play, {cnt("play_draw='draw'")} as draw
    from m where {VISIBLE} group by 1),
  x as (select a.*, (select sum(exp(lgamma(play+draw+1)-lgamma(i+1)-lgamma(play+draw-i+1)+(play+draw)*ln(0.5::double)))
    from unnest(range(0, least(play,draw)+1)) u(i)) as tail from a),
  y as (select player_id, play, draw, least(1.0, 2*tail) as p from x)
  select player_id, play, draw, round(p,6) as p, case when p>=0.1 then 50.0 when p<=0.0001 then 100.0
  else round(50+50*(log10(p)+1)/-3.0,1) end as score from y""")
def _(t):
    return P.side_balance(ALL.apply(t.m), ["player_id"]).withColumn("p", F.round("p", 6))


_ENR = JO1.replace("from m ", "from w ").replace("join m ", "join w ").replace("select m.*", "select w.*").replace(
    "m.match_id", "w.match_id").replace("m.my_seat", "w.my_seat")
_W30 = f"""w as (select *, play_day>=date '2024-01-11' as now_, play_day<date '2024-01-11' as then_ from md where {VISIBLE})"""


def _enriched(t):
    return M.enriched_matches(ALL.apply(t.md), t.mu, t.c)


@query("mulligan_shift", f"""with {_W30}, {_ENR}, a as (select player_id, {cnt('now_ and mulligan')} as now_yes,
    {cnt('now_ and mulligan is not null')} as now_n, {cnt('then_ and mulligan')} as before_yes,
    {cnt('then_ and mulligan is not null')} as before_n from rec group by 1),
  b as (select *, (now_yes+before_yes)::double/(now_n+before_n) as p from a)
  select player_id, now_yes, now_n, before_yes, before_n, case when least(now_n*p, now_n*(1-p), before_n*p, before_n*(1-p))>=5
  then round(power((now_yes::double/now_n-before_yes::double/before_n)/sqrt(p*(1-p)*(1.0/now_n+1.0/before_n)),2),6) end as chi2
  from b""", ("md", "mu", "c"))
def _(t):
    return P.mulligan_shift(_enriched(t), ["player_id"], DAY, 10).withColumn("chi2", F.round("chi2", 6))


_MIX = """s as (select player_id, {cards} as cards, {a} as a, {b} as b from rec where {known} group by 1,2 having a+b>0),
  tt as (select player_id, sum(a) as an, sum(b) as bn from s group by 1),
  cell as (select s.player_id, a, b, an, bn, (a+b)*(an::double/(an+bn)) as ea, (a+b)*(1-an::double/(an+bn)) as eb
    from s join tt using (player_id)),
  mix as (select player_id, cast(max(an) as bigint) as now_n, cast(max(bn) as bigint) as before_n, cast(count(*) as bigint) as kinds,
    sum(power(a-ea,2)/ea+power(b-eb,2)/eb) as stat, min(least(ea,eb)) as le from cell group by 1)"""


@query("opponent_mix_shift", f"""with {_W30}, {_ENR},
  {_MIX.format(cards="array_to_string(commanders, ',')", a=cnt('now_'), b=cnt('then_'), known='len(commanders)>0')}
  select player_id, now_n, before_n, kinds, case when le>=5 and kinds>1 then round(stat,6) end as chi2,
  case when le>=5 and kinds>1 then kinds-1 end as df from mix""", ("md", "mu", "c"))
def _(t):
    return P.opponent_mix_shift(_enriched(t), ["player_id"], DAY, 10).withColumn(
        "chi2", F.round("chi2", 6))


# chi-square tail: finite sum, with erfc(sqrt(h)) from the all-positive series of erf for odd degrees of freedom
_TAIL = """least(1.0, case when df % 2 = 1 then greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-h) * list_sum(list_transform(range(0, 400),
    lambda i: exp(least(700, i * ln(2.0) + (2 * i + 1) * ln(sqrt(h)) - (lgamma(2 * i + 2.0) - i * ln(2.0) - lgamma(i + 1.0)))))))
    else 0.0 end + coalesce(list_sum(list_transform(range(0, cast(df // 2 as bigint)), lambda i: exp(
    (i + (df % 2) / 2.0) * ln(h) - h - lgamma(i + (df % 2) / 2.0 + 1)))), 0.0))"""


@query("opponent_mix_p_values", f"""with {_W30}, {_ENR},
  {_MIX.format(cards="array_to_string(commanders, ',')", a=cnt('now_'), b=cnt('then_'), known='len(commanders)>0')},
  x as (select player_id, now_n, before_n, kinds, case when le>=5 and kinds>1 then stat end as chi2,
    case when le>=5 and kinds>1 then kinds-1 end as df from mix),
  y as (select *, case when chi2 is null then null when chi2<=0 then 1.0 else {_TAIL} end as p_ from (select *, chi2/2 as h from x)),
  z as (select *, round(p_, 6) as p from y)
  select player_id, now_n, before_n, kinds, chi2, df, p, case when p is null then null when p>=0.10 then 50.0 when p<=1e-4 then 100.0
    else round(50+50*(log10(p)+1)/-3.0, 1) end as score from z""", ("md", "mu", "c"))
def _(t):
    mix = P.opponent_mix_shift(_enriched(t), ["player_id"], DAY, 10)
    p = chi2_tail("chi2", F.col("df").cast("double"))
    return mix.withColumn("p", F.round(p, 6)).withColumn("score", p_to_score("p"))


@query("mulligan_shift_p_values", f"""with {_W30}, {_ENR}, a as (select player_id, {cnt('now_ and mulligan')} as now_yes,
    {cnt('now_ and mulligan is not null')} as now_n, {cnt('then_ and mulligan')} as before_yes,
    {cnt('then_ and mulligan is not null')} as before_n from rec group by 1),
  b as (select *, (now_yes+before_yes)::double/(now_n+before_n) as p from a),
  x as (select player_id, 1 as df, case when least(now_n*p, now_n*(1-p), before_n*p, before_n*(1-p))>=5 then
    power((now_yes::double/now_n-before_yes::double/before_n)/sqrt(p*(1-p)*(1.0/now_n+1.0/before_n)),2) end as chi2 from b),
  y as (select *, case when chi2 is null then null when chi2<=0 then 1.0 else {_TAIL} end as p_ from (select *, chi2/2 as h from x))
  select player_id, round(p_, 6) as p from y""", ("md", "mu", "c"))
def _(t):
    shift = P.mulligan_shift(_enriched(t), ["player_id"], DAY, 10)
    return shift.select("player_id", F.round(chi2_tail("chi2", F.lit(1.0)), 6).alias("p"))


def _report_sql(keys: str, where: str) -> str:
    """The whole window report: side balance, both shifts with p values where they may be judged, the longest losing streak."""
    same = lambda c: f"min(coalesce({c},''))=max(coalesce({c},''))"
    return f"""with {_W30}, {_ENR}, rw as (select *, coalesce(my_result,'')='loss' as lost from rec where (now_ or then_) and {where}),
  un as (select {keys}, {cnt('now_')} as n, {same('event_key')} and {same('my_deck_tag')} and {same('my_deck_version')}
    and min(coalesce(my_deck_version,''))<>'' as comparable, {cnt("now_ and play_draw='play'")} as play,
    {cnt("now_ and play_draw='draw'")} as draw, {cnt('now_ and mulligan')} as my, {cnt('now_ and mulligan is not null')} as mn,
    {cnt('then_ and mulligan')} as by_, {cnt('then_ and mulligan is not null')} as bn_ from rw group by {keys}),
  si as (select *, least(1.0, 2*(select sum(exp(lgamma(play+draw+1)-lgamma(i+1)-lgamma(play+draw-i+1)+(play+draw)*ln(0.5::double)))
    from unnest(range(0, least(play,draw)+1)) u(i))) as side_p, (my+by_)::double/nullif(mn+bn_,0) as mp from un),
  x as (select *, case when least(mn*mp, mn*(1-mp), bn_*mp, bn_*(1-mp))>=5 then power((my::double/mn-by_::double/bn_)
    /sqrt(mp*(1-mp)*(1.0/mn+1.0/bn_)),2) end as chi2, 1 as df from si),
  mu_p as (select {keys}, case when chi2 is null then null when chi2<=0 then 1.0 else {_TAIL} end as mull_p
    from (select *, chi2/2 as h from x)),
  {_MIX.format(cards="array_to_string(commanders, ',')", a=cnt('now_'), b=cnt('then_'), known='len(commanders)>0')
      .replace('player_id', keys).replace('s.' + keys, ', '.join('s.' + k.strip() for k in keys.split(','))).replace('from rec', 'from rw').replace('group by 1,2', f'group by {keys}, cards').replace('group by 1)', f'group by {keys})')},
  mx as (select *, case when le>=5 and kinds>1 then stat end as chi2, case when le>=5 and kinds>1 then kinds-1 end as df from mix),
  cp as (select {keys}, now_n as card_n, before_n, case when chi2 is null then null when chi2<=0 then 1.0 else {_TAIL} end as cards_p
    from (select *, chi2/2 as h from mx)),
  nowr as (select * from rw where now_), {islands_sql('i', 'nowr', keys, 'lost', 'coalesce(start_time,-1), match_id')},
  ml as (select {keys}, coalesce(max(len) filter (where state),0) as streak from i group by {keys})
  select {keys}, n, comparable, case when n>0 then play end as play, case when n>0 then draw end as draw,
  case when play+draw>=20 then round(side_p,6) end as side_p,
  case when play+draw>=20 then case when side_p>=0.1 then 50.0 when side_p<=0.0001 then 100.0
    else round(50+50*(log10(side_p)+1)/-3.0,1) end end as side_score, mn as mulligan_n, my as mulligan_yes,
  case when comparable and bn_>=20 and mn>=20 then round(mull_p,6) end as mulligan_p, coalesce(card_n,0) as card_n,
  case when comparable and card_n>=20 and before_n>=20 then round(cards_p,6) end as card_p, coalesce(streak,0) as max_loss_streak
  from x left join mu_p using ({keys}) left join cp using ({keys}) left join ml using ({keys})"""


def _report(t, keys, rows):
    now, _ = P.window_periods(DAY, 10)
    out = P.window_report(rows, S.loss_streaks(rows.filter(now), keys), keys, DAY, 10)
    return out.withColumns({c: F.round(c, 6) for c in ("side_p", "mulligan_p", "card_p")})


@query("window_report", _report_sql("player_id", "true"), ("md", "mu", "c"))
def _(t):
    return _report(t, ["player_id"], _enriched(t))


_BUILD = "event_key is not null and my_deck_tag is not null and my_deck_version is not null"


@query("window_report_by_build", _report_sql("event_key, my_deck_tag, my_deck_version", _BUILD), ("md", "mu", "c"))
def _(t):
    """Rows of one event, deck and version of all players, so that the shifts may be judged."""
    return _report(t, ["event_key", "my_deck_tag", "my_deck_version"], _enriched(t).filter(_BUILD))


@query("match_set_summary", f"""with w as (select * from m where {VISIBLE}), {_ENR},
  ls as (select *, coalesce(my_result,'')='loss' as lost from rec),
  {islands_sql('i', 'ls', 'player_id', 'lost', 'coalesce(start_time,-1), match_id')},
  mls as (select player_id, coalesce(max(len) filter (where state),0) as max_loss_streak from i group by 1),
  met as (select player_id, grp_id, {CNT} as met from (select player_id, unnest(commanders) as grp_id from rec) group by 1,2),
  topc as (select player_id, string_agg(grp_id || '=' || met, ',' order by rk) filter (where met>=3) as top_cards from
    (select *, row_number() over (partition by player_id order by met desc, grp_id) as rk from met) where rk<=5 group by 1),
  dc as (select player_id, {CNT} as distinct_cards from met group by 1),
  a as (select player_id, {CNT} as matches, {cnt("my_result='win'")} as w, {cnt("my_result='loss'")} as losses,
    {cnt("my_result is null")} as unknown_result, {cnt("play_draw='play'")} as play, {cnt("play_draw='draw'")} as draw,
    {cnt("play_draw is null")} as unknown_side, {cnt("mulligan is not null")} as mulligan_known,
    {cnt("mulligan")} as mulligan_yes, {cnt("my_deck_tag<>''")} as deck_known,
    {cnt("contains(event_key,'Brawl')")} as card_eligible, {cnt("contains(event_key,'Brawl') and len(commanders)>0")} as card_known,
    {cnt("duration_sec is not null")} as duration_known, round(sum(duration_sec),3) as duration_total from rec group by 1)
  select player_id, matches, losses, unknown_result, {rate_sql('w', 'w+losses')}, play, draw, unknown_side,
  {rate_sql('play', 'play+draw', 'play_share')}, mulligan_known, mulligan_yes, deck_known, card_eligible, card_known,
  coalesce(distinct_cards,0) as distinct_cards, coalesce(top_cards,'') as top_cards, duration_known, duration_total,
  max_loss_streak from a join mls using (player_id) left join topc using (player_id) left join dc using (player_id)""",
       ("m", "mu", "c"))
def _(t):
    rows = M.enriched_matches(ALL.apply(t.m), t.mu, t.c)
    return M.match_set_summary(rows, S.loss_streaks(rows, ["player_id"]), ["player_id"])
