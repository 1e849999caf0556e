"""The driver's tables seen as match history, in one text for both engines.

Each view is a list of select expressions over one table (or a short select); ``{K}``, ``{STR}`` and
``{MS}`` stand for the few spellings on which the engines differ.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

SPARK = {
    "K": "K",
    "STR": "string",
    "MS": "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {})",
    "FLOORDIV": "({} div {})",
}
DUCK = {
    "K": "K",
    "STR": "varchar",
    "MS": "(epoch_us({}) // 1000)",
    "FLOORDIV": "({} // {})",
}

TODAY = "2024-01-20"
# the number inside ``props``, read once per row
SPARK_K = "cast(get_json_object(props,'$.k') as int)"
EVENTS_DUCK = "(select *, cast(json_extract_string(props,'$.k') as int) as K from events)"

_MODE = """case when {E} like 'Traditional%' or {E} like 'TradDraft\\_%' escape '\\' then 'BO3'
  when {E} in ('Ladder','Play','Play_Brawl_Historic') or {E} like 'QuickDraft%' or {E} like 'PickTwoDraft%'
  then 'BO1' else 'unknown' end"""

_EVENT = """case cast(floor(value) as bigint)%7 when 0 then 'Play_Brawl_Historic'
  when 1 then 'QuickDraft_MOM_20230428' when 2 then 'PickTwoDraft_HOB_20260811' when 3 then 'Ladder'
  when 4 then 'Traditional_Ladder' when 5 then 'MWM_Momir_20240101' else 'Sealed_DMU_20220901' end"""

_MATCH_MODE = ("case cast(floor(value) as bigint)%7 when 0 then 'BO1' when 1 then 'BO1' when 2 then 'BO1' "
               "when 3 then 'BO1' when 4 then 'BO3' else 'unknown' end")

_NO_TIME = "user_id%10=0 and event_id%50=0"


def match_columns(d: dict, player: str = "user_id", null_times: bool = True) -> list[str]:
    ms = d["MS"].format("ts")
    none = _NO_TIME if null_times else "1=0"
    k = d["K"]
    s = d["STR"]
    return [
        "event_id as match_id",
        f"{player} as player_id",
        f"case when {none} then null else {ms} end as start_time",
        f"case when {none} then null else cast(ts as date) end as play_day",
        "case when event_type in ('purchase','signup') then 'win' when event_type in ('error','view') "
        "then 'loss' end as my_result",
        f"case when {k}%5 in (0,1) then 'play' when {k}%5 in (2,3) then 'draw' end as play_draw",
        f"{_EVENT} as event_key",
        f"{_MATCH_MODE} as match_mode",
        f"case when {k}%13=0 then null else 1 end as my_seat",
        f"concat('opp', cast({k}%20 as {s})) as opponent_name",
        f"case when event_id%11=0 then null else concat('deck', cast(event_id%4 as {s})) end as my_deck_tag",
        f"case when event_id%7=0 then null else concat('d', cast(user_id as {s}), '-', "
        f"cast(event_id%3 as {s})) end as my_deck_id",
        f"case when {k}%6=0 then null else concat('v', cast({k}%4 as {s})) end as my_deck_version",
        "value as duration_sec",
        f"case when {k}%17=0 then 1 else 0 end as is_bot",
        f"case when event_id%211=0 then 1 else 0 end as is_abnormal",
        "case when event_id%3=0 then 'import' else 'log' end as source",
        f"case when {k}%8=0 then 'Concede' when {k}%8=1 then null else 'Game' end as end_reason",
        f"case when {k}%9=0 then null else cast({k}%9+3 as int) end as total_turns",
        f"case {k}%10 when 0 then 'Aggro' when 1 then 'Control' when 2 then 'Ramp,Combo' when 3 then 'Combo' "
        "when 4 then 'Midrange' when 5 then '' end as opp_archetype_tag",
    ]


GAMES = """select l_orderkey as match_id, l_linenumber as game_no,
  case min(l_returnflag) when 'A' then 'win' when 'R' then 'loss' end as result,
  case min(l_linestatus) when 'F' then 'play' else 'draw' end as play_draw,
  max(l_quantity) as duration_sec
from lineitem group by l_orderkey, l_linenumber"""

COMMANDERS = """select distinct l_orderkey as match_id, 1+l_linenumber%2 as seat,
  cast(l_partkey as {STR}) as grp_id from lineitem"""

MULLIGANS = """select l_orderkey as match_id, l_linenumber as game_no,
  case when l_linenumber%3=0 then null else 1 end as seat,
  max(case when l_quantity > 48 then null else cast(l_quantity as int)%3 end) as kept_on
from lineitem group by l_orderkey, l_linenumber"""

RANKS = """select event_id as id, user_id as player_id,
  case when event_id%37=0 then null else {MS_TS} end as ts,
  case {K}%7 when 0 then 'Bronze' when 1 then 'Silver' when 2 then 'Gold' when 3 then 'Platinum'
    when 4 then 'Diamond' when 5 then 'Mythic' end as constructed_class,
  cast(1+event_id%5 as int) as constructed_level,
  case {K}%3 when 0 then 'Gold' when 1 then 'Platinum' end as limited_class,
  cast(1+event_id%4 as int) as limited_level
from events where event_type='signup'"""

CARDS = """select cast(p_partkey as {STR}) as grp_id, p_name as name,
  case when p_partkey%3=0 then null else concat('zh_', p_name) end as name_zh
from part"""

# one customer's orders as a match sequence: day-grain times, hence natural ties
TIED = """select o_orderkey as match_id, o_custkey as player_id,
  {MS_O} as start_time, cast(o_orderdate as date) as play_day,
  case when o_orderpriority like '1%' or o_orderpriority like '2%' then 'play'
       when o_orderpriority like '4%' or o_orderpriority like '5%' then 'draw' end as play_draw,
  case o_orderstatus when 'F' then 'win' when 'O' then 'loss' end as my_result
from orders"""


def _select(template: str, d: dict) -> str:
    return (template.replace("{MS_TS}", d["MS"].format("ts")).replace("{MS_O}", d["MS"].format("o_orderdate"))
            .replace("{K}", d["K"]).replace("{STR}", d["STR"]))


def duck_views() -> dict[str, str]:
    m = "select " + ", ".join(match_columns(DUCK)) + f" from {EVENTS_DUCK}"
    dense = "select " + ", ".join(match_columns(DUCK, "user_id%25", null_times=False)) + f" from {EVENTS_DUCK}"
    return {
        "m": m, "md": dense,
        "g": _select(GAMES, DUCK), "c": _select(COMMANDERS, DUCK), "mu": _select(MULLIGANS, DUCK),
        "r": _select(RANKS, DUCK).replace("from events", f"from {EVENTS_DUCK}"), "cards": _select(CARDS, DUCK), "tied": _select(TIED, DUCK),
    }


def with_views(body: str, *names: str) -> str:
    """Prefix an oracle text with the view definitions it uses; ``body`` may open with its own CTEs."""
    views = duck_views()
    ctes = ",\n".join(f"{n} as ({views[n]})" for n in names)
    body = body.strip()
    recursive = "recursive " if body.lower().startswith("with recursive") else ""
    if body.lower().startswith("with"):
        rest = body[len("with recursive"):] if recursive else body[len("with"):]
        return f"with {recursive}{ctes},\n{rest.strip()}"
    return f"with {ctes}\n{body}"


class Tables:
    """Lazy DataFrames over one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # calendar days of the oracle are UTC
        self.dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("K", F.expr(SPARK_K))

    def _run(self, template: str, table: str) -> DataFrame:
        text = _select(template, SPARK).replace(f"from {table}", "from {src}")
        return self.spark.sql(text, src=self.events if table == "events" else self.raw(table))

    @cached_property
    def m(self) -> DataFrame:
        return self.events.selectExpr(*match_columns(SPARK))

    @cached_property
    def md(self) -> DataFrame:
        return self.events.selectExpr(*match_columns(SPARK, "user_id%25", null_times=False))

    @cached_property
    def g(self) -> DataFrame:
        return self._run(GAMES, "lineitem")

    @cached_property
    def c(self) -> DataFrame:
        return self._run(COMMANDERS, "lineitem")

    @cached_property
    def mu(self) -> DataFrame:
        return self._run(MULLIGANS, "lineitem")

    @cached_property
    def r(self) -> DataFrame:
        return self._run(RANKS, "events")

    @cached_property
    def cards(self) -> DataFrame:
        return self._run(CARDS, "part")

    @cached_property
    def tied(self) -> DataFrame:
        return self._run(TIED, "orders")
