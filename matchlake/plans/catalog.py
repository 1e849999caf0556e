"""Registry of named queries with their oracle texts."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ("m",)):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is the equivalent oracle text."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views) if views else sql
        return fn
    return add


# ---- oracle text snippets -------------------------------------------------------------------
Z = "1.959963984540054"
CNT = "cast(count(*) as bigint)"


def cnt(cond: str) -> str:
    return f"cast(count(*) filter (where {cond}) as bigint)"


def pct_sql(part: str, whole: str, digits: int = 1) -> str:
    return f"case when ({whole}) > 0 then round(100.0::double * ({part}) / ({whole}), {digits}) end"


def rate_sql(wins: str, n: str, prefix: str = "") -> str:
    p = f"{prefix}_" if prefix else ""
    w, t = f"({wins})::double", f"({n})::double"
    mid = f"(({w}/{t}) + {Z}*{Z}/(2*{t}))"
    half = f"({Z}*sqrt(({w}/{t})*(1-{w}/{t})/{t} + {Z}*{Z}/(4*{t}*{t})))"
    den = f"(1+{Z}*{Z}/{t})"
    return f"""({n}) as {p}n, ({wins}) as {p}wins, {pct_sql(wins, n)} as {p}wr,
      case when ({n})=0 then 0.0::double when ({wins})=0 then 0.0::double
        else round(greatest(0.0, ({mid}-{half})/{den})*100, 1) end as {p}lo,
      case when ({n})=0 then 0.0::double when ({wins})=({n}) then 100.0::double
        else round(least(1.0, ({mid}+{half})/{den})*100, 1) end as {p}hi"""


def family_sql(e: str = "event_key") -> str:
    return f"""case when starts_with(coalesce({e},''),'MWM_') then 'weekly'
      when contains({e},'Brawl') then 'brawl' when contains({e},'Draft') then 'draft'
      when contains({e},'Sealed') then 'sealed' when {e}='Ladder' or suffix({e},'_Ladder') then 'ladder'
      when {e}='Play' or suffix({e},'_Play') then 'play' when contains({e},'Event') then 'constructed'
      else 'other' end"""


VISIBLE = "is_abnormal=0 and is_bot=0"
DECIDED = f"{VISIBLE} and my_result is not null"
