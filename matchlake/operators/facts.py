"""Daily facts: notable things about every (player, day), scored and reduced to at most two per day.

All days of all players in one job. Facts that need only day totals come from one aggregate; the rest
come from runs, card and opponent aggregates. History ('before the day') is a running window over
day-level rows, so nothing later than the day can leak in.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import classify as C
from ..functions.winrate import count_where, is_decided, is_loss, is_win
from ..session import cut_lineage
from .runs import best_run_per_day, capped_runs
from .sequences import longest_true_run, result_arcs, streak_observations

DAY = ["player_id", "play_day"]
OUT = [*DAY, "kind", "level", "n", "denominator", "weight", "side", "detail", "seq"]

# ---- fixed values ---------------------------------------------------------------------------
MARATHON, LONG = 15, 10
MILESTONES = (100, 250, 500, 1000, 1500, 2000, 2500, 3000, 4000, 5000, 6000, 7000, 8000, 9000, 10000, 12000,
              15000, 20000)
THEMES = {
    "hot_wr": "result", "play_draw_streak": "side", "pd_skew": "side", "repeat_commander": "opponent",
    "repeat_opponent": "opponent", "rare_commander": "opponent", "revenge": "opponent", "nemesis": "opponent",
    "volume": "tempo", "blitz": "tempo", "arc": "tempo", "milestone": "history", "limited_run": "limited",
}
WEIGHTS = {
    "milestone": 1.1, "hot_wr": 1.0, "play_draw_streak": 1.0, "revenge": 0.95, "repeat_opponent": 0.9,
    "nemesis": 0.85, "repeat_commander": 0.85, "arc": 0.8, "rare_commander": 0.75, "pd_skew": 0.6, "blitz": 0.5,
    "volume": 0.25,
}
RUN_WEIGHTS = {"cap": 1.15, "near": 1.05, "even": 0.95, "bust": 0.7, "low": 0.6}
DEFAULT_WEIGHT = 0.5
RARE_DAYS, RARE_LEGENDARY_DAYS = 180, 365
FRESH_DAYS = 7
SECOND_SHARE = 0.3
# ---------------------------------------------------------------------------------------------
NEEDED = [*DAY, "match_id", "start_time", "event_key", "my_result", "play_draw", "my_deck_id", "duration_sec",
          "opponent_name", "is_bot", "commanders"]
# candidate order decides ties, as listed here
ORDER = ("single", "volume", "hot_wr", "play_draw_streak", "pd_skew", "repeat_commander", "repeat_opponent", "arc",
         "blitz", "limited_run", "milestone", "revenge", "nemesis", "rare_commander")
HISTORY_KINDS = ("milestone", "revenge", "nemesis", "rare_commander")


def _map(table: dict, key: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(key))


def _text(v) -> Column:
    return F.lit(None).cast("string") if v is None else (v if isinstance(v, Column) else F.lit(v)).cast("string")


def _fact(kind: str, n: Column, denominator: Column, level=None, side=None, detail=None, weight=None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), _text(level).alias("level"), n.cast("bigint").alias("n"),
        denominator.cast("bigint").alias("denominator"),
        (F.lit(None) if weight is None else weight).cast("double").alias("weight"),
        _text(side).alias("side"), _text(detail).alias("detail"), F.lit(ORDER.index(kind)).alias("seq"))


def day_totals(rows: DataFrame) -> DataFrame:
    """One row per (player, day) with every count the simple facts need and the match total before it."""
    seconds = F.coalesce("duration_sec", F.lit(0.0))
    base = rows.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("n"), count_where(is_win()).alias("wins"), count_where(is_decided()).alias("decided"),
        count_where(F.col("play_draw") == "play").alias("play"), count_where(F.col("play_draw") == "draw").alias("draw"),
        F.round(F.sum(seconds), 3).alias("seconds"),
        count_where((seconds > 0) & (seconds < 60)).alias("blitz"),
        count_where(F.size("commanders") > 0).alias("identified"),
        F.max("my_result").alias("any_result"), F.max("play_draw").alias("any_side"))
    before = Window.partitionBy("player_id").orderBy("play_day").rowsBetween(Window.unboundedPreceding, -1)
    return base.withColumn("total_before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def simple_facts(base: DataFrame) -> DataFrame:
    """single, volume, hot win rate, side skew (not yet checked against streaks), blitz, milestone."""
    n, decided, wins = F.col("n"), F.col("decided"), F.col("wins")
    known = F.col("play") + F.col("draw")
    share = wins / decided
    hot = F.when(decided == 3, wins == 3).otherwise((decided >= 4) & (share >= 0.70))
    perfect = (share >= 0.95) | ((decided >= 4) & (wins == decided))
    strong = (share >= 0.80) & (decided >= 10)
    side = (F.when(known < 3, F.lit(None)).when(F.col("play") / known >= 0.70, "play")
            .when(F.col("draw") / known >= 0.70, "draw"))
    side_n = F.when(side == "play", F.col("play")).otherwise(F.col("draw"))
    mark = F.array_min(F.filter(F.array(*[F.lit(m) for m in MILESTONES]),
                                lambda m: (m > F.col("total_before")) & (m <= F.col("total_before") + n)))
    hours = F.when(F.col("seconds") > 0, F.round(F.col("seconds") / 3600).cast("int"))
    many = n > 1
    candidates = F.array_compact(F.array(
        F.when(n == 1, _fact("single", n, n, detail=F.coalesce("any_result", F.lit("unknown")), side=F.col("any_side"))),
        F.when(n >= LONG, _fact("volume", n, n, F.when(n >= MARATHON, "legendary").otherwise("rare"), detail=hours)),
        F.when(many & hot, _fact("hot_wr", decided, n, F.when(perfect | strong, "legendary").otherwise("rare"))),
        F.when(many & side.isNotNull(), _fact("pd_skew", side_n, n, side=side)),
        F.when(many & (F.col("blitz") >= 3), _fact("blitz", F.col("blitz"), n)),
        F.when(many & mark.isNotNull(), _fact("milestone", n, n, "legendary", detail=mark)),
    ))
    return base.select(*DAY, F.explode(candidates).alias("f")).select(*DAY, "f.*")


def streak_facts(rows: DataFrame, base: DataFrame) -> DataFrame:
    seen = streak_observations(rows, DAY).join(base.filter("n > 1").select(*DAY, F.col("n").alias("day_n")), DAY)
    return seen.select(*DAY, _fact("play_draw_streak", F.col("length"), F.col("day_n"), F.col("level"),
                                   side=F.col("side"), detail=F.round("scan", 6)).alias("f")).select(*DAY, "f.*")


def drop_covered_skew(simple: DataFrame, streaks: DataFrame) -> DataFrame:
    """A side skew says nothing when one streak of that side already covers all of it."""
    covering = streaks.select(*DAY, "side", F.col("n").alias("covered"), F.lit("pd_skew").alias("kind"))
    joined = simple.join(covering, [*DAY, "side", "kind"], "left")
    return joined.filter((F.col("kind") != "pd_skew") | F.col("covered").isNull()
                         | (F.col("covered") < F.col("n"))).select(*OUT)


def cards_per_day(rows: DataFrame) -> DataFrame:
    """(player, card, day): meetings that day, first row of the day, last time seen on an earlier day."""
    at = F.struct(F.col("start_time").alias("time"), F.col("match_id").alias("id"))
    met = (rows.select(*DAY, "start_time", "match_id", F.explode("commanders").alias("grp_id"))
           .groupBy(*DAY, "grp_id").agg(F.count(F.lit(1)).alias("met"), F.min(at).alias("first"),
                                        F.max(at).alias("latest")))
    before = Window.partitionBy("player_id", "grp_id").orderBy("play_day").rowsBetween(
        Window.unboundedPreceding, -1)
    return met.withColumn("seen_before", F.max("latest.time").over(before))


def card_facts(rows: DataFrame, cards: DataFrame, base: DataFrame, rare_days: int = RARE_DAYS,
               legendary_days: int = RARE_LEGENDARY_DAYS) -> DataFrame:
    """The most repeated opposing card (heavier when met back to back) and the longest-unseen one."""
    totals = base.filter("n > 1").select(*DAY, F.col("n").alias("day_n"), "identified")
    top = cards.groupBy(*DAY).agg(F.min(F.struct((-F.col("met")).alias("a"), "grp_id", "met")).alias("t")).select(
        *DAY, F.col("t.grp_id").alias("top_card"), F.col("t.met").alias("met")).filter("met >= 3")
    flagged = rows.select(*DAY, "start_time", "match_id", "commanders").join(top.select(*DAY, "top_card"), DAY)
    flagged = flagged.withColumn("hit", F.expr("array_contains(commanders, top_card)"))
    run = longest_true_run(flagged, DAY, "hit").select(*DAY, "run")
    streak = F.coalesce(F.col("run") >= 3, F.lit(False))
    denominator = F.when(F.col("identified") > 0, F.col("identified")).otherwise(F.col("day_n"))
    repeated = top.join(totals, DAY).join(run, DAY, "left").select(*DAY, _fact(
        "repeat_commander", F.when(streak, F.col("run")).otherwise(F.col("met")), denominator,
        F.when(streak, "legendary"), detail=F.col("top_card")).alias("f"))
    # the gap is counted from the last row of the day, as later rows of a day are further away
    gap = F.floor((F.col("latest.time") - F.col("seen_before")) / 86_400_000)
    late = cards.filter("seen_before is not null").withColumn("gap", gap).filter(F.col("gap") >= rare_days)
    best = late.groupBy(*DAY).agg(F.min(F.struct((-F.col("gap")).alias("a"), F.col("latest").alias("b"), "grp_id",
                                                 "gap")).alias("t")).join(totals, DAY)
    rare = best.select(*DAY, _fact(
        "rare_commander", F.lit(1), F.col("day_n"),
        F.when(F.col("t.gap") >= legendary_days, "legendary").otherwise("rare"),
        detail=F.col("t.gap")).alias("f"))
    return repeated.unionByName(rare).select(*DAY, "f.*")


def opponents_per_day(rows: DataFrame) -> DataFrame:
    """(player, opponent, day) over people: the day's record and the record of all earlier days."""
    name = F.trim(F.coalesce("opponent_name", F.lit("")))
    person = rows.withColumn("opponent", name).filter((F.col("opponent") != "") & (F.coalesce("is_bot", F.lit(0)) == 0))
    counts = ~F.coalesce("event_key", F.lit("")).contains("BotMatch")
    at = F.struct(F.col("start_time").alias("time"), F.col("match_id").alias("id"))
    day = person.groupBy(*DAY, "opponent").agg(
        F.count(F.lit(1)).alias("met"), F.min(F.when(is_win(), at)).alias("first_win"),
        F.min(F.when(is_loss(), at)).alias("first_loss"),
        count_where(counts & is_win()).alias("w"), count_where(counts & is_loss()).alias("l"))
    before = Window.partitionBy("player_id", "opponent").orderBy("play_day").rowsBetween(
        Window.unboundedPreceding, -1)
    return day.select(*DAY, "opponent", "met", "first_win", "first_loss",
                      F.coalesce(F.sum("w").over(before), F.lit(0)).alias("prior_wins"),
                      F.coalesce(F.sum("l").over(before), F.lit(0)).alias("prior_losses"))


def opponent_facts(opponents: DataFrame, base: DataFrame) -> DataFrame:
    """Same person three times in a day; beating someone who led; losing again to someone never beaten."""
    pw, pl = F.col("prior_wins"), F.col("prior_losses")
    revenge = F.col("first_win").isNotNull() & (pl >= 2) & (pl > pw)
    nemesis = F.col("first_loss").isNotNull() & (pl >= 3) & (pw == 0)

    def pick(cond, first):
        return F.min(F.when(cond, F.struct((-pl).alias("a"), F.col(first).alias("b"), F.col("opponent").alias("o"))))

    agg = opponents.groupBy(*DAY).agg(
        F.min(F.struct((-F.col("met")).alias("a"), F.col("opponent").alias("o"), "met")).alias("top"),
        pick(revenge, "first_win").alias("rev"), pick(nemesis, "first_loss").alias("nem"))
    agg = agg.join(base.filter("n > 1").select(*DAY, F.col("n").alias("day_n")), DAY)
    found = F.array_compact(F.array(
        F.when(F.col("top.met") >= 3, _fact("repeat_opponent", F.col("top.met"), F.col("day_n"), "legendary",
                                            detail=F.col("top.o"))),
        F.when(F.col("rev").isNotNull(), _fact("revenge", F.lit(1), F.col("day_n"), detail=F.col("rev.o"))),
        F.when(F.col("nem").isNotNull(), _fact("nemesis", F.lit(1), F.col("day_n"), detail=F.col("nem.o")))))
    return agg.select(*DAY, F.explode(found).alias("f")).select(*DAY, "f.*")


def arc_facts(rows: DataFrame, base: DataFrame) -> DataFrame:
    arcs = result_arcs(rows, DAY).join(base.filter("n > 1").select(*DAY, F.col("n").alias("day_n")), DAY)
    return arcs.select(*DAY, _fact(
        "arc", F.col("decided"), F.col("day_n"), F.when(F.col("arc") == "comeback", "legendary").otherwise("rare"),
        detail=F.concat_ws(":", "arc", F.col("first_len").cast("string"), F.col("last_len").cast("string")))
        .alias("f")).select(*DAY, "f.*")


def run_facts(rows: DataFrame, base: DataFrame) -> DataFrame:
    """The best capped run that ended that day, wherever it began."""
    best = best_run_per_day(capped_runs(rows)).withColumnRenamed("n", "run_n").join(
        base.filter("n > 1").select(*DAY, F.col("n").alias("day_n")), DAY)
    level = F.when(F.col("band") == "cap", "legendary").when(F.col("band") == "near", "rare")
    return best.select(*DAY, _fact("limited_run", F.col("run_n"), F.col("day_n"), level, detail=F.col("band"),
                                   weight=_map(RUN_WEIGHTS, "band")).alias("f")).select(*DAY, "f.*")


def filter_for_volume(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """On marathon days weak signals go: ordinary hot streaks and side runs, and any side skew."""
    marathon = base.select(*DAY, (F.col("n") >= MARATHON).alias("marathon"))
    weak = (F.col("kind") == "pd_skew") | (F.col("kind").isin("hot_wr", "play_draw_streak")
                                           & (F.coalesce("level", F.lit("")) != "legendary"))
    return candidates.join(marathon, DAY).filter(~(F.col("marathon") & weak)).drop("marathon")


def fact_candidates(rows: DataFrame, rare_days: int = RARE_DAYS,
                    legendary_days: int = RARE_LEGENDARY_DAYS) -> DataFrame:
    """Every candidate fact of every (player, day). ``rows`` are enriched, dated match rows.

    The needed columns and the day-level tables are written once, since several kinds of fact read them.
    """
    rows = cut_lineage(rows.select(*NEEDED))
    base = cut_lineage(day_totals(rows))
    streaks = cut_lineage(streak_facts(rows, base))
    parts = [drop_covered_skew(simple_facts(base), streaks), streaks,
             card_facts(rows, cut_lineage(cards_per_day(rows)), base, rare_days, legendary_days),
             opponent_facts(opponents_per_day(rows), base), arc_facts(rows, base), run_facts(rows, base)]
    out = parts[0].select(*OUT)
    for p in parts[1:]:
        out = out.unionByName(p.select(*OUT))
    return filter_for_volume(out, base)


def drama(seen: Column, use_rarity: bool = False) -> Column:
    """weight x evidence x freshness x level bonus; optional rarity from the scan probability."""
    weight = F.coalesce(F.col("weight"), _map(WEIGHTS, "kind"), F.lit(DEFAULT_WEIGHT))
    evidence = 1 + 0.12 * F.log(1 + F.col("n"))
    fresh = 1 / (1 + 0.6 * F.least(seen, F.lit(3)))
    bonus = F.when(F.col("level") == "legendary", 1.4).otherwise(1.0)
    score = weight * evidence * fresh * bonus
    if use_rarity:
        p = F.when(F.col("kind") == "play_draw_streak", F.col("detail").cast("double"))
        score = score * F.when((p > 0) & (p < 1), F.sqrt(F.least(1 / p, F.lit(50.0)))).otherwise(1.0)
    return score


def assemble(candidates: DataFrame, seen: Column | None = None, use_rarity: bool = False) -> DataFrame:
    """Best fact, then the best one of another theme that scores at least 30% of it; volume comes last."""
    scored = candidates.withColumn("score", drama(F.lit(0) if seen is None else seen, use_rarity))
    scored = scored.withColumn("theme", F.coalesce(_map(THEMES, "kind"), F.lit("other")))
    order = [F.col("kind") == "volume", F.desc("score"), F.desc("n"), F.asc("seq"), F.asc("detail"), F.asc("side")]
    day = Window.partitionBy(*DAY)  # a handful of candidates per day
    ranked = scored.withColumn("rank", F.row_number().over(day.orderBy(*order)))
    lead = F.max(F.when(F.col("rank") == 1, F.struct("theme", "score"))).over(day)
    ranked = ranked.withColumn("lead", lead)
    second = (F.col("rank") > 1) & (F.col("theme") != F.col("lead.theme")) & (
        F.col("score") >= SECOND_SHARE * F.col("lead.score"))
    ranked = ranked.withColumn("pick", F.when(second, F.col("rank")))
    ranked = ranked.withColumn("next", F.min("pick").over(day))
    return ranked.filter((F.col("rank") == 1) | (F.col("rank") == F.col("next"))).withColumn(
        "slot", F.when(F.col("rank") == 1, 1).otherwise(2)).drop("rank", "lead", "pick", "next")


def recent_kinds(candidates: DataFrame) -> DataFrame:
    """(player, day, kind) -> how often the kind was told on the seven days before, when each of those
    days is judged without history and without freshness."""
    told = assemble(candidates.filter(~F.col("kind").isin(*HISTORY_KINDS))).select("player_id", "play_day", "kind")
    ahead = told.select("player_id", "kind", F.explode(
        F.sequence(F.date_add("play_day", 1), F.date_add("play_day", FRESH_DAYS))).alias("play_day"))
    return ahead.groupBy("player_id", "play_day", "kind").agg(F.count(F.lit(1)).alias("seen"))


def daily_facts(rows: DataFrame, rare_days: int = RARE_DAYS, legendary_days: int = RARE_LEGENDARY_DAYS,
                use_rarity: bool = False) -> DataFrame:
    """At most two facts for every (player, day), less likely to repeat what the last week already told."""
    candidates = cut_lineage(fact_candidates(rows, rare_days, legendary_days))
    fresh = candidates.join(recent_kinds(candidates), [*DAY, "kind"], "left").withColumn(
        "seen", F.coalesce("seen", F.lit(0)))
    return assemble(fresh, F.col("seen"), use_rarity)
