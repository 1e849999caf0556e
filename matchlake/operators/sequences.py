"""Streaks, scan probabilities, day arcs, rank curves and version changes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import classify as C
from ..functions.winrate import is_decided
from ..functions.tests_of_chance import no_run_probability
from ..session import cut_lineage
from .ordered import chunked, islands, mark_ties


def _side_rows(rows: DataFrame, keys: list[str], target_rows: int | None) -> DataFrame:
    """Dated rows with ``side`` NULL wherever the order or the side cannot be confirmed."""
    dated = rows.filter("start_time is not null").select(
        *keys, "start_time", "match_id", "play_draw")
    marked = mark_ties(chunked(dated, keys, "start_time", target_rows), keys, "start_time", "match_id")
    side = F.when(~F.col("_tied") & F.col("play_draw").isin("play", "draw"), F.col("play_draw"))
    return marked.withColumn("side", side)


def side_streaks(rows: DataFrame, keys: list[str], target_rows: int | None = None) -> DataFrame:
    """Longest run on either side and the current one. Unknown sides and tied times break a run; any
    undated row makes the order unknowable for the whole key."""
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                     F.count(F.when(F.col("start_time").isNull(), 1)).alias("undated"))
    runs = islands(_side_rows(rows, keys, target_rows), keys, "start_time", "match_id", "side",
                   attrs=("_tied",), flags=("_tied",))
    last = F.struct("side", "len", "tail")
    agg = runs.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("side") == "play", F.col("len"))), F.lit(0)).alias("lp"),
        F.coalesce(F.max(F.when(F.col("side") == "draw", F.col("len"))), F.lit(0)).alias("ld"),
        F.max_by(last, F.col("tail")).alias("cur"), F.max("_tied").alias("ambiguous"))
    sure = F.col("undated") == 0
    reason = (F.when(~sure, "undated rows").when(F.col("cur.tail._tied"), "last rows share one time")
              .when(F.col("cur.side").isNull(), "last side unknown"))
    return totals.join(agg, keys, "left").select(
        *keys, "n", F.when(sure, F.col("lp")).alias("longest_play"), F.when(sure, F.col("ld")).alias("longest_draw"),
        F.when(sure, F.col("cur.side")).alias("current_side"),
        F.when(sure & F.col("cur.side").isNotNull(), F.col("cur.len")).otherwise(F.lit(0)).alias("current_n"),
        F.when(sure, F.col("cur.tail.time")).alias("last_time"), reason.alias("reason"),
        F.when(sure, F.col("ambiguous")).alias("ambiguous_order"))


def severity(p: Column) -> Column:
    return (F.when(p < 0.01, "legendary").when(p < 0.05, "rare").when(p < 0.15, "unusual")
            .otherwise("notable"))


def percent(p: Column) -> Column:
    v = p * 100
    return F.when(v < 0.1, F.round(v, 3)).when(v < 1, F.round(v, 2)).otherwise(F.round(v, 1))


def streak_observations(rows: DataFrame, keys: list[str], min_length: int = 3,
                        target_rows: int | None = None) -> DataFrame:
    """Best run per side (longest, then latest) with the scan probability over all confirmable blocks."""
    undated = rows.filter("start_time is null").select(*keys).distinct()
    prepared = _side_rows(rows, keys, target_rows)
    # the rows are read once; everything below works on their runs
    runs = cut_lineage(islands(prepared, keys, "start_time", "match_id", "side").join(undated, keys, "left_anti"))
    best = runs.filter("side is not null").groupBy(*keys, "side").agg(F.max_by(
        F.struct("len", "head", "tail"), F.struct("len", F.col("tail.time"))).alias("b")).select(
        *keys, "side", F.col("b.len").alias("length"), F.col("b.head.time").alias("first_time"),
        F.col("b.head.tie").alias("first_id"), F.col("b.tail.time").alias("last_time"),
        F.col("b.tail.tie").alias("last_id")).filter(F.col("length") >= min_length)
    joined = runs.select(*keys, F.col("head.time").alias("time"), F.col("head.tie").alias("tie"),
                         F.col("side").isNotNull().alias("sided"), F.col("len").alias("size"))
    blocks = (islands(chunked(joined, keys, "time", target_rows), keys, "time", "tie", "sided", weight="size")
              .filter("sided").groupBy(*keys, F.col("len").alias("block")).agg(F.count(F.lit(1)).alias("times")))
    pairs = best.select(*keys, "side", "length").join(blocks, keys)
    table = pairs.select("block", "length").distinct().withColumn(
        "q", no_run_probability(F.col("block"), F.col("length")))
    scan = (pairs.join(table, ["block", "length"]).groupBy(*keys, "side").agg(
        F.min("q").alias("q_min"), F.sum(F.when(F.col("q") > 0, F.col("times") * F.log("q"))).alias("log_q"),
        F.sum("times").alias("blocks"), F.sum(F.col("times") * F.col("block")).alias("known")))
    p = F.when(F.col("q_min") <= 0, F.lit(1.0)).otherwise(1 - F.exp("log_q"))
    fixed = F.pow(F.lit(0.5), F.col("length"))
    return (best.join(scan, [*keys, "side"]).withColumn("scan", p)
            .select(*keys, "side", "length", "first_time", "first_id", "last_time", "last_id", "blocks", "known",
                    "scan", percent(F.col("scan")).alias("scan_percent"), percent(fixed).alias("fixed_percent"),
                    severity(F.col("scan")).alias("level")))


def streak_evidence(rows: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """The match rows inside each reported run, as rows (never a collected id list)."""
    runs = observations.select(*keys, "side", "first_time", "last_time")
    return (rows.join(runs, keys).filter(F.col("start_time").between(F.col("first_time"), F.col("last_time")))
            .select(*keys, "side", "match_id", "start_time"))


def loss_streaks(rows: DataFrame, keys: list[str], target_rows: int | None = None) -> DataFrame:
    """Longest run of losses per key; anything else (also an unknown result) breaks it."""
    ordered = rows.select(*keys, F.coalesce("start_time", F.lit(-1)).alias("time"), "match_id",
                          F.coalesce(F.col("my_result") == "loss", F.lit(False)).alias("lost"))
    runs = islands(chunked(ordered, keys, "time", target_rows), keys, "time", "match_id", "lost")
    return runs.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("lost"), F.col("len"))), F.lit(0)).alias("max_loss_streak"))


def rank_curve(ranks: DataFrame, track: str = "constructed", target_rows: int | None = None) -> DataFrame:
    """Dated, recognised rank points with adjacent repeats collapsed to the first."""
    cls, level = F.col(f"{track}_class"), F.col(f"{track}_level")
    points = ranks.filter("ts is not null").select(
        "player_id", "ts", "id", cls.alias("class"), level.alias("level"), C.rank_score(cls, level).alias("score"))
    points = chunked(points.filter("score is not null"), ["player_id"], "ts", target_rows)
    steps = islands(points, ["player_id"], "ts", "id", "score", attrs=("class", "level"))
    return steps.select("player_id", F.col("head.time").alias("ts"), F.col("head.class").alias("class"),
                        F.col("head.level").alias("level"), "score", C.score_label("score").alias("label"))


def result_arcs(rows: DataFrame, keys: list[str], target_rows: int | None = None) -> DataFrame:
    """First and last result run of a key when they oppose each other, both >= 3, and do not overlap."""
    decided = rows.filter(is_decided() & F.col("start_time").isNotNull()).select(
        *keys, "start_time", "match_id", "my_result")
    runs = islands(chunked(decided, keys, "start_time", target_rows), keys, "start_time", "match_id", "my_result")
    piece = F.struct("my_result", "len")
    agg = runs.groupBy(*keys).agg(F.sum("len").alias("decided"), F.min_by(piece, F.col("head")).alias("a"),
                                  F.max_by(piece, F.col("tail")).alias("z"))
    arc = F.when(F.col("a.my_result") == "loss", "comeback").otherwise("collapse")
    return agg.filter((F.col("decided") >= 6) & (F.col("a.my_result") != F.col("z.my_result"))
                      & (F.col("a.len") >= 3) & (F.col("z.len") >= 3)
                      & (F.col("a.len") + F.col("z.len") <= F.col("decided"))).select(
        *keys, arc.alias("arc"), "decided", F.col("a.len").alias("first_len"), F.col("z.len").alias("last_len"))


def longest_true_run(rows: DataFrame, keys: list[str], flag: str, target_rows: int | None = None) -> DataFrame:
    """Longest run of rows with ``flag`` true (earliest on ties) among all rows of the key."""
    ordered = rows.select(*keys, "start_time", "match_id", F.coalesce(flag, F.lit(False)).alias("hit"))
    runs = islands(chunked(ordered, keys, "start_time", target_rows), keys, "start_time", "match_id", "hit")
    return runs.filter("hit").groupBy(*keys).agg(F.max_by(
        F.struct("len", "head", "tail"), F.struct("len", (-F.col("head.time")).alias("t"))).alias("b")).select(
        *keys, F.col("b.len").alias("run"), F.col("b.head.time").alias("run_first"),
        F.col("b.tail.time").alias("run_last"))


def version_changes(rows: DataFrame, keys: list[str], target_rows: int | None = None) -> DataFrame:
    """Points where the build version changes, with the record of that version from that day on."""
    versioned = rows.filter("start_time is not null and coalesce(my_deck_version, '') <> ''")
    ordered = chunked(versioned.select(*keys, "start_time", "match_id", "play_day", "my_deck_version"), keys,
                      "start_time", target_rows)
    marks = islands(ordered, keys, "start_time", "match_id", "my_deck_version", attrs=("play_day",)).select(
        *keys, F.col("head.play_day").alias("play_day"), F.col("my_deck_version").alias("version"),
        F.col("head.tie").alias("match_id"))
    per_day = versioned.groupBy(*keys, F.col("my_deck_version").alias("version"), "play_day").agg(
        F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("my_result") == "win", 1)).alias("w"),
        F.count(F.when(F.col("my_result") == "loss", 1)).alias("l"))
    onward = Window.partitionBy(*keys, "version").orderBy(F.desc("play_day")).rowsBetween(
        Window.unboundedPreceding, 0)
    after = per_day.select(*keys, "version", "play_day", F.sum("c").over(onward).alias("n_after"),
                           F.sum("w").over(onward).alias("wins_after"), F.sum("l").over(onward).alias("losses_after"))
    return marks.join(after, [*keys, "version", "play_day"]).select(
        *keys, F.col("play_day").cast("string").alias("day"), "version", "match_id", "n_after", "wins_after",
        "losses_after")
