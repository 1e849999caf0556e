"""Capped runs: a limited event ends at its win cap or its loss cap, then counting restarts.

Within a chunk of one (player, event, deck) group this is a fold. Groups larger than one chunk use
that the counter has few states: each chunk is summarised as 'start state -> end state', summaries
are composed in two levels (blocks of chunks, then chunks), and every chunk is folded again from its
true start state. The result is the same as one sequential pass, without one task seeing the group.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import classify as C
from ..functions.winrate import is_decided
from .ordered import CHUNK, CHUNKS, chunked

FOLD_ROWS = 20_000
BLOCK = 1000
KEYS = ["player_id", "event_key", "deck_id"]

_STEP = """(a, x) -> if(a.w + x.won >= cap_wins or a.l + 1 - x.won >= cap_losses,
    named_struct('w', 0, 'l', 0, 'c', a.c + 1L),
    named_struct('w', a.w + x.won, 'l', a.l + 1 - x.won, 'c', a.c))"""
_TRANSITIONS = f"""transform(sequence(0, cap_wins * cap_losses - 1), s -> aggregate(seq,
    named_struct('w', cast(s div cap_losses as int), 'l', s % cap_losses, 'c', 0L), {_STEP}))"""
_RUNS = """aggregate(seq,
    named_struct('w', w0, 'l', l0, 'p', 0, 'f', 1, 'done', cast(array() as
      array<struct<first:int,last:int,wins:int,losses:int>>)),
    (a, x) -> if(a.w + x.won >= cap_wins or a.l + 1 - x.won >= cap_losses,
      named_struct('w', 0, 'l', 0, 'p', a.p + 1, 'f', a.p + 2, 'done', concat(a.done, array(named_struct(
        'first', a.f, 'last', a.p + 1, 'wins', a.w + x.won, 'losses', a.l + 1 - x.won)))),
      named_struct('w', a.w + x.won, 'l', a.l + 1 - x.won, 'p', a.p + 1, 'f', a.f, 'done', a.done)),
    a -> a.done)"""


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sequential composition of the transitions of one block of chunks."""
    pdf = pdf.sort_values(CHUNK)
    losses = int(pdf["cap_losses"].iloc[0])
    total = None
    for step in pdf["trans"]:
        if total is None:
            total = [(e["w"], e["l"], e["c"]) for e in step]
        else:
            total = [(step[w * losses + l]["w"], step[w * losses + l]["l"], c + step[w * losses + l]["c"])
                     for w, l, c in total]
    out = pdf[KEYS + ["_block", "cap_losses"]].head(1).copy()
    out[CHUNK] = out["_block"]
    out["trans"] = [[{"w": w, "l": l, "c": c} for w, l, c in total]]
    return out[KEYS + ["_block", CHUNK, "cap_losses", "trans"]]


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Start state of every chunk, given the start state of the first."""
    pdf = pdf.sort_values(CHUNK)
    losses = int(pdf["cap_losses"].iloc[0])
    w, l, c = int(pdf["w0"].iloc[0]), int(pdf["l0"].iloc[0]), int(pdf["c0"].iloc[0])
    rows = []
    for step in pdf["trans"]:
        rows.append((w, l, c))
        end = step[w * losses + l]
        w, l, c = end["w"], end["l"], c + end["c"]
    out = pdf[KEYS + [CHUNK]].copy()
    out["w0"], out["l0"], out["c0"] = zip(*rows)
    return out


def _folded(matches: DataFrame, fold_rows: int, block: int) -> DataFrame:
    rows = (matches.withColumn("spec", C.run_spec()).filter(F.col("spec").isNotNull() & is_decided())
            .select("player_id", "event_key", F.coalesce("my_deck_id", F.lit("")).alias("deck_id"),
                    F.coalesce("start_time", F.lit(0)).alias("time"), "match_id",
                    (F.col("my_result") == "win").cast("int").alias("won"), "spec.*"))
    spec = ["kind", "cap_wins", "cap_losses", "break_even"]
    pieces = chunked(rows, KEYS, "time", fold_rows, "match_id").groupBy(*KEYS, CHUNK, CHUNKS, *spec).agg(
        F.array_sort(F.collect_list(F.struct("time", "match_id", "won"))).alias("seq"))
    many = pieces.filter(F.col(CHUNKS) > 1).withColumn("trans", F.expr(_TRANSITIONS)).select(
        *KEYS, CHUNK, F.floor(F.col(CHUNK) / block).alias("_block"), "cap_losses", "trans")
    key_types = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    key_ddl = ", ".join(f"{k} {key_types[k]}" for k in KEYS)
    trans_ddl = "trans array<struct<w:int,l:int,c:bigint>>"
    totals = many.groupBy(*KEYS, "_block").applyInPandas(
        _compose, f"{key_ddl}, _block bigint, {CHUNK} bigint, cap_losses int, {trans_ddl}")
    zero = {"w0": F.lit(0), "l0": F.lit(0), "c0": F.lit(0).cast("bigint")}
    start_ddl = f"{key_ddl}, {CHUNK} bigint, w0 int, l0 int, c0 bigint"
    block_starts = totals.withColumns(zero).groupBy(*KEYS).applyInPandas(_starts, start_ddl)
    chunk_starts = (many.join(block_starts.withColumnRenamed(CHUNK, "_block"), [*KEYS, "_block"])
                    .groupBy(*KEYS, "_block").applyInPandas(_starts, start_ddl))
    none = F.lit(0)
    return (pieces.join(chunk_starts, [*KEYS, CHUNK], "left")
            .withColumn("w0", F.coalesce("w0", none)).withColumn("l0", F.coalesce("l0", none))
            .withColumn("c0", F.coalesce("c0", none.cast("bigint")))
            .withColumn("done", F.expr(_RUNS)))


def capped_runs(matches: DataFrame, fold_rows: int = FOLD_ROWS, block: int = BLOCK) -> DataFrame:
    """Finished runs only: record, band, whether unbeaten, and when the run ended."""
    folded = _folded(matches, fold_rows, block)
    runs = folded.select(*KEYS, "kind", "cap_wins", "break_even", "c0", "seq", F.posexplode("done").alias("i", "run"))
    end = F.element_at("seq", F.col("run.last"))
    wins, losses = F.col("run.wins"), F.col("run.losses")
    return runs.select(
        *KEYS, (F.col("c0") + F.col("i") + 1).alias("run_no"), "kind", wins.alias("wins"), losses.alias("losses"),
        F.col("cap_wins").alias("cap"), "break_even", C.run_band(wins, "cap_wins", "break_even").alias("band"),
        (losses == 0).alias("perfect"), end["time"].alias("end_time"), end["match_id"].alias("end_match"),
        (wins + losses).alias("n"))


def capped_run_members(matches: DataFrame, fold_rows: int = FOLD_ROWS, block: int = BLOCK) -> DataFrame:
    """Every match of a finished run with its run number (rows of unfinished runs drop out)."""
    folded = _folded(matches, fold_rows, block)
    parts = F.expr("""concat(transform(done, (r, i) -> named_struct('run_no', c0 + i + 1,
        'rows', slice(seq, r.first, r.last - r.first + 1))),
      array(named_struct('run_no', c0 + size(done) + 1, 'rows', if(size(done) = 0, seq,
        slice(seq, done[size(done) - 1].last + 1, size(seq))))))""")
    labelled = folded.select(*KEYS, F.explode(parts).alias("part")).select(
        *KEYS, "part.run_no", F.explode("part.rows").alias("row")).select(
        *KEYS, "run_no", F.col("row.match_id").alias("match_id"))
    finished = capped_runs(matches, fold_rows, block).select(*KEYS, "run_no")
    return labelled.join(finished, [*KEYS, "run_no"], "left_semi")


def best_run_per_day(runs: DataFrame) -> DataFrame:
    """The run most worth telling of each (player, day it ended): band, then wins, then latest end."""
    order = F.struct((-C.band_order("band")).alias("b"), "wins", "end_time", "event_key", "deck_id")
    best = F.struct("event_key", "deck_id", "run_no", "kind", "wins", "losses", "band", "perfect", "end_time", "n")
    day = F.to_date(F.timestamp_millis("end_time"))
    return (runs.withColumn("play_day", day).groupBy("player_id", "play_day")
            .agg(F.max_by(best, order).alias("b")).select("player_id", "play_day", "b.*"))
