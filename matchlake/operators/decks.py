"""Deck names that tell decks apart, deck lists and identities under a name."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import classify as C
from ..functions.winrate import count_where, is_win, rate_columns
from ..scope import Scope
from .overview import top_ranked

NO_ID_LABEL = "deck id not recorded"


def _filled(col: str):
    return F.coalesce(F.col(col), F.lit("")) != ""


def deck_labels(matches: DataFrame) -> DataFrame:
    """(player, deck id): name of its latest named match, share of limited events and distinguishing labels.

    ``limited_label`` exists only where the name is shared by several ids and the deck is limited;
    ``identity_label`` covers every shared name.
    """
    with_id = matches.filter(_filled("my_deck_id"))
    shared = (with_id.filter(_filled("my_deck_tag")).groupBy("player_id", F.col("my_deck_tag").alias("tag"))
              .agg(F.countDistinct("my_deck_id").alias("ids")).filter("ids > 1")
              .select("player_id", "tag", F.lit(True).alias("ambiguous")))
    latest = F.struct(F.coalesce("start_time", F.lit(-1)), "match_id")
    per_id = with_id.groupBy("player_id", "my_deck_id").agg(
        F.max_by("my_deck_tag", F.when(_filled("my_deck_tag"), latest)).alias("tag"), F.count(F.lit(1)).alias("n"),
        count_where(C.is_limited()).alias("limited"), count_where(C.is_draft()).alias("draft"),
        F.min("start_time").alias("first_time"))
    kind = (F.when(F.col("limited") / F.col("n") < C.LIMITED_SHARE, F.lit(None))
            .when(F.col("draft") * 2 >= F.col("limited"), "draft").otherwise("sealed"))
    when_first = F.coalesce(C.minute_label("first_time"), F.lit("time not recorded"))
    labelled = per_id.join(shared, ["player_id", "tag"], "left").withColumn("kind", kind)
    known = F.col("ambiguous") & F.col("kind").isNotNull()
    limited_label = F.when(known, F.concat_ws(" · ", "kind", when_first))
    return labelled.select(
        "player_id", "my_deck_id", "tag", "n", "limited", "draft", "first_time", "kind",
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
        limited_label.alias("limited_label"),
        F.coalesce(limited_label, F.when(F.col("ambiguous"), F.concat(F.lit("since "), when_first)))
        .alias("identity_label"))


def recent_decks(matches: DataFrame, scope: Scope, limit: int | None = 12, focus: DataFrame | None = None) -> DataFrame:
    """Decks by recency (key = id, else name) with labels made unique within the player.

    ``focus`` (player_id, primary family) narrows each player to the dominant recent family.
    """
    all_labels = deck_labels(matches).select("player_id", F.col("my_deck_id").alias("deck_id"), "limited_label")
    rows = scope.decided(matches)
    if focus is not None:
        rows = (rows.withColumn("_family", C.event_family())
                .join(focus.select("player_id", F.col("primary").alias("_family")),
                      ["player_id", "_family"], "left_semi"))
    did = F.coalesce(F.col("my_deck_id"), F.lit(""))
    tag = F.coalesce(F.col("my_deck_tag"), F.lit(""))
    keyed = rows.select(
        "player_id", did.alias("deck_id"), F.when(did == "", tag).otherwise("").alias("name_key"),
        tag.alias("tag"), "start_time", "match_id", "play_draw", "my_result")
    agg = keyed.groupBy("player_id", "deck_id", "name_key").agg(
        F.max_by("tag", F.struct(F.coalesce("start_time", F.lit(-1)), "match_id")).alias("deck"),
        F.count(F.lit(1)).alias("cnt"), count_where(is_win()).alias("won"),
        F.min("start_time").alias("first_time"), F.max("start_time").alias("last_time"),
        count_where(F.col("play_draw") == "play").alias("play"),
        count_where(F.col("play_draw") == "draw").alias("draw"))
    blank = (F.col("deck_id") == "") & (F.col("name_key") == "")
    head = agg.groupBy("player_id").agg(
        count_where(~blank).alias("total"),
        F.coalesce(F.sum(F.when(blank, F.col("cnt"))), F.lit(0)).alias("unlabelled"))
    decks = agg.filter(~blank).join(all_labels, ["player_id", "deck_id"], "left")
    decks = decks.withColumn("label", F.coalesce("limited_label", F.nullif(F.col("deck"), F.lit("")), "deck_id"))
    recency = Window.partitionBy("player_id").orderBy(F.desc_nulls_last("last_time"), "label", "deck_id", "name_key")
    same = Window.partitionBy("player_id", "label")
    decks = decks.withColumn("position", F.row_number().over(recency))
    decks = decks.withColumn("label", F.when(F.count(F.lit(1)).over(same) > 1, F.concat(
        "label", F.lit(" · since "), F.coalesce(C.minute_label("first_time"), F.lit("time not recorded")))
    ).otherwise(F.col("label")))
    tail = F.when(F.col("deck_id") != "", F.substring("deck_id", 1, 6)).otherwise(
        F.concat(F.lit("row "), F.col("position").cast("string")))
    decks = decks.withColumn("label", F.when(F.count(F.lit(1)).over(same) > 1, F.concat_ws(
        " · ", "label", tail)).otherwise(F.col("label")))
    if limit is not None:
        decks = decks.filter(F.col("position") <= limit)
    return (decks.join(head, "player_id")
            .select("player_id", "position", "deck", "deck_id", "label", "first_time", "last_time", "play",
                    "draw", *rate_columns("won", "cnt"), "total", "unlabelled"))


def deck_identities(matches: DataFrame, scope: Scope) -> DataFrame:
    """Every (name, deck id) pair with its count in scope and the id's store-wide label."""
    rows = Scope(event=scope.event, family=scope.family, mode=scope.mode,
                 exclude_abnormal=scope.exclude_abnormal, exclude_bot=scope.exclude_bot).apply(matches)
    counts = (rows.groupBy("player_id", F.coalesce("my_deck_tag", F.lit("")).alias("deck"),
                           F.coalesce("my_deck_id", F.lit("")).alias("deck_id"))
              .agg(F.count(F.lit(1)).alias("n")).filter("deck <> ''"))
    if scope.deck:
        counts = counts.filter(F.col("deck") == scope.deck)
    labels = deck_labels(matches).select("player_id", F.col("my_deck_id").alias("deck_id"), "identity_label")
    label = F.coalesce("identity_label", F.nullif(F.col("deck_id"), F.lit("")), F.lit(NO_ID_LABEL))
    return (counts.join(labels, ["player_id", "deck_id"], "left")
            .select("player_id", "deck", "deck_id", label.alias("label"), "n"))


def deck_kinds(matches: DataFrame, scope: Scope, keys: list[str]) -> DataFrame:
    rows = scope.apply(matches)
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), count_where(C.is_brawl()).alias("brawl"),
                                  count_where(C.is_limited()).alias("limited"))
    return agg.select(*keys, "n", "brawl", "limited", C.deck_kind("n", "brawl", "limited").alias("kind"))
