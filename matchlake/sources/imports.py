"""Histories from elsewhere: flat lines, nested enrichment, translation catalogues."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import classify as C
from ..schemas import HISTORY_LINE
from ..session import cut_lineage
from .deckcodes import decode_codes

SOURCE = "untapped"  # fixed value: source name of imported history rows
MATCH = ("struct<short_id:string,match_start:bigint,friendly_system_seat_id:int,friendly_team_id:int,active_player_id:int,"
         "friendly_deck_id:string,friendly_deckstring:string,event_name:string,opponents:array<struct<player_name:string>>,"
         "games:array<struct<game_number:int,winning_team_id:int,active_player_id:int,player_opening_hands:array<string>,"
         "opponent_revealed_deckstrings:array<string>>>>")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_LINE).json(path)


def synthetic_id(ts: Column, deck: Column, on_play: Column) -> Column:
    return F.concat_ws("_", F.lit("ut"), ts.cast("string"), F.coalesce(deck.cast("string"), F.lit("")),
                       F.coalesce(on_play, F.lit(0)).cast("string"))


def import_history(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Flat history to match rows; only what lies before the player's first log-sourced match."""
    first_log = matches.filter("source = 'log'").groupBy(F.col("player_id").cast("string").alias("player_id")).agg(
        F.min("start_time").alias("cutoff"))
    kept = rows.join(first_log, "player_id", "left").filter("cutoff is null or ts < cutoff")
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    return kept.select(
        synthetic_id(F.col("ts"), F.col("deck_id"), F.col("on_play")).alias("match_id"), "player_id",
        F.lit(SOURCE).alias("source"), named("event").alias("event_key"), F.col("ts").alias("start_time"),
        F.when(F.col("dur") > 0, F.col("ts") + F.col("dur") * 1000).alias("end_time"),
        F.when(F.col("on_play") == 1, "play").when(F.col("on_play") == 0, "draw").alias("play_draw"),
        F.when(F.col("win") == 1, "win").when(F.col("win") == 0, "loss").alias("my_result"),
        named("deck").alias("my_deck_tag"))


def find_match_objects(texts: DataFrame) -> DataFrame:
    """JSON texts (file, value) to the match objects in them, at any depth.

    An object with a ``short_id`` and ``games`` is a match and is not searched further. Each level is
    checkpointed, so a text is parsed once; the search ends when a level has nothing left to open.
    """
    level = texts.select("file", F.try_parse_json("value").alias("v"), F.lit("").alias("path")).filter("v is not null")
    found = None
    while True:
        level = cut_lineage(level)
        if level.isEmpty():
            break
        complete = F.try_variant_get("v", "$.games", "variant").isNotNull()
        typed = level.withColumn("short_id", F.when(complete, F.try_variant_get("v", "$.short_id", "string")))
        hit = typed.filter("short_id is not null").select(
            "file", "path", "short_id", F.try_variant_get("v", "$", MATCH).alias("m"))
        found = hit if found is None else found.unionByName(hit)
        rest = typed.filter("short_id is null").select("file", "v", "path")
        kids = texts.sparkSession.sql(
            "select file, e.value as v, concat(path, lpad(cast(e.pos as string), 9, '0')) as path "
            "from {rest}, lateral variant_explode(v) e where schema_of_variant(e.value) like 'OBJECT%' "
            "or schema_of_variant(e.value) like 'ARRAY%'", rest=rest)
        level = kids
    if found is None:
        found = level.select("file", "path", F.lit("").alias("short_id"), F.try_variant_get("v", "$", MATCH).alias("m")).limit(0)
    return found


def latest_objects(found: DataFrame) -> DataFrame:
    """The last occurrence of every short id, files in name order."""
    return found.groupBy("short_id").agg(F.max_by("m", F.struct("file", "path")).alias("m")).select("m.*")


def enrich_history(raw: DataFrame, matches: DataFrame, mapping: DataFrame) -> dict[str, DataFrame]:
    """Attach seats, games, mulligans and commanders of nested history to matches already imported.

    ``mapping(title_id, card_id)``. Only exact synthetic ids match; everything else is counted as skipped.
    """
    raw = cut_lineage(raw)
    seat = F.col("friendly_system_seat_id")
    on_play = F.coalesce((F.col("active_player_id") == seat).cast("int"), F.lit(0))
    keyed = raw.withColumn("match_id", F.when(seat.isNotNull(), synthetic_id(
        F.col("match_start"), F.col("friendly_deck_id"), on_play)))
    known = matches.filter(F.col("source") == SOURCE).select("match_id", "player_id")
    hit = cut_lineage(keyed.join(known, "match_id"))
    skipped = keyed.join(known, "match_id", "left_anti")
    patch = hit.select("match_id", "player_id", F.lit(SOURCE).alias("source"), seat.alias("my_seat"),
                       F.col("friendly_deck_id").alias("my_deck_id"),
                       F.when(F.size("opponents") == 1, F.col("opponents")[0]["player_name"]).alias("opponent_name"))
    game = hit.select("match_id", seat.alias("seat"), F.col("friendly_team_id").alias("team"),
                      C.is_brawl("event_name").alias("brawl"), F.explode("games").alias("g")).filter(
        "g.game_number is not null")
    won, active = F.col("g.winning_team_id"), F.col("g.active_player_id")
    games = game.select(
        "match_id", F.col("g.game_number").alias("game_no"),
        F.when(won.isNotNull(), F.when(won == F.col("team"), "win").otherwise("loss")).alias("result"),
        F.when(active.isNotNull(), F.when(active == F.col("seat"), "play").otherwise("draw")).alias("play_draw"))
    mulligans = game.filter(F.size("g.player_opening_hands") > 0).select(
        "match_id", F.col("g.game_number").alias("game_no"), "seat",
        (F.size("g.player_opening_hands") - 1).alias("kept_on"))
    other = F.when(F.col("seat") == 1, 2).otherwise(1)
    own_codes = hit.filter("friendly_deckstring is not null").select(
        "match_id", seat.alias("seat"), F.col("friendly_deckstring").alias("code"), F.lit(0).alias("game"),
        F.lit(0).alias("nth"), C.is_brawl("event_name").alias("brawl"))
    shown = game.filter("brawl").select("match_id", other.alias("seat"), F.col("g.game_number").alias("game"),
                                        F.posexplode("g.opponent_revealed_deckstrings").alias("nth", "code"), "brawl")
    codes = own_codes.unionByName(shown.select(own_codes.columns))
    decoded = cut_lineage(codes.join(decode_codes(codes, "code"), "code"))
    cards = (decoded.filter("brawl").select("match_id", "seat", "game", "nth", F.explode("cards").alias("c"))
             .filter("c.section = 'commanders'").join(mapping, F.col("c.title_id") == mapping["title_id"], "left")
             .select("match_id", "seat", F.struct("game", "nth", "c.pos").alias("at"), "card_id"))
    named = cards.filter("card_id is not null").groupBy("match_id", "seat", F.col("card_id").cast("string").alias("grp_id")).agg(
        F.min("at").alias("at"))
    ordered = named.groupBy("match_id", "seat").agg(F.array_sort(F.collect_list(F.struct("at", "grp_id"))).alias("l"))
    commanders = ordered.select("match_id", "seat", F.posexplode("l").alias("partner_idx", "x")).select(
        "match_id", "seat", F.col("x.grp_id").alias("grp_id"), "partner_idx")
    one = lambda name, df, value=F.count(F.lit(1)): df.agg(value.alias("n")).select(F.lit(name).alias("what"), "n")
    distinct = F.countDistinct("match_id")
    report = (one("raw", raw).unionByName(one("matched", hit)).unionByName(one("skipped", skipped))
              .unionByName(one("with_commanders", commanders, distinct))
              .unionByName(one("with_mulligans", mulligans, distinct))
              .unionByName(one("invalid_codes", decoded.filter("cards is null")))
              .unionByName(one("unresolved_titles", cards.filter("card_id is null"))))
    return {"matches": patch, "games": games, "mulligans": mulligans, "commanders": commanders, "report": report}


# ---- translations ---------------------------------------------------------------------------
FACES = r"\s+/{2,3}\s+"


def printings(rows: DataFrame, min_stage: int = 5) -> DataFrame:
    """Snapshot rows (file, key, original, translation, stage, context) to trusted printings."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    position = F.trim(F.element_at(F.split("key", r"\|"), 1))
    return rows.select(
        clean("original").alias("english"), clean("translation").alias("chinese"),
        F.coalesce(F.col("stage").try_cast("int"), F.lit(0)).alias("stage"),
        F.lower(F.regexp_extract("file", r"([^-/]*)\.[^.]*$", 1)).alias("set_code"),
        F.lower(F.trim(F.regexp_extract(position, "·(.*)$", 1))).alias("collector"),
        F.trim(F.regexp_extract(F.coalesce("context", F.lit("")), r"Translated from:\s*([^\n<]+)", 1)).alias("provider")
    ).filter("english is not null and chinese is not null").filter(F.col("stage") >= min_stage)


def translation_catalogue(prints: DataFrame, cards: DataFrame) -> DataFrame:
    """Card names translated face by face: exact printing first, else the name's only best translation;
    untranslated faces stay as they are, cards without any translated face drop out."""
    pick = F.struct("chinese", "stage", "provider")
    exact = prints.groupBy("english", "set_code", "collector").agg(
        F.max_by(pick, F.struct("stage", "chinese")).alias("e"))
    per_stage = prints.groupBy("english", "stage").agg(F.countDistinct("chinese").alias("kinds"), F.min(pick).alias("u"))
    unique = per_stage.groupBy("english").agg(F.max_by(F.struct("kinds", "u"), "stage").alias("b")).filter(
        "b.kinds = 1").select("english", F.col("b.u").alias("u"))
    faces = cards.filter("coalesce(name, '') <> ''").select(
        "grp_id", "name", F.lower(F.coalesce("set_code", F.lit(""))).alias("set_code"),
        F.lower(F.coalesce("collector", F.lit(""))).alias("collector"),
        F.regexp_extract_all("name", F.lit(f"({FACES})"), F.lit(1)).alias("gaps"),
        F.posexplode(F.split("name", FACES)).alias("i", "english"))
    faces = faces.withColumn("english", F.trim("english"))
    found = (faces.join(exact, ["english", "set_code", "collector"], "left").join(unique, "english", "left")
             .withColumn("hit", F.coalesce("e", "u")))
    text = F.concat(F.coalesce("hit.chinese", "english"), F.coalesce(F.get("gaps", F.col("i")), F.lit("")))
    whole = found.groupBy("grp_id").agg(
        F.first("name").alias("name_en"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("t")))), lambda x: x["t"]), "")
        .alias("name_zh"),
        F.count(F.lit(1)).alias("faces"), F.count("hit").alias("translated"), F.min("hit.stage").alias("stage"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("hit.provider", F.lit("")))), "/").alias("providers"))
    return whole.filter("translated > 0")
