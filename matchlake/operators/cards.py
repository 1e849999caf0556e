"""Card dimensions: display names, archetypes, loads, fills, coverage."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import classify as C


def display_names(cards: DataFrame, catalogue: DataFrame | None = None,
                  overrides: DataFrame | None = None, lang: str = "zh") -> DataFrame:
    """grp_id -> display name: override, else catalogue (only when its English name agrees), else table.

    ``cards(grp_id, name, name_zh, source)``, ``catalogue(grp_id, name_en, name_zh, source)``,
    ``overrides(grp_id, name_zh)``.
    """
    src = F.col("source") if "source" in cards.columns else F.lit(None).cast("string")
    base = cards.select("grp_id", F.col("name").alias("t_en"), F.col("name_zh").alias("t_zh"), src.alias("t_src"))
    if catalogue is not None:
        base = base.join(catalogue.select("grp_id", F.col("name_en").alias("c_en"), F.col("name_zh").alias("c_zh"),
                                          F.col("source").alias("c_src")), "grp_id", "full_outer")
    else:
        base = base.selectExpr("*", "cast(null as string) c_en", "cast(null as string) c_zh",
                               "cast(null as string) c_src")
    if overrides is not None:
        base = base.join(overrides.select("grp_id", F.trim("name_zh").alias("o_zh")), "grp_id", "full_outer")
    else:
        base = base.selectExpr("*", "cast(null as string) o_zh")
    blank = F.lit("")
    english = F.coalesce(F.nullif("t_en", blank), F.nullif("c_en", blank))
    agrees = english.isNull() | (F.col("c_en") == english)
    table_zh = F.coalesce(F.when(agrees, F.nullif("c_zh", blank)), F.nullif("t_zh", blank))
    override = F.nullif("o_zh", blank)
    zh = F.coalesce(override, table_zh)
    label = (F.when(override.isNotNull(), "override")
             .when(table_zh.isNotNull(), F.coalesce(F.when(agrees, F.col("c_src")), F.lit("cached")))
             .when(english.isNotNull() & (F.col("t_src") == "client"), "client, untranslated")
             .when(english.isNotNull() & (F.col("t_src") == "scryfall"), "scryfall, untranslated")
             .when(english.isNotNull(), "english, source not recorded").otherwise("missing"))
    fallback = F.concat(F.lit("grpId:"), F.col("grp_id"))
    full = F.coalesce(zh if lang == "zh" else english, english, zh)
    return base.select(
        "grp_id", F.coalesce(C.front_face(full), fallback).alias("card_name"),
        F.coalesce(full, fallback).alias("full_name"), english.alias("name_en"), zh.alias("name_zh"),
        label.alias("name_source"))


def load_priors(texts: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects name -> tag or [tags] to (card_name, tags); '_' keys and unknown tags are dropped."""
    pairs = texts.select(F.explode(F.from_json(column, "map<string,string>")).alias("card_name", "raw"))
    many = F.from_json("raw", "array<string>")
    tags = F.when(F.col("raw").startswith("["), C.clean_tag_array(many)).otherwise(C.tag_list("raw"))
    return (pairs.filter(~F.col("card_name").startswith("_")).select("card_name", tags.alias("tags"))
            .filter(F.size("tags") > 0))


def archetype_map(priors: DataFrame, profiles: DataFrame) -> DataFrame:
    """Tags per card name; a manual profile (user value, else auto) replaces the prior set."""
    manual = profiles.select("card_name", C.tag_list(F.coalesce("archetype_user", "archetype_auto")).alias("m_tags"))
    manual = manual.filter(F.size("m_tags") > 0).groupBy("card_name").agg(F.max("m_tags").alias("m_tags"))
    base = priors.groupBy("card_name").agg(F.max("tags").alias("tags"))
    return (base.join(manual, "card_name", "full_outer")
            .select("card_name", F.coalesce("m_tags", "tags").alias("tags")))


def load_card_names(localisations: DataFrame, cards: DataFrame) -> DataFrame:
    """Per card the formatted localisation (format 1), else the one of the lowest format, cleaned.

    ``cards(grp_id, title_id)``, ``localisations(title_id, formatted, text)``.
    """
    best = localisations.groupBy("title_id").agg(
        F.min_by("text", F.struct((F.col("formatted") != 1).alias("a"), F.col("formatted").alias("b"),
                                  F.col("text").alias("c"))).alias("raw"))
    named = cards.join(best, "title_id", "left").withColumn("name", clean_client_name("raw"))
    return named.filter("name <> ''").select("grp_id", "name")


def clean_client_name(raw) -> "F.Column":
    raw = F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit(""))
    text = F.regexp_replace(raw, r'(?i)<sprite="[^"]*"\s+name="arena_a"\s*/?>', "A-")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def pending_cards(commanders: DataFrame, cards: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Ids used by any fact but absent from the dimension."""
    used = commanders.select("grp_id")
    if history is not None:
        used = used.union(history.select("grp_id"))
    return used.filter("grp_id is not null").distinct().join(cards.select("grp_id"), "grp_id", "left_anti")


def translation_worklist(cards: DataFrame) -> DataFrame:
    """Cards that still lack a translation and were never looked up."""
    return cards.filter("name is not null and name_zh is null and tried_at is null").select("grp_id", "name")


def fill_cards(cards: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert unknown ids; known rows keep every non-empty value and only have gaps filled."""
    inc = incoming.select("grp_id", F.col("name").alias("i_name"), F.col("source").alias("i_source"))
    blank = F.lit("")
    return cards.join(inc, "grp_id", "full_outer").select(
        "grp_id", F.coalesce(F.nullif("name", blank), "i_name").alias("name"), "name_zh",
        F.coalesce(F.nullif("source", blank), "i_source").alias("source"))


def name_coverage(commanders: DataFrame, cards: DataFrame, sample: int = 5) -> DataFrame:
    """Distinct used ids: named, missing, and the first few missing ids (a fixed-size sample)."""
    used = commanders.select("grp_id").filter("grp_id is not null").distinct()
    named = cards.filter("coalesce(name, '') <> ''").select("grp_id", F.lit(True).alias("has"))
    joined = used.join(named, "grp_id", "left")
    totals = joined.agg(F.count(F.lit(1)).alias("used"), F.count("has").alias("named"))
    first = joined.filter("has is null").select("grp_id").orderBy("grp_id").limit(sample)
    missing = first.agg(F.array_join(F.array_sort(F.collect_list("grp_id")), ",").alias("sample_missing"))
    both = totals.unionByName(missing, allowMissingColumns=True)
    return both.agg(F.max("used").alias("used"), F.max("named").alias("named"),
                    F.max("sample_missing").alias("sample_missing")).select(
        "used", "named", (F.col("used") - F.col("named")).alias("missing"), "sample_missing")


def card_mapping(cards: DataFrame, preferred: DataFrame) -> DataFrame:
    """title_id -> card id: plain primary cards, preferring ids already in the data, then the lowest id.

    Titles without such a card follow the first linked primary face, else the interchangeable title.
    ``cards(grp_id bigint, title_id bigint, is_secondary int, is_token int, linked array<bigint>,
    interchangeable bigint)``.
    """
    known = preferred.select(F.col("grp_id").cast("bigint").alias("grp_id")).distinct().withColumn(
        "pref", F.lit(True))
    plain = cards.filter("is_secondary = 0 and is_token = 0")
    direct = (plain.join(known, "grp_id", "left").groupBy("title_id")
              .agg(F.min_by("grp_id", F.struct(F.col("pref").isNull(), "grp_id")).alias("card_id")))
    open_cards = cards.filter("is_token = 0").join(direct, "title_id", "left_anti")
    front = (open_cards.select("grp_id", F.posexplode("linked").alias("pos", "linked_id"))
             .join(cards.filter("is_secondary = 0").select(
                 F.col("grp_id").alias("linked_id"), F.col("title_id").alias("front_title")), "linked_id")
             .groupBy("grp_id").agg(F.min_by("front_title", "pos").alias("front_title")))
    target = F.coalesce("front_title", "interchangeable")
    via = (open_cards.join(front, "grp_id", "left").withColumn("target", target)
           .join(direct.select(F.col("title_id").alias("target"), "card_id"), "target")
           .groupBy("title_id").agg(F.min_by("card_id", "grp_id").alias("card_id")))
    return direct.unionByName(via)
