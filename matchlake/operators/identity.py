"""Deck identities: connected components of 'deck id - build version' links, all players at once."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import classify as C
from ..scope import Scope
from ..session import stored


def _clean(col: str):
    return F.nullif(F.trim(F.col(col).cast("string")), F.lit(""))


def id_node():
    return F.concat(F.lit("i:"), _clean("my_deck_id"))


def version_node():
    return F.concat(F.lit("v:"), _clean("my_deck_version"))


def name_node():
    return F.concat(F.lit("n:"), _clean("my_deck_tag"))


def components(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """(player_id, a, b) links -> (player_id, node, label), label = smallest node of the component.

    Alternating stars: in a large star every node ties its larger neighbours to the smallest node it sees, in a small star itself
    and its smaller neighbours. Connected nodes stay connected, and chains of any length and order shrink in a logarithmic
    number of rounds, until every node hangs on the smallest of its component. Links leave as they are replaced, so
    their number never grows. Every round is written, packed. Each join has a side with one row per node, so a node with very
    many links can be split by adaptive execution. ``rounds`` receives the number of links after each round.
    """
    pairs = edges.select("player_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "deck-pairs")
    nodes = pairs.select("player_id", F.col("a").alias("node")).union(pairs.select("player_id", "b")).distinct()
    links, before = pairs.filter("a <> b"), None
    while True:
        links = stored(_small_star(_large_star(links)), "deck-links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("player_id", "a", "b").cast("decimal(38,0)"))).first()
        if rounds is not None:
            rounds.append(now[0])
        if now == before:
            break
        before = now
    hung = links.select("player_id", F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.join(hung, ["player_id", "node"], "left").withColumn("label", F.coalesce("label", "node"))


def _large_star(links: DataFrame) -> DataFrame:
    """(a > b) links: every node ties its larger neighbours to the smallest of itself and its neighbours."""
    both = links.union(links.select("player_id", F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("player_id", "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter("b > a").join(least, ["player_id", "a"]).select("player_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """(a > b) links: every node ties itself and its smaller neighbours to the smallest of them."""
    least = links.groupBy("player_id", "a").agg(F.min("b").alias("m"))
    tied = links.join(least, ["player_id", "a"]).filter("b <> m").select("player_id", F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("player_id", "a", F.col("m").alias("b"))).distinct()


def deck_edges(matches: DataFrame) -> DataFrame:
    linked = matches.select("player_id", id_node().alias("a"), version_node().alias("b"))
    return linked.filter("a is not null and b is not null")


def with_identity(matches: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Add ``identity`` (component label) and ``reliable``; rows without id and version fall back to
    their name, rows with nothing at all drop out."""
    if labels is None:
        labels = components(deck_edges(matches))
    node = F.coalesce(id_node(), version_node(), name_node())
    rows = matches.withColumn("node", node).filter("node is not null")
    names = F.col("node").startswith("n:")
    named = rows.filter(names).withColumn("identity", F.col("node"))
    firm = rows.filter(~names)
    # a node that never met a partner is its own component
    nodes = firm.select("player_id", "node").distinct().join(labels, ["player_id", "node"], "left").select(
        "player_id", "node", F.coalesce("label", "node").alias("identity"))
    known = firm.join(nodes, ["player_id", "node"])
    out = known.unionByName(named.select(known.columns))
    return out.withColumn("reliable", ~F.col("identity").startswith("n:")).drop("node")


def identity_summary(rows: DataFrame) -> DataFrame:
    """Size of each identity: rows, distinct ids, versions and names, and its latest name."""
    latest = F.struct(F.col("start_time").isNotNull().alias("a"), F.coalesce("start_time", F.lit(-1)).alias("b"),
                      F.col("match_id").alias("c"))
    return rows.groupBy("player_id", "identity").agg(
        F.first("reliable").alias("reliable"), F.count(F.lit(1)).alias("n"),
        F.countDistinct(_clean("my_deck_id")).alias("deck_ids"),
        F.countDistinct(_clean("my_deck_version")).alias("versions"),
        F.countDistinct(_clean("my_deck_tag")).alias("names"),
        F.max_by(_clean("my_deck_tag"), F.when(_clean("my_deck_tag").isNotNull(), latest)).alias("title"))


def seeds_by_name(rows: DataFrame) -> DataFrame:
    """Identity a deck name leads to: that of its latest row with id or version, else the name itself."""
    order = F.struct(F.col("reliable").alias("r"), F.col("start_time").isNotNull().alias("a"),
                     F.coalesce("start_time", F.lit(-1)).alias("b"), F.col("match_id").alias("c"))
    named = rows.withColumn("deck", _clean("my_deck_tag")).filter("deck is not null")
    return named.groupBy("player_id", "deck").agg(F.max_by("identity", order).alias("identity"),
                                                  F.max("reliable").alias("reliable"))


def seeds_by_key(rows: DataFrame, deck_id: str | None = None, deck_version: str | None = None) -> DataFrame:
    """Identities of the rows that carry the given id AND version (each if given)."""
    cond = F.lit(True)
    if deck_id:
        cond = cond & (_clean("my_deck_id") == deck_id)
    if deck_version:
        cond = cond & (_clean("my_deck_version") == deck_version)
    return rows.filter(cond).select("player_id", "identity").distinct()


def unlinked_same_name(rows: DataFrame, seeds: DataFrame, labels: DataFrame, scope: Scope) -> DataFrame:
    """Visible rows of a name that its identity does not cover; zero where a distinguishing label exists."""
    derived = (rows.select("player_id", "identity", "my_deck_id").distinct()
               .join(labels.filter("limited_label is not null").select("player_id", "my_deck_id"),
                     ["player_id", "my_deck_id"], "left_semi")
               .select("player_id", "identity").distinct().withColumn("derived", F.lit(True)))
    firm = seeds.filter("reliable").join(derived, ["player_id", "identity"], "left")
    named = (rows.filter(scope.visible()).withColumn("deck", _clean("my_deck_tag"))
             .groupBy("player_id", "deck", F.col("identity").alias("row_identity")).agg(F.count(F.lit(1)).alias("c")))
    miss = (F.col("row_identity") != F.col("identity")) & F.col("derived").isNull()
    return (firm.join(named, ["player_id", "deck"], "left").groupBy("player_id", "deck", "identity")
            .agg(F.coalesce(F.sum(F.when(miss, F.col("c"))), F.lit(0)).alias("unlinked")))
