"""Connected components of a link table, smallest label first."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label): the smallest node of the component, for every node that has a link.

    Each round takes the smallest label among the neighbours, then jumps to that label's own label, until nothing moves; every
    round is a written table. Joins only ever meet one small row per key on one side, so hot nodes may be split.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").filter("node <> other").distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = step.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = written(step.join(own, "label", "left").select("node", "old", F.coalesce("jump", "label").alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.filter("old <> label").limit(1).count():
            return labels
