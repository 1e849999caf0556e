"""CSV sink: header, UTF-8 with a byte-order mark, ordered, split over as many files as Spark likes."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_csv(df: DataFrame, path: str, order: list[str], drop: tuple[str, ...] = ()) -> None:
    """Range-partition by the order columns (no single-task sort) and write CSV part files.

    Files sort by name in row order; the mark goes into the first header cell of each file.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    ordered = ranged.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]).drop(*drop)
    first, *rest = ordered.columns
    (ordered.withColumnRenamed(first, "\ufeff" + first).write.mode("errorifexists")
     .option("header", True).option("encoding", "UTF-8").csv(path))
