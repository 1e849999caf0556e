"""The key of a match: two players may share one, so (player_id, match_id); tables without players belong to a single player."""
from __future__ import annotations

from pyspark.sql import DataFrame


def match_key(*frames: DataFrame) -> list[str]:
    """The match columns all frames know."""
    return [c for c in ("player_id", "match_id") if all(c in f.columns for f in frames)]
