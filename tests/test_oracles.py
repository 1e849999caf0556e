"""Registered queries against their DuckDB texts on the smallest test set (all of them with FULL=1)."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUICK = ["overview_totals", "overview_sections", "trend_weekly", "filter_options", "repeat_opponents", "recent_decks",
         "matchups", "side_streaks", "capped_runs", "rank_curve", "comparison_by_event", "side_balance_test", "deck_cards",
         "facts_opponents", "facts_from_day_totals", "merge_matches", "snapshot_diff", "deck_codes", "translation_catalogue", "merge_shared_matches",
         "match_page_far", "log_files_roundtrip", "deck_code_rejects", "log_unclosed_records", "log_shared_matches", "opponent_mix_p_values"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


NAMES = sorted(entry.oracle_sql()) if os.environ.get("FULL") else QUICK


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in rel.description], rel.fetchall())


def test_every_query_is_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
