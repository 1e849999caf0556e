"""The registered queries: contracts of names and rows, the SQL oracle, the pipeline against its parts."""
import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks import rows_of

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]


OTHER_ROWS = ("op11_", "op12_", "op13_")   # words, pieces and components: tested in modules of their own


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(n for n in NAMES if not n.startswith(OTHER_ROWS)))
def test_one_row_per_document(spark, name):
    got = entry.queries()[name](spark, SF)
    source = "pages" if name.startswith("op3_") else "documents"
    key = "page_id" if source == "pages" else "doc_id"
    want = spark.read.parquet(f"{SF}/{source}.parquet").select(key)
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in want.collect())
    if name in entry.oracle_sql():
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
        rel = con.execute(entry.oracle_sql()[name])
        assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in rel.description], rel.fetchall())


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.written(stage(spark, kept[-1], SF), name))
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept]
    assert all(k.columns == docs.columns for k in kept[1:-1])
    q = entry.queries()
    toxic = {r.doc_id for r in q["op5_toxicity"](spark, SF).filter("predicted = 1").collect()}
    assert sorted(ids[1]) == sorted(set(ids[0]) - toxic)
    from matchlake.llm import decontamination, jaccard
    groups = {r.component_id for r in jaccard.grouped(kept[1]).collect()}
    assert sorted(ids[2]) == sorted(groups)
    leaks = {r.doc_id for r in decontamination.decontaminated(kept[2], spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").collect()}
    assert sorted(ids[3]) == sorted(set(ids[2]) - leaks)
    assert set(ids[4]) <= set(ids[3]) and sorted(ids[4]) == sorted(ids[5])
    assert [r[0] for r in entry.queries()["pipeline"](spark, SF).select("doc_id").orderBy("doc_id").collect()] == sorted(ids[5])


def test_rows_of_the_other_operators(spark):
    q = {n.split("_")[0]: entry.queries()[n] for n in NAMES}
    words = q["op11"](spark, SF)
    assert words.columns == ["word", "form", "root", "n", "n_near", "form_n"] and words.count() == words.select("word").distinct().count() > 0
    pieces = q["op12"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(pieces.doc_id) == {r[0] for r in docs.select("doc_id").collect()} and (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    z = q["op13"](spark, SF).toPandas()
    assert len(z) == z.n.iloc[0] * 32 and z.identity_error.max() < 1e-9
