"""Named queries of the operators over the test tables."""
from __future__ import annotations

from . import (decontamination, fingerprints, html_text, jaccard, language, mixing, packing, quality, sharding, suffixes,
               toxicity, variants, whitening)
from .common import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_toxicity(spark, sf_dir):
    return toxicity.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_language_id(spark, sf_dir):
    return language.identified(table(spark, sf_dir, "documents"))


@query
def op9_sharding(spark, sf_dir):
    return sharding.sharded_documents(table(spark, sf_dir, "documents"))


@query
def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("h", "copies")


@query
def op1_decontamination(spark, sf_dir):
    return decontamination.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_html_extraction(spark, sf_dir):
    return html_text.extracted(table(spark, sf_dir, "pages"))


@query
def op4_quality(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_fingerprints(spark, sf_dir):
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


@query
def op2_suffix_dedup(spark, sf_dir):
    return suffixes.deduplicated(table(spark, sf_dir, "documents"))


@query
def op8_jaccard_join(spark, sf_dir):
    return jaccard.grouped(table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark, sf_dir):
    return variants.grouped(table(spark, sf_dir, "documents"))


@query
def op12_packing(spark, sf_dir):
    return packing.digests(packing.packed(table(spark, sf_dir, "documents")))


@query
def op13_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


ORACLES["op8_jaccard_join"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words),
members as (select doc_id, unnest(s) as x from sets),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from members a join members b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (
  select h.a, h.b from shared h join sets p on p.doc_id = h.a join sets q on q.doc_id = h.b
  where 100 * k >= 75 * (len(p.s) + len(q.s) - k)),
both_ways as (select a, b from links union all select b, a from links),
reach(node, other) as (
  select a, b from both_ways union select r.node, l.b from reach r join both_ways l on l.a = r.other)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) as component_id
from sets s left join reach r on r.node = s.doc_id group by s.doc_id, s.s"""
