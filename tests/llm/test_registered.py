"""The registered queries: names, types and one row per document, and the whole pipeline."""

import pytest
from conftest import SF

from voxtide.llm.queries import QUERIES

CONTRACTS = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_hilbert_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string",
    "op8_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op9_mixture_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op10_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.dtypes[:CONTRACTS[name].count(",") + 1] == [tuple(x.split(" ")) for x in CONTRACTS[name].split(", ")]
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    want = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert set(ids) == want and (name.startswith("op9") or len(ids) == len(want))


def test_pipeline_packs_what_its_stages_keep(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for stage, step in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = step(spark, docs, SF)
        assert docs.columns == columns, stage
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before, stage
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert kept and {r.doc_id for r in rows} == kept
    ends = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends.get(r.doc_id, 0)  # pieces of a document meet
        ends[r.doc_id] = r.start + r.length
    assert all(ends[r.doc_id] == r.doc_tokens for r in rows)
