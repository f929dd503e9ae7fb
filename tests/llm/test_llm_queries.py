"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from txloom.llm import ledger, minhash
from txloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "embeddings"):
        con.execute(f"create view {name_} as select * from '{FOLDER}/{name_}.parquet'")
    found = con.execute(ORACLES[name])
    order = [c[0] for c in found.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(order)
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(found.fetchall())


def test_rollup_query_against_documents(spark):
    from llm_helpers import library

    plain, docs = library(), spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    first, want = {}, {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        if first.setdefault(r.text, r.doc_id) == r.doc_id:
            n = len(plain.encode(r.text, add_special_tokens=False).ids) + (r.lang == "en")
            a, b, c = want.get((r.source, r.lang), (0, 0, 0))
            want[r.source, r.lang] = (a + 1, b + n, c + len(r.text))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_chars) for r in QUERIES["op7_token_rollups"](spark, FOLDER).collect()}
    assert got == want


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        before, ids = {r.doc_id for r in docs.collect()}, {r.doc_id for r in after.collect()}
        assert ids <= before
        if name == "quality_rules":
            assert ids == {r.doc_id for r in ledger.apply_policy(ledger.rule_ledger(docs)).where("kept").collect()}
        if name == "near_duplicates":
            assert ids == {r.doc_id for r in minhash.near_duplicates(docs, percent=80).where("kept").collect()}
        if name in ("substring_dedup", "packing"):
            assert ids == before
        if name != "packing":
            assert after.columns == names
        docs = after
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, FOLDER).collect() == []
