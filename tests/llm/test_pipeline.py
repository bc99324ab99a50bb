import os
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import exact_dedup, mixing, registry, simhash, toxicity
from plain import plain_near

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    one = model.scorer()
    kept = {i for i, r in rows.items() if one(r["text"]) < 0.5}
    latest = {}
    for i in sorted(kept):
        latest[rows[i]["text"] or ""] = i
    kept = set(latest.values())
    kept = plain_near({i: rows[i]["text"] for i in kept})
    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = exact_dedup.C.written(stage(spark, now, SF), "stage")
        assert now.columns == docs.columns
    assert {r["doc_id"] for r in now.collect()} == kept
    mixed = exact_dedup.C.written(corpus_pipeline.STAGES[3][1](spark, now, SF), "stage")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= kept
    want = {r["id"]: len(r["draws"]) for r in mixing.drawn_docs(now.selectExpr("doc_id AS id", "source", "regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+') AS size")).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in want.items() if v})
    last = corpus_pipeline.STAGES[4][1](spark, mixed, SF).collect()
    assert len(last) == mixed.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last)


def test_registry():
    assert [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries()) and simhash.MOST == 4


def through(spark, docs, sf):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(exact_dedup.C.written(stage(spark, out[-1], sf), name.replace(" ", "_")))
    return out


def test_stages_on_edge_rows(spark, edge, none, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and other columns go through; empty tables give empty results."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = edge.selectExpr("*", "'own' AS ids", "'own' AS component_id", "'own' AS mix_copy_of")
    stages = through(spark, extra, str(tmp_path))
    assert all(s.columns == extra.columns for s in stages[:-1]) and stages[1].count() == edge.count()
    texts = [r["text"] or "" for r in stages[2].collect()]
    assert sorted(texts) == sorted({r["text"] or "" for r in edge.collect()})  # without labels nothing is toxic, and each text stays once
    last = stages[-1].collect()
    assert all(r["round_trip"] for r in last) and {r["doc_id"] for r in last} <= {r["doc_id"] for r in stages[3].collect()}
    assert all(r["component_id"] == "own" for r in last)
    assert [s.count() for s in through(spark, none, str(tmp_path))] == [0] * 6
