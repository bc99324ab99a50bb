import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import exact_dedup as X


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for r in rows:
        ids = [i for i in groups[r[1] or ""] if i is not None]
        keep = max(ids) if ids else None
        out.append((r[0], keep, len(groups[r[1] or ""]), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in X.annotate(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()], key=str)


def test_edge_cases(edge):
    assert got(edge) == plain([tuple(r) for r in edge.collect()])
    kept = X.dedup(edge)
    assert kept.columns == edge.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in edge.collect()})


def test_empty(none):
    assert got(none) == [] and X.dedup(none).collect() == []


def test_clashing_names(clash):
    kept = X.dedup(clash)
    assert kept.columns == clash.columns and all(r["keep_id"] == "own keep_id" for r in kept.collect())
    assert X.annotate(clash).select("keep_id").schema[0].dataType.simpleString() == "bigint"


def test_many_copies_and_few_words(spark, monkeypatch):
    rows = [(i, f"t{i % 7 if i % 3 else i}", "s", "en") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    assert got(df) == plain(rows)
    # a probe by shuffled join, and a filter so small that its words cannot tell bits apart
    monkeypatch.setattr(X, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(X, "ROWS_PER_WORD", 10**9)
    assert got(df) == plain(rows)


def test_rows_do_not_shuffle_before_the_probe(spark, monkeypatch):
    rows = [(i, f"t{i % 40 if i % 3 else i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (256, 0):  # ranges of the filter: of several blocks, of one
            monkeypatch.setattr(X, "BROADCAST_WORDS", most)
            tagged = X._tagged(df, "text", len(rows))
            assert "hashpartitioning" not in tagged._jdf.queryExecution().executedPlan().toString()
            repeated = {t for _, t in rows if sum(t == u for _, u in rows) > 1}
            assert tagged.count() == len(rows) and repeated <= {r["text"] for r in tagged.filter("__possible").collect()}
            assert tagged.filter("NOT __possible").count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["", "a", "b", "c", None])), max_size=12))
def test_any(spark, rows):
    rows = [(i, t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == plain(rows)
