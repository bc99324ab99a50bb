import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import _common as C
from tessera.llm import toxicity as T


def corpus(n=700):
    rng = np.random.default_rng(1)
    syllables = ["an", "be", "co", "du", "el", "fi", "go", "hu", "in", "jo"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.integers(1, 5)))
    bad = ["horrible", "wretched", "vermin", "dreadful", "imbecile"]
    rows, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [str(rng.choice(bad)) if toxic and rng.random() < 0.08 else word() for _ in range(rng.integers(40, 200))]
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    got = T.score(docs.withColumn("held", C.crc_mod(F.col("doc_id"), 5) == 0), model).filter("held").collect()
    right = [(r["toxicity"] >= 0.5) == bool(truth[r["doc_id"]]) for r in got]
    assert len(right) > 100 and np.mean(right) > 0.93
    assert all(0 <= r["toxicity"] <= 1 for r in got)


def test_whole_texts_train(spark):
    rows, labels = corpus(500)
    # what tells the classes apart starts after 20,000 characters
    filler = "ordinary opening words " * 900
    docs = spark.createDataFrame([(i, filler + t) for i, t in rows], "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sum(w in model.toxic for w in (b" horri", b" wretc", b" vermi", b" dread", b" imbec")) >= 3
    one, truth = model.scorer(), dict(labels)
    assert np.mean([(one(filler + t) >= 0.5) == bool(truth[i]) for i, t in rows]) > 0.8


def test_all_ordinary_windows_train(monkeypatch):
    given = []
    monkeypatch.setattr(T, "_trained", lambda samples, size, **how: given.append(len(samples)) or b"")
    T._dictionaries([], [b" word" * 250_000] * 10)
    assert given == [10 * -(-1_250_000 // 256)]


def test_edge_cases(spark, edge, none, clash):
    rows, labels = corpus(300)
    model = T.fit([(t, y) for (_, t), (_, y) in zip(rows, labels)])
    out = T.score(edge, model).collect()
    assert len(out) == edge.count() and all(math.isfinite(r["toxicity"]) for r in out)
    assert len({r["toxicity"] for r in out if not (r["text"] or "").strip()}) == 1
    assert T.score(none, model).collect() == [] and T.score(clash, model).columns == [*clash.columns, "toxicity"]


def test_without_both_labels(spark, edge, none):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    model = T.train(edge, labels)
    assert model.weights is None and {r["toxicity"] for r in T.score(edge, model).collect()} == {model.base}
    assert T.train(none, labels).base == 0.0
