import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import _common as C
from tessera.llm import class_lm as L


def scored(df):
    docs = df.select("doc_id", "text").withColumn("held_out", C.crc_mod(F.col("doc_id"), 7) == 2)
    model, words = L.train(docs.filter("NOT held_out").select("text"))
    return model, L.score(docs, model, words).collect()


def base_of(rows):
    counts = Counter()
    for r in rows:
        if zlib.crc32(str("null" if r[0] is None else r[0]).encode()) % 7 != 2:
            counts.update([*L.words_of(r[1]), b""])
    return counts, sum(counts.values()), len(counts)


def test_base_is_exact(edge, monkeypatch):
    rows = [tuple(r) for r in edge.collect()]
    counts, total, distinct = base_of(rows)
    for known in (L.KNOWN, 3):
        monkeypatch.setattr(L.frequent, "__defaults__", (known,))
        model, got = scored(edge)
        assert (model.total, model.distinct) == (total, distinct) and len(got) == len(rows)
        want = sorted((str(r[0]), len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w), 6)) for r in rows for w in [[*L.words_of(r[1]), b""]])
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_without_training_documents(none, spark):
    model, got = scored(none)
    assert not model.trained and got == []
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    words = L.C.written(L.word_counts(docs.select("text").limit(0)), "w")
    r = L.score(docs, model, words).first()
    assert r["n_tokens"] == 3 and r["n_known"] == 0 and r["score"] == r["base_score"]


def test_exchange_finds_classes():
    # types 1 to 10 follow 11 to 20 and the other way round: two classes explain the pairs
    pairs = np.zeros((21, 21), np.float32)
    pairs[1:11, 11:21] = 5
    pairs[11:21, 1:11] = 5
    of = L.exchange(pairs, 3)
    assert len(set(of[1:11])) == 1 == len(set(of[11:21])) and of[1] != of[11]


def test_classes_beat_the_base_on_held_out_text(spark):
    rng = np.random.default_rng(0)
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(a if k % 2 else b) for k in range(60))) for i in range(150)]
    _, got = scored(spark.createDataFrame(rows, "doc_id long, text string"))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held) and len(held) > 5


def test_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([("a b c a b",), ("a c d",)], "text string")
    model, _ = L.train(texts)
    assert np.allclose((10 ** model.transition).sum(1), 1)


@pytest.mark.parametrize("own", [1, 3, L.OWN])
def test_words_of_a_class_sum_to_one(spark, monkeypatch, own):
    monkeypatch.setattr(L, "CORE", 2)
    monkeypatch.setattr(L, "OWN", own)
    monkeypatch.setattr(L.frequent, "__defaults__", (6,))
    texts = spark.createDataFrame([("a b c a b d e f",), ("a c d g h i j",), ("k l m a b c d",)], "text string")
    model, words = L.train(texts)
    counts = {r["word"].encode(): r["c"] for r in words.collect()}
    assert 4 < len(model.words) < len(counts)
    total = np.zeros(L.CLASSES)
    for w, k in model.words.items():
        total[model.cls[k]] += 10 ** model.word_log[k]
    for w in counts.keys() - model.words.keys():
        s = L.shape(w)
        total[model.shape_cls[s]] += 10 ** model.shape_log[s] * (1 - model.shape_new[s]) * counts[w] / model.shape_total[s]
    for s in range(L.SHAPES):  # the one unknown word of each bucket
        total[model.shape_cls[s]] += 10 ** model.shape_log[s] * model.shape_new[s]
    used = np.bincount(np.concatenate([model.cls, model.shape_cls]), minlength=L.CLASSES) > 0
    assert np.allclose(total[used], 1)


def test_words_beyond_the_core_get_classes_from_their_contexts(spark, monkeypatch):
    monkeypatch.setattr(L, "CORE", 20)
    rng = np.random.default_rng(1)
    # words that stand after x and before y, and the other way round; their last bytes say nothing
    names = [f"w{i}_{rng.integers(1e6)}" for i in range(80)]
    text = lambda: " ".join(f"x {rng.choice(names[:40])} y" if rng.random() < 0.5 else f"y {rng.choice(names[40:])} x" for _ in range(80))
    model, _ = L.train(spark.createDataFrame([(text(),) for _ in range(60)], "text string"))
    of = [{int(model.cls[model.words[n.encode()]]) for n in part if model.words[n.encode()] > 20} for part in (names[:40], names[40:])]
    assert not of[0] & of[1]
