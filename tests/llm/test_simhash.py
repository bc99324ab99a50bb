import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def plain_labels(codes, keys):
    near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4) & (keys[:, None] == keys[None, :])
    label = np.arange(len(codes))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(codes))])
        if (new == label).all():
            return label
        label = new


def test_fingerprints():
    for text in (None, "", "one", "One two THREE", "a b c d", "a b c d e f a b c d", "É é \x0b x\ty  z w"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_gray_rank_neighbours():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


def test_index_equals_all_pairs():
    rng = np.random.default_rng(0)
    for t in range(12):
        codes = []
        for b in rng.integers(0, 2**63, 30):
            for _ in range(rng.integers(1, 40)):
                c = int(b)
                for k in rng.integers(0, 64, rng.integers(0, 6)):
                    c ^= 1 << int(k)
                codes.append(c)
        codes = np.unique(np.array(codes, np.uint64))
        keys = rng.integers(0, 3, len(codes)) if t % 2 else np.zeros(len(codes), int)
        order = np.lexsort((simhash.gray_rank(codes), keys))
        codes, keys = codes[order], keys[order]
        label, want, seen = simhash.Index(keys, codes).join(), plain_labels(codes, keys), {}
        assert all(seen.setdefault(a, b) == b for a, b in zip(label, want)) and len(set(label)) == len(set(want))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (-5, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: -5, 101: -5, -5: -5}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_annotate(spark, edge, none):
    rows = [(i, " ".join(f"w{j}" for j in range(200)) + (f" tail{i}" if i else ""), "s", "en") for i in range(20)]
    rows += [(100 + i, f"text {i} of its own " * 3, "s", "en") for i in range(30)] + [(200, "", "s", "en"), (201, None, "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    codes = np.array([plain_fingerprint(r[1]) for r in rows], np.uint64)
    label = plain_labels(codes, np.zeros(len(rows)))
    least = {lab: min(r[0] for r, x in zip(rows, label) if x == lab) for lab in set(label)}
    got = {r["id"]: r["component_id"] for r in simhash.annotate(df).collect()}
    assert got == {r[0]: least[lab] for r, lab in zip(rows, label)}
    kept = simhash.near_dedup(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values())) and kept.columns == df.columns
    assert simhash.annotate(edge).count() == edge.count() and simhash.annotate(none).count() == 0
    assert simhash.near_dedup(none).count() == 0


def test_clashing_names(clash):
    out = simhash.near_dedup(clash)
    assert out.columns == clash.columns and out.filter(F.col("fp") == "own fp").count() == out.count()
