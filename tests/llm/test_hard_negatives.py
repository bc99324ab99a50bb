import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H


def plain(rows, every=100):
    """rows (vec_id, embedding, label) -> sorted results over all pairs, in whole numbers."""
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * float(x)) for x in v]
        if any(abs(float(x)) > H.LARGEST / 256 for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        held[i] = min(held.get(i, (label, ints)), (label, ints))
    out = []
    for a in sorted(held):
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(held[a][1], held[i][1])) for i in held if i != a}
        same = sorted((i for i in score if held[i][0] == held[a][0]), key=lambda i: (-score[i], i))[:5]
        for p in same:
            fits = [i for i in score if held[i][0] != held[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            for k, n in enumerate(sorted(fits, key=lambda i: (-score[i], i))[:5], 1):
                out.append((a, p, k, n, score[p], score[n]))
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int"


def ours(spark, rows, tmp_path, extra=()):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit(f"own {n}").alias(n) for n in extra])
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in H.op12_hard_negatives(spark, str(tmp_path)).collect())


def test_against_plain(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    centres = [[r.gauss(0, 0.3) for _ in range(16)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + r.gauss(0, 0.15))) for x in r.choice(centres)], r.randrange(4)) for i in range(2000)]
    rows += [(2000 + i, rows[i][1], r.randrange(4)) for i in range(0, 400, 3)]  # copies: ties
    assert len(want := plain(rows)) > 100
    monkeypatch.setattr(H, "ROWS", 128)
    monkeypatch.setattr(H, "ANCHORS", 7)
    assert ours(spark, rows, tmp_path) == want


def test_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(i * 10, [0.5, -0.25 + i / 100, i % 3 / 7], i % 3) for i in range(60)]
    rows += [(None, [1.0], 1), (3, None, 1), (4, [1.0, None], 1), (6, [nan], 1), (8, [inf], 1), (9, [1.0], None), (11, [3e38], 1), (12, [], 2), (13, [2.0], 2), (15, [1.0] * 9, 1)]
    rows += [(100, [0.4, -0.2, 0.1], 1), (100, [0.4, -0.2, 0.1], 1), (-100, [-1.0, -1.0, 0.0], 0), (200, [0.0, 0.0, 0.0], 2)]
    assert ours(spark, rows, tmp_path, ("id", "v", "row", "part", "grp", "rank", "score", "positives")) == plain(rows)


def test_empty(spark, tmp_path):
    assert ours(spark, [], tmp_path) == []


@pytest.mark.parametrize("most", [100, 3000, 1 << 24])
def test_planes_bound_and_drop(most):
    """Single floats, double floats and integers; every pair that may qualify is left with its exact score, and most others are dropped on the way."""
    g = np.random.default_rng(most)
    x, a = (g.normal(0, most / 6, (n, 24)).astype(np.int64).clip(-most, most) for n in (3000, 20))
    bits, kind = most.bit_length(), H._kind(24, most)
    assert kind is {100: np.float32, 3000: np.float64, 1 << 24: np.int64}[most]
    assert (sum(w * p.astype(np.int64) for w, p, _ in H.planes(x, bits, kind)) == x).all()
    s = x @ a.T
    low, high = np.full((20, 1), -(1 << 62)), np.full((20, 1), 1 << 62)
    r, c, got, left = H.sliced(x, a, np.ones(s.shape, bool), low, high, 5, bits, kind)
    assert (got == s[r, c]).all() and left == sorted(left, reverse=True) and left[-1] < s.size / 50
    found = set(zip(r.tolist(), c.tolist()))
    for k in range(20):
        assert {(i, k) for i in np.flatnonzero(s[:, k] >= np.sort(s[:, k])[-5])} <= found
