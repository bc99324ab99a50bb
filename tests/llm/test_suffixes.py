import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import suffix_dedup as S
from tessera.llm.suffix_array import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(s):
    s = [*s, 0]
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def plain(rows):
    """id and text -> removed bytes, by every window."""
    seen, out = set(), {}
    for _, i, t in sorted({(i is None, i or 0, t or "") for i, t in rows}):
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        out[i, t] = bytes(b for b, g in zip(raw, gone) if not g)
    return out


def check(df):
    want = plain([(r["doc_id"], r["text"]) for r in df.collect()])
    rows = S._with_spans(df, "doc_id", "text", False).collect()
    assert len(rows) == df.count()
    for r in rows:
        kept = S._rest(r["text"].encode(), S._merged(r["spans"]))
        assert kept == want[r["id"] or 0, r["text"]], r["id"]


def corpus(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [" ".join(word() for _ in range(rng.randint(0, 8))), p[a : a + rng.randint(60, 400)]]
        rows.append((i, " ".join(parts)))
    rows += [(100, "ab" * 400), (101, "x" * 500), (102, "ab" * 300), (103, rows[5][1]), (104, None), (105, "short")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("crowd", [S.CROWD, 3])
def test_equals_all_windows(spark, crowd, monkeypatch):
    monkeypatch.setattr(S, "CROWD", crowd)
    check(corpus(spark))


@pytest.mark.parametrize("remember", [S.REMEMBER, 5])
@pytest.mark.parametrize("ids", [range(40), range(39, -1, -1)])
def test_copies_of_one_task(spark, ids, remember, monkeypatch):
    monkeypatch.setattr(S, "REMEMBER", remember)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(100, 700))) for _ in range(20)]
    # each text twice, next to each other or far apart
    order = [t for t in texts[:10] for _ in (0, 1)] + texts[10:] + texts[10:]
    df = spark.createDataFrame(list(zip(ids, order)), "doc_id long, text string").coalesce(1)
    check(df)
    got = {r["id"]: sum(b - a for a, b in S._merged(r["spans"])) for r in S._with_spans(df, "doc_id", "text", False).collect()}
    assert sum(got.values()) == sum(map(len, texts))


def test_edge_cases(edge, none, clash):
    check(edge.select("doc_id", "text"))
    assert S.dedup_spans(none).collect() == []
    out = S.dedup_spans(clash)
    assert out.columns == clash.columns and {r["piece"] for r in out.collect()} == {"own piece"}
    assert [r["text"] for r in out.collect() if r["doc_id"] == 3] == [None]


def test_cut_texts(spark):
    passage = "".join(chr(97 + hashlib.md5(b"%d" % i).digest()[0] % 26) for i in range(150))
    rows = [(1, f"first {passage} end"), (2, f"second {passage} other"), (3, passage[:99])]
    got = {r["doc_id"]: r["text"] for r in S.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the space on either side is shared too, and so is the d of nothing else
    assert got == {1: f"first {passage} end", 2: "secondother", 3: passage[:99]}


def test_shared_windows_are_grouped_by_owner():
    a, b = bytes(range(120)), bytes(range(10, 120)) + b"zz"
    assert S.shared_windows([a, b], [(False, 1, 0, 0), (False, 2, 0, 0)]) == [(1, 0, 110)]
    assert S.shared_windows([b, b], [(False, 2, 0, 0), (False, 2, 0, 0)]) == []
    groups = defaultdict(list)
    for k, x, y in S.shared_windows([a, a, b], [(False, 1, 0, 0), (False, 0, 0, 0), (False, 2, 0, 0)]):
        groups[k].append((x, y))
    assert groups == {0: [(0, 120)], 2: [(0, 110)]}


def test_reach_about_the_minimizer():
    gram = bytes(range(S.GRAM))
    assert S._reach(b"abc" + gram + b"de", 3, b"xbc" + gram + b"dfe", 3) == S.GRAM + 3
    assert S._reach(b"bc" + gram, 2, b"abc" + gram + b"d", 3) == S.GRAM + 2
    assert S._reach(gram, 0, gram, 0) == S.GRAM


@pytest.mark.parametrize("remember", [S.REMEMBER, 40])
def test_overlapping_repeats_in_one_task(spark, remember, monkeypatch):
    monkeypatch.setattr(S, "REMEMBER", remember)
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(150, 500))) for _ in range(5)]
    rows = [(i if i % 7 else None, " ".join(rng.choice(passages)[rng.randint(0, 40) :] + rng.choice("xyz") for _ in range(rng.randint(1, 5)))) for i in range(40)]
    rows = [r for k, r in enumerate(rows) if r[0] is not None or k == 0]
    check(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))


def colliding() -> tuple[str, str]:
    """Two texts of 160 characters that differ and agree in sums of c[i] * b**i modulo 2**64 for every odd b: their difference is a product of factors x**n - 1, each even and most divisible by more than 2."""
    diff = [1]
    for n in (1, 2, 3, 4, 4, 4, 4, 6, 8, 10, 10, 12, 12, 16, 16, 16, 28):
        diff = [(diff[i - n] if i >= n else 0) - (diff[i] if i < len(diff) else 0) for i in range(len(diff) + n)]
    diff += [0] * (160 - len(diff))
    low = [79 - d // 2 for d in diff]
    return "".join(map(chr, low)), "".join(chr(c + d) for c, d in zip(low, diff))


@pytest.mark.parametrize("parts", [1, 4])
def test_texts_made_to_collide(spark, parts):
    a, b = colliding()
    for base in (S._BASE, 0xD6E8FEB86659FD93, 3):
        assert sum((ord(x) - ord(y)) * pow(base, i, 1 << 64) for i, (x, y) in enumerate(zip(a, b))) % (1 << 64) == 0
    assert a != b and a.isascii() and b.isascii()
    whole = np.array([0]), np.array([160])
    assert all(x != y for x, y in zip(S._identities(a.encode(), *whole), S._identities(b.encode(), *whole)))
    check(spark.createDataFrame([(1, a), (2, a), (3, b), (4, b)], "doc_id long, text string").repartition(parts))
