import hashlib
from collections import defaultdict

from tessera.llm import line_dedup as L


def plain_chunks(text):
    lines, out, start = (text or "").split("\n"), [], 0
    v = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    for i in range(len(lines)):
        if i == len(lines) - 1 or (v[i] + 31 * (v[i - 1] if i else 0)) % 4 == 0:
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def plain(rows):
    first = {}
    for key, t in sorted(((r[0] is None, r[0] or 0), r[1] or "") for r in rows):
        for k, c in enumerate(plain_chunks(t)):
            first.setdefault("\n".join(c), (key, k))
    out = defaultdict(list)
    for r in rows:
        key = (r[0] is None, r[0] or 0)
        kept = [c for k, c in enumerate(plain_chunks(r[1])) if len(c) < 2 or first["\n".join(c)] == (key, k)]
        out[r[0]].append("\n".join("\n".join(c) for c in kept) if len(kept) < len(plain_chunks(r[1])) else r[1])
    return out


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def check(df):
    want, got = plain([(r[0], r[1]) for r in rows_of(df)]), defaultdict(list)
    for i, t in rows_of(L.dedup_lines(df)):
        got[i].append(t)
    assert {k: sorted(map(str, v)) for k, v in got.items()} == {k: sorted(map(str, v)) for k, v in want.items()}


def shared(spark):
    body = [f"line {i} of a passage" for i in range(40)]
    rows = [(i, "\n".join([f"own {i}"] * (i % 3) + body[i % 5 : 30 + i % 7] + [f"end {i}"])) for i in range(25)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_shifted_passages(spark):
    df = shared(spark)
    check(df)
    before = sum(len(t.split("\n")) for _, t in rows_of(df))
    assert sum(len(t.split("\n")) for _, t in rows_of(L.dedup_lines(df))) < before / 2


def test_edge_cases(edge, none, clash):
    check(edge.select("doc_id", "text"))
    assert L.dedup_lines(none).collect() == [] and L.dedup_lines(clash).columns == clash.columns
    assert {r["lines"] for r in L.dedup_lines(clash).collect()} == {"own lines"}


def test_hashes_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(L.F, "xxhash64", lambda *c: L.F.lit(7).cast("long"))
    try:
        check(spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "f\ng\nh\ni\nj"), (3, "a\nb\nc\nd\ne")], "doc_id long, text string"))
    finally:
        monkeypatch.undo()
