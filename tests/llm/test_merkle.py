import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle as M


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields):
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def climb(nodes, at):
    """The node over all, and (left, right) siblings of node ``at`` on the way."""
    path = []
    while len(nodes) > 1:
        a = at // 8 * 8
        path.append(("".join(nodes[a:at]), "".join(nodes[at + 1 : a + 8])))
        nodes, at = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], at // 8
    return nodes[0], path


def plain(rows):
    """rows (doc_id, source, lang, n_chars, text) -> sorted results."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: sorted((r[0] is not None, r[0] or 0, leaf_of(r), r) for r in groups[g]) for g in order}
    subs = [climb([x[2] for x in leaves[g]], 0)[0] for g in order]
    out = []
    for k, g in enumerate(order):
        root, high = climb(subs, k)
        for i, (_, _, leaf, r) in enumerate(leaves[g]):
            path = climb([x[2] for x in leaves[g]], i)[1] + high
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            at = leaf_of((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if bad else leaf
            for a, b in path:
                at = sha(a, at, b)
            out.append((r[0], leaf, subs[k], root, sha(*[a + b for a, b in path]), at, at == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def ours(spark, rows, tmp_path, name="documents", extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        df = df.select("*", *[F.lit(f"own {n}").alias(n) for n in ("g", "id", "leaf", "other", "row", "rank", "depth", "n", "b", "h", "path", "top", "block")])
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return sorted([tuple(r) for r in M.op11_merkle(spark, str(tmp_path)).collect()], key=str)


def corpus(n, langs, seed=1):
    r = random.Random(seed)
    return [(r.choice([i, i, i * 7919, -i]), r.choice(["a", None, "É"]), r.choice(langs), r.choice([i, None]), r.choice([f"Text {i} ÄB\nz", "", None, "same TEXT"])) for i in range(n)]


@pytest.mark.parametrize("n, langs", [(700, ["en", "de", None, "zh"]), (400, [f"l{i}" for i in range(75)]), (1, ["x"])])
def test_against_plain(spark, tmp_path, n, langs):
    rows = corpus(n, langs)
    assert ours(spark, rows, tmp_path) == plain(rows)


def test_edges(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "s", None, 1, "null id"), (5, "a", "en", 3, "ABC"), (5, "a", "en", 3, "ABC"), (5, "a", "en", 4, "other"), (-3, "", "", 0, ""), (9, "b", "=", 9, "Long WORD " * 200_000)]
    assert ours(spark, rows, tmp_path, extra=True) == plain(rows)


def test_empty(spark, tmp_path):
    assert ours(spark, [], tmp_path) == []


def test_blocks_over_several_steps(spark, tmp_path):
    """Over 8^4 leaves: blocks reduce twice."""
    rows = [(i * 3, "s", "en" if i % 50 else "de", i, f"T{i}") for i in range(4800)]
    assert ours(spark, rows, tmp_path) == plain(rows)


def test_crowded_prefixes(spark):
    """Repeated ids and equal rows are ranked by digits of leaf and row number when a prefix holds too many."""
    r = random.Random(2)
    rows = [("=en", r.choice([7, 7, 7, 8, 5000, None]), bytes([r.randrange(3)]) * 32, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id long, leaf binary, row long").repartition(3)
    got = sorted((x["rank"], x["id"], bytes(x["leaf"]), x["row"]) for x in M.ranked(df, crowd=4).collect())
    want = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
    assert got == [(i, x[1], x[2], x[3]) for i, x in enumerate(want)]
