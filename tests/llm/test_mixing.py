import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import mixing


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def corpus(spark, n=600):
    rows = [(i, "w " * (i * 7 % 23), ["a", "b", "c", "d", None, "tiny"][(i % 5) if i % 97 else 5], "en") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)


def test_targets_and_takes(spark):
    df = corpus(spark)
    docs = df.select(F.col("doc_id").alias("id"), "source", mixing.n_words(F.col("text")).alias("size"))
    rows = mixing.drawn_docs(docs, block_rows=16).collect()
    assert len(rows) == 600
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want, taken = plain_targets(sizes), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert len(r["draws"]) <= 3 and len({d["copy"] for d in r["draws"]}) == len(r["draws"])
        taken[r["source"]] += r["size"] * len(r["draws"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 23, (s, taken[s], want[s])
    again = {r["id"]: r["draws"] for r in mixing.drawn_docs(docs.repartition(7), block_rows=16).collect()}
    assert again == {r["id"]: r["draws"] for r in rows}
    # the size of blocks is no part of what is taken
    other = {r["id"]: len(r["draws"]) for r in mixing.drawn_docs(docs, block_rows=1000).collect()}
    assert other == {r["id"]: len(r["draws"]) for r in rows}


def test_tree_splits_exactly(spark):
    blocks = spark.createDataFrame([(f"s{i % 3}", f"b{i}") for i in range(1003)], "source string, key string")
    out = mixing.split_tree(blocks, 8, "x").collect()
    assert len({r["key"] for r in out}) == len(out) == 1003
    per = Counter(r["shard"] for r in out)
    assert len(per) == 8 and max(per.values()) - min(per.values()) <= 2
    share = Counter((r["shard"], r["source"]) for r in out)
    assert all(20 < n < 65 for n in share.values())


def test_mix(spark, edge, none, clash):
    df = corpus(spark, 200)
    out = mixing.mix(df).collect()
    per = Counter((r["doc_id"], r["mix_copy"]) for r in out)
    assert max(per.values()) == 1 and {r["mix_shard"] for r in out} <= set(range(8))
    assert mixing.mix(none).count() == 0
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in mixing.mix(edge).collect())
    assert words > 0
    assert mixing.mix(clash).columns[: len(clash.columns)] == clash.columns


def test_shards_are_written(spark, tmp_path):
    mixing.write_shards(mixing.mix(corpus(spark, 100)), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == mixing.mix(corpus(spark, 100)).count()


def test_quotas_of_the_tree(spark):
    """Each node's halves, by source, against plain Python with the same draws."""
    import hashlib

    rows = [(f"s{i % 3}" if i % 7 else None, f"b{i}") for i in range(301)]
    got = {r["key"]: r["shard"] for r in mixing.split_tree(spark.createDataFrame(rows, "source string, key string"), 8, "x").collect()}
    nodes = {0: [k for _, k in rows]}
    for depth in range(3):
        deeper = {}
        for node, keys in nodes.items():
            order = sorted(keys, key=lambda k: (hashlib.md5(f"x/{depth}|{node}|{k}".encode()).hexdigest(), k))
            half = (len(order) + 1) // 2
            deeper[2 * node], deeper[2 * node + 1] = order[:half], order[half:]
        nodes = deeper
    source = {k: s for s, k in rows}
    want = Counter((node, source[k]) for node, keys in nodes.items() for k in keys)
    assert Counter((shard, source[k]) for k, shard in got.items()) == want
    assert got == {k: node for node, keys in nodes.items() for k in keys}


def test_taken_is_what_shards_hold(spark):
    df = corpus(spark, 300)
    held = Counter()
    for r in mixing.mix(df).collect():
        held[r["doc_id"]] += len(r["text"].split())
    docs = df.select(F.col("doc_id").alias("id"), "source", mixing.n_words(F.col("text")).alias("size"))
    assert held == Counter({r["id"]: r["size"] * len(r["draws"]) for r in mixing.drawn_docs(docs).collect() if r["size"] * len(r["draws"])})
