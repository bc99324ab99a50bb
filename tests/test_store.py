import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import Collection
from tessera.functions.stemming import index_terms
from tessera.operators import bm25
from tessera.operators.retrieval import Options, Searcher
from tessera.plans import answers, indexing, migrations
from tessera.plans import store as S
from tessera.plans.providers import HashEmbedder
from tessera.plans.store import Conflict, Store
from tessera.sources import listing


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def truth(store):
    """Statistics worked out anew from the chunks, in plain Python."""
    active = {r["id"]: r["active"] for r in store.table("documents").collect()}
    posted, lens, df = [], {}, {}
    for c in store.table("chunks").collect():
        terms = index_terms(c["text"]) + index_terms(c["heading_path"])
        lens[c["id"]] = (len(terms), active[c["doc_id"]])
        for t in set(terms):
            posted.append((c["id"], t, terms.count(t)))
            a = df.setdefault(t, [0, 0])
            a[0] += 1
            a[1] += active[c["doc_id"]]
    totals = {"chunks": len(lens), "tokens": sum(n for n, _ in lens.values()), "active_chunks": sum(a for _, a in lens.values()), "active_tokens": sum(n for n, a in lens.values() if a), "documents": len(active)}
    return posted, {i: n for i, (n, _) in lens.items()}, {t: tuple(x) for t, x in df.items()}, totals


def check(store):
    posted, lens, df, totals = truth(store)
    assert rows(store.table("postings"), "chunk_id", "term", "tf") == sorted(posted, key=str)
    assert {r["chunk_id"]: r["dl"] for r in store.table("chunk_len").collect()} == lens
    got = {r["term"]: (r["n_all"], r["n_active"]) for r in store.table("term_stats").collect()}
    assert {t: x for t, x in got.items() if x != (0, 0)} == df
    assert store.manifest["totals"] == totals
    hashes = {r["content_hash"] for r in store.table("documents").collect()}
    assert hashes <= {r["hash"] for r in store.table("content").collect()}


WORDS = ["running", "runs", "index", "naïve", "Café", "goroutine", "the", "compiled", "zebra", "2024"]


def test_any_changes_equal_a_rebuild(spark, tmp_path, monkeypatch):
    """Files come, change, go and come back; after each run the tables are what a plain count gives, and searches are those of a new catalog."""
    monkeypatch.setattr(S, "TIER", 4)
    monkeypatch.setattr(S, "KEEP", 3)
    r, root = random.Random(4), tmp_path / "files"
    root.mkdir()
    store, col = Store(spark, f"file://{tmp_path}/cat"), Collection("c", str(root))
    for step in range(3):
        for i in range(6):
            at = root / f"{i}.md"
            if r.random() < 0.5:
                at.write_text(f"# {r.choice(WORDS)}\n" + " ".join(r.choices(WORDS, k=r.randrange(1, 40))))
            elif at.exists() and r.random() < 0.4:
                at.unlink()
        indexing.index(store, col)
    check(store)
    assert len(store.versions()) <= 3
    new = Store(spark, f"file://{tmp_path}/new")
    indexing.index(new, col)
    for query in ("the compiled",):
        found = [[(x["path"], x["score"]) for x in Searcher(s, stats_scope="active").lexical(Options(query)).collect()] for s in (store, new)]
        assert sorted(found[0]) == sorted(found[1])
    indexing.index(store, Collection("d", str(root)))
    indexing.delete_collection(store, "c")
    check(store)
    store.compact(whole=True)
    check(store)
    assert all(len(e["segments"]) <= 1 and not e["deletes"] for e in store.manifest["tables"].values())


def test_a_change_writes_what_it_changes(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    for i in range(300):
        (root / f"{i:03}.txt").write_text(" ".join(f"word{(i * k) % 997}" for k in range(300)))
    store, col = Store(spark, f"file://{tmp_path}/cat"), Collection("c", str(root))
    indexing.index(store, col)
    first = store.manifest
    whole = store.size()
    old = store.table("documents")
    (root / "007.txt").write_text("only this one is new")
    indexing.index(store, col)
    files = {x["path"]: x["bytes"] for e in store.manifest["tables"].values() for kind in e.values() for x in kind}
    before = {x["path"] for e in first["tables"].values() for kind in e.values() for x in kind}
    assert before <= set(files) and sum(b for p, b in files.items() if p not in before) < whole / 8
    # a reader of the older version goes on with it
    assert old.count() == 300 and store.table("chunks", first).filter("doc_id = 8").first()["text"].startswith("word0 word7")
    assert store.table("chunks").filter("doc_id = 8").first()["text"] == "only this one is new"


def cached(spark, *pairs):
    return spark.createDataFrame([(k, "m", v) for k, v in pairs], "key string, model string, response string").withColumn("created_at", F.current_timestamp())


def test_two_writers(spark, tmp_path):
    a, b = (Store(spark, f"file://{tmp_path}/cat") for _ in range(2))
    base = a.manifest
    doc = spark.createDataFrame([(1, "c", "p", "t", "h", True, None, None)], schemas.schema("documents"))
    a.commit(add={"documents": doc}, base=base)
    with pytest.raises(Conflict):
        b.commit(add={"documents": doc}, base=base)
    # tables that only grow take both, and other tables do not meet
    b.commit(add={"llm_cache": cached(spark, ("a1", "x"))}, base=base)
    a.commit(add={"llm_cache": cached(spark, ("b1", "y"))}, base=base)
    assert a.manifest["version"] == 3 and rows(b.table("llm_cache"), "key", "response") == [("a1", "x"), ("b1", "y")]
    assert not a._publish(a.manifest) and a.table("documents").count() == 1


def test_answers_are_a_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "TIER", 4)
    store = Store(spark, f"file://{tmp_path}/cat")
    cache = answers.Cache(store)
    for i in range(6):
        cache.set("m", f"q{i % 4}", f"answer {i}")
    assert [cache.get("m", f"q{i}") for i in range(5)] == ["answer 4", "answer 5", "answer 2", "answer 3", None]
    assert len(store.manifest["tables"]["llm_cache"]["segments"]) < 6
    scan = store.cached(answers.key_of("m", "q0"))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in scan.partition("PartitionFilters")[2][:80]


def old_catalog(spark, store, at):
    """What ``store`` holds, laid out as version 1 did."""
    tables = {}
    for name in ("content", "documents", "chunks", "chunk_len", "index_runs", "llm_cache", "postings", "chunk_vectors", "embeddings"):
        df = store.table(name)
        df = df.select(*[f.name for f in schemas._schema(migrations.SNAPSHOTS[name])]) if name in migrations.SNAPSHOTS else df
        df.write.parquet(f"{at}/{name}/v=3")
        tables[name] = 3
    with open(f"{at}/_manifest.json", "w") as f:
        json.dump({"schema_version": 1, "tables": tables}, f)


def test_migration(spark, tmp_path, monkeypatch):
    root, at = tmp_path / "files", tmp_path / "old"
    root.mkdir()
    for i, text in enumerate(["running the index", "compiled index of books", "zebra"]):
        (root / f"{i}.txt").write_text(text)
    now = Store(spark, f"file://{tmp_path}/cat")
    indexing.index(now, Collection("c", str(root)))
    indexing.embed(now, HashEmbedder())
    (root / "2.txt").unlink()
    indexing.index(now, Collection("c", str(root)))
    at.mkdir()
    old_catalog(spark, now, at)
    steps = dict(migrations.STEPS)

    def broken(store):
        raise RuntimeError("the power went")

    monkeypatch.setitem(migrations.STEPS, 2, broken)
    with pytest.raises(RuntimeError, match="power"):
        Store(spark, f"file://{at}")
    done = []
    for k, step in steps.items():
        monkeypatch.setitem(migrations.STEPS, k, lambda s, k=k, step=step: (done.append(k), step(s)))
    store = Store(spark, f"file://{at}")
    assert done == [2] and store.version == schemas.VERSION  # the first step is not done again
    check(store)
    Store(spark, f"file://{at}")
    assert done == [2]
    for t in ("documents", "chunks", "postings", "chunk_vectors", "embeddings", "content"):
        assert rows(store.table(t), *[c for c in now.table(t).columns if c != "created_at"]) == rows(now.table(t), *[c for c in now.table(t).columns if c != "created_at"]), t
    found = [[(r["path"], r["score"]) for r in Searcher(s).lexical(Options("index")).collect()] for s in (store, now)]
    assert found[0] == found[1] and len(found[0]) == 2
    (root / "3.txt").write_text("a new index entry")
    assert indexing.index(store, Collection("c", str(root))).added == 1
    check(store)
    newer = store.manifest | {"version": store.manifest["version"] + 1, "schema_version": schemas.VERSION + 1}
    store._publish(newer)
    with pytest.raises(RuntimeError, match="newer"):
        Store(spark, f"file://{at}")


def failing(log):
    """An embedder that notes each text that it is asked for, and fails once at one of them."""

    class Failing(HashEmbedder):
        def embed(self, texts):
            if "fail here" in texts and not os.path.exists(f"{log}.failed"):
                open(f"{log}.failed", "w").close()
                raise RuntimeError("down")
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return HashEmbedder.embed(self, texts)

    out = Failing()
    out.parallel = 1
    return out


def test_embedding_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexing, "REQUEST", 2)
    root = tmp_path / "files"
    root.mkdir()
    for i in range(12):
        (root / f"{i}.txt").write_text("fail here" if i == 5 else f"text {i % 10}")
    log = str(tmp_path / "log")
    store, provider = Store(spark, f"file://{tmp_path}/cat"), failing(log)
    indexing.index(store, Collection("c", str(root)))
    with pytest.raises(Exception, match="down"):
        indexing.embed(store, provider)
    asked = open(log).read().splitlines() if os.path.exists(log) else []
    assert store.table("embeddings").count() == 0
    assert indexing.embed(store, provider) == 12
    every = open(log).read().splitlines()
    assert every[: len(asked)] == asked and len(every) == len(set(every)) == 10  # two texts are copies
    assert indexing.embed(store, provider) == 0 and not os.path.exists(tmp_path / "cat" / "_staged")


@pytest.mark.parametrize("k", [1, 3, 10])
def test_blocks_rank_as_all_postings_do(spark, k, monkeypatch):
    monkeypatch.setattr(bm25, "SMALL", 0)
    r = random.Random(k)
    docs = []
    for i in range(3000):
        long = r.randrange(5, 60)
        docs.append((i, [r.choice(["a", "a", "b", "c", "d"]) if r.random() < (0.9 if i // 128 == 7 else 0.15) else "x" for _ in range(long)]))
    tokens = spark.createDataFrame(docs, "chunk_id long, tokens array<string>").repartition(3)
    posted, lengths = bm25.postings(tokens), tokens.select("chunk_id", F.size("tokens").alias("dl")).persist()
    blocks = bm25.blocked(posted.join(lengths, "chunk_id").withColumn("doc_id", F.col("chunk_id"))).persist()
    nd, avgdl = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    for terms in (["a"], ["b", "c"], ["d", "d", "a"], ["b", "none"], []):
        n_t = {t: sum(t in w for _, w in docs) for t in terms}
        got = bm25.search_blocks(blocks, bm25.Stats(nd, avgdl, n_t), terms, k)
        want = bm25.search_postings(posted, lengths, terms, k)
        assert rows(got.hits, "rank", "chunk_id", "score") == rows(want, "rank", "chunk_id", "score")
        assert got.opened <= got.blocks
        odd = lambda df: df.filter("chunk_id % 2 = 1")
        got = bm25.search_blocks(blocks, bm25.Stats(nd, avgdl, n_t), terms, k, odd)
        want = bm25.search_postings(posted, lengths, terms, k, odd(lengths))
        assert rows(got.hits, "rank", "chunk_id", "score") == rows(want, "rank", "chunk_id", "score")


def test_blocks_are_skipped(spark):
    """One range of ids scores far above the others: the rest stay closed."""
    n = 128 * 300
    rows_ = spark.range(n).select(F.lit("t").alias("term"), F.col("id").alias("chunk_id"), F.col("id").alias("doc_id"), F.when((F.col("id") >= 1280) & (F.col("id") < 1408), 20).otherwise(1).alias("tf"), F.lit(40).alias("dl"))
    found = bm25.search_blocks(bm25.blocked(rows_), bm25.Stats(3 * n, 40.0, {"t": n}), ["t"], 10)
    assert found.blocks == 300 and found.opened <= 40 + 1 and [r["chunk_id"] for r in found.hits.orderBy("rank").collect()] == list(range(1280, 1290))
    few = bm25.search_blocks(bm25.blocked(rows_), bm25.Stats(3 * n, 40.0, {"t": n}), ["t"], 2)
    assert few.opened == 8


def test_each_token_is_stemmed_once(spark, tmp_path, monkeypatch):
    root = tmp_path / "files"
    root.mkdir()
    (root / "a.txt").write_text("Running runs ran running")
    store, col = Store(spark, f"file://{tmp_path}/cat"), Collection("c", str(root))
    indexing.index(store, col)
    assert rows(store.table("tokens"), "token", "term") == [("Running", "run"), ("ran", "ran"), ("running", "run"), ("runs", "run")]
    (root / "b.txt").write_text("running ran walks naïve")
    indexing.index(store, col)
    added = [s["rows"] for s in store.manifest["tables"]["tokens"]["segments"]]
    assert added == [4, 2]  # walks, naïve
    assert rows(store.table("postings").filter("term = 'run'"), "tf") == [(1,), (3,)]


def test_listing_equals_walk(spark, tmp_path):
    r = random.Random(1)
    for _ in range(120):
        parts = [r.choice(["a", "_b", ".c", "d.md", "node_modules", "é", "A"]) for _ in range(r.randrange(0, 4))]
        at = tmp_path / "t" / "/".join(parts)
        try:
            at.mkdir(parents=True, exist_ok=True)
            (at / r.choice(["x.md", "_y.txt", ".md", ".z.py", "no.bin", "UP.MD", "a.txt", "a-b.txt", "plain"])).write_text("t")
        except OSError:
            pass
    (tmp_path / "t" / "link").symlink_to(tmp_path / "t" / "a")
    (tmp_path / "t" / "link.md").symlink_to(tmp_path / "t" / "a")
    for root in (str(tmp_path / "t"), f"{tmp_path}/t/"):
        want = list(listing.walk(root))
        found = listing.listed(spark, root).orderBy(listing.order(F.col("path"))).collect()
        assert [x["path"] for x in found] == want and len(want) > 20
    shutil.copytree(tmp_path / "t", tmp_path / "u", symlinks=False, ignore=lambda d, names: [n for n in names if n.startswith("link")])
    by_uri = [x["path"] for x in listing.listed(spark, f"file://{tmp_path}/u").orderBy(listing.order(F.col("path"))).collect()]
    assert by_uri == list(listing.walk(str(tmp_path / "u")))
    got = listing.read(listing.listed(spark, f"file://{tmp_path}/u"), f"file://{tmp_path}/u").collect()
    assert len(got) == len(by_uri) and all(bytes(x["body"]) == b"t" and x["error"] is None for x in got)
    gone = listing.read_files(spark, str(tmp_path / "u"), ["none.md"]).first()
    assert gone["body"] is None and "none.md" in gone["error"]
    with pytest.raises(OSError):
        listing.listed(spark, str(tmp_path / "nothing"))
    assert listing.listed(spark, str(tmp_path / "t"), (".go",)).count() == 0
