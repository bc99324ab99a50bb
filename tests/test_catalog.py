import json
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tessera import cli, output
from tessera.config import Collection, Provider
from tessera.functions.text import query_terms
from tessera.operators import bm25, fusion
from tessera.operators.retrieval import Options, Searcher
from tessera.plans import answers, catalog, indexing
from tessera.plans.providers import HashEmbedder, HttpEmbedder, HttpGenerator, HttpReranker, ProviderError
from tessera.plans.store import Locked, Store

FILES = {
    "go.md": "# Go\n## Intro\nGo is a compiled language with goroutines. Go programs start fast.\n",
    "rust.md": "# Rust\n## Intro\nRust has ownership and borrowing; compiled programs are safe.\n",
    "notes.txt": "Shopping list: milk, running shoes and a compiled index of books.\n",
    "sub/_x.py": "def goroutine():\n    return 'not go'\n",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "files"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/catalog")


def test_index_over_time(spark, store, tree):
    col = Collection("c", str(tree))
    run = indexing.index(store, col)
    assert (run.scanned, run.added, run.updated, run.removed) == (4, 4, 0, 0)
    ids = {r["path"]: r["id"] for r in store.table("documents").collect()}
    assert sorted(ids.values()) == [1, 2, 3, 4]
    again = indexing.index(store, col)
    assert (again.added, again.updated, again.removed) == (0, 0, 0)
    indexing.embed(store, HashEmbedder())
    (tree / "go.md").write_text("# Go\nNew words.\n")
    (tree / "notes.txt").unlink()
    run = indexing.index(store, col)
    assert (run.added, run.updated, run.removed) == (0, 1, 1)
    docs = {r["path"]: r for r in store.table("documents").collect()}
    assert docs["go.md"]["id"] == ids["go.md"] and not docs["notes.txt"]["active"]
    chunks = {r["id"] for r in store.table("chunks").collect()}
    assert {r["chunk_id"] for r in store.table("chunk_vectors").collect()} <= chunks
    assert {r["chunk_id"] for r in store.table("chunk_len").collect()} == chunks
    # a file that is back is active again, under its id
    (tree / "notes.txt").write_text(FILES["notes.txt"])
    assert indexing.index(store, col).added == 1
    docs = {r["path"]: r for r in store.table("documents").collect()}
    assert docs["notes.txt"]["active"] and docs["notes.txt"]["id"] == ids["notes.txt"]
    assert store.table("index_runs").count() == 4 and catalog.last_run(store) != "never"
    with pytest.raises(OSError):
        indexing.index(store, Collection("gone", str(tree / "gone")))
    assert store.table("index_runs").filter("error IS NOT NULL").count() == 1


def test_bm25_equals_fts5(store, tree):
    indexing.index(store, Collection("c", str(tree)))
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(text, heading, tokenize='porter unicode61')")
    for r in store.table("chunks").collect():
        c.execute("insert into t(rowid, text, heading) values (?, ?, ?)", (r["id"], r["text"], r["heading_path"]))
    s = Searcher(store)
    for query in ("compiled", "Intro rust", "go go", "compiled programs", "running", "goroutines", "absent", "!!"):
        found = [(r["chunk_id"], r["score"]) for r in s.lexical(Options(query)).collect()]
        terms = query_terms(query)
        want = [] if not terms else c.execute("select rowid, -bm25(t) s from t where t match ? order by s desc, rowid", (" ".join(f'"{t}"' for t in terms),)).fetchall()
        assert [i for i, _ in found] == [i for i, _ in want], query
        assert all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(found, want))


def test_search_modes(store, tree):
    indexing.index(store, Collection("c", str(tree)))
    indexing.index(store, Collection("d", str(tree / "sub")))
    assert indexing.embed(store, HashEmbedder()) == store.table("chunks").count()
    assert indexing.embed(store, HashEmbedder()) == 0
    s = Searcher(store, embedder=HashEmbedder())
    hybrid = s.search(Options("compiled programs", explain=True)).collect()
    assert len(hybrid) == 5 and hybrid[0]["explain"]["rrf_score"] == hybrid[0]["score"] and "<b>" in hybrid[0]["snippet"]
    assert [r["score"] for r in hybrid] == sorted((r["score"] for r in hybrid), reverse=True)
    assert all(r["collection"] == "d" for r in s.search(Options("goroutine", "d")).collect())

    class Backwards:
        def rerank(self, query, passages):
            return [float(i) for i in range(len(passages))]

    deep = Searcher(store, embedder=HashEmbedder(), reranker=Backwards()).search(Options("compiled programs", mode="deep", top_k=3)).collect()
    assert [r["chunk_id"] for r in deep] == [r["chunk_id"] for r in hybrid][::-1][:3]

    class Broken:
        model, parallel = "b", 1

        def embed(self, texts):
            raise ProviderError("down")

    lexical = s.search(Options("compiled programs", mode="lexical")).collect()
    assert [r["chunk_id"] for r in Searcher(store, embedder=Broken()).search(Options("compiled programs")).collect()] == [r["chunk_id"] for r in lexical]
    assert [r["explain"] for r in lexical] == [None] * len(lexical)
    with pytest.raises(ValueError):
        s.search(Options("x", mode="other"))
    stats = {r["collection"]: r.asDict() for r in catalog.stats(store).collect()}
    assert stats["c"]["documents"] == 4 and stats["d"]["embeddings"] == 1


def test_get_and_delete(store, tree):
    indexing.index(store, Collection("c", str(tree)))
    indexing.index(store, Collection("d", str(tree / "sub")))
    doc = store.table("documents").filter("path = 'go.md'").first()
    got = catalog.get(store, doc["content_hash"][:8].upper()).collect()
    assert [bytes(r["body"]).decode() for r in got] == [FILES["go.md"]] and got[0]["uri"] == "tessera://c/go.md"
    before = store.table("content").count()
    indexing.delete_collection(store, "c")
    assert before == 4 and store.table("content").count() == 1
    assert {r["collection"] for r in store.table("documents").collect()} == {"d"}
    chunks = {r["id"] for r in store.table("chunks").collect()}
    assert {r["chunk_id"] for r in store.table("postings").collect()} == chunks
    indexing.rename_collection(store, "d", "e")
    assert {r["collection"] for r in store.table("documents").collect()} == {"e"}


def test_one_writer(store):
    with store.writing():
        with pytest.raises(Locked):
            with store.writing():
                pass
    with store.writing():
        pass


def test_ask_caches(store, tree):
    indexing.index(store, Collection("c", str(tree)))

    class Once:
        model, calls = "m", 0

        def complete(self, system, user, max_tokens=0):
            self.calls += 1
            assert "tessera://c/go.md" in user and user.endswith("goroutines")
            return "an answer"

    g, s = Once(), Searcher(store)
    assert answers.ask(s, g, "goroutines").text == "an answer"
    assert answers.ask(s, g, "goroutines").text == "an answer" and g.calls == 1
    assert answers.ask(s, g, "zzz").text == answers.NOTHING and g.calls == 1


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        seen: list = []
        answer: dict = {}

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.seen.append((self.path, body, self.headers.get("Authorization")))
            raw = json.dumps(self.answer(body) if callable(self.answer) else self.answer).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *a):
            pass

    Handler.seen = []
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Handler.url = f"http://127.0.0.1:{s.server_port}"
    yield Handler
    s.shutdown()


def test_providers(server):
    e = HttpEmbedder(Provider(base_url=server.url + "/", model="m", api_key="k", batch_size=2))
    server.answer = staticmethod(lambda b: {"data": [{"embedding": [float(i)] * 4, "index": i} for i in reversed(range(len(b["input"])))]})
    assert e.embed(["a", "b", "c"]) == [[0.0] * 4, [1.0] * 4, [0.0] * 4]
    assert [s[2] for s in server.seen] == ["Bearer k"] * 2 and server.seen[0][0] == "/v1/embeddings"
    server.answer = {"error": {"message": "no"}}
    for call in (lambda: e.embed(["a"]), lambda: HttpReranker(Provider(base_url=server.url)).rerank("q", ["a"]), lambda: HttpGenerator(Provider(base_url=server.url)).complete("s", "u")):
        with pytest.raises(ProviderError, match="no"):
            call()
    assert server.seen[-1][2] is None
    server.answer = {"data": [{"embedding": [1.0], "index": 0}]}
    with pytest.raises(ProviderError, match="index 1"):
        e.embed(["a", "b"])
    server.answer = {"results": [{"index": 1, "relevance_score": 0.5}]}
    assert HttpReranker(Provider(base_url=server.url)).rerank("q", ["a", "b"]) == [0.0, 0.5]
    server.answer = {"choices": [{"message": {"content": "hi"}}]}
    assert HttpGenerator(Provider(base_url=server.url)).complete("s", "u", 5) == "hi"
    assert [m["role"] for m in server.seen[-1][1]["messages"]] == ["system", "user"] and server.seen[-1][1]["max_tokens"] == 5


def lists(spark, a, b):
    one = spark.createDataFrame([(c, 1.0 / (i + 1), i + 1) for i, c in enumerate(a)], "chunk_id long, score double, rank int")
    two = spark.createDataFrame([(c, 0.1 * i, i + 1) for i, c in enumerate(b)], "chunk_id long, distance double, rank int")
    return [(r["chunk_id"], r["rrf_score"]) for r in fusion.fuse(one, two).orderBy("rank").collect()]


def test_fusion(spark):
    assert lists(spark, [], []) == []
    assert [c for c, _ in lists(spark, [3, 1], [])] == [3, 1]
    both = lists(spark, [1, 2], [2, 3])
    assert both[0][0] == 2 and len(both) == 3
    assert lists(spark, [7], [7])[0][1] == pytest.approx(2 / 61, abs=1e-9)
    assert [c for c, _ in lists(spark, [1, 2], [2, 1])] == [1, 2]
    assert fusion.strong_signal([4.0, 1.0]) and not fusion.strong_signal([3.0, 1.0]) and not fusion.strong_signal([4.0])


def test_bm25_of_empty_tables(spark):
    docs = spark.createDataFrame([], "chunk_id long, text string")
    assert bm25.search(docs, ["a"]).collect() == [] and bm25.search(docs, []).collect() == []


def test_formats(spark):
    rows = spark.createDataFrame([(1, 2, "c", "p.md", "T", "H", "s", 0.5, None)], "doc_id long, chunk_id long, collection string, path string, title string, heading_path string, snippet string, score double, explain string").collect()
    assert output.as_text(rows) == "1. T (score: 0.5000)\n   tessera://c/p.md [H]\n   s\n"
    assert json.loads(output.as_json(rows))[0]["title"] == "T" and output.as_json([]) == "[]"
    assert output.as_markdown(rows).startswith("### T\n**Location:** `tessera://c/p.md` › H\n> s")
    assert output.as_text([]) == "No results found." and output.as_markdown([]) == "_No results found._"


def test_commands(spark, tmp_path, tree, capsys):
    cfg = tmp_path / "c.yaml"
    cfg.write_text(f"database_path: {tmp_path}/cat\n")
    run = lambda *a: cli.main(["--config", str(cfg), *a])
    assert run("index", str(tree), "--name", "mine") == 0 and run("list") == 0
    assert "mine" in capsys.readouterr().out
    assert run("search", "goroutines") == 0 and "tessera://mine/go.md" in capsys.readouterr().out
    assert run("query", "compiled", "--mode", "lexical", "--explain") == 0 and "[explain]" in capsys.readouterr().out
    assert run("stats") == 0 and "Documents:  4" in capsys.readouterr().out
    assert run("index", str(tree), "--name", "other") == 0 and run("index", "other") == 0
    assert run("stats") == 0 and "other" in capsys.readouterr().out
    assert run("doctor") == 0 and run("get", "zzzz") == 1 and run("ask", "x") == 1 and run("index", "none") == 1
    assert run("delete", "other") == 0 and run("stats") == 0 and "No indexed documents" in capsys.readouterr().out
