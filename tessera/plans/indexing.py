"""Incremental indexing: one batch job from a directory to a committed set of tables.

Files are hashed and joined with the catalog by path; only new and changed ones are parsed, chunked and posted. A commit
writes the rows of these documents and the ids of those whose older rows go, in one version. Statistics are kept as
differences: what the new chunks add to a term's count, less what the older ones had.

Terms. Tokens are cut by a pattern; each distinct one is stemmed once, when the catalog first meets it, and stays in
the table ``tokens``. Postings of a run come from its tokens by a join.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Collection
from ..functions.stemming import term
from ..operators import bm25, chunking, parsing
from ..sources import listing
from .store import Store

#: A token: letters, digits and marks of all scripts, and private characters.
TOKEN = r"[\p{L}\p{N}\p{M}\p{Co}]+"
#: Tables that a document's chunks have rows in.
OF_CHUNKS = ("chunks", "posting_blocks", "chunk_len", "chunk_vectors", "embeddings")
#: Texts of a request, on average, where the provider does not say.
REQUEST = 32


@dataclass
class Run:
    scanned: int = 0
    added: int = 0
    updated: int = 0
    removed: int = 0


def _now():
    return F.date_trunc("second", F.current_timestamp())


def classify(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (path, body, hash, error), known documents of the collection -> files with doc_id and change.

    added, updated, same, restored (an inactive document is back, the same or not), removed, failed (unreadable: left alone).
    """
    old = known.select("path", F.col("id").alias("doc_id"), F.col("content_hash").alias("old_hash"), "active")
    change = (
        F.when(F.col("seen").isNull(), F.when(F.col("active"), "removed").otherwise("gone"))
        .when(F.col("error").isNotNull(), "failed")
        .when(F.col("doc_id").isNull(), "added")
        .when(~F.col("active"), "restored")
        .when(F.col("hash") == F.col("old_hash"), "same")
        .otherwise("updated")
    )
    return files.withColumn("seen", F.lit(True)).join(old, "path", "full_outer").withColumn("change", change).drop("seen")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def token_counts(chunks: DataFrame) -> DataFrame:
    """chunks (id, doc_id, text, heading_path) -> (chunk_id, doc_id, dl, token, tf): tokens of the text and its heading path. A chunk without tokens has one row, without a token."""
    every = chunks.select(F.col("id").alias("chunk_id"), "doc_id", F.concat(tokens(F.col("text")), tokens(F.col("heading_path"))).alias("all"))
    one = every.select("chunk_id", "doc_id", F.size("all").alias("dl"), F.explode_outer("all").alias("token"))
    return one.groupBy("chunk_id", "doc_id", "dl", "token").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def stemmed(words: DataFrame) -> DataFrame:
    """(token) of distinct tokens -> (token, term), an Arrow function."""

    @F.pandas_udf("string")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(term)

    return words.select("token", stems("token").alias("term"))


def new_tokens(counts: DataFrame, known: DataFrame) -> DataFrame:
    """(token, term) of tokens that the dictionary ``known`` lacks."""
    used = counts.filter("token IS NOT NULL").select("token").distinct()
    return stemmed(used.join(known.select("token"), "token", "left_anti"))


def postings(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """token_counts -> (term, chunk_id, doc_id, tf, dl)."""
    met = counts.filter("token IS NOT NULL").join(dictionary, "token")
    return met.groupBy("chunk_id", "doc_id", "dl", "term").agg(F.sum("tf").cast("int").alias("tf"))


def lengths(counts: DataFrame) -> DataFrame:
    return counts.select("chunk_id", "doc_id", "dl").distinct()


def difference(posted: DataFrame, n_all: int, n_active: Column | int) -> DataFrame:
    """What postings (chunk_id, term) add to the statistics: so many for each chunk that has the term."""
    rows = posted.select("term", F.lit(n_all).alias("a"), (n_active if isinstance(n_active, Column) else F.lit(n_active)).alias("b"))
    return rows.groupBy("term").agg(F.sum("a").alias("n_all"), F.sum("b").alias("n_active"))


def statistics(store: Store, terms: list[str], scope: str = "all", manifest: dict | None = None) -> bm25.Stats:
    """Of all rows of the index, or of active documents: two numbers of the manifest, and the rows of the terms."""
    manifest = manifest or store.manifest
    names = list(dict.fromkeys(terms))
    totals, prefix = manifest["totals"], "active_" if scope == "active" else ""
    rows = store.table("term_stats", manifest).filter(F.col("term").isin(names)).collect() if names else []
    nd = totals[prefix + "chunks"]
    return bm25.Stats(nd, totals[prefix + "tokens"] / nd if nd else 0.0, {r["term"]: r["n_active" if scope == "active" else "n_all"] for r in rows})


def _numbered(store: Store, df: DataFrame, after: int, *order: str | Column) -> DataFrame:
    """Ids after the largest one, by ``order``, which tells rows apart. Rows are written in ranges of it first, so a lost executor changes no id; then each range is ranked and shifted by the ranges before it."""
    ranged = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    placed = store.scratch(ranged)
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # one row for each range
    shift = sizes.select("__p", (F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + after).alias("__shift"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return placed.withColumn("__k", rank).join(F.broadcast(shift), "__p").withColumn("id", F.col("__shift") + F.col("__k")).drop("__p", "__k", "__shift")


def index(store: Store, col: Collection, chunk_size: int = chunking.TARGET) -> Run:
    """The run has a row from its start; one that did not end keeps it without an end."""
    with store.writing():
        started = datetime.now(UTC).replace(microsecond=0)
        run_id = (store.table("index_runs").agg(F.max("id")).first()[0] or 0) + 1
        _log(store, (run_id, col.name, started, None, 0, 0, 0, 0, None))
        result, error = Run(), None
        try:
            listed = listing.listed(store.spark, col.path, col.extensions, col.ignore, store.scratch)
            result = _apply(store, col, listing.read(listed, col.path), chunk_size)
            return result
        except Exception as e:
            error = str(e)
            raise
        finally:
            ended = datetime.now(UTC).replace(microsecond=0)
            _log(store, (run_id, col.name, started, ended, result.scanned, result.added, result.updated, result.removed, error))
            store.drop_scratch()
            store.compact()


def _log(store: Store, row: tuple) -> None:
    now = store.spark.createDataFrame([row], store.table("index_runs").schema)
    store.commit(add={"index_runs": now}, drop={"index_runs": now.select("id")} if row[3] else None)


def _apply(store: Store, col: Collection, files: DataFrame, chunk_size: int) -> Run:
    base = store.manifest
    documents, chunks, content, known = (store.table(t, base) for t in ("documents", "chunks", "content", "tokens"))
    held = [classify(files, documents.filter(F.col("collection") == col.name)).persist()]
    changes = held[0]
    try:
        n = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        added, updated, restored, removed = (n.get(c, 0) for c in ("added", "updated", "restored", "removed"))
        run = Run(sum(v for c, v in n.items() if c not in ("removed", "gone")), added + restored, updated, removed)
        if not (added or updated or restored or removed):
            return run
        fresh = changes.filter(F.col("change").isin("added", "updated", "restored"))
        parsed = parsing.parsed(fresh.select("path", "body", "hash", "doc_id", "change"))
        last = documents.agg(F.max("id")).first()[0] or 0
        docs = parsed.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "id")
        if added:
            docs = _numbered(store, parsed.filter("doc_id IS NULL").drop("doc_id"), last, listing.order(F.col("path"))).unionByName(docs)
        docs = docs.persist()
        held.append(docs)
        # a document that was known has rows to hide
        old = changes.filter(F.col("change").isin("updated", "restored", "removed")).select("doc_id", "change").persist()
        held.append(old)
        made = docs.select(F.col("id").alias("doc_id"), F.col("hash").alias("content_hash"), "title", "path", F.lit(col.name).alias("collection"))
        was = documents.join(old.select(F.col("doc_id").alias("id"), "change"), "id") if updated or restored or removed else documents.withColumn("change", F.lit("")).limit(0)
        rows = made.join(was.select(F.col("id").alias("doc_id"), "indexed_at"), "doc_id", "left").select(F.col("doc_id").alias("id"), "collection", "path", "title", "content_hash", F.lit(True).alias("active"), F.coalesce("indexed_at", _now()).alias("indexed_at"), _now().alias("updated_at"))
        gone = was.filter("change = 'removed'").withColumns({"active": F.lit(False), "updated_at": _now()})
        cut = chunking.chunk_sections(docs.select(F.col("id").alias("doc_id"), F.col("hash").alias("content_hash"), "sections"), chunk_size)
        cut = _numbered(store, cut, chunks.agg(F.max("id")).first()[0] or 0, "doc_id", "seq").persist()
        counts = token_counts(cut).persist()
        held += [cut, counts]
        stems = new_tokens(counts, known).persist()
        held.append(stems)
        posted = postings(counts, known.unionByName(stems)).persist()
        held.append(posted)
        lens = lengths(counts)
        n_chunks, n_tokens = lens.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        totals = {"documents": added, "chunks": n_chunks, "tokens": n_tokens, "active_chunks": n_chunks, "active_tokens": n_tokens}
        stats = [difference(posted, 1, 1)]
        if updated or restored or removed:
            stale = token_counts(chunks.join(old, "doc_id", "left_semi")).persist()
            held.append(stale)
            # a restored document was not active, and a removed one stays in the index
            kinds = old.withColumns({"a": F.when(F.col("change") == "removed", 0).otherwise(-1), "b": F.when(F.col("change") == "restored", 0).otherwise(-1)}).drop("change")
            per_doc = lengths(stale).join(kinds, "doc_id")
            row = per_doc.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("a"), F.col("a") * F.col("dl"), F.col("b"), F.col("b") * F.col("dl"))]).first()
            for t, x in zip(("chunks", "tokens", "active_chunks", "active_tokens"), row):
                totals[t] += x
            less = postings(stale, known.unionByName(new_tokens(stale, known))).join(kinds, "doc_id")
            stats.append(less.groupBy("term").agg(F.sum("a").alias("n_all"), F.sum("b").alias("n_active")))
        changed = stats[0] if len(stats) == 1 else stats[0].unionByName(stats[1]).groupBy("term").agg(F.sum("n_all").alias("n_all"), F.sum("n_active").alias("n_active"))
        bodies = contents(docs.select("id", "hash", "body")).select("hash", "body", _now().alias("created_at")).join(content.select("hash"), "hash", "left_anti")
        replaced = old.filter("change <> 'removed'").select("doc_id")
        store.commit(
            add={
                "content": bodies,
                "documents": rows.unionByName(gone.select(*rows.columns)),
                "chunks": cut,
                "posting_blocks": bm25.blocked(posted),
                "chunk_len": lens,
                "tokens": stems,
                "term_stats": changed.filter("n_all <> 0 OR n_active <> 0"),
            },
            drop={"documents": old.select("doc_id"), **dict.fromkeys(OF_CHUNKS, replaced)} if updated or restored or removed else None,
            totals=totals,
            base=base,
        )
        return run
    finally:
        for df in held:
            df.unpersist()


def contents(docs: DataFrame, body: str = "body") -> DataFrame:
    """docs (id, hash, body) -> (hash, body, first_id, copies): each content once."""
    return docs.groupBy("hash").agg(F.min_by(body, "id").alias(body), F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def pending(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks (id, ...) that have no embedding (chunk_id)."""
    return chunks.join(embeddings.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def embedded(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks (id, ...) that have one."""
    return chunks.join(embeddings.select(F.col("chunk_id").alias("id")), "id", "left_semi")


def without_collection(documents: DataFrame, chunks: DataFrame, per_chunk: dict[str, DataFrame], name: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """documents (id, collection), chunks (id, doc_id) and tables of chunks (chunk_id), less all of a collection."""
    gone = documents.filter(F.col("collection") == name).select(F.col("id").alias("doc_id"))
    gone_chunks = chunks.join(gone, "doc_id", "left_semi").select(F.col("id").alias("chunk_id"))
    kept = documents.filter(F.col("collection").isNull() | (F.col("collection") != name))
    return kept, chunks.join(gone, "doc_id", "left_anti"), {t: df.join(gone_chunks, "chunk_id", "left_anti") for t, df in per_chunk.items()}


def orphans(content: DataFrame, documents: DataFrame) -> DataFrame:
    """Content (hash, ...) that no document (content_hash) has."""
    return content.join(documents.select(F.col("content_hash").alias("hash")), "hash", "left_anti")


def staged(store: Store, todo: DataFrame, provider) -> DataFrame:
    """todo (chunk_id, doc_id, text) -> (chunk_id, doc_id, vector). Equal texts are asked for once.

    Texts are dealt to requests by their hash, so a request is the same whenever it is made, and its answer is put into
    the store before the task goes on: a task that runs again, or a run after a failure, finds it there and does not ask.
    """
    texts = store.scratch(todo.select(F.sha2("text", 256).alias("text_hash"), "text").dropDuplicates(["text_hash"]))
    each = getattr(getattr(provider, "cfg", None), "batch_size", 0) or REQUEST
    requests = max(1, -(-texts.count() // each))
    folder = store.fs.makeQualified(store._path(f"_staged/{hashlib.sha256(provider.model.encode()).hexdigest()[:16]}")).toString().replace("file:/", "file:///", 1)

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("text_hash")
        fs, top = pafs.FileSystem.from_uri(folder)
        name = f"{top}/{hashlib.sha256(''.join(group['text_hash']).encode()).hexdigest()}.parquet"
        if fs.get_file_info(name).type == pafs.FileType.NotFound:
            vectors = pa.array(provider.embed(group["text"].tolist()), pa.list_(pa.float32()))
            fs.create_dir(top, recursive=True)
            part = f"{name}.{uuid.uuid4().hex}"
            pq.write_table(pa.table({"text_hash": group["text_hash"].tolist(), "vector": vectors}), part, filesystem=fs)
            fs.move(part, name)
        with fs.open_input_file(name) as f:
            return pq.read_table(f).to_pandas()

    dealt = texts.withColumn("request", F.pmod(F.xxhash64("text_hash"), F.lit(requests))).repartition(provider.parallel, "request")
    answers = dealt.groupBy("request").applyInPandas(ask, "text_hash string, vector array<float>")
    return todo.withColumn("text_hash", F.sha2("text", 256)).drop("text").join(store.scratch(answers), "text_hash").select("chunk_id", "doc_id", "vector")


def embed(store: Store, provider, collection: str | None = None) -> int:
    """Vectors for active chunks without one; how many. Batches go out from the executors, as many at a time as there are partitions."""
    with store.writing():
        base = store.manifest
        live = store.table("documents", base).filter("active")
        if collection:
            live = live.filter(F.col("collection") == collection)
        chunks = store.table("chunks", base).join(live.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        todo = pending(chunks, store.table("embeddings", base)).select(F.col("id").alias("chunk_id"), "doc_id", "text")
        try:
            made = store.scratch(staged(store, todo, provider))
            n = made.count()
            if n:
                meta = made.select("chunk_id", "doc_id", F.lit("http").alias("provider"), F.lit(provider.model).alias("model"), F.size("vector").alias("dimension"), _now().alias("embedded_at"))
                store.commit(add={"chunk_vectors": made, "embeddings": meta}, base=base)
                store.compact(["chunk_vectors", "embeddings"])
            store.fs.delete(store._path("_staged"), True)
            return n
        finally:
            store.drop_scratch()


def delete_collection(store: Store, name: str) -> None:
    """Everything of a collection, and content that no document has any more, in one commit."""
    with store.writing():
        base = store.manifest
        documents, known = store.table("documents", base), store.table("tokens", base)
        gone = documents.filter(F.col("collection") == name).select(F.col("id").alias("doc_id"), "active").persist()
        chunks = store.table("chunks", base)
        counts = token_counts(chunks.join(gone, "doc_id", "left_semi")).persist()
        try:
            active = F.when(F.col("active"), 1).otherwise(0)
            row = lengths(counts).join(gone, "doc_id").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (F.lit(1), F.col("dl"), active, active * F.col("dl"))]).first()
            totals = {t: -x for t, x in zip(("chunks", "tokens", "active_chunks", "active_tokens"), row)} | {"documents": -gone.count()}
            less = postings(counts, known.unionByName(new_tokens(counts, known))).join(gone, "doc_id")
            stats = less.groupBy("term").agg((-F.count(F.lit(1))).alias("n_all"), (-F.sum(active)).alias("n_active"))
            unused = orphans(store.table("content", base).select("hash"), documents.join(gone.withColumnRenamed("doc_id", "id"), "id", "left_anti"))
            runs = store.table("index_runs", base).filter(F.col("collection") == name).select("id")
            ids = gone.select("doc_id")
            store.commit(add={"term_stats": stats}, drop={"documents": ids, "content": unused, "index_runs": runs, **dict.fromkeys(OF_CHUNKS, ids)}, totals=totals, base=base)
            store.compact()
        finally:
            gone.unpersist()
            counts.unpersist()


def rename_collection(store: Store, old: str, new: str) -> None:
    with store.writing():
        base = store.manifest
        changed = {t: store.table(t, base).filter(F.col("collection") == old).withColumn("collection", F.lit(new)) for t in ("documents", "index_runs")}
        store.commit(add=changed, drop={t: df.select("id") for t, df in changed.items()}, base=base)
