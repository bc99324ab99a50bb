"""Reading the catalog: documents by hash, counts, the last run. The plans take frames, so they work on any source of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .store import Store


def matching(docs: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    """The first ``limit`` active documents (collection, path, content_hash, active, ...) whose hash begins with ``prefix``."""
    found = docs.filter("active").filter(X.hash_prefix(F.col("content_hash"), prefix)).orderBy("collection", "path").limit(limit)
    return found.withColumns({"short_id": X.short_id(F.col("content_hash")), "uri": X.uri(F.col("collection"), F.col("path"))})


def with_content(docs: DataFrame, content: DataFrame) -> DataFrame:
    """``docs`` (content_hash, ...) with what ``content`` (hash, ...) has for their hashes."""
    return docs.join(content.withColumnRenamed("hash", "content_hash"), "content_hash")


def get(store: Store, prefix: str, limit: int = 5) -> DataFrame:
    """Active documents whose hash begins with ``prefix``, with their bodies."""
    found = F.broadcast(matching(store.table("documents"), prefix, limit))
    return with_content(found, store.table("content").select("hash", "body")).select("collection", "path", "title", "content_hash", "short_id", "uri", "body").orderBy("collection", "path")


def counts(docs: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """docs (id, collection, active), chunks (id, doc_id), embeddings (chunk_id) -> documents, chunks and embeddings of each collection with an active document.

    Aggregates are made before the joins, so there is no fan-out and no distinct.
    """
    live = docs.filter("active").select("id", "collection")
    per_chunk = embeddings.groupBy(F.col("chunk_id").alias("id")).agg(F.count(F.lit(1)).alias("e"))
    per_doc = chunks.select("id", "doc_id").join(per_chunk, "id", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.coalesce("e", F.lit(0))).alias("embeddings"))
    met = live.join(per_doc, live["id"] == per_doc["doc_id"], "left")
    return met.groupBy("collection").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("chunks", F.lit(0))).alias("chunks"), F.sum(F.coalesce("embeddings", F.lit(0))).alias("embeddings"))


def stats(store: Store) -> DataFrame:
    return counts(store.table("documents"), store.table("chunks"), store.table("embeddings")).orderBy("collection")


def history(runs: DataFrame) -> DataFrame:
    """runs (collection, finished_at, files_scanned) -> for each collection with a finished run: the last one's end, how many, and the most files."""
    done = runs.filter("finished_at IS NOT NULL")
    return done.groupBy("collection").agg(F.max("finished_at").alias("last_finished"), F.count(F.lit(1)).alias("runs"), F.coalesce(F.max("files_scanned"), F.lit(0)).alias("most"))


def last_run(store: Store) -> str:
    at = history(store.table("index_runs")).agg(F.date_format(F.max("last_finished"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    return at or "never"


def human_bytes(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    size, unit = n / 1024, 0
    while size >= 1024:
        size, unit = size / 1024, unit + 1
    return f"{size:.1f} {'KMGTPE'[unit]}iB"
