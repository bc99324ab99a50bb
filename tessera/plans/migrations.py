"""Steps from older catalogs to the layout of now, in order, each one commit.

A step is skipped once the manifest says that it was done, and one that broke off leaves the manifest as it was, so the
next opening begins with it again. What a step reads is never changed by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import bm25
from . import indexing
from .store import Store

# Columns of version 1 that have changed since.
SNAPSHOTS = {
    "chunk_vectors": "chunk_id bigint, vector array<float>",
    "embeddings": "chunk_id bigint, provider string, model string, dimension int, embedded_at timestamp",
    "postings": "chunk_id bigint, term string, tf int",
}


def snapshot(store: Store, manifest: dict, name: str) -> DataFrame:
    """A table of version 1: a folder for each version of it."""
    schema = schemas._schema(SNAPSHOTS[name]) if name in SNAPSHOTS else schemas.schema(name)
    now = manifest["snapshots"].get(name)
    return store.spark.createDataFrame([], schema) if now is None else store.spark.read.schema(schema).parquet(f"{store.root}/{name}/v={now}")


def to_segments(store: Store) -> None:
    """1 to 2: each table's snapshot becomes its first segment; vectors and embeddings get their document's id."""
    base = store.manifest
    old = lambda name: snapshot(store, base, name)
    owner = old("chunks").select(F.col("id").alias("chunk_id"), "doc_id")
    add = {t: old(t) for t in ("content", "documents", "chunks", "chunk_len", "index_runs", "llm_cache")}
    add |= {t: old(t).join(owner, "chunk_id") for t in ("chunk_vectors", "embeddings")}
    store.commit(add=add, totals={"documents": add["documents"].count()}, base=base, schema_version=2)


def to_blocks(store: Store) -> None:
    """2 to 3: postings in blocks, and the statistics that searches read. The dictionary of tokens fills as texts are indexed again."""
    base = store.manifest
    lens = store.table("chunk_len", base)
    posted = snapshot(store, base, "postings").join(lens, "chunk_id")
    active = store.table("documents", base).select(F.col("id").alias("doc_id"), F.when(F.col("active"), 1).otherwise(0).alias("live"))
    sums = lens.join(active, "doc_id").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (F.lit(1), F.col("dl"), F.col("live"), F.col("live") * F.col("dl"))]).first()
    stats = indexing.difference(posted.join(active, "doc_id"), 1, F.col("live"))
    totals = dict(zip(("chunks", "tokens", "active_chunks", "active_tokens"), sums))
    store.commit(add={"posting_blocks": bm25.blocked(posted), "term_stats": stats}, totals=totals, base=base, schema_version=3)


STEPS: dict[int, Callable[[Store], None]] = {1: to_segments, 2: to_blocks}


def migrate(store: Store) -> None:
    with store.writing():
        while (at := store.version) < schemas.VERSION:
            STEPS[at](store)
