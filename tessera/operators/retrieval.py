"""Searches over the catalog: lexical, hybrid and deep, with results as one schema."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import Search
from ..functions import snippets
from ..functions import text as X
from ..functions.stemming import term
from ..plans import indexing
from ..plans.store import Store
from . import bm25, fusion, knn

log = logging.getLogger(__name__)
MODES = ("lexical", "hybrid", "deep")


@dataclass
class Options:
    query: str
    collection: str = ""
    top_k: int = 10
    mode: str = "hybrid"
    explain: bool = False


@dataclass
class Searcher:
    store: Store
    config: Search = field(default_factory=Search)
    embedder: object | None = None
    reranker: object | None = None
    #: "all": soft-deleted chunks weigh in the statistics; "active": they do not.
    stats_scope: str = "all"
    unicode_terms: bool = False

    def _live(self, collection: str) -> DataFrame:
        docs = self.store.table("documents").filter("active")
        docs = docs.filter(F.col("collection") == collection) if collection else docs
        return docs.select(F.col("id").alias("doc_id"), "collection", "path", F.coalesce("title", "path").alias("title"))

    def _terms(self, query: str) -> list[str]:
        return [term(t) for t in X.query_terms(query, self.unicode_terms)]

    def _bm25(self, query: str, collection: str, k: int) -> DataFrame:
        """Statistics are read, not counted, and only blocks of postings that may hold a result are opened."""
        now, terms = self.store.manifest, self._terms(query)
        blocks, docs = self.store.blocks(now), self._live(collection).select("doc_id")
        if blocks is None:
            return self.store.spark.createDataFrame([], "chunk_id bigint, score double, rank int")
        of = indexing.statistics(self.store, terms, self.stats_scope, now)
        live = lambda rows: self.store.live("posting_blocks", rows, now).join(docs, "doc_id", "left_semi")
        return bm25.search_blocks(blocks, of, terms, k, live).hits

    def _knn(self, vector: list[float], collection: str, k: int) -> DataFrame:
        live = self.store.table("embeddings").join(self._live(collection).select("doc_id"), "doc_id", "left_semi").select("chunk_id")
        return knn.search(self.store.table("chunk_vectors").select("chunk_id", "vector"), vector, k, live=live)

    def _shown(self, hits: DataFrame, query: str, opts: Options) -> DataFrame:
        """hits (chunk_id, score, explain fields) of at most a few hundred rows -> results."""
        terms = self._terms(query)

        @F.udf("string")
        def snippet(text, lexical):
            return snippets.snippet(text, terms) if lexical else text

        chunks = self.store.table("chunks").select(F.col("id").alias("chunk_id"), "doc_id", "text", F.coalesce("heading_path", F.lit("")).alias("heading_path"))
        met = chunks.join(F.broadcast(hits), "chunk_id")
        met = self._live("").join(F.broadcast(met), "doc_id")
        names = ["bm25_score", "bm25_rank", "vector_distance", "vector_rank", "rrf_score", "rerank_score"]
        kinds = dict(met.dtypes)
        given = [F.col(n) if n in kinds else F.lit(None).cast("int" if n.endswith("rank") else "double").alias(n) for n in names]
        explain = F.struct(*given) if opts.explain else F.lit(None)
        lexical = F.col("bm25_rank").isNotNull() if "bm25_rank" in kinds else F.lit(False)
        out = met.select("doc_id", "chunk_id", "collection", "path", "title", "heading_path", snippet("text", lexical).alias("snippet"), "score", explain.alias("explain"))
        schema = schemas._schema(schemas.RESULT)
        return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).orderBy(F.desc("score"), "chunk_id")

    def _kept(self, hits: DataFrame) -> DataFrame:
        """A short list, computed once."""
        rows = hits.collect()
        return self.store.spark.createDataFrame(rows, hits.schema)

    def lexical(self, opts: Options) -> DataFrame:
        k = opts.top_k if opts.top_k > 0 else 10
        hits = self._kept(self._bm25(opts.query, opts.collection, k))
        return self._shown(hits.withColumns({"bm25_score": F.col("score"), "bm25_rank": F.col("rank")}), opts.query, opts)

    def search(self, opts: Options) -> DataFrame:
        if opts.mode not in MODES:
            raise ValueError(f"unknown mode {opts.mode!r}")
        if opts.mode == "lexical":
            return self.lexical(opts)
        k = opts.top_k if opts.top_k > 0 else 10
        wide = max(k, self.config.bm25_top_k)
        first = self._bm25(opts.query, opts.collection, wide).collect()
        hits = self.store.spark.createDataFrame(first, "chunk_id long, score double, rank int")
        only = hits.filter(F.col("rank") <= k).withColumns({"bm25_score": F.col("score"), "bm25_rank": F.col("rank")})
        if self.embedder is None or (opts.mode == "hybrid" and fusion.strong_signal([r["score"] for r in first])):
            if self.embedder is None:
                log.warning("no embedding provider: lexical results only")
            return self._shown(only, opts.query, opts)
        try:
            near = self._kept(self._knn(self.embedder.embed([opts.query])[0], opts.collection, max(k, self.config.vector_top_k)))
        except Exception as e:
            log.warning("vector search failed, lexical results only: %s", e)
            return self._shown(only, opts.query, opts)
        deep = opts.mode == "deep" and self.reranker is not None
        fused = fusion.fuse(hits, near, self.config.rrf_k, max(k, self.config.rerank_top_k) if deep else k)
        fused = self._kept(fused.withColumn("score", F.col("rrf_score")))
        out = self._shown(fused, opts.query, opts)
        return self._reranked(fused, opts, k) if deep else out

    def _reranked(self, fused: DataFrame, opts: Options, k: int) -> DataFrame:
        """The best by fusion in the order of a reranker's scores; in the order they have if it fails."""
        best = fused.filter(F.col("rank") <= self.config.rerank_top_k)
        texts = self.store.table("chunks").select(F.col("id").alias("chunk_id"), "text").join(F.broadcast(best.select("chunk_id", "rank")), "chunk_id").orderBy("rank").collect()
        try:
            scores = self.reranker.rerank(opts.query, [r["text"] for r in texts])
        except Exception as e:
            log.warning("reranking failed, fused results: %s", e)
            return self._shown(fused.filter(F.col("rank") <= k), opts.query, opts)
        given = self.store.spark.createDataFrame([(r["chunk_id"], float(s)) for r, s in zip(texts, scores)], "chunk_id long, rerank_score double")
        ranked = best.join(given, "chunk_id").withColumn("score", F.col("rerank_score"))
        return self._shown(ranked.orderBy(F.desc("score"), "chunk_id").limit(k), opts.query, opts)
