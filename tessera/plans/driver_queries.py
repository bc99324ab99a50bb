"""Queries over the driver's tables, one for each operator, with the same in DuckDB's SQL.

The adapter: ``documents`` are the corpus; collection is source, path is doc_id and ``.txt``, content_hash is the text's
SHA-256, a document is active unless doc_id is a multiple of 10, and a document is its own chunk. ``embeddings`` are the
vectors (vec_id is the chunk), and vector 0 is the query. Doubles are rounded to nine decimals before they are ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import bm25, chunking, fusion, knn, parsing
from . import catalog, indexing

TERMS = ["this", "with"]
#: Documents as marked-up lines: a heading, a fence, sentences as lines, an open fence and a line of spaces; in Spark's SQL and in DuckDB's.
MARKUP = """SELECT doc_id, '# ' || coalesce(source, 'none') || chr(10) || '```' || chr(10) || replace(coalesce(text, ''), '. ', '.' || chr(10)) || chr(10) || '~~~' || chr(10) || chr(10) || '  #' || coalesce(lang, '') || chr(10) || '  ' AS text FROM documents"""
#: Documents as Markdown with headings of several levels inside quotes and list items, fences with a sign in them, and lazy lines.
MARKDOWN = """SELECT doc_id, 'start ' || doc_id || chr(10) || '# ' || source || chr(10) || 'under ' || lang || chr(10) || '> ## in quote ' || (doc_id % 5) || chr(10) || '> quoted ' || doc_id || chr(10)
  || 'lazy' || chr(10) || chr(10) || '- item' || chr(10) || '  ### in item' || chr(10) || '  ```' || chr(10) || '  # no heading ' || doc_id || chr(10) || '  ```' || chr(10) || '- next' || chr(10)
  || 'Title' || (doc_id % 3) || chr(10) || chr(10) || 'Rule ' || lang || chr(10) || '---' || chr(10) || '    code ' || doc_id || chr(10) || chr(10) || '> > # ' || lang || ' #' || chr(10) || '> > deep' AS text FROM documents"""
QUESTION = "What is the best of them?"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("collection"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), (F.col("doc_id") % 10 != 0).alias("active"), "text", "lang")


def _hashed(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id = 0").first()["embedding"])


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _spread(docs: DataFrame) -> DataFrame:
    """The driver's tables are one row group each; tokenizing is worth spreading when the scan is not."""
    n = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(n) if docs.rdd.getNumPartitions() < n else docs


def bm25_search(spark, sf, terms=TERMS, k=10, where="active"):
    docs = _spread(_docs(spark, sf).select("chunk_id", "collection", "path", "active", "text"))
    return bm25.search(docs, list(terms), k, F.expr(where))


def bm25_topk(spark, sf):
    return bm25_search(spark, sf).select("chunk_id", "collection", "path", "score")


def bm25_collection(spark, sf):
    return bm25_search(spark, sf, where="active AND collection = 'src1'").select("chunk_id", "collection", "score")


def bm25_dup_terms(spark, sf):
    return bm25_search(spark, sf, terms=["this", "this", "with"]).select("chunk_id", "score")


def bm25_explain(spark, sf):
    out = bm25_search(spark, sf, k=50)
    return out.select("chunk_id", F.col("score").alias("bm25_score"), F.col("rank").cast("long").alias("bm25_rank"), "dl")


def corpus_stats(spark, sf):
    tokens = bm25.tokenized(_docs(spark, sf).select("chunk_id", "text"))
    return tokens.agg(F.count(F.lit(1)).alias("nd"), F.round(F.avg(F.size("tokens")), 9).alias("avgdl"), F.sum(F.size("tokens")).cast("long").alias("total_tokens"))


def term_df(spark, sf):
    tokens = bm25.tokenized(_docs(spark, sf).select("chunk_id", "text"))
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def postings(spark, sf):
    tokens = bm25.tokenized(_docs(spark, sf).select("chunk_id", "text"))
    return bm25.postings(tokens).select("chunk_id", "term", F.col("tf").cast("long").alias("tf"))


def bm25_indexed(spark, sf):
    """An index of the query's terms, and a search that opens the blocks it needs; texts are read once."""
    terms = list(TERMS)
    kept = F.filter("tokens", lambda t: t.isin(terms))
    held = bm25.tokenized(_spread(_docs(spark, sf).select("chunk_id", "text"))).select("chunk_id", F.size("tokens").alias("dl"), kept.alias("tokens")).persist()
    try:
        posted = held.select("chunk_id", F.col("chunk_id").alias("doc_id"), "dl", F.explode("tokens").alias("term"))
        blocks = bm25.blocked(posted.groupBy("chunk_id", "doc_id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))).persist()
        nd, avgdl, *n_t = held.agg(F.count(F.lit(1)), F.avg("dl"), *[F.count_if(F.array_contains("tokens", t)) for t in terms]).first()
        found = bm25.search_blocks(blocks, bm25.Stats(nd, avgdl, dict(zip(terms, n_t))), terms).hits.select("chunk_id", "score")
        blocks.unpersist()
        return found
    finally:
        held.unpersist()


def knn_topk(spark, sf):
    return knn.search(_vectors(spark, sf), _query_vector(spark, sf)).select("chunk_id", "distance", "score")


def knn_collection(spark, sf):
    return knn.search(_vectors(spark, sf), _query_vector(spark, sf), where=F.col("label") == 1).select("chunk_id", "distance")


def knn_active_join(spark, sf):
    live = _docs(spark, sf).filter("active").select("chunk_id", "collection", "path")
    near = knn.search(_vectors(spark, sf).drop("label"), _query_vector(spark, sf), live=live.select("chunk_id"))
    return near.select("chunk_id", "distance").join(live, "chunk_id")


def knn_many(spark, sf):
    """The five nearest of every hundredth vector, itself left out, by clusters."""
    rows = _vectors(spark, sf).select("chunk_id", "vector")
    queries = rows.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    found = knn.search_many(knn.clustered(rows), queries, 6).hits.filter("chunk_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("rank", rank.cast("long")).filter("rank <= 5").select("query_id", "chunk_id", "distance", "rank")


def cosine_zero_norm(spark, sf):
    v = _vectors(spark, sf)
    other = F.when(F.col("chunk_id") % 3 == 0, F.transform("vector", lambda x: x * 0)).when(F.col("chunk_id") % 3 == 1, F.slice("vector", 1, 3)).otherwise(F.col("vector"))
    return v.select("chunk_id", F.round(V.cosine_distance(F.col("vector"), other), 9).alias("distance"))


def _lists(spark, sf):
    return bm25_search(spark, sf, k=50), knn.search(_vectors(spark, sf), _query_vector(spark, sf), k=50)


def rrf_fuse(spark, sf):
    out = fusion.fuse(*_lists(spark, sf))
    return out.select("chunk_id", "rrf_score", F.col("bm25_rank").cast("long").alias("bm25_rank"), F.col("vector_rank").cast("long").alias("vector_rank"))


def hybrid_topk(spark, sf):
    out = fusion.fuse(*_lists(spark, sf), top_k=10)
    docs = _docs(spark, sf).select("chunk_id", "collection", "path")
    return F.broadcast(out).join(docs, "chunk_id", "left").select("chunk_id", "collection", "path", "rrf_score")


def strong_signal(spark, sf):
    best = bm25_search(spark, sf, k=50).select("score")
    scores = [r["score"] for r in best.orderBy(F.desc("score")).limit(2).collect()]
    return spark.createDataFrame([(fusion.strong_signal(scores),)], "strong boolean")


def _sections(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", chunking.whole_text_sections(F.col("text")).alias("sections"))


def _chunks(spark, sf, target):
    return chunking.chunk_sections(_sections(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")), target)


def chunk_documents(spark, sf):
    return _chunks(spark, sf, 256).select("doc_id", F.col("seq").cast("long").alias("seq"), "text", F.col("content_length").cast("long").alias("content_length"))


def chunk_stats(spark, sf):
    return _chunks(spark, sf, 512).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("content_length").cast("long").alias("bytes"))


def chunk_seq(spark, sf):
    c = _chunks(spark, sf, 256).groupBy("doc_id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("docs"), F.count_if((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).alias("gapless"))


def _made(spark, sf, sql):
    """Rows of ``sql`` over the documents, without a table in the catalog."""
    return spark.sql(sql.replace("FROM documents", "FROM {documents}"), documents=spark.read.parquet(f"{sf}/documents.parquet"))


def chunk_markup(spark, sf):
    return chunking.chunk_sections(_sections(_made(spark, sf, MARKUP)), 50).select("doc_id", F.col("seq").cast("long").alias("seq"), "text")


def line_scores(spark, sf):
    lines = _made(spark, sf, MARKUP).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return lines.select("doc_id", F.col("i").cast("long").alias("i"), chunking.line_score(F.col("line")).cast("long").alias("line_score"))


def content_dedup(spark, sf):
    docs = _hashed(spark, sf).select(F.col("content_hash").alias("hash"), F.col("chunk_id").alias("id"), "text")
    return indexing.contents(docs, "text").select(F.col("hash").alias("content_hash"), "first_id", "copies")


def content_addressed_join(spark, sf):
    docs = _hashed(spark, sf)
    content = docs.groupBy(F.col("content_hash").alias("hash")).agg(F.min(F.octet_length("text")).cast("long").alias("size"))
    return catalog.with_content(docs.filter("active").select("chunk_id", "path", "content_hash"), content)


def incremental_changes(spark, sf):
    """The catalog has what is not a multiple of 7; on disk is what is not a multiple of 11, every 13th document edited."""
    docs = _hashed(spark, sf).select("chunk_id", "path", "content_hash")
    known = docs.filter("chunk_id % 7 <> 0").select("path", F.col("chunk_id").alias("id"), "content_hash", F.lit(True).alias("active"))
    edited = F.when(F.col("chunk_id") % 13 == 0, F.sha2(F.concat("content_hash", F.lit("+")), 256)).otherwise(F.col("content_hash"))
    files = docs.filter("chunk_id % 11 <> 0").select("path", edited.alias("hash"), F.lit(None).cast("string").alias("error"))
    return indexing.classify(files, known).groupBy("change").agg(F.count(F.lit(1)).alias("files"))


def get_by_prefix(spark, sf):
    return catalog.matching(_hashed(spark, sf), "A").select("collection", "path", "short_id", "uri")


def collection_stats(spark, sf):
    """A chunk's vector is its document's. A blank document has no chunk, and its vector all the same, so it stands in for one and is taken off again."""
    docs = _docs(spark, sf)
    made = _chunks(spark, sf, 512).select("doc_id", F.when(F.col("seq") == 0, F.col("doc_id")).alias("id"))
    bare = docs.filter(F.size(chunking.whole_text_sections(F.col("text"))) == 0)
    n_bare = bare.filter("active").groupBy("collection").agg(F.count(F.lit(1)).alias("bare"))
    rows = made.unionByName(bare.select(F.col("chunk_id").alias("doc_id"), F.col("chunk_id").alias("id")))
    out = catalog.counts(docs.select(F.col("chunk_id").alias("id"), "collection", "active"), rows, _vectors(spark, sf).select("chunk_id").distinct())
    return out.join(n_bare, "collection", "left").withColumn("chunks", F.col("chunks") - F.coalesce("bare", F.lit(0))).drop("bare")


def cascade_delete_survivors(spark, sf):
    docs = _docs(spark, sf).select(F.col("chunk_id").alias("id"), "collection")
    chunks = _chunks(spark, sf, 512).select("doc_id", F.col("doc_id").alias("id"))
    bare = docs.select(F.col("id").alias("doc_id"), "id", F.lit(True).alias("bare"))  # a document's vector, whether it has chunks or not
    kept, left, others = indexing.without_collection(docs, chunks.withColumn("bare", F.lit(False)).unionByName(bare), {"chunk_vectors": _vectors(spark, sf)}, "src2")
    rows = {"documents": kept, "chunks": left.filter("NOT bare"), **others}
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in rows.items()])


def orphan_content(spark, sf):
    docs = _hashed(spark, sf)
    return indexing.orphans(docs.select(F.col("content_hash").alias("hash")).distinct(), docs.filter("collection <> 'src3'")).withColumnRenamed("hash", "content_hash")


def _live(spark, sf):
    return _docs(spark, sf).filter("active").select(F.col("chunk_id").alias("id"), "collection")


def pending_embeddings(spark, sf):
    return indexing.pending(_live(spark, sf), _vectors(spark, sf)).withColumnRenamed("id", "chunk_id")


def embedded_documents(spark, sf):
    return indexing.embedded(_live(spark, sf), _vectors(spark, sf)).withColumnRenamed("id", "chunk_id")


def llm_cache_key(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return c.select("conv_id", "turn", X.cache_key(F.col("role"), F.coalesce("text", F.lit(""))).alias("key"))


def query_sanitize(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    return b.select("item_id", F.array_join(X.query_terms_column(F.col("text")), " ").alias("terms"))


def index_run_audit(spark, sf):
    """Events as runs: a type is a collection, and a value a number of files."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    runs = catalog.history(e.select(F.col("event_type").alias("collection"), F.col("ts").alias("finished_at"), F.col("value").alias("files_scanned")))
    return runs.select(F.col("collection").alias("event_type"), "last_finished", "runs", F.round("most", 9).alias("most"))


def heading_paths(spark, sf):
    """Sections of Markdown, through the parser that files go through."""
    files = _made(spark, sf, MARKDOWN).select("doc_id", F.lit("a.md").alias("path"), F.col("text").cast("binary").alias("body"))
    s = parsing.parsed(files).select("doc_id", "title", F.posexplode("sections").alias("i", "s"))
    return s.select("doc_id", "title", F.col("i").cast("long").alias("i"), "s.heading_path", "s.text", F.col("s.ordinal").cast("long").alias("ordinal"))


def titles(spark, sf):
    docs = _docs(spark, sf)
    return docs.select("chunk_id", X.title_or_name(F.when(F.col("chunk_id") % 2 == 0, F.col("lang")).otherwise(F.lit("")), F.col("path")).alias("title"))


def slugs(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", X.slug_column(F.col("p_name")).alias("slug"))


def rank_windows(spark, sf):
    """Rank within a partition, as bm25 ranks and chunk numbers need: the two dearest orders of each customer."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("rank", rank.cast("long")).filter("rank <= 2")


_D = "SELECT doc_id AS chunk_id, source AS collection, doc_id || '.txt' AS path, doc_id % 10 <> 0 AS active, sha256(text) AS content_hash, text FROM documents"
_T = f"SELECT chunk_id, collection, path, active, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({_D})"


def _bm25_sql(terms: list[str], k: int, select: str, where: str = "active") -> str:
    names = list(dict.fromkeys(terms))
    s = ", ".join(f"count(*) FILTER (list_contains(w, '{t}')) AS n{i}" for i, t in enumerate(names))
    f = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(names))
    one = lambda i: f"(CASE WHEN ln((nd - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((nd - n{i} + 0.5) / (n{i} + 0.5)) ELSE 0.000001 END) * (f{i} * 2.2::DOUBLE) / (f{i} + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
    score = " + ".join(f"{terms.count(t)} * {one(i)}" for i, t in enumerate(names))
    hits = " AND ".join(f"f{i} > 0" for i in range(len(names)))
    return f"""WITH t AS MATERIALIZED ({_T}), s AS (SELECT count(*)::DOUBLE AS nd, avg(len(w)) AS avgdl, {s} FROM t),
    c AS (SELECT chunk_id, collection, path, active, len(w) AS dl, {f} FROM t),
    b AS (SELECT chunk_id, collection, path, dl::INTEGER AS dl, round({score}, 9) AS score FROM c, s WHERE {hits} AND {where}),
    r AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM b)
    SELECT {select} FROM r WHERE rank <= {k}"""


_NEAR = """SELECT vec_id AS chunk_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS distance FROM embeddings"""
_FUSED = f"""b AS ({_bm25_sql(TERMS, 50, 'chunk_id, rank')}),
  v AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM ({_NEAR}) QUALIFY rank <= 50),
  f AS (SELECT coalesce(b.chunk_id, v.chunk_id) AS chunk_id, round(coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0), 9) AS rrf_score, b.rank AS bm25_rank, v.rank AS vector_rank
        FROM b FULL OUTER JOIN v ON b.chunk_id = v.chunk_id)"""


def _chunk_sql(rows: str, target: int) -> str:
    """(doc_id, seq, text): a recursive walk over each document's lines."""
    space = r"[\s\p{Z}\x{85}]"
    return f"""WITH RECURSIVE d AS ({rows}), l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d WHERE regexp_replace(text, '{space}+', '', 'g') <> ''),
    x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM l),
    p AS (SELECT doc_id, i, n, line, length(line) + 1 AS size, regexp_replace(regexp_replace(line, '{space}+$', ''), '^{space}+', '') AS bare FROM x),
    sc AS (SELECT *, CASE WHEN bare LIKE '#%' THEN 100 WHEN bare LIKE '```%' OR bare LIKE '~~~%' THEN 80 WHEN bare = '' THEN 20 ELSE 0 END AS score FROM p),
    w AS (
      SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS acc, 0::BIGINT AS part, FALSE AS stop FROM l
      UNION ALL
      SELECT w.doc_id, w.i + 1, CASE WHEN w.stop THEN 0 ELSE w.acc END + s.size, w.part + w.stop::INT,
        (CASE WHEN w.stop THEN 0 ELSE w.acc END + s.size) >= {target // 4} AND ((CASE WHEN w.stop THEN 0 ELSE w.acc END + s.size) >= {target}
          OR (s.score > 0 AND s.score * greatest(0, 1 - abs((CASE WHEN w.stop THEN 0 ELSE w.acc END + s.size) - {target})::DOUBLE / {target}) >= 20))
      FROM w JOIN sc s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
    g AS (SELECT w.doc_id, w.part, regexp_replace(string_agg(s.line, chr(10) ORDER BY s.i), '{space}+$', '') AS text FROM w JOIN sc s ON s.doc_id = w.doc_id AND s.i = w.i GROUP BY w.doc_id, w.part)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS seq, text, strlen(text)::BIGINT AS content_length FROM g WHERE text <> ''"""


_ROWS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
_MARKUP_ROWS = MARKUP
_STOP = ", ".join(f"'{w}'" for w in sorted(X.STOP_WORDS))

SQL = {
    "bm25_topk": _bm25_sql(TERMS, 10, "chunk_id, collection, path, score"),
    "bm25_collection": _bm25_sql(TERMS, 10, "chunk_id, collection, score", "active AND collection = 'src1'"),
    "bm25_dup_terms": _bm25_sql(["this", "this", "with"], 10, "chunk_id, score"),
    "bm25_explain": _bm25_sql(TERMS, 50, "chunk_id, score AS bm25_score, rank AS bm25_rank, dl"),
    "bm25_indexed": _bm25_sql(TERMS, 10, "chunk_id, score", "true"),
    "corpus_stats": f"SELECT count(*) AS nd, round(avg(len(w)), 9) AS avgdl, sum(len(w))::BIGINT AS total_tokens FROM ({_T})",
    "term_df": f"SELECT term, count(*) AS n_t FROM (SELECT unnest(list_distinct(w)) AS term FROM ({_T})) GROUP BY term",
    "postings": f"SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM ({_T})) GROUP BY chunk_id, term",
    "knn_topk": f"SELECT chunk_id, distance, round(1 / (1 + distance), 9) AS score FROM ({_NEAR}) ORDER BY distance, chunk_id LIMIT 10",
    "knn_collection": f"SELECT chunk_id, distance FROM ({_NEAR}) WHERE label = 1 ORDER BY distance, chunk_id LIMIT 10",
    "knn_active_join": f"SELECT n.chunk_id, distance, collection, path FROM ({_NEAR}) n JOIN ({_D}) d ON n.chunk_id = d.chunk_id WHERE active ORDER BY distance, n.chunk_id LIMIT 10",
    "knn_many": """SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(1 - list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9) AS distance,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9), b.vec_id) AS rank
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY rank <= 5""",
    "cosine_zero_norm": "SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 < 2 THEN 2.0::DOUBLE ELSE round(1 - list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 9) END AS distance FROM embeddings",
    "rrf_fuse": f"WITH {_FUSED} SELECT chunk_id, rrf_score, bm25_rank, vector_rank FROM f",
    "hybrid_topk": f"WITH {_FUSED} SELECT f.chunk_id, d.source AS collection, d.doc_id || '.txt' AS path, rrf_score FROM f LEFT JOIN documents d ON d.doc_id = f.chunk_id ORDER BY rrf_score DESC, f.chunk_id LIMIT 10",
    "strong_signal": f"WITH b AS ({_bm25_sql(TERMS, 2, 'score, rank')}) SELECT coalesce(count(*) = 2 AND min(score) > 0 AND max(score) / min(score) > 3, false) AS strong FROM b",
    "chunk_documents": _chunk_sql(_ROWS, 256),
    "chunk_stats": f"SELECT doc_id, count(*) AS chunks, sum(content_length)::BIGINT AS bytes FROM ({_chunk_sql(_ROWS, 512)}) GROUP BY doc_id",
    "chunk_seq": f"SELECT count(*) AS docs, count(*) FILTER (lo = 0 AND hi = n - 1) AS gapless FROM (SELECT doc_id, min(seq) AS lo, max(seq) AS hi, count(*) AS n FROM ({_chunk_sql(_ROWS, 256)}) GROUP BY doc_id)",
    "chunk_markup": f"SELECT doc_id, seq, text FROM ({_chunk_sql(_MARKUP_ROWS, 50)})",
    "heading_paths": f"""WITH m AS ({MARKDOWN}), d AS (SELECT d.doc_id, d.source, d.lang, m.text AS body FROM documents d JOIN m ON d.doc_id = m.doc_id),
      s AS (SELECT doc_id, source AS title, body, unnest([
        {{'i': 0, 'path': '', 'text': 'start ' || doc_id, 'mark': ''}},
        {{'i': 1, 'path': source, 'text': 'under ' || lang, 'mark': '# '}},
        {{'i': 2, 'path': source || ' > in quote ' || (doc_id % 5), 'text': 'quoted ' || doc_id || chr(10) || 'lazy' || chr(10) || '- item', 'mark': '> ## '}},
        {{'i': 3, 'path': source || ' > in quote ' || (doc_id % 5) || ' > in item', 'text': '# no heading ' || doc_id || chr(10) || '- next Title' || (doc_id % 3), 'mark': '  ### '}},
        {{'i': 4, 'path': source || ' > Rule ' || lang, 'text': 'code ' || doc_id, 'mark': 'Title' || (doc_id % 3) || chr(10) || chr(10)}},
        {{'i': 5, 'path': lang, 'text': 'deep', 'mark': '> > # '}}]) AS x FROM d)
      SELECT doc_id, title, x.i::BIGINT AS i, x.path AS heading_path, x.text AS text,
             CASE WHEN x.i = 0 THEN 0 ELSE strlen(substr(body, 1, instr(body, chr(10) || x.mark) + length(x.mark)))::BIGINT END AS ordinal FROM s""",
    "line_scores": f"""SELECT doc_id, i, (CASE WHEN b LIKE '#%' THEN 100 WHEN b LIKE '```%' OR b LIKE '~~~%' THEN 80 WHEN b = '' THEN 20 ELSE 0 END)::BIGINT AS line_score
      FROM (SELECT doc_id, i, regexp_replace(line, '^\\s+', '') AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM ({_MARKUP_ROWS})))""",
    "content_dedup": f"SELECT content_hash, min(chunk_id) AS first_id, count(*) AS copies FROM ({_D}) GROUP BY content_hash",
    "content_addressed_join": f"SELECT chunk_id, path, content_hash, strlen(text)::BIGINT AS size FROM ({_D}) WHERE active",
    "incremental_changes": f"""WITH o AS (SELECT path, content_hash AS old_hash FROM ({_D}) WHERE chunk_id % 7 <> 0),
      n AS (SELECT path, CASE WHEN chunk_id % 13 = 0 THEN sha256(content_hash || '+') ELSE content_hash END AS new_hash FROM ({_D}) WHERE chunk_id % 11 <> 0)
      SELECT CASE WHEN old_hash IS NULL THEN 'added' WHEN new_hash IS NULL THEN 'removed' WHEN old_hash = new_hash THEN 'same' ELSE 'updated' END AS change, count(*) AS files
      FROM o FULL OUTER JOIN n ON o.path = n.path GROUP BY 1""",
    "get_by_prefix": f"SELECT collection, path, substr(content_hash, 1, 6) AS short_id, 'tessera://' || collection || '/' || path AS uri FROM ({_D}) WHERE active AND content_hash ILIKE 'A%' ORDER BY collection, path LIMIT 5",
    "collection_stats": f"""WITH c AS ({_chunk_sql(_ROWS, 512)})
      SELECT collection, count(DISTINCT d.chunk_id) AS documents, count(DISTINCT (c.doc_id, c.seq)) FILTER (c.seq IS NOT NULL) AS chunks, count(DISTINCT e.vec_id) AS embeddings
      FROM ({_D}) d LEFT JOIN c ON c.doc_id = d.chunk_id LEFT JOIN embeddings e ON e.vec_id = d.chunk_id WHERE active GROUP BY collection""",
    "cascade_delete_survivors": f"""WITH c AS ({_chunk_sql(_ROWS, 512)}), gone AS (SELECT doc_id FROM documents WHERE source = 'src2')
      SELECT 'documents' AS "table", count(*) AS rows FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
      UNION ALL SELECT 'chunks', count(*) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM gone)
      UNION ALL SELECT 'chunk_vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM gone)""",
    "orphan_content": "SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source <> 'src3')",
    "pending_embeddings": f"SELECT d.chunk_id, collection FROM ({_D}) d LEFT JOIN embeddings e ON e.vec_id = d.chunk_id WHERE active AND e.vec_id IS NULL",
    "embedded_documents": f"SELECT chunk_id, collection FROM ({_D}) WHERE active AND chunk_id IN (SELECT vec_id FROM embeddings)",
    "llm_cache_key": "SELECT conv_id, turn, sha256(role || chr(0) || coalesce(text, '')) AS key FROM conversations",
    "query_sanitize": f"""WITH s AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[\\s\\p{{Z}}\\x{{85}}]+'), lambda t: regexp_replace(t, '[^A-Za-z0-9]', '', 'g')), lambda t: t <> '') AS every FROM benchmark),
      m AS (SELECT *, list_filter(every, lambda t: lower(t) NOT IN ({_STOP})) AS telling FROM s)
      SELECT item_id, array_to_string(CASE WHEN len(telling) > 0 THEN telling ELSE every END, ' ') AS terms FROM m""",
    "index_run_audit": "SELECT event_type, max(ts) AS last_finished, count(*) AS runs, coalesce(round(max(value), 9), 0) AS most FROM events WHERE ts IS NOT NULL GROUP BY event_type",
    "titles": "SELECT doc_id AS chunk_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN nullif(lang, '') END, doc_id || '.txt') AS title FROM documents",
    "slugs": "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'collection') AS slug FROM part",
    "rank_windows": "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 2",
}
QUERIES = {name: globals()[name] for name in SQL}
