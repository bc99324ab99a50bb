"""Line dedup by content-defined line chunks, DataFrame functions only.

A text is cut into lines, each line is hashed, and a rolling hash over the hashes of the last two lines ends a chunk where
it is 0 modulo ``DIVISOR``. Boundaries depend on the lines around them alone, so they shift with the text: what two
documents share is cut alike from the second shared line on. A chunk of two or more lines that occurs again anywhere is
kept at its first occurrence (smallest id, then place) and removed at all others.

Chunks are found by a 64-bit hash, which is what shuffles; bytes are compared for those whose hash is repeated: the least
and the greatest text of a hash are equal when all are. If a hash ever has two texts, its chunks are grouped by the text
itself.

Defined results. Null text is empty text: one empty line. A null id sorts after every id. Lines end at line feeds only; the
rest of a text, line feeds before and after removed chunks included, stays as it is when no chunk is removed, and is the
remaining lines joined by line feeds otherwise. Rows that repeat an id and a text count as one occurrence at each place.
A text of any length is one row with an array of its lines. Empty tables give empty results. :func:`dedup_lines` keeps the input's columns, with the text replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

DIVISOR = 4
#: Multiplier of the rolling hash.
BASE = 31
LEAST_LINES = 2


def cut(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, lines, chunks): chunks have pos, start and n (lines) and h (hash of the text)."""
    return _cut(df.select(df[id_col].alias("id"), C.empty_text(df[text_col]).alias("text"), F.struct(*[df[c] for c in df.columns]).alias("row")))


def _cut(base: DataFrame) -> DataFrame:
    out = base.withColumn("lines", F.split("text", "\n", -1)).drop("text")
    out = out.withColumn("v", F.transform("lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long")))
    ends = F.filter(F.sequence(F.lit(1), F.size("v")), lambda i: (i == F.size("v")) | ((F.get("v", i - 1) + BASE * F.coalesce(F.get("v", i - 2), F.lit(0))) % DIVISOR == 0))
    out = out.withColumn("ends", ends).drop("v")
    bounds = F.transform("ends", lambda e, k: F.struct(k.alias("pos"), F.coalesce(F.get("ends", k - 1), F.lit(0)).alias("start"), (e - F.coalesce(F.get("ends", k - 1), F.lit(0))).alias("n")))
    out = out.withColumn("bounds", bounds).drop("ends")
    return out.withColumn("chunks", F.transform("bounds", lambda b: F.struct(b["pos"].alias("pos"), b["start"].alias("start"), b["n"].alias("n"), F.when(b["n"] >= LEAST_LINES, F.xxhash64(_text(F.col("lines"), b))).alias("h")))).drop("bounds")


def _text(lines: Column, b: Column) -> Column:
    return F.array_join(F.slice(lines, b["start"] + 1, b["n"]), "\n")


def _first(pos: str = "pos") -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col(pos).alias("pos"))


def removals(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, gone): for each id with chunks to remove, their (pos, h)."""
    base = df.select(df[id_col].alias("id"), C.empty_text(df[text_col]).alias("text"))
    found = _cut(base).select("id", F.explode(F.filter("chunks", lambda c: c["h"].isNotNull())).alias("c"))
    found = C.written(found.select("id", "c.pos", "c.h"), "chunks")
    repeated = C.written(found.groupBy("h").agg(F.count(F.lit(1)).alias("n_h")).filter("n_h > 1"), "repeated")
    n = repeated.count()
    texts = _cut(base).select("id", "lines", F.explode(F.filter("chunks", lambda c: c["h"].isNotNull())).alias("c"))
    texts = texts.select("id", F.col("c.pos").alias("pos"), F.col("c.h").alias("h"), _text(F.col("lines"), F.col("c")).alias("chunk"))
    texts = texts.join(C.small_side(repeated.select("h"), n), "h", "left_semi")
    by_hash = texts.groupBy("h").agg(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("n"), (F.min("chunk") == F.max("chunk")).alias("same"))
    by_hash = C.written(by_hash, "compared")
    met = C.join_hot(found, by_hash.filter("same"), "h", "n", max(1, found.count()))
    gone = met.filter(F.col("first").isNotNull() & (_first() != F.col("first"))).select("id", "pos", "h")
    if not by_hash.filter("NOT same").isEmpty():
        unlike = texts.join(F.broadcast(by_hash.filter("NOT same").select("h")), "h", "left_semi")
        firsts = unlike.groupBy("h", "chunk").agg(F.min(_first()).alias("first"))
        more = unlike.join(firsts, ["h", "chunk"]).filter(_first() != F.col("first")).select("id", "pos", "h")
        gone = gone.unionByName(more)
    # one group is one document's chunks
    return C.written(gone.groupBy("id").agg(F.collect_set(F.struct("pos", "h")).alias("gone")), "gone")


def _applied(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """cut(df) with ``stay``: the chunks that remain."""
    gone = removals(df, id_col, text_col)
    # the bound is on chunks, 16 bytes each, since a document may lose any number of them
    n = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    gone = gone.withColumnRenamed("id", "gone_id")
    out = cut(df, id_col, text_col)
    out = out.join(C.small_side(gone, n), out["id"].eqNullSafe(F.col("gone_id")), "left").drop("gone_id")
    # a chunk's place is its index; a row that repeats an id with another text has other hashes there
    own = F.filter("gone", lambda g: F.get(F.col("chunks"), g["pos"])["h"] == g["h"])
    places = F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), F.transform(own, lambda g: g["pos"]))
    return out.withColumn("stay", F.when(F.col("gone").isNull(), F.col("chunks")).otherwise(F.transform(places, lambda p: F.get(F.col("chunks"), p))))


def _kept_text() -> Column:
    return F.array_join(F.transform("stay", lambda c: _text(F.col("lines"), c)), "\n")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without repeated multi-line chunks; texts that lose nothing are as they were, null ones null."""
    out = _applied(df, id_col, text_col)
    text = F.when(F.size("stay") == F.size("chunks"), F.col("row")[text_col]).otherwise(_kept_text())
    return out.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = _applied(docs, "doc_id", "text")
    n_lines = F.size("lines")
    kept = F.aggregate("stay", F.lit(0), lambda s, c: s + c["n"])
    return out.select(F.col("id").alias("doc_id"), n_lines.cast("long").alias("n_lines"), F.size("chunks").cast("long").alias("n_chunks"), (F.size("chunks") - F.size("stay")).cast("long").alias("n_removed_chunks"), (n_lines - kept).cast("long").alias("n_removed_lines"), F.sha2(_kept_text().cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
v AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS v FROM l),
e AS (SELECT *, (v + 31 * coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4 = 0 AS stop FROM v),
k AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e),
c AS (SELECT doc_id, pos, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY doc_id, pos),
f AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY chunk, n >= 2 ORDER BY doc_id, pos) > 1 AS gone FROM c)
SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*) AS n_chunks, count_if(gone)::BIGINT AS n_removed_chunks,
       coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
       sha256(coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
