"""BM25 (k1 = 1.2, b = 0.75) with AND semantics, ad hoc over tokens or over an index of postings.

idf = ln((N - n + 0.5) / (n + 0.5)), or 1e-6 where that is not positive. N, n and the mean length are over all rows of the
index, whatever the filters. A term that a query has twice counts twice. Scores are rounded to nine decimals before they
are ordered, and ties go by id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TOP_K = 10
#: Bits of a chunk id inside a block of postings.
BLOCK_BITS = 7
#: Blocks whose scores set the threshold, for each row that is wanted; blocks that a scan may be asked for by name; ranges of ids that are all opened, since it takes fewer jobs.
FIRST_BLOCKS, NAMED_BLOCKS, SMALL = 4, 4096, 256


@dataclass
class Stats:
    nd: int
    avgdl: float
    n_t: dict[str, int]


def idf(nd: Column, n_t: Column) -> Column:
    raw = F.ln((nd - n_t + 0.5) / (n_t + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def part(idf_: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return idf_ * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def tokenized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("tokens", X.tokens(F.col(text_col))).drop(text_col)


def _tf(term: str) -> Column:
    return F.size(F.filter("tokens", lambda w: w == F.lit(term)))


def counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """docs (..., tokens) with dl and tf_0, tf_1, ... of the distinct terms: the tokens themselves go no further."""
    return docs.withColumns({"dl": F.size("tokens"), **{f"tf_{i}": _tf(t) for i, t in enumerate(dict.fromkeys(terms))}}).drop("tokens")


def stats(counts: DataFrame, terms: list[str]) -> Stats:
    """One row comes to the driver: N, the mean length, and n of each term."""
    names = list(dict.fromkeys(terms))
    row = counts.agg(F.count(F.lit(1)), F.avg("dl"), *[F.count_if(F.col(f"tf_{i}") > 0) for i in range(len(names))]).first()
    return Stats(row[0], row[1] or 0.0, dict(zip(names, row[2:])))


def scored(counts: DataFrame, terms: list[str], of: Stats) -> DataFrame:
    """Rows that have all terms, with their score."""
    times = Counter(terms)
    hits, score = F.lit(True), F.lit(0.0)
    for i, (t, n) in enumerate(times.items()):
        tf = F.col(f"tf_{i}")
        hits = hits & (tf > 0)
        score = score + n * part(idf(F.lit(of.nd), F.lit(of.n_t[t])), tf, F.col("dl"), F.lit(of.avgdl))
    return counts.filter(hits).withColumn("score", F.round(score, 9)).drop(*[f"tf_{i}" for i in range(len(times))])


def top(hits: DataFrame, k: int = TOP_K, id_col: str = "chunk_id") -> DataFrame:
    """The k best with their ranks. The window is over those k rows."""
    best = hits.orderBy(F.desc("score"), id_col).limit(k if k > 0 else TOP_K)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def search(docs: DataFrame, terms: list[str], k: int = TOP_K, where: Column | None = None, id_col: str = "chunk_id") -> DataFrame:
    """docs (id, text, ...) -> the k best rows that ``where`` lets through. ``where`` does not touch the statistics."""
    if not terms:
        return docs.limit(0).drop("text").withColumns({"dl": F.lit(0), "score": F.lit(0.0), "rank": F.lit(0)})
    terms = [t.lower() for t in terms]
    counts = counted(tokenized(docs), terms)
    found = scored(counts, terms, stats(counts, terms))
    return top(found if where is None else found.filter(where), k, id_col)


def postings(tokens: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, tokens) -> (id, term, tf)."""
    return tokens.select(id_col, F.explode("tokens").alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def search_postings(index: DataFrame, lengths: DataFrame, terms: list[str], k: int = TOP_K, allowed: DataFrame | None = None) -> DataFrame:
    """postings (chunk_id, term, tf), lengths (chunk_id, dl) -> (chunk_id, score, rank) of the k best.

    Only the postings of the terms are read (they are pushed down to the scan). ``allowed``: chunk ids to keep.
    """
    times = Counter(terms)
    if not times:
        return lengths.limit(0).select("chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    hits = index.filter(F.col("term").isin(*times))
    nd, avgdl = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    n_t = {r["term"]: r["count"] for r in hits.groupBy("term").count().collect()}
    if len(n_t) < len(times):
        return lengths.limit(0).select("chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    per_term = F.lit(0.0)
    for t, n in times.items():
        own = F.max(F.when(F.col("term") == t, F.col("tf")))
        per_term = per_term + n * part(idf(F.lit(nd), F.lit(n_t[t])), own, F.first("dl"), F.lit(avgdl))
    met = hits.join(lengths.select("chunk_id", "dl"), "chunk_id")
    if allowed is not None:
        met = met.join(allowed, "chunk_id", "left_semi")
    found = met.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.round(per_term, 9).alias("score")).filter(F.col("n") == len(times)).drop("n")
    return top(found, k)


def blocked(rows: DataFrame) -> DataFrame:
    """Postings (term, chunk_id, doc_id, tf, dl) in blocks: a term's postings of 2^BLOCK_BITS neighbouring chunk ids are one row, with what bounds their scores from above: the greatest tf and the least dl. No window over a term, so a frequent term is many groups."""
    block = F.shiftright("chunk_id", BLOCK_BITS).alias("block")
    held = rows.groupBy("term", block).agg(F.sort_array(F.collect_list(F.struct("chunk_id", "doc_id", "tf", "dl"))).alias("p"))
    return held.select("term", "block", F.size("p").alias("n"), F.array_max("p.tf").alias("max_tf"), F.array_min("p.dl").alias("min_dl"), F.col("p.chunk_id").alias("chunk_ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))


def opened(blocks: DataFrame) -> DataFrame:
    """Blocks -> a row for each posting."""
    mine = ("n", "max_tf", "min_dl", "chunk_ids", "doc_ids", "tfs", "dls")
    one = F.explode(F.arrays_zip("chunk_ids", "doc_ids", "tfs", "dls")).alias("p")
    return blocks.select(*[c for c in blocks.columns if c not in mine], one).select("*", F.col("p.chunk_ids").alias("chunk_id"), F.col("p.doc_ids").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl")).drop("p", "block")


@dataclass
class Found:
    """The k best (chunk_id, score, rank), and how many ranges of chunk ids have all terms, and were opened."""

    hits: DataFrame
    blocks: int
    opened: int


def search_blocks(index: DataFrame, of: Stats, terms: list[str], k: int = TOP_K, live: Callable[[DataFrame], DataFrame] | None = None) -> Found:
    """Blocks of postings -> the k best chunks that have all terms, as :func:`search_postings` ranks them, without opening blocks that cannot hold one.

    A block's bounds give the most that any of its postings can add; what they add up to over the terms bounds every chunk
    of a range of ids. The ranges with the greatest bounds are opened first, the k-th best score there is the threshold,
    and of the others only those with a greater bound are opened. ``live`` takes postings and returns those that count as
    hits; ``of`` are the statistics, whatever is live.
    """
    times, k = Counter(terms), k if k > 0 else TOP_K
    spark = index.sparkSession
    nothing = Found(spark.createDataFrame([], "chunk_id bigint, score double, rank int"), 0, 0)
    if not times or any(not of.n_t.get(t) for t in times):
        return nothing
    mine = index.filter(F.col("term").isin(*times))
    weight = {t: n * max(math.log(x) if (x := (of.nd - of.n_t[t] + 0.5) / (of.n_t[t] + 0.5)) > 0 else LEAST_IDF, LEAST_IDF) for t, n in times.items()}
    of_term = F.create_map(*[F.lit(x) for pair in weight.items() for x in pair])[F.col("term")]
    bounds = mine.groupBy("block", "term").agg(F.max(part(of_term, F.col("max_tf"), F.col("min_dl"), F.lit(of.avgdl))).alias("most"))
    bounds = bounds.groupBy("block").agg(F.sum("most").alias("most"), F.count(F.lit(1)).alias("terms")).filter(F.col("terms") == len(times)).select("block", "most").persist()

    def scores(blocks: DataFrame) -> DataFrame:
        rows = opened(blocks)
        rows = live(rows) if live else rows
        per_term = F.lit(0.0)
        for t, n in times.items():
            own = F.max(F.when(F.col("term") == t, F.col("tf")))
            per_term = per_term + n * part(idf(F.lit(of.nd), F.lit(of.n_t[t])), own, F.first("dl"), F.lit(of.avgdl))
        met = rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.round(per_term, 9).alias("score"))
        return top(met.filter(F.col("n") == len(times)).drop("n"), k).select("chunk_id", "score", "rank")

    try:
        total = bounds.count()
        if total <= SMALL:
            return Found(spark.createDataFrame(scores(mine).collect(), nothing.hits.schema), total, total)
        first = [r["block"] for r in bounds.orderBy(F.desc("most"), "block").limit(FIRST_BLOCKS * k).collect()]

        best = scores(mine.filter(F.col("block").isin(first))).collect() if first else []
        known = spark.createDataFrame(best, "chunk_id bigint, score double, rank int")
        # a bound and a score may differ in their last bits
        rest = bounds.filter(~F.col("block").isin(first)) if first else bounds
        rest = rest.filter(F.col("most") >= min(r["score"] for r in best) - 1e-6) if len(best) == k else rest
        n = rest.count()
        if not n:
            return Found(known, total, len(first))
        if n <= NAMED_BLOCKS:
            more = mine.filter(F.col("block").isin([r["block"] for r in rest.select("block").collect()]))
        else:
            more = mine.join(rest.select("block"), "block", "left_semi")
        others = spark.createDataFrame(scores(more).collect(), known.schema)
        return Found(top(known.unionByName(others).drop("rank"), k).select("chunk_id", "score", "rank"), total, len(first) + n)
    finally:
        bounds.unpersist()
