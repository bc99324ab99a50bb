"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree, DataFrame functions only.

1. A source's target is its weight's share of all words, at most ``max_repeats`` times its own size; what is cut there is
   shared again by weight until no source is above (water filling, solved in closed form on one row per source).
2. A source's documents are permuted by MD5 of seed and id, and cut into *blocks* by leading hex digits of it, about
   ``block_rows`` documents each. The whole part of target/size takes every block that often; the rest takes the blocks
   in order and, in the block where the quota runs out, the documents in order, to the nearest document.
3. The block quotas go down a binary tree to ``shards`` output shards. At each node the left child gets exactly half of
   the node's blocks, drawn without replacement from all its sources' blocks together: the first half of a random
   permutation, whose counts by source are a multivariate-hypergeometric draw. The permutation is ranked by hash buckets
   and then within the one bucket that holds the middle, so no task ranks a whole node.
   What a shard holds is what the tree dealt it: a document is taken as often as shards got its block (but the last copy of
   a cut block, which ends at the quota).
4. Inside a shard, documents are ordered by a hash of seed, copy and id.

Windows run over sources (one row each), over the blocks of a source, and over the documents of one cut block for each source.

Defined results. Null text is empty text, of size 0; a source of size 0 has target 0 and nothing is taken from it. A null
source is a source of its own, the last in order. Null ids permute as the text ``null``; rows that repeat an id permute
next to each other, smaller sizes first, and each counts. A text of any length counts all its words, and is never cut. Empty tables give empty results. Other columns pass through;
:func:`mix` adds ``mix_shard``, ``mix_copy`` and ``mix_order`` in place of columns so named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
MAX_REPEATS = 3
BLOCK_ROWS = 4096
SHARDS = 8
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    return F.regexp_count(C.empty_text(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, n_rows) with target. One row per source goes through single-partition windows, and nothing else."""
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", max_repeats * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").isNull(), "source")
    all_rows = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(all_rows) - before) / weight_left)
    # the water level: the first source, by ascending cap per weight, that does not reach its cap
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(all_rows)["level"]
    return rows.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), level * F.col("w")), F.col("cap").cast("double"))).select("source", "source_size", "n_rows", "target")


def split_tree(blocks: DataFrame, shards: int, seed: str) -> DataFrame:
    """``blocks`` (one row per drawn block, identified by ``key``) with ``shard``: exact halves at every node of the tree."""
    out = blocks.withColumn("node", F.lit(0).cast("long"))
    for depth in range((shards - 1).bit_length()):
        draw = F.md5(F.concat_ws("|", F.lit(f"{seed}/{depth}"), "node", "key").cast("binary"))
        out = C.written(out.withColumn("draw", draw).withColumn("bucket", F.substring("draw", 1, 3)), "draws")
        counts = out.groupBy("node", "bucket").agg(F.count(F.lit(1)).alias("here"))
        node = Window.partitionBy("node")
        to = F.sum("here").over(node.orderBy("bucket"))
        half = F.floor((F.sum("here").over(node) + 1) / 2)
        cut = counts.select("node", "bucket", (to - F.col("here")).alias("before"), to.alias("to"), half.alias("half"))
        out = out.join(cut, ["node", "bucket"])
        whole = out.filter("to <= half OR before >= half").withColumn("left", F.col("to") <= F.col("half"))
        rank = F.row_number().over(Window.partitionBy("node", "bucket").orderBy("draw", "key"))
        split = out.filter("to > half AND before < half").withColumn("left", F.col("before") + rank <= F.col("half"))
        out = whole.unionByName(split).withColumn("node", 2 * F.col("node") + F.when(F.col("left"), 0).otherwise(1)).select(*blocks.columns, "node")
    return out.withColumnRenamed("node", "shard")


def plan(docs: DataFrame, shards: int, seed: str, block_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """docs (id, source, size, ...) -> docs with ``block`` and ``perm``; (source, block, shards of its whole copies, cut quota, shard of the cut, target...); rows of the latter."""
    docs = docs.withColumn("perm", F.md5(F.concat_ws("|", F.lit(seed), C.id_text(F.col("id"))).cast("binary")))
    sizes = C.written(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")), "sources")
    largest = sizes.agg(F.max("n_rows")).first()[0] or 0
    digits = 1
    while 16**digits * block_rows < largest and digits < 12:
        digits += 1
    docs = docs.withColumn("block", F.substring("perm", 1, digits))
    goal = C.written(targets(sizes), "targets")
    blocks = C.written(docs.groupBy("source", "block").agg(F.sum("size").alias("block_size")), "blocks")
    to = F.sum("block_size").over(Window.partitionBy("source").orderBy("block"))
    blocks = blocks.withColumn("before", to - F.col("block_size"))
    blocks = blocks.join(goal, blocks["source"].eqNullSafe(goal["source"]), "left").drop(goal["source"])
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    blocks = blocks.withColumn("full", full).withColumn("quota", F.col("target") - F.col("full") * F.col("source_size"))
    # the part of the last, partial copy that lies in this block: all, none, or up to `cut` words
    room = F.col("quota") - F.col("before")
    part = F.when(F.col("block_size") == 0, F.lit("none")).when(room >= F.col("block_size"), F.lit("all")).when(room > 0, F.lit("cut")).otherwise(F.lit("none"))
    blocks = blocks.withColumn("part", part).withColumn("cut", F.when(F.col("part") == "cut", room))
    copies = F.col("full") + F.when(F.col("part") == "none", 0).otherwise(1)
    drawn = blocks.filter(copies > 0).select("source", "block", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    drawn = drawn.withColumn("key", F.concat_ws("|", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "block", "copy"))
    dealt = split_tree(drawn, shards, seed).groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("draws"))
    out = blocks.join(dealt, blocks["source"].eqNullSafe(dealt["source"]) & (blocks["block"] == dealt["block"]), "left")
    out = C.written(out.select(blocks["source"], blocks["block"], "source_size", "target", "cut", F.coalesce("draws", F.array().cast("array<struct<copy:int,shard:bigint>>")).alias("draws")), "plan")
    return docs, out, out.count()


def drawn_docs(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs (id, source, size, ...) with source_size, target and ``draws``: an array of (copy, shard), one for each copy that the mix takes."""
    docs, blocks, n = plan(docs, shards, seed, block_rows)
    blocks = blocks.withColumnRenamed("source", "b_source").withColumnRenamed("block", "b_block")
    on = docs["source"].eqNullSafe(F.col("b_source")) & (docs["block"] == F.col("b_block"))
    met = docs.join(C.small_side(blocks, n), on).drop("b_source", "b_block")
    whole = met.filter("cut IS NULL")
    order = Window.partitionBy("source", "block").orderBy("perm", "id", "size")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    cut = met.filter("cut IS NOT NULL").withColumn("before", before)
    cut = cut.withColumn("draws", F.when(F.col("before") + F.col("size") / 2 <= F.col("cut"), F.col("draws")).otherwise(F.slice("draws", 1, F.size("draws") - 1))).drop("before")
    return whole.unionByName(cut).drop("cut", "block")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: a row of ``df`` for each copy taken, with mix_shard, mix_copy and mix_order (the place within the shard, by hash)."""
    df = df.drop(*[c for c in ("mix_shard", "mix_copy", "mix_order") if c not in (id_col, text_col, source_col)])
    docs = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[id_col].alias("id"), df[source_col].alias("source"), n_words(df[text_col]).alias("size"))
    out = drawn_docs(docs, shards, seed).select("row", "perm", F.explode("draws").alias("d"))
    return out.select("row.*", F.col("d.shard").alias("mix_shard"), F.col("d.copy").alias("mix_copy"), place(seed, F.col("d.copy")).alias("mix_order"))


def place(seed: str, copy: Column) -> Column:
    """Place of a copy of a document (by its ``perm``) within its shard: 16 hex digits, in their order."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(seed), copy, F.col("perm")).cast("binary")), 1, 16)


def write_shards(mixed: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One folder per shard, rows in their shuffled order; a shard's rows are range-partitioned, so a large shard has many files."""
    mixed.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order").write.partitionBy("mix_shard").parquet(path)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``draws``: copy:shard:place of each copy that a shard holds, comma-joined."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "source", n_words(F.col("text")).alias("size"))
    out = drawn_docs(C.written(docs, "sizes"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + F.col("size"))
    held = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["copy"], d["shard"], place(SEED, d["copy"]))), ",")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), held.alias("draws"))


def _level(name: str, of: str, depth: int) -> str:
    """SQL of one level of the tree: the first half of each node's blocks, in a random order, goes left."""
    return f"""{name} AS (
  SELECT source, block, copy, key, 2 * node + (row_number() OVER (PARTITION BY node ORDER BY md5('{SEED}/{depth}|' || node || '|' || key), key) > (count(*) OVER (PARTITION BY node) + 1) // 2)::INT AS node
  FROM {of})"""


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')) AS perm
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM d GROUP BY source),
w AS (SELECT source, source_size, 1 + (k - 1) % 3 AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
l AS (SELECT arg_min(level, cap / weight) AS level FROM r WHERE level <= cap / weight),
t AS (SELECT r.source, r.source_size, coalesce(least(r.cap::DOUBLE, l.level * r.weight), r.cap::DOUBLE) AS target FROM r, l),
g AS (SELECT CASE WHEN max(n) <= 16 * {BLOCK_ROWS} THEN 1 WHEN max(n) <= 256 * {BLOCK_ROWS} THEN 2 WHEN max(n) <= 4096 * {BLOCK_ROWS} THEN 3 ELSE 4 END AS digits FROM s),
p AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
             substr(perm, 1, digits) AS block,
             sum(size) OVER (PARTITION BY d.source ORDER BY perm, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, g),
q AS (SELECT source, block, any_value(whole) AS whole, sum(size) AS block_size,
             any_value(target) - any_value(whole) * any_value(source_size) - min(before) AS room FROM p GROUP BY source, block),
c AS (SELECT *, whole + (block_size > 0 AND room > 0)::INT AS copies, block_size > 0 AND room > 0 AND room < block_size AS cut FROM q),
n0 AS (SELECT source, block, copy, concat_ws('|', coalesce('s' || source, 'n'), block, copy) AS key, 0 AS node FROM (SELECT source, block, unnest(range(1, copies + 1)) AS copy FROM c)),
{_level("n1", "n0", 0)},
{_level("n2", "n1", 1)},
{_level("n3", "n2", 2)},
h AS (SELECT p.doc_id, p.perm, p.size, p.source, p.before, n3.copy, n3.node AS shard
      FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source AND p.block = c.block JOIN n3 ON n3.source IS NOT DISTINCT FROM c.source AND n3.block = c.block
      WHERE NOT c.cut OR n3.copy < c.copies OR p.before + p.size / 2 <= p.target - p.whole * p.source_size),
a AS (SELECT doc_id, perm, size, source, before, sum(size)::BIGINT AS taken, string_agg(copy || ':' || shard || ':' || substr(md5('{SEED}|' || copy || '|' || perm), 1, 16), ',' ORDER BY copy) AS draws
      FROM h GROUP BY doc_id, perm, size, source, before)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(a.taken, 0) AS taken, coalesce(a.draws, '') AS draws
FROM p LEFT JOIN a ON p.doc_id IS NOT DISTINCT FROM a.doc_id AND p.source IS NOT DISTINCT FROM a.source AND p.before = a.before AND p.size = a.size
"""
