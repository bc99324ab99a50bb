"""A Merkle manifest of a dataset: a radix-ranked trie of every group's rows, and a proof for every row.

1. A row's *leaf* is the SHA-256 of its fields. Texts are read once; what goes on is the id and 32 bytes (64 for a row that
   is tampered with).
2. *Ranks.* Digits of the id, from the first, are counted by group and prefix; a prefix's offset is its parent's and what
   its smaller siblings hold. So a group's exact ranks need no global sort: rows are ordered only inside a last digit
   (4096 ids). A prefix that still holds over ``CROWD`` rows, which takes repeated ids, goes on by digits of the leaf and
   then of the row's number, so no id's rows meet in one task.
3. *Trie.* Base-8 digits of the rank name the nodes. Blocks of 8^4 neighbours, the nodes of one longest prefix, reduce
   together, four levels in one step; then blocks of their nodes, until each group has one node, its subroot. Subroots are
   ranked in ranges and reduced in the same way to the root.
4. *Proofs* go down the same blocks: a block gets the siblings above it once, and a row those of its own four levels.

Defined results. A null field is ``-`` in a leaf. A null group is a group of its own, the first one. Null ids come before
all others of their group, rows that repeat an id in the order of their leaves, and equal rows one after another, each
with its own proof. A row with a null id is never tampered with by :func:`op11_merkle`. A long text is hashed whole, and
nothing of it goes on. An empty table has no root and gives no rows. Results hold the id and what is computed; other
columns are not carried, so none can clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

FANOUT = 8
#: Levels that a block reduces, and bits of a rank inside it.
LEVELS, BITS = 4, 12
#: Hex digits of the key: of the first prefix to hold rows, and of each step to a longer one.
DIGITS, STEP = 13, 3
#: Rows of a prefix that are ordered together.
CROWD = 1 << 16
#: Digits of a whole key: the id's, the leaf's, the row number's.
KEY = 16 + 64 + 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(fields: list[Column]) -> Column:
    """Hex SHA-256 of fields, each with its length in bytes before it."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _id_digits(id_: Column) -> Column:
    """16 hex digits in the order of the ids; those of a null id come first."""
    flipped = id_.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.coalesce(F.lpad(F.hex(flipped), 16, "0"), F.lit("-" * 16))


def _group_key(group: Column) -> Column:
    """A text in the groups' order, empty for a null group."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _depth(n: Column) -> Column:
    """Levels over n leaves: the least d with 8^d >= n."""
    return F.when(n <= 1, 0).otherwise(F.ceil(F.length(F.bin(n - 1)) / 3)).cast("int")


def offsets(counts: DataFrame, digits: int) -> DataFrame:
    """counts (g, b, n) of prefixes b of up to ``digits`` -> (g, b, offset): rows of the group before the prefix. Windows are over the children of one prefix."""
    levels, at = [counts.select("g", F.col("b").alias("p"), "n")], digits
    while at > 1:
        at -= STEP
        levels.append(levels[-1].groupBy("g", F.substring("p", 1, at).alias("p")).agg(F.sum("n").alias("n")))
    before = lambda *by: F.sum("n").over(Window.partitionBy(*by).orderBy("p")) - F.col("n")
    done = levels[-1].select("g", "p", before("g").alias("offset"))
    for level in levels[-2::-1]:
        above = done.select("g", F.col("p").alias("parent"), "offset")
        here = level.withColumn("parent", F.substring("p", 1, at)).withColumn("before", before("g", "parent"))
        done = here.join(above, ["g", "parent"]).select("g", "p", (F.col("offset") + F.col("before")).alias("offset"))
        at += STEP
    return done.select("g", F.col("p").alias("b"), "offset")


def ranked(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """rows (g, id, leaf, row, ...) with their rank in the group g, from 0, by id, leaf and row."""
    key = F.concat(_id_digits(F.col("id")), F.hex("leaf"), F.lpad(F.hex("row"), 16, "0"))
    rows, digits = rows.withColumn("b", F.substring(_id_digits(F.col("id")), 1, DIGITS)), DIGITS
    while True:
        counts = C.written(rows.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n")), "digits")
        full = counts.filter((F.col("n") > crowd) & (F.length("b") == digits)).select("g", "b", F.lit(True).alias("longer"))
        n = full.count() if digits < KEY else 0
        if not n:
            break
        digits = min(KEY, digits + STEP)
        rows = rows.join(C.small_side(full, n), ["g", "b"], "left").withColumn("b", F.when(F.col("longer"), F.substring(key, 1, digits)).otherwise(F.col("b"))).drop("longer")
    # in steps of STEP, the longest prefix reaches down to one digit
    at = C.written(offsets(counts, digits + (1 - digits) % STEP), "offsets")
    inside = F.row_number().over(Window.partitionBy("g", "b").orderBy(F.asc_nulls_first("id"), "leaf", "row")) - 1
    return rows.join(at, ["g", "b"]).withColumn("rank", F.col("offset") + inside).drop("b", "offset")


def in_ranges(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``rank``, from 0, by a key that no two rows share: ranges are counted, and each is ranked by itself."""
    placed = C.written(df.repartitionByRange(key).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    # one row for each range
    shift = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    return placed.join(F.broadcast(shift), "range").withColumn("rank", F.col("shift") + inside).drop("range", "shift")


def _up(level: list[str]) -> list[str]:
    return [hashlib.sha256("".join(level[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(level), FANOUT)]


def _levels(digests: list[bytes], depth: int) -> list[list[str]]:
    """A block's nodes, level by level; ``depth``: levels that are left above it and in it."""
    out = [[d.hex() for d in digests]]
    for _ in range(min(LEVELS, depth)):
        out.append(_up(out[-1]))
    return out


_NODE = "g string, depth int, rank bigint, h binary"


def _reduced(nodes: DataFrame, step: int) -> DataFrame:
    """nodes (g, depth, rank, h) at level LEVELS * step -> the nodes LEVELS higher, or subroots."""

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        depth = t["depth"][0].as_py()
        top = _levels(t["h"].to_pylist(), depth - LEVELS * step)[-1]
        if len(top) != 1:
            raise RuntimeError("a block of more than one node")
        return pa.table({"g": t["g"][:1], "depth": t["depth"][:1], "rank": pa.array([t["rank"][0].as_py() >> BITS], pa.int64()), "h": pa.array([bytes.fromhex(top[0])], pa.binary())})

    return nodes.select("g", "depth", "rank", "h").groupBy("g", F.shiftright("rank", BITS).alias("block")).applyInArrow(block, _NODE)


def fold(nodes: DataFrame, deepest: int) -> tuple[list[DataFrame], DataFrame]:
    """nodes (g, depth, rank, h): the leaves of each tree -> the nodes of every LEVELS-th level, and (g, depth, h) of the top of each tree."""
    steps, tops = [nodes], [nodes.filter("depth = 0")]
    for step in range(-(-deepest // LEVELS)):
        made = C.written(_reduced(steps[-1].filter(F.col("depth") > LEVELS * step), step), "nodes")
        tops.append(made.filter(F.col("depth") <= LEVELS * (step + 1)))
        steps.append(made)
    return steps, C.union_all([t.select("g", "depth", "h") for t in tops])


_PATH = "array<struct<l:string,r:string>>"


def _sides(level: list[str], i: int) -> tuple[str, str]:
    """What stands left and right of node i in its run."""
    a = i // FANOUT * FANOUT
    return "".join(level[a:i]), "".join(level[i + 1 : a + FANOUT])


def _climb(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Left and right siblings of node i of the lowest level, up to the block's top."""
    return [_sides(level, i // FANOUT**k) for k, level in enumerate(levels[:-1])]


def _met(nodes: DataFrame, above: DataFrame):
    """Blocks of nodes and the row of ``above`` (g, block, path, top) for each: cogroups of at most 8^LEVELS rows and one."""
    return nodes.groupBy("g", F.shiftright("rank", BITS).alias("block")).cogroup(above.groupBy("g", "block"))


def descend(steps: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tops (g, depth, path, top) of each tree -> (g, block, path, top) of every block of leaves: the siblings above it, from below."""
    arrow = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))

    def paths(step: int):
        def block(t: pa.Table, up: pa.Table) -> pa.Table:
            t = t.sort_by("rank")
            levels = _levels(t["h"].to_pylist(), t["depth"][0].as_py() - LEVELS * step)
            rest = [(x["l"], x["r"]) for x in up["path"][0].as_py()]
            own = [[{"l": a, "r": b} for a, b in _climb(levels, i) + rest] for i in range(len(t))]
            return pa.table({"g": t["g"], "block": t["rank"], "path": pa.array(own, arrow), "top": pa.array([up["top"][0].as_py()] * len(t), pa.string())})

        return block

    first = lambda step: tops.filter((F.col("depth") > LEVELS * step if step else F.lit(True)) & (F.col("depth") <= LEVELS * (step + 1))).select("g", F.lit(0).cast("long").alias("block"), "path", "top")
    last = max(0, len(steps) - 2)
    above = first(last)
    for step in range(last, 0, -1):
        nodes = steps[step].filter(F.col("depth") > LEVELS * step)
        made = _met(nodes, above).applyInArrow(paths(step), f"g string, block bigint, path {_PATH}, top string")
        above = C.written(made.unionByName(first(step - 1)), "paths")
    return above


@dataclass
class Manifest:
    """leaves (g, id, leaf, other, depth, rank): a row each; blocks (g, block, path, top): siblings above each block of leaves, and its group's subroot."""

    leaves: DataFrame
    blocks: DataFrame
    subroots: DataFrame
    root: str | None


def manifest(df: DataFrame, id_col: str, fields: list[str], group_col: str, tampered: dict[str, Column] | None = None, where: Column | None = None) -> Manifest:
    """``tampered``: what stands in for fields in the leaves that are checked later, in rows ``where`` it holds."""
    whole = leaf([df[f] for f in fields])
    other = F.when(where, leaf([(tampered or {}).get(f, df[f]) for f in fields])) if where is not None else F.lit(None).cast("string")
    rows = df.select(_group_key(df[group_col]).alias("g"), df[id_col].alias("id"), F.unhex(whole).alias("leaf"), F.unhex(other).alias("other"))
    rows = C.written(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    totals = C.written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("depth", _depth(F.col("n"))), "groups")
    n_groups, deepest = totals.agg(F.count(F.lit(1)), F.coalesce(F.max("depth"), F.lit(0))).first()
    placed = ranked(rows).join(C.small_side(totals.select("g", "depth"), n_groups), "g")
    leaves = C.written(placed.select("g", "depth", "rank", "id", "leaf", "other"), "ranked")
    steps, tops = fold(leaves.withColumnRenamed("leaf", "h"), deepest)
    tops = C.written(in_ranges(tops, "g"), "subroots")
    over = tops.select(F.lit("").alias("g"), F.lit(n_groups).cast("long").alias("n"), "rank", "h").withColumn("depth", _depth(F.col("n"))).drop("n")
    super_steps, root = fold(over, 0 if n_groups <= 1 else -(-(n_groups - 1).bit_length() // 3))
    found = root.select(F.lower(F.hex("h"))).first()
    none = F.array().cast(_PATH)
    above = descend(super_steps, root.select("g", "depth", none.alias("path"), F.lit("").alias("top")))
    # the path of each subroot: its block's own levels and those above
    sub = _each(_met(over.select("g", "depth", "rank", F.lit(None).cast("long").alias("id"), F.col("h").alias("leaf"), F.lit(None).cast("binary").alias("other")), above))
    paths = tops.join(sub, "rank").select("g", "depth", "path", F.lower(F.hex("h")).alias("top"))
    return Manifest(leaves, descend(steps, C.written(paths, "paths")), tops.select("g", "h"), found[0] if found else None)


def _each(met) -> DataFrame:
    """(rank, path) of every node of blocks."""
    arrow = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))

    def block(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        levels = _levels(t["leaf"].to_pylist(), t["depth"][0].as_py())
        rest = [(x["l"], x["r"]) for x in up["path"][0].as_py()]
        return pa.table({"rank": t["rank"], "path": pa.array([[{"l": a, "r": b} for a, b in _climb(levels, i) + rest] for i in range(len(t))], arrow)})

    return met.applyInArrow(block, f"rank bigint, path {_PATH}")


def proofs(m: Manifest) -> DataFrame:
    """(id, leaf, subroot, proof_sha256, folded_root) of every row: its path is folded again, from the leaf that stands in for its own where there is one."""

    def block(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        own, other = t["leaf"].to_pylist(), t["other"].to_pylist()
        levels = _levels(own, t["depth"][0].as_py())
        rest = [(x["l"], x["r"]) for x in up["path"][0].as_py()]
        sha, out, run, tail, text = hashlib.sha256, [], -1, [], ""
        for i, (leaf_, changed) in enumerate(zip(own, other)):
            low = [_sides(levels[0], i)] if len(levels) > 1 else []
            if i // FANOUT != run:  # what is above a run of leaves is theirs together
                run = i // FANOUT
                tail = _climb(levels[1:], run) + rest if len(levels) > 1 else rest
                text = "".join(a + b for a, b in tail)
            digest = (changed or leaf_).hex()
            for a, b in low + tail:
                digest = sha(f"{a}{digest}{b}".encode()).hexdigest()
            out.append((sha(("".join(a + b for a, b in low) + text).encode()).hexdigest(), digest))
        cols = {"id": t["id"], "leaf": pa.array([x.hex() for x in own], pa.string()), "subroot": pa.array([up["top"][0].as_py()] * len(t), pa.string())}
        return pa.table(cols | {n: pa.array([x[k] for x in out], pa.string()) for k, n in enumerate(("proof_sha256", "folded_root"))})

    return _met(m.leaves.select("g", "depth", "rank", "id", "leaf", "other"), m.blocks).applyInArrow(block, "id bigint, leaf string, subroot string, proof_sha256 string, folded_root string")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    where = docs["doc_id"].isNotNull() & (C.crc_mod(docs["doc_id"], 3) == 0)
    m = manifest(docs, "doc_id", list(FIELDS), "lang", {"text": lower_ascii(docs["text"])}, where)
    out = proofs(m).withColumnRenamed("id", "doc_id").withColumn("root", F.lit(m.root).cast("string"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _leaf_sql(text: str) -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: crc32 of a text in SQL: its table from the polynomial, then a fold over the bytes.
_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(s)), lambda i: ascii(s[i + 1])::UBIGINT)),
  lambda c, b: xor(t[(xor(c, b) & 255)::INT + 1], c >> 8))"""
SQL = f"""
WITH RECURSIVE bits AS (SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
s AS (SELECT *, doc_id::VARCHAR AS s FROM documents),
r AS (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
             CASE WHEN doc_id IS NOT NULL AND xor({_CRC}, 4294967295::UBIGINT) % 3 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other FROM s, crc),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM r),
n AS (SELECT lang, 0 AS level, rank AS idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS width FROM d
  UNION ALL SELECT lang, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (width + 7) // 8 FROM n WHERE width > 1 GROUP BY lang, level, idx // 8, width),
sub AS (SELECT lang, level AS depth, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM n WHERE width = 1),
u AS (SELECT 0 AS level, rank AS idx, h, count(*) OVER () AS width FROM sub
  UNION ALL SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (width + 7) // 8 FROM u WHERE width > 1 GROUP BY level, idx // 8, width),
root AS (SELECT h AS root FROM u WHERE width = 1),
low AS (SELECT d.lang, d.rank, n.level AS step, coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx < d.rank // (8 ** n.level)::BIGINT), '') AS l,
               coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx > d.rank // (8 ** n.level)::BIGINT), '') AS r
        FROM d JOIN n ON d.lang IS NOT DISTINCT FROM n.lang AND n.width > 1 AND n.idx // 8 = d.rank // (8 ** (n.level + 1))::BIGINT GROUP BY d.lang, d.rank, n.level),
high AS (SELECT s.lang, s.depth + u.level AS step, coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx < s.rank // (8 ** u.level)::BIGINT), '') AS l,
                coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx > s.rank // (8 ** u.level)::BIGINT), '') AS r
         FROM sub s JOIN u ON u.width > 1 AND u.idx // 8 = s.rank // (8 ** (u.level + 1))::BIGINT GROUP BY s.lang, s.depth, u.level),
p AS (SELECT lang, rank, step, l, r FROM low UNION ALL SELECT d.lang, d.rank, h.step, h.l, h.r FROM d JOIN high h ON d.lang IS NOT DISTINCT FROM h.lang),
q AS (SELECT lang, rank, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM p GROUP BY lang, rank),
f AS (SELECT lang, rank, 0 AS step, coalesce(other, leaf) AS h FROM d
  UNION ALL SELECT f.lang, f.rank, f.step + 1, sha256(p.l || f.h || p.r) FROM f JOIN p ON f.lang IS NOT DISTINCT FROM p.lang AND f.rank = p.rank AND f.step = p.step),
e AS (SELECT lang, rank, arg_max(h, step) AS h FROM f GROUP BY lang, rank)
SELECT d.doc_id, d.leaf, sub.h AS subroot, root.root, coalesce(q.proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = root.root AS verified
FROM d JOIN sub ON d.lang IS NOT DISTINCT FROM sub.lang JOIN e ON d.lang IS NOT DISTINCT FROM e.lang AND d.rank = e.rank
LEFT JOIN q ON d.lang IS NOT DISTINCT FROM q.lang AND d.rank = q.rank, root
"""
