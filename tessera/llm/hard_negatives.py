"""Hard negatives by bit-sliced integer products.

Components are integers, floor(256 x), and a row's score for an anchor is their exact inner product. Rows are cut into
*parts* and anchors into *groups*; each part meets each group in one task (a stated query set against all rows, in blocks).
There a part's components are sliced into bit-planes. Planes are added from the sign on; after each, what the lower ones
can still add lies between the anchor's negative and its positive components times their largest value, so every pair has
an interval of scores, half as wide as before. A pair is dropped once its interval lies outside all windows it is wanted
for, or below the scores that already fill them. While many pairs are left a plane is one matrix product; then
the remaining pairs alone are finished.

Two such searches: an anchor's best rows of the same label (one window without limits), then, for each of these
positives, the best rows of other labels between 80 % and 100 % of its score (a window each). Parts return what they have
for each window, at most as many rows as are wanted, and the best of all parts are ranked by score, then id.

Defined results. Rows with a null id, label or vector, or with a null or non-finite component, take no part; nor do rows
with a component of over 2^26 in size after scaling, whose products would not fit the result's 64 bits. Of rows that repeat
an id the one with the smallest label, then the smallest vector, counts. A shorter vector reads as if zeros followed, an
empty one scores 0 with all. Ties go by id. A negative positive score leaves no window, so no row. Empty tables give empty
results. Only the three columns named are read, so others cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

SCALE = 256
LARGEST = 1 << 26
#: Rows of a part, anchors of a group, at most on average: what a task holds.
PART, GROUP = 1 << 18, 1 << 12
#: Rows and anchors of one matrix product.
ROWS, ANCHORS = 4096, 512
#: Pairs go on one by one when fewer than one in so many are left.
FEW = 16
#: Pairs that are finished together.
PAIRS = 1 << 15
WANTED, LOW, HIGH = 5, 80, 100
_BELOW = np.iinfo(np.int64).min


def components(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("bigint"))


def usable(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v): one row for each id, of those that take part."""
    fine = F.forall(df[vector_col], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= LARGEST / SCALE))
    rows = df.filter(df[id_col].isNotNull() & df[label_col].isNotNull() & df[vector_col].isNotNull() & fine)
    rows = rows.select(rows[id_col].cast("long").alias("id"), F.struct(rows[label_col].cast("long").alias("label"), components(rows[vector_col]).cast("array<int>").alias("v")).alias("row"))
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v")


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows, zeros after the shorter ones."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return out


def _kind(dims: int, most: int) -> type:
    """The numbers in which all sums are exact: single floats, double floats, or integers."""
    reach = 4 * max(1, dims) * (most + 1) ** 2
    return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64


def planes(x: np.ndarray, bits: int, kind: type) -> list[tuple[int, np.ndarray, int]]:
    """(weight, 0/1 matrix, largest sum of the weights below) from the sign's plane on."""
    out = [(-(1 << bits), (x < 0).astype(kind), (1 << bits) - 1)]
    for b in range(bits - 1, -1, -1):
        out.append((1 << b, ((x >> b) & 1).astype(kind), (1 << b) - 1))
    return out


def sliced(x: np.ndarray, a: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: int, bits: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Rows x against anchors a, pairs ``alive``, windows low and high (anchors, windows) -> (row, anchor, score) of the pairs that no interval excluded, and how many pairs were left after each plane.

    ``low`` is what a score must reach; the ``wanted`` best lower bounds inside a window raise it for this call.
    """
    s = np.zeros(alive.shape, kind)
    plus, minus = np.where(a > 0, a, 0).sum(1), np.where(a < 0, a, 0).sum(1)
    at, low, left = None, low.copy(), []
    af = a.astype(kind)
    clipped = lambda w: w if kind is np.int64 else np.clip(w, -(1 << 52), 1 << 52).astype(np.float64)
    top = clipped(high)
    for weight, plane, rest in planes(x, bits, kind):
        least, most = (rest * minus).astype(kind), (rest * plus).astype(kind)
        floor = clipped(low)
        if at is None:
            s += kind(weight) * (plane @ af.T)
            lo, hi = s + least, s + most
            fits = np.zeros(alive.shape, bool)
            for w in range(low.shape[1]):
                fits |= (hi >= floor[:, w]) & (lo <= top[:, w])
            alive &= fits
            n = int(alive.sum())
            if 0 < rest < 16 and len(x) > wanted and n:
                for w in range(low.shape[1]):
                    sure = np.where(alive & (lo >= floor[:, w]) & (hi <= top[:, w]), lo, -np.inf if kind is not np.int64 else _BELOW)
                    best = np.partition(sure, -wanted, axis=0)[-wanted]
                    if kind is not np.int64:
                        best = np.where(np.isfinite(best), best, -(2.0**62))
                    low[:, w] = np.maximum(low[:, w], best.astype(np.int64))
            if n * FEW < alive.size:
                at = np.nonzero(alive)
                s = s[at]
        else:
            r, c = at
            for i in range(0, len(r), PAIRS):
                j = slice(i, i + PAIRS)
                s[j] += kind(weight) * np.einsum("ij,ij->i", plane[r[j]], af[c[j]])
            lo, hi = s + least[c], s + most[c]
            fits = ((hi[:, None] >= floor[c]) & (lo[:, None] <= top[c])).any(1)
            at, s, n = (r[fits], c[fits]), s[fits], int(fits.sum())
        left.append(n)
    if at is None:
        at = np.nonzero(alive)
        s = s[at]
    return at[0], at[1], np.rint(s).astype(np.int64) if kind is not np.int64 else s, left


class Best:
    """The best rows so far for each window of each anchor: a few for each, by score, then id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, wanted: int):
        self.low, self.high, self.reach, self.wanted = low, high, low.copy(), wanted
        self.kept = np.zeros((4, 0), np.int64)  # anchor, window, score, id

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        parts = [self.kept]
        for w in range(self.low.shape[1]):
            fits = (score >= self.reach[anchor, w]) & (score <= self.high[anchor, w])
            parts.append(np.stack([anchor[fits], np.full(int(fits.sum()), w), score[fits], ids[fits]]))
        rows = np.concatenate(parts, axis=1)
        rows = rows[:, np.lexsort((rows[3], -rows[2], rows[1], rows[0]))]
        key = rows[0] * self.low.shape[1] + rows[1]
        first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        self.kept = rows[:, rank < self.wanted]
        last = rows[:, rank == self.wanted - 1]
        self.reach[last[0], last[1]] = np.maximum(self.reach[last[0], last[1]], last[2])


def search(rows: tuple[np.ndarray, np.ndarray, np.ndarray], anchors: tuple[np.ndarray, np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray, same: bool, wanted: int, bits: int, kind: type) -> np.ndarray:
    """rows and anchors (ids, labels, components) -> (anchor, window, score, id) of the best rows of the same label, or of others, in each window."""
    best = Best(low, high, wanted)
    for i in range(0, len(rows[0]), ROWS):
        ids, labels, x = (c[i : i + ROWS] for c in rows)
        for k in range(0, len(anchors[0]), ANCHORS):
            a_ids, a_labels, a = (c[k : k + ANCHORS] for c in anchors)
            equal = labels[:, None] == a_labels[None, :]
            alive = (equal & (ids[:, None] != a_ids[None, :])) if same else ~equal
            r, c, s, _ = sliced(x, a, alive, best.reach[k : k + ANCHORS], best.high[k : k + ANCHORS], wanted, bits, kind)
            best.add(c + k, s, ids[r])
    return best.kept


def _meet(rows: DataFrame, anchors: DataFrame, parts: int, groups: int):
    """Each part of the rows with each group of the anchors."""
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    group = F.pmod(F.xxhash64("id", F.lit("group")), F.lit(groups)).cast("int")
    left = rows.withColumn("part", part).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = anchors.withColumn("grp", group).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.groupBy("part", "grp").cogroup(right.groupBy("part", "grp"))


def mine(df: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", wanted: int = WANTED, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``anchors`` says of the column ``id`` which rows are anchors; low and high are per cent of a positive's score."""
    spark = df.sparkSession
    rows = C.written(usable(df, id_col, label_col, vector_col), "vectors")
    chosen = rows.filter(anchors)
    size = F.transform("v", lambda x: F.abs(x.cast("long")))
    n, dims, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(size)), F.lit(0))).first()
    n_anchors = chosen.count()
    dims, bits, kind = max(1, dims), max(1, int(most).bit_length()), _kind(dims, most)
    parts = max(-(-n // PART), min(max(1, n // 256), 2 * spark.sparkContext.defaultParallelism))
    groups = max(1, -(-n_anchors // GROUP))
    columns = lambda t: (t["id"].to_numpy(), t["label"].to_numpy(), _matrix(t["v"], dims))
    empty = lambda names: pa.table({c: pa.array([], pa.int64()) for c in names})

    def nearest(t: pa.Table, a: pa.Table) -> pa.Table:
        names = ("anchor_id", "score", "id")
        if not len(t) or not len(a):
            return empty(names)
        ids, labels, x = columns(a)
        low_, high_ = np.full((len(ids), 1), -(1 << 62)), np.full((len(ids), 1), 1 << 62)
        found = search(columns(t), (ids, labels, x), low_, high_, True, wanted, bits, kind)
        return pa.table(dict(zip(names, (ids[found[0]], found[2], found[3]))))

    def negatives(t: pa.Table, a: pa.Table) -> pa.Table:
        names = ("anchor_id", "positive_id", "positive_score", "negative_score", "negative_id")
        if not len(t) or not len(a):
            return empty(names)
        ids, labels, x = columns(a)
        low_, high_, p_ids, p_scores = (np.full((len(ids), wanted), fill) for fill in (1 << 62, -(1 << 62), 0, 0))
        for i, given in enumerate(a["positives"].to_pylist()):
            for w, p in enumerate(given):
                p_ids[i, w], p_scores[i, w] = p["id"], p["score"]
                low_[i, w], high_[i, w] = -(-low * p["score"] // 100), high * p["score"] // 100
        found = search(columns(t), (ids, labels, x), low_, high_, False, wanted, bits, kind)
        at = (found[0], found[1])
        return pa.table(dict(zip(names, (ids[found[0]], p_ids[at], p_scores[at], found[2], found[3]))))

    def best(found: DataFrame, by: list[str], score: str, id_: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), id_))
        return found.withColumn("rank", rank).filter(F.col("rank") <= wanted)

    near = _meet(rows, chosen, parts, groups).applyInArrow(nearest, "anchor_id bigint, score bigint, id bigint")
    near = best(near, ["anchor_id"], "score", "id").groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id", "score"))).alias("positives"))
    asked = C.written(chosen.join(near, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "positives"), "anchors")
    made = _meet(rows, asked, parts, groups).applyInArrow(negatives, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_score bigint, negative_id bigint")
    out = best(made, ["anchor_id", "positive_id"], "negative_score", "negative_id")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("id") % 100 == 0)


SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
