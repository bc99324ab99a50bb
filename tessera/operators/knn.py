"""Exact nearest neighbours by cosine distance: of one query by a scan, of many by clusters that the triangle inequality skips."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

TOP_K = 10
#: Centres: the root of the number of vectors, or so many (a sample by hash of the id, which the driver holds); rows of a cell of a cluster, and queries of a block, on average.
CENTRES, CELL, QUERIES = 256, 1 << 15, 1 << 12
#: What two ways of adding up a distance may differ by, and so does a rounded one.
SLACK = 1e-8
#: Cluster of what has distance V.WORST from everything: no vector, one without components, or of norm zero.
NOWHERE = -1


def distances(vectors: DataFrame, query: list[float], vector_col: str = "vector") -> DataFrame:
    """``vectors`` with their distance from the query, a literal: no join."""
    q = V.literal(query)
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    return vectors.withColumn("distance", F.round(V.cosine_distance(F.col(vector_col), q, norm_b=F.lit(norm)), 9)).drop(vector_col)


def search(vectors: DataFrame, query: list[float], k: int = TOP_K, id_col: str = "chunk_id", vector_col: str = "vector", where: Column | None = None, live: DataFrame | None = None) -> DataFrame:
    """The k nearest: distance, rank, and score = 1 / (1 + distance). Each task keeps k rows. ``live``: ids (one column, named as ``id_col``) of rows that count."""
    rows = vectors if where is None else vectors.filter(where)
    rows = rows if live is None else rows.join(live, id_col, "left_semi")
    near = distances(rows, query, vector_col).orderBy("distance", id_col).limit(k if k > 0 else TOP_K)
    return near.withColumns({"rank": F.row_number().over(Window.orderBy("distance", id_col)), "score": F.round(V.similarity(F.col("distance")), 9)})


@dataclass
class Clusters:
    """rows (cluster, part, chunk_id, vector, away): vectors with their distance from their centre, of unit vectors; of each cluster (cluster, radius, n, parts), so CENTRES + 1 at most; centres as unit vectors."""

    rows: DataFrame
    clusters: list[tuple[int, float, int, int]]
    centres: np.ndarray
    n: int

    def parts(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame([(c[0], c[3]) for c in self.clusters], "cluster int, parts int")


def _units(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i] = v
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Unit vectors of lists of ``dims`` numbers each."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _dims(vectors: DataFrame) -> int:
    """The most frequent length."""
    row = vectors.groupBy(F.size("vector").alias("dims")).count().filter("dims > 0").orderBy(F.desc("count"), "dims").first()
    return row["dims"] if row else 0


def clustered(vectors: DataFrame, centres: int = CENTRES) -> Clusters:
    """vectors (chunk_id, vector), by their nearest of some centres. Vectors of another length than most, whose distance from the others is V.WORST, count as none."""
    dims = _dims(vectors)
    proper = (F.size("vector") == dims) & (V.norm(F.col("vector")) > 0) if dims else F.lit(False)
    proper = F.coalesce(proper & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    flagged = vectors.select("chunk_id", "vector", proper.alias("proper"))
    centres = min(centres, max(1, math.isqrt(vectors.count())))
    picked = flagged.filter("proper").orderBy(F.xxhash64("chunk_id", "vector")).limit(centres).select("vector").collect()
    chosen = _units([np.array(r["vector"]) for r in picked], dims) if picked else np.zeros((0, dims))

    @F.pandas_udf("cluster int, away double")
    def placed(column):
        import pandas as pd

        x = _units(list(column), dims) if len(column) else np.zeros((0, dims))
        near = x @ chosen.T
        at = near.argmax(1) if len(x) else np.zeros(0, int)
        away = np.sqrt(np.maximum(0.0, 2 - 2 * near[np.arange(len(x)), at]))
        return pd.DataFrame({"cluster": at.astype(np.int32), "away": away})

    good = flagged.filter("proper").withColumn("p", placed("vector")).select("p.cluster", "chunk_id", "vector", "p.away") if picked else None
    none = flagged.filter("NOT proper").select(F.lit(NOWHERE).alias("cluster"), "chunk_id", "vector", F.lit(0.0).alias("away"))
    rows = (none if good is None else good.unionByName(none)).persist()
    sizes = rows.groupBy("cluster").agg(F.max("away"), F.count(F.lit(1))).collect()
    out = Clusters(rows, [(c, r, n, max(1, -(-n // CELL))) for c, r, n in sizes], chosen, sum(n for _, _, n in sizes))
    # a large cluster is several cells
    out.rows = rows.join(F.broadcast(out.parts()), "cluster").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts")
    return out


@dataclass
class Neighbours:
    """hits (query_id, chunk_id, distance, rank), and how many pairs of a query and a vector there are, were in opened cells, and were worked out."""

    hits: DataFrame
    pairs: int
    opened: int
    scored: int


_PAIR = "query_id bigint, chunk_id bigint, near double"


def _opened(index: Clusters, asked: DataFrame, k: int, dims: int, blocks: int) -> DataFrame:
    """asked (cluster, query_id, q, to_centre, reach) -> the k nearest of each query in each cell, with ties, and how many were worked out (near is null). A cell meets its queries block by block."""

    def cell(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ("query_id", "chunk_id", "near")
        if not len(rows) or not len(queries):
            return pa.table({n: pa.array([], pa.float64() if n == "near" else pa.int64()) for n in names})
        ids, q_ids = rows["chunk_id"].to_numpy(), queries["query_id"].to_numpy()
        if key[0].as_py() == NOWHERE:
            keep = np.sort(ids)[:k]
            return pa.table(dict(zip(names, (np.repeat(q_ids, len(keep)), np.tile(keep, len(q_ids)), np.full(len(keep) * len(q_ids), V.WORST)))))
        x, away = _matrix(rows["vector"], dims), rows["away"].to_numpy()
        q, to, reach = _matrix(queries["q"], dims), queries["to_centre"].to_numpy(), queries["reach"].to_numpy()
        out, scored = [], 0
        for at in range(0, len(q_ids), 256):
            j = slice(at, at + 256)
            # a vector is at least as far as its distance from the centre and the query's differ
            may = np.abs(to[j, None] - away[None, :]) <= reach[j, None] + SLACK
            some = may.any(0)
            near = np.where(may[:, some], 1 - q[j] @ x[some].T, np.inf)
            scored += int(may.sum())
            own, last = ids[some], min(k, near.shape[1]) - 1
            if last < 0:
                continue
            limit = np.partition(near, last, axis=1)[:, last] + SLACK
            r, c = np.nonzero((near <= limit[:, None]) & np.isfinite(near))
            # of more than k within the slack, the smaller ids can stand before the others only among equals: all go on
            out.append((q_ids[j][r], own[c], near[r, c]))
        found = [np.concatenate(z) for z in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        t = pa.table(dict(zip(names, found)))
        return pa.concat_tables([t, pa.table({"query_id": pa.array([scored], pa.int64()), "chunk_id": pa.array([None], pa.int64()), "near": pa.array([None], pa.float64())})])

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    asked = asked.join(F.broadcast(index.parts()), "cluster").withColumns({"block": block, "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}).drop("parts")
    rows = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.groupBy("cluster", "part", "block").cogroup(asked.groupBy("cluster", "part", "block")).applyInArrow(cell, _PAIR)


def search_many(index: Clusters, queries: DataFrame, k: int = TOP_K) -> Neighbours:
    """queries (query_id, vector) -> the k nearest of each, as :func:`search` has them.

    A query first opens the clusters nearest to it that hold 2 k vectors. Its k-th distance there is its *reach*: other clusters
    are opened only where the query's distance from the centre, less the cluster's radius, is within it, and of their vectors only those whose own
    distance from the centre allows it are worked out. Queries and vectors of a cell meet in one block product.
    """
    spark, dims = queries.sparkSession, index.centres.shape[1]
    cells, n_queries = index.clusters, queries.count()
    if not cells or not n_queries:
        return Neighbours(spark.createDataFrame([], "query_id bigint, chunk_id bigint, distance double, rank int"), 0, 0, 0)
    cluster, radius, n_in = (np.array([c[i] for c in cells]) for i in range(3))
    blocks = -(-n_queries // QUERIES)
    far = np.sqrt(2 * V.WORST)
    centres = index.centres
    schema = "cluster int, query_id bigint, q array<double>, to_centre double, reach double"

    def asked(first: bool):
        def run(batches):
            for t in batches:
                rows = {n: [] for n in ("cluster", "query_id", "q", "to_centre", "reach")}
                for i in range(t.num_rows):
                    v, reach = np.array(t.column(1)[i].as_py() or [], float), t.column(2)[i].as_py()
                    proper = len(v) == dims and dims > 0 and np.isfinite(v).all() and (v != 0).any()
                    to = np.full(len(cells), far)
                    if proper and len(centres):
                        unit = v / np.linalg.norm(v)
                        to = np.where(cluster == NOWHERE, far, np.sqrt(np.maximum(0, 2 - 2 * (centres @ unit)))[np.maximum(cluster, 0)])
                    least = np.where(cluster == NOWHERE, far, np.maximum(0.0, to - radius)) if proper else np.full(len(cells), far)
                    order = np.argsort(least, kind="stable")
                    before = np.cumsum(n_in[order]) - n_in[order]
                    start = before < 2 * k
                    chosen = order[start] if first else order[~start & (least[order] <= reach + SLACK)]
                    for c in chosen.tolist():
                        rows["cluster"].append(int(cluster[c]) if proper else NOWHERE)
                        rows["query_id"].append(t.column(0)[i].as_py())
                        rows["q"].append(v.tolist() if proper else [])
                        rows["to_centre"].append(float(to[c]))
                        rows["reach"].append(float(reach))
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("cluster", pa.int32()), ("query_id", pa.int64()), ("q", pa.list_(pa.float64())), ("to_centre", pa.float64()), ("reach", pa.float64())]))

        return run

    base = queries.select("query_id", F.col("vector").cast("array<double>").alias("v"))
    # a query that has no direction is as far from all: any k vectors with the smallest ids are its nearest
    fine = F.coalesce((F.size("v") == dims) & (V.norm(F.col("v")) > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    lost = base.filter(~fine).select("query_id")
    base = base.filter(fine)
    one = base.withColumn("reach", F.lit(far)).mapInArrow(asked(True), schema).persist()
    found = _opened(index, one, k, dims, blocks).persist()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("near", "chunk_id"))
    reach = found.filter("near IS NOT NULL").withColumn("r", rank).filter(F.col("r") == k).select("query_id", F.sqrt(2 * F.greatest(F.lit(0.0), F.col("near"))).alias("reach"))
    two = base.join(reach, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(far))).mapInArrow(asked(False), schema).persist()
    more = _opened(index, two, k, dims, blocks).persist()
    sizes = F.broadcast(spark.createDataFrame([(c[0], c[2]) for c in cells], "cluster int, n bigint"))
    opened = sum(df.join(sizes, "cluster").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (one, two))
    scored = found.unionByName(more).filter("near IS NULL").agg(F.coalesce(F.sum("query_id"), F.lit(0))).first()[0]
    pairs = found.unionByName(more).filter("near IS NOT NULL")
    # the k nearest and what may round to the same; then their distances as everywhere else
    least = pairs.withColumn("r", rank).filter(F.col("r") == k).select("query_id", (F.col("near") + SLACK).alias("limit"))
    pairs = pairs.join(least, "query_id", "left").filter(F.col("limit").isNull() | (F.col("near") <= F.col("limit"))).select("query_id", "chunk_id")
    met = pairs.join(base, "query_id").join(index.rows.select("chunk_id", "vector"), "chunk_id")
    met = met.select("query_id", "chunk_id", F.round(V.cosine_distance(F.col("vector"), F.col("v")), 9).alias("distance"))
    if lost.limit(1).count():
        smallest = index.rows.select("chunk_id").orderBy("chunk_id").limit(k).agg(F.collect_list("chunk_id").alias("ids"))
        far_ones = lost.join(F.broadcast(smallest)).select("query_id", F.explode("ids").alias("chunk_id"), F.lit(V.WORST).alias("distance"))
        met = met.unionByName(far_ones)
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return Neighbours(met.withColumn("rank", final).filter(F.col("rank") <= k), n_queries * index.n, int(opened), int(scored))
