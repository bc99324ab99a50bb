"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: words are lower-cased (A to Z), cut into 4-word shingles, repeats included; a bit is set if it is set in
more than half of the shingles' XXH64 (seed 42).

Links (4 or fewer differing bits), over distinct fingerprints. The 64 bits fall into five segments; two fingerprints that
differ in at most four bits agree in one of them. So the index's top level holds, for each segment, the nodes that share
its pattern: every fingerprint goes to five of them, 8 bytes each, and nodes are dealt over the cluster. Inside a node,
fingerprints are sorted by Gray rank (of the bits rotated so that the segment comes first), which puts codes that differ
little side by side; runs of eight become leaves, eight leaves a node, and so on. A node keeps the bits in which all its
members agree. Two nodes are compared on the bits that both have fixed and their parents had not, differences add up on
the way down, and a pair of groups is pruned as a whole when they exceed four, or when all members of both are linked
already. Each task returns a spanning forest of its links, never all pairs; :mod:`.components` joins the forests.

Equal fingerprints are one key from the start. A node of the top level holds distinct fingerprints only, 16 bytes each in
memory; near copies of one text fill at most a ball of a few bits' radius (43,745 codes within three).

Defined results. Null text is empty text; a text without words has fingerprint zero and links like any other. A text of
fewer than four words has one shingle, the whole sequence. A null id never is a component's id unless all are null.
Repeated rows share a component. A text of any length is read whole, in one row's memory. Empty tables give empty results. :func:`near_dedup` keeps the input's columns, and the
row whose id is its component's smallest (all rows of that id, if it repeats; and rows with a null id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .components import components

SHINGLE = 4
SEED = 42
MOST = 4
#: (first bit from the top, bits) of the five segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
FAN = 8
#: Pairs of nodes that are expanded at a time (64 pairs of children each), and fingerprints of several nodes indexed at a time.
FRONT = 4096
BLOCK = 1 << 15
#: Fingerprint rows (five for each fingerprint) of a task, on average.
TASK_ROWS = 2_000_000


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64, n)
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, n, 8192):
        counts += np.unpackbits(raw[at : at + 8192], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fingerprints as signed longs."""
    base = C.only(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return base.mapInArrow(C.trimmed(run), f"id {base.schema['id'].dataType.simpleString()}, fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order: neighbours there differ in one bit."""
    r = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(s))
    return r


class Index:
    """Gray-ordered codes of several keys (equal keys adjacent), and above them nodes of up to FAN children with the bits that all below share."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        self.codes = codes
        self.fixed, self.value, self.first, self.last = [np.full(len(codes), ~np.uint64(0))], [codes], [None], [None]
        low, high, key = codes, codes, keys
        while True:
            n = len(key)
            new = np.empty(n, bool)
            new[0], new[1:] = True, key[1:] != key[:-1]
            starts_of_key = np.flatnonzero(new)
            place = np.arange(n) - np.repeat(starts_of_key, np.diff(np.append(starts_of_key, n)))
            if len(self.first) > 1 and len(starts_of_key) == n:
                break
            starts = np.flatnonzero(place % FAN == 0)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            key = key[starts]
            self.fixed.append(~(low ^ high))
            self.value.append(low)
            self.first.append(starts)
            self.last.append(np.append(starts[1:], n))
        self.label = np.arange(len(codes))

    def _same(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest label below each node of a level."""
        least = most = self.label
        for k in range(1, level + 1):
            least, most = np.minimum.reduceat(least, self.first[k]), np.maximum.reduceat(most, self.first[k])
        return least, most

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            to = np.arange(len(self.label))
            np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = to[to]
                if (further == to).all():
                    break
                to = further
            self.label = to[self.label]

    def join(self, most: int = MOST) -> np.ndarray:
        """Link all codes of a key that differ in at most ``most`` bits; the labels of the components (index of a member)."""
        top = len(self.first) - 1
        roots = np.arange(len(self.first[top]))
        stack = [(top, roots, roots, np.zeros(len(roots), np.uint8))]
        across = np.arange(FAN)
        while stack:
            level, a, b, differences = stack.pop()
            if len(a) > FRONT:
                stack.append((level, a[FRONT:], b[FRONT:], differences[FRONT:]))
                a, b, differences = a[:FRONT], b[:FRONT], differences[:FRONT]
            least, largest = self._same(level)
            open_ = ~((least[a] == largest[a]) & (least[b] == largest[b]) & (least[a] == least[b]))
            a, b, differences = a[open_], b[open_], differences[open_]
            if not len(a):
                continue
            ca = (self.first[level][a][:, None] + across)[:, :, None]
            cb = (self.first[level][b][:, None] + across)[:, None, :]
            fits = (ca < self.last[level][a][:, None, None]) & (cb < self.last[level][b][:, None, None]) & ((a != b)[:, None, None] | (ca <= cb))
            if level == 1:
                fits &= ca != cb
            pair, x, y = np.nonzero(fits)
            ca, cb = ca[pair, x, 0], cb[pair, 0, y]
            below = level - 1
            known = self.fixed[level][a] & self.fixed[level][b]
            fresh = self.fixed[below][ca] & self.fixed[below][cb] & ~known[pair]
            total = differences[pair] + np.bitwise_count((self.value[below][ca] ^ self.value[below][cb]) & fresh)
            keep = total <= most
            ca, cb, total = ca[keep], cb[keep], total[keep]
            if not below:
                self._link(ca, cb)
                continue
            # pairs of a node with itself come off the stack first: what is linked inside is pruned across
            own = ca == cb
            for part in (~own, own):
                if part.any():
                    stack.append((below, ca[part], cb[part], total[part]))
        return self.label


def _rotated(codes: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64) & np.uint64(63)
    back = (np.uint64(64) - by) & np.uint64(63)
    return np.where(by == 0, codes, (codes << by) | (codes >> back))


def _forest(keys: np.ndarray, fp: np.ndarray, shift: np.ndarray) -> pa.RecordBatch:
    """Spanning links (a, b) of fingerprints of several top nodes."""
    codes = _rotated(fp, shift)
    order = np.lexsort((gray_rank(codes), keys))
    keys, fp, codes = keys[order], fp[order], codes[order]
    label = Index(keys, codes).join()
    own = label != np.arange(len(label))
    a, b = fp[own].view(np.int64), fp[label[own]].view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(codes: DataFrame, rows: int) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose components are those of all links."""
    parts = [F.struct(F.lit(k * 8192).cast("int").alias("base"), F.lit(at).alias("shift"), F.shiftrightunsigned("fp", 64 - at - n).bitwiseAND(F.lit((1 << n) - 1)).cast("int").alias("seg")) for k, (at, n) in enumerate(SEGMENTS)]
    spread = codes.select("fp", F.explode(F.array(*parts)).alias("s")).select("fp", F.col("s.shift").alias("shift"), (F.col("s.base") + F.col("s.seg")).alias("key"))
    conf = codes.sparkSession.conf
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), 5 * rows // TASK_ROWS)
    spread = spread.repartition(tasks, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            key = batch.column(2).to_numpy()
            held.append((key, batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            n += len(key)
            if n < BLOCK or not len(key):
                continue
            key, fp, shift = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut:
                yield _forest(key[:cut].copy(), fp[:cut].copy(), shift[:cut].copy())
            held, n = [(key[cut:], fp[cut:], shift[cut:])], len(key) - cut
        if n:
            yield _forest(*(np.concatenate(x) for x in zip(*held)))

    return spread.select("fp", "shift", "key").mapInArrow(C.trimmed(run), "a bigint, b bigint")


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id, component_size) of every row of ``df``."""
    docs = C.written(fingerprints(df, id_col, text_col), "fingerprints")
    codes = C.written(docs.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "codes")
    total, n_codes = docs.count(), codes.count()
    of = components(links(codes.select("fp"), n_codes))
    met = codes.join(of.withColumnRenamed("node", "fp"), "fp", "left")
    linked = C.written(met.filter("root IS NOT NULL"), "linked")
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    several = linked.join(ids, "root").select("fp", "n", "component_id", "component_size")
    alone = met.filter("root IS NULL AND n > 1").select("fp", "n", F.col("first").alias("component_id"), F.col("n").alias("component_size"))
    groups = C.written(several.unionByName(alone), "groups")
    out = C.join_hot(docs, groups, "fp", "n", total)
    in_group = F.col("n").isNotNull()
    return out.select("id", "fp", F.when(in_group, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("component_size", F.lit(1)).cast("long").alias("component_size"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose component has a smaller id."""
    gone = annotate(df, id_col, text_col).filter("id <> component_id").select(F.col("id").alias("__gone")).distinct()
    gone = C.written(gone, "gone")
    return df.join(C.small_side(gone, gone.count()), df[id_col] == F.col("__gone"), "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")
