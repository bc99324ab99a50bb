"""Suffix-array dedup over a whole corpus: every byte that a 100-byte string covers which also starts earlier is removed.

One suffix array over a corpus cannot be built in one place, so strings meet by content first:

1. Each 100-byte window of a text has a *minimizer*, its 32-byte string of least hash (the leftmost of equals). Windows in a
   row with the same minimizer form a piece. Equal windows have equal minimizers at equal places, so equal windows lie in
   pieces with one minimizer hash.
2. Minimizer hashes are counted. Hashes that occur twice or more go into a Bloom filter of fixed size, and a second pass
   over the texts lets only pieces through whose minimizer is in it.
3. Equal pieces (BLAKE2b-128 of their bytes) meet; all but the earliest are removed whole. Tasks do so for their own
   pieces before the shuffle, so a passage of any number of copies sends one piece a task.
4. What is left differs, and may still share windows: with at least 34 bytes on one side of the minimizer. Pieces meet by
   the minimizer with those 34 bytes, left and right, where two or more do, and suffix arrays over their strings
   (:mod:`.suffix_array`) put windows that are equal next to each other; bytes are compared. In each run of equal windows
   all but the earliest are removed. A meeting of over ``CROWD`` pieces, which would be one task's, is spread over the
   cluster by the windows themselves.

The removed intervals of a document are gathered (one group is one document) and cut out.

Defined results. Null text is empty text. Texts of under 100 bytes lose nothing. A null id sorts after every id. Rows that
repeat an id and a text are one document, and each of them gets its result; rows that repeat an id with another text are
ordered by a hash of the text. A text of any length is searched whole, by one task as far as its pieces. Empty tables give empty results. A cut may fall inside a character: :func:`dedup_spans`
drops the broken rest of it in its text. It keeps the input's columns, with the text replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .suffix_array import suffix_array

LENGTH = 100
GRAM = 32
#: Bytes beside the minimizer that two pieces with a window in common share on one side at least.
SIDE = (LENGTH - GRAM + 1) // 2
FILTER_WORDS = 1 << 22
#: Bytes of strings that one suffix array takes; pieces that meet by one key, from which on windows are spread.
BATCH = 1 << 16
CROWD = 5000
#: Pieces that a task remembers to find equal ones before the shuffle.
REMEMBER = 400_000

_U = np.uint64
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(self.n - 1, b, _U)]), dtype=_U) for b in (self.base, pow(self.base, -1, 1 << 64)))
        return self.up, self.down


_powers = _Powers(_BASE)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(_MIX)
    return h ^ (h >> _U(29))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=out[1:])
    return out, down


def minimizers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: hash of the minimizer, its place, and the first window. data: uint8, of LENGTH or more."""
    sums, down = _sums(data)
    hashes = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM])
    # 33 bits of hash over 31 of place: strings go by those bits of their hash, then from the left
    least = (hashes & _U(-1 << 31 & 2**64 - 1)) | np.arange(len(hashes), dtype=_U)
    width, across = 1, LENGTH - GRAM + 1
    while width < across:
        step = min(width, across - width)
        least = np.minimum(least[step:], least[:-step])
        width += step
    place = (least & _U(2**31 - 1)).astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    place = place[first]
    return hashes[place], place, first


def _identities(raw: bytes, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b-128 of raw[first:stop], for each, as two numbers. It decides that pieces are equal, so it must be a hash that no text can be made to collide in, as sums of powers can."""
    found = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), stop.tolist())])
    both = np.frombuffer(found, "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _bytes(x: pa.Scalar) -> bytes:
    return (x.as_py() or "").encode("utf-8", "surrogatepass")


def _minimizer_counts(texts: DataFrame) -> DataFrame:
    """(h, n) of minimizer hashes that occur twice or more. A task takes equal texts twice at most: a copy's minimizers reach the filter wherever the second pass meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bool] = {}
        held: list[np.ndarray] = []
        n = 0

        def flushed() -> pa.RecordBatch:
            h, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count)], names=["h", "n"])

        for batch in batches:
            for x in batch.column(0):
                raw = _bytes(x)
                if len(raw) < LENGTH:
                    continue
                whole = hashlib.blake2b(raw, digest_size=16).digest()
                again = seen.get(whole)
                if again:
                    continue
                if again is not None or len(seen) < REMEMBER:
                    seen[whole] = again is not None
                held.append(minimizers(np.frombuffer(raw, np.uint8))[0])
                n += len(held[-1])
                if n > 1 << 20:
                    yield flushed()
                    held, n = [], 0
        if held:
            yield flushed()

    return texts.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")


def _filter_of(repeated: DataFrame, column: str) -> np.ndarray:
    """A blocked Bloom filter of FILTER_WORDS words at most (32 MB): the driver gets its words that have bits."""
    n = repeated.count()
    words = min(FILTER_WORDS, 1 << max(10, n.bit_length()))
    h = F.col(column)
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int"))
    mask = bit(58).bitwiseOR(bit(52)).bitwiseOR(bit(46))
    table = repeated.groupBy(h.bitwiseAND(F.lit(words - 1)).alias("word")).agg(F.bit_or(mask).alias("m")).toArrow()
    out = np.zeros(words, _U)
    for part in table.to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy().view(_U)
    return out


def _may_be_in(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(h), _U)
    for s in (58, 52, 46):
        mask |= _U(1) << ((h >> _U(s)) & _U(63))
    return (bloom[(h & _U(len(bloom) - 1)).astype(np.int64)] & mask) == mask


_PIECE = "i1 bigint, i2 bigint, no_id boolean, id {id}, key bigint, start int, stop int, place int, piece binary"
_NAMES = ["i1", "i2", "no_id", "id", "key", "start", "stop", "place", "piece"]


class _Held:
    """Texts and pieces that a task holds, to find equal ones before the shuffle. A text is held once, for its earliest document."""

    def __init__(self, id_type: pa.DataType):
        self.id_type = id_type
        self.texts: dict[bytes, int] = {}
        self.docs: list[tuple] = []  # (no_id, id, key)
        self.raws: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []  # i1, i2, start, stop, place
        self.owners: list[int] = []
        self.whole: list[tuple] = []  # documents that are later copies, and their length
        self.n = 0

    def add(self, doc: object, key: int, raw: bytes, known: np.ndarray) -> None:
        at = (doc is None, doc if doc is not None else 0, key)
        digest = hashlib.blake2b(raw, digest_size=16).digest()
        k = self.texts.get(digest)
        if k is not None:
            # the later copy goes whole; the pieces are the earlier one's
            if at != self.docs[k]:
                self.whole.append((*max(at, self.docs[k]), len(raw)))
                self.docs[k] = min(at, self.docs[k])
            return
        self.texts[digest] = len(self.docs)
        self.docs.append(at)
        data = np.frombuffer(raw, np.uint8)
        h, place, first = minimizers(data)
        stop = np.append(first[1:], len(data) - LENGTH + 1) + LENGTH - 1
        keep = _may_be_in(known, h)
        place, first, stop = place[keep], first[keep], stop[keep]
        self.raws.append(raw if len(first) else b"")
        if len(first):
            self.parts.append((*_identities(raw, first, stop), first, stop, place))
            self.owners.append(len(self.docs) - 1)
            self.n += len(first)

    def full(self) -> bool:
        return self.n > REMEMBER or len(self.docs) > REMEMBER

    def _rows(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray, start: np.ndarray, stop: np.ndarray, place: np.ndarray, pieces: pa.Array) -> pa.RecordBatch:
        no_id, ids, keys = (pa.array([d[i] if i != 1 or not d[0] else None for d in self.docs], t) for i, t in enumerate((pa.bool_(), self.id_type, pa.int64())))
        doc = pa.array(doc)
        made = [pa.array(one), pa.array(two), no_id.take(doc), ids.take(doc), keys.take(doc), *[pa.array(x.astype(np.int32)) for x in (start, stop, place)], pieces]
        return pa.RecordBatch.from_arrays(made, names=_NAMES)

    def sent(self) -> Iterator[pa.RecordBatch]:
        """The earliest of equal pieces with its bytes, the others without; then nothing is held any more."""
        if self.whole:
            n = len(self.whole)
            zero, none = pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary())
            gone = [pa.array([w[i] if i != 1 or not w[0] else None for w in self.whole], t) for i, t in enumerate((pa.bool_(), self.id_type, pa.int64()))]
            yield pa.RecordBatch.from_arrays([zero, zero, *gone, pa.nulls(n, pa.int32()).fill_null(0), pa.array([w[3] for w in self.whole], pa.int32()), pa.nulls(n, pa.int32()).fill_null(0), none], names=_NAMES)
        if self.parts:
            one, two, start, stop, place = (np.concatenate(x) for x in zip(*self.parts))
            doc = np.repeat(np.array(self.owners), [len(p[0]) for p in self.parts])
            rank = np.empty(len(self.docs), np.int64)
            rank[sorted(range(len(self.docs)), key=self.docs.__getitem__)] = np.arange(len(self.docs))
            order = np.lexsort((rank[doc] << 32 | start, two, one))
            one, two, start, stop, place, doc = (x[order] for x in (one, two, start, stop, place, doc))
            first = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            # of the others, those of a document that overlap become one interval (stops grow with starts)
            later = np.flatnonzero(~first)
            later = later[np.lexsort((start[later], doc[later]))]
            apart = np.ones(len(later), bool)
            apart[1:] = (doc[later][1:] != doc[later][:-1]) | (start[later][1:] > stop[later][:-1])
            last = stop[later][np.append(np.flatnonzero(apart)[1:], len(later)) - 1] if len(later) else stop[later]
            later = later[apart]
            for at in np.array_split(np.arange(len(later)), len(later) // 20_000 + 1) if len(later) else ():
                zero = np.zeros(len(at), np.int64)
                yield self._rows(zero, zero, doc[later[at]], start[later[at]], last[at], zero, pa.nulls(len(at), pa.binary()))
            for at in np.array_split(np.flatnonzero(first), first.sum() // 20_000 + 1):
                pieces = [self.raws[d][a:b] for d, a, b in zip(doc[at].tolist(), start[at].tolist(), stop[at].tolist())]
                yield self._rows(one[at], two[at], doc[at], start[at], stop[at], place[at] - start[at], pa.array(pieces, pa.binary()))
        self.__init__(self.id_type)


def _pieces(docs: DataFrame, bloom: np.ndarray) -> DataFrame:
    """Pieces that may occur again, and (with no piece) intervals that a task knows to be removed. docs: (id, key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = held or _Held(batch.column(0).type)
            for x, k, t in zip(batch.column(0), batch.column(1), batch.column(2)):
                raw = _bytes(t)
                if len(raw) >= LENGTH:
                    held.add(x.as_py(), k.as_py(), raw, shared.value)
                    if held.full():
                        yield from held.sent()
        if held:
            yield from held.sent()

    return docs.mapInArrow(run, _PIECE.format(id=docs.schema["id"].dataType.simpleString()))


def _earliest(pieces: DataFrame) -> DataFrame:
    """Of equal pieces the earliest with its bytes; the others, and what was known to be removed, without."""
    near = pieces.repartition("i1", "i2", F.when(F.col("piece").isNull(), F.xxhash64("id", "start")))
    near = near.sortWithinPartitions("i1", "i2", "no_id", "id", "key", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, where = None, None
        for batch in batches:
            # rows without a piece may stand between those of a group: only rows with one are looked at
            has = np.flatnonzero(batch.column(8).is_valid().to_numpy(zero_copy_only=False))
            one, two = (batch.column(c).to_numpy()[has] for c in (0, 1))
            new = np.ones(len(has), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            if len(has):
                new[0] = last != (one[0], two[0])
                last = (one[-1], two[-1])
            drop, skip = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            drop[has[~new]] = True
            of = np.maximum.accumulate(np.where(new, np.arange(len(has)), -1))
            here = lambda r: tuple(batch.column(c)[r].as_py() for c in (3, 4, 5))
            for j in np.flatnonzero(~new).tolist():
                # a row that repeats the first one's document
                r = int(has[j])
                skip[r] = here(r) == (here(int(has[of[j]])) if of[j] >= 0 else where)
            if len(has) and of[-1] >= 0:
                where = here(int(has[of[-1]]))
            piece = pc.if_else(pa.array(drop), pa.scalar(None, pa.binary()), batch.column(8))
            yield pa.RecordBatch.from_arrays([*batch.columns[:8], piece], names=_NAMES).filter(pa.array(~skip))

    return near.mapInArrow(run, pieces.schema)


def _sides(pieces: DataFrame) -> DataFrame:
    """A row for each side of a piece's minimizer with SIDE bytes: side (hash of the minimizer with them), and the part of the piece whose windows have them, with the minimizer's place in it (at)."""
    left = F.when(
        F.col("place") >= SIDE,
        F.struct(F.xxhash64(F.lit(0), F.substr("piece", F.col("place") + 1 - SIDE, F.lit(SIDE + GRAM))).alias("side"), F.lit(0).alias("cut"), (F.col("place") + LENGTH - SIDE).alias("n"), F.col("place").alias("at")),
    )
    cut = F.greatest(F.lit(0), F.col("place") + GRAM + SIDE - LENGTH)
    right = F.when(
        F.octet_length("piece") - F.col("place") - GRAM >= SIDE,
        F.struct(F.xxhash64(F.lit(1), F.substr("piece", F.col("place") + 1, F.lit(SIDE + GRAM))).alias("side"), cut.alias("cut"), F.octet_length("piece").alias("n"), (F.col("place") - cut).alias("at")),
    )
    out = pieces.select("no_id", "id", "key", "start", "piece", F.explode(F.array_compact(F.array(left, right))).alias("s"))
    return out.select("no_id", "id", "key", (F.col("start") + F.col("s.cut")).alias("start"), F.substr("piece", F.col("s.cut") + 1, F.col("s.n") - F.col("s.cut")).alias("piece"), F.col("s.side").alias("side"), F.col("s.at").alias("at"))


def shared_windows(strings: list[bytes], order: list[tuple]) -> list[tuple[int, int, int]]:
    """(string, first, stop) of windows of ``strings`` that occur earlier by ``order`` (document..., place of the string in it); by a suffix array."""
    lengths = np.array([len(s) for s in strings])
    joined = b"".join(strings)
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    # bytes are from 2 on; 1 ends a string and 0 all
    text = np.ones(int(ends[-1]) + 1, np.int64)
    text[-1] = 0
    inside = np.ones(len(text), bool)
    inside[ends - 1] = inside[-1] = False
    text[inside] = np.frombuffer(joined, np.uint8).astype(np.int64) + 2
    sa = np.array(suffix_array(text.tolist()))
    owner = np.repeat(np.arange(len(strings)), lengths + 1)
    sa = sa[sa < len(owner)]
    sa = sa[sa + LENGTH <= (starts + lengths)[owner[sa]]]
    if len(sa) < 2:
        return []
    narrow = text.astype(np.int16)
    equal = np.ones(len(sa) - 1, bool)
    for d in range(0, LENGTH, 4):
        at = np.flatnonzero(equal)
        if not len(at):
            return []
        a, b = sa[at], sa[at + 1]
        same = narrow[a + d] == narrow[b + d]
        for e in (1, 2, 3):
            same &= narrow[a + d + e] == narrow[b + d + e]
        equal[at] = same
    # by document and place in it: a piece may be here for both its sides, and a window of it is one window
    ranks = {o: k for k, o in enumerate(sorted({o[:-1] for o in order}))}
    place = np.array([(ranks[o[:-1]] << 32) + o[-1] for o in order]) - starts
    run = np.concatenate([[0], np.cumsum(~equal)])
    of = place[owner[sa]] + sa
    least = np.minimum.reduceat(of, np.flatnonzero(np.concatenate([[True], ~equal])))
    gone = sa[of > least[run]]
    gone.sort()
    if not len(gone):
        return []
    cut = np.flatnonzero(np.concatenate([[True], np.diff(gone) > 1]))
    last = np.append(cut[1:], len(gone)) - 1
    return [(int(k), int(a - starts[k]), int(b - starts[k]) + LENGTH) for k, a, b in zip(owner[gone[cut]].tolist(), gone[cut], gone[last])]


def _reach(x: bytes, a: int, y: bytes, b: int) -> int:
    """How long x and y are equal about the minimizer, which is at a and b of them."""
    right = min(len(x) - a, len(y) - b) - GRAM
    left = min(a, b)
    after = int.from_bytes(x[a + GRAM : a + GRAM + right]) ^ int.from_bytes(y[b + GRAM : b + GRAM + right])
    before = int.from_bytes(x[a - left : a], "little") ^ int.from_bytes(y[b - left : b], "little")
    return GRAM + right + left - (after.bit_length() + 7) // 8 - (before.bit_length() + 7) // 8


def _by_suffix_arrays(sided: DataFrame) -> DataFrame:
    """Intervals of pieces whose windows occur in an earlier piece of the same side."""
    near = sided.select("side", "no_id", "id", "key", "start", "piece", "at").repartition("side").sortWithinPartitions("side")
    id_type = sided.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow_id = None
        last, group = None, []
        ready, size, gone = [], 0, []

        def found() -> pa.RecordBatch:
            if ready:
                order = [(r[0], 0 if r[0] else r[1], r[2], r[3]) for r in ready]
                gone.extend((*ready[k][1:3], ready[k][3] + a, ready[k][3] + b) for k, a, b in shared_windows([r[4] for r in ready], order))
            kinds = (arrow_id, pa.int64(), pa.int32(), pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array([g[i] for g in gone], k) for i, k in enumerate(kinds)], names=["id", "key", "start", "stop"])
            ready.clear()
            gone.clear()
            return out

        def close() -> int:
            """The group's pieces, equal ones once: of those the later ones go whole."""
            if len(group) < 2:
                return 0
            first: dict[bytes, tuple] = {}
            for row in sorted(group, key=lambda r: (r[0], 0 if r[0] else r[1], r[2], r[3])):
                same = first.setdefault(row[4], row)
                if same[:4] != row[:4]:
                    gone.append((row[1], row[2], row[3], row[3] + len(row[4])))
            if len(first) < 2:
                return 0
            if len(first) == 2:
                # two that are equal for less than a window about the minimizer share none here
                (x, one), (y, two) = first.items()
                if _reach(x, one[5], y, two[5]) < LENGTH:
                    return 0
            ready.extend(first.values())
            return sum(map(len, first))

        for batch in batches:
            arrow_id = batch.column(2).type
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != last:
                    size += close()
                    if size > BATCH or len(gone) > 50_000:
                        yield found()
                        size = 0
                    last, group = row[0], []
                group.append(row[1:])
        close()
        if ready or gone:
            yield found()

    return near.mapInArrow(run, f"id {id_type}, key bigint, start int, stop int")


def _by_windows(sided: DataFrame) -> DataFrame:
    """The same, for sides with very many pieces: each window goes its own way."""
    windows = sided.select("no_id", "id", "key", F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("piece") - LENGTH + 1), lambda i: F.substr("piece", i, F.lit(LENGTH)))), "start")
    windows = windows.select("no_id", "id", "key", (F.col("start") + F.col("pos")).alias("start"), F.col("col").alias("window"))
    windows = C.written(windows.withColumn("w", F.sha2("window", 256)).drop("window").distinct(), "windows")
    firsts = windows.groupBy("w").agg(F.min(F.struct("no_id", "id", "key", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = C.join_hot(windows, C.written(firsts, "firsts"), "w", "n", max(1, windows.count()))
    gone = met.filter(F.struct("no_id", "id", "key", "start") != F.col("first"))
    return gone.select("id", "key", "start", (F.col("start") + LENGTH).cast("int").alias("stop"))


def removed(docs: DataFrame) -> DataFrame:
    """docs (id, key, text) -> (id, key, spans): unmerged intervals of removed bytes, an array for each document that has any."""
    repeated = C.written(_minimizer_counts(docs.select("text")), "minimizers")
    pieces = C.written(_earliest(_pieces(docs, _filter_of(repeated, "h"))), "pieces")
    gone = pieces.filter("piece IS NULL").select("id", "key", "start", "stop")
    sided = _sides(pieces.filter("piece IS NOT NULL"))
    sides = C.written(sided.groupBy("side").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sides")
    bloom = docs.sparkSession.sparkContext.broadcast(_filter_of(sides, "side"))

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = batch.column(batch.schema.get_field_index("side")).to_numpy().view(_U)
            yield batch.filter(pa.array(_may_be_in(bloom.value, side)))

    sided = sided.mapInArrow(meeting, sided.schema)
    crowds = sides.filter(F.col("n") > CROWD).select("side")
    n = crowds.count()
    parts = [gone]
    if n:
        # a crowd has over CROWD pieces, so crowds are at most that small a part of all pieces
        crowd = C.small_side(crowds, n)
        parts += [_by_suffix_arrays(sided.join(crowd, "side", "left_anti")), _by_windows(sided.join(crowd, "side", "left_semi"))]
    else:
        parts.append(_by_suffix_arrays(sided))
    spans = C.union_all(parts)
    return spans.groupBy("id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _merged(spans: list | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _rest(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def _with_spans(df: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    text = C.empty_text(df[text_col])
    docs = df.select(df[id_col].alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    spans = removed(docs)
    if carry:
        docs = df.select(df[id_col].alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), F.struct(*[df[c] for c in df.columns]).alias("row"))
    spans = spans.withColumnsRenamed({"id": "s_id", "key": "s_key"})
    return docs.join(spans, docs["id"].eqNullSafe(F.col("s_id")) & (docs["key"] == F.col("s_key")), "left").drop("s_id", "s_key", "key")


def dedup_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with its texts cut; a null text stays null."""
    out = _with_spans(df, id_col, text_col, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            cut = [_rest(_bytes(t), _merged(s)).decode("utf-8", "ignore") for t, s in zip(batch.column(at["text"]), batch.column(at["spans"]).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(at["row"]), pa.array(cut, pa.string())], names=["row", "cut"])

    cut = out.select("text", "spans", "row").mapInArrow(run, f"row {out.schema['row'].dataType.simpleString()}, cut string")
    return cut.select(*[F.when(F.col("row")[c].isNotNull(), F.col("cut")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, s in zip(batch.column(1), batch.column(2).to_pylist()):
                raw, spans = _bytes(t), _merged(s)
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_rest(raw, spans)).hexdigest()))
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return out.select("id", "text", "spans").mapInArrow(run, f"doc_id {out.schema['id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
