"""SentencePiece encoding and decoding by a relational lattice.

Text is cut into *units* no piece crosses: letters, or other characters, with the spaces before them, and line feeds. The distinct units go through
a lattice on the cluster: their substrings of up to the longest piece are exploded, equi-joined to the piece table (its
size is the model's), grouped by unit again, and a higher-order ``aggregate`` folds Viterbi's table over the positions.

The model at hand is of the BPE kind, whose encoding is no maximum of a sum of scores, so no score is summed: the best
path is the one that merging by rank leaves. The fold takes the edges of a unit by rank and place, and its state is the set
of boundaries that still stand, as bits. An edge whose two ends stand, with one more boundary between them, is a merge, and
takes that one away. One pass does it, since no piece of the model is made of pieces that are merged after it
(:func:`piece_table` refuses a model with such a piece; runs of spaces share a rank, see :func:`turn`). The edges that are left between two boundaries next to each other
are the path. The result is the library's own.

Documents become codes, in chunks of ``CHUNK`` or more: places in a dictionary of the ``KNOWN`` most frequent units, which
goes along with each task, and running numbers for the chunk's other units. Those units alone are joined to the lattice's
table, and their ids go back to the chunk. Units are compared as text throughout. Text is read twice and never shuffled.

Memory: a unit without a cut in it, such as a run of one sign, is one group of the lattice (up to 16 edges a character).

Defined results. Null and empty texts have no tokens. Characters that the model lacks become the model's byte pieces.
Decoding joins pieces and drops the space that encoding adds in front; it gives the text back, but for the character
U+2581, which the model takes for a space, and reads byte pieces that are no UTF-8 as U+FFFD. Ids outside the model
decode to nothing. Null ids give null. Repeated rows give equal ids. Empty tables give empty results. :func:`encode` and
:func:`decode` keep the input's columns; a column named like the added one gives way to it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units of the dictionary that goes along with each task, at most (some 6 MB; the same at any size of the corpus).
KNOWN = 1 << 19
#: Codes of a chunk, from which on it ends; distinct words and units that a task counts at a time.
CHUNK = 1 << 16
TASK_WORDS, TASK_UNITS = 200_000, 450_000
NEVER = 2**31 - 1
#: Units longer than this are cut further where no piece has both characters side by side.
#: Those of fewer than LONG characters have their boundaries in one word.
LONG = 48
#: Characters of a block of a unit; boundaries of a word of them.
RUN = 256
BLOCK = 32
#: Bytes of the input, as planned, for one task of the lattice, and the most tasks.
TASK_BYTES = 4 << 20
MOST_TASKS = 50_000
STEPS = 16
#: Characters by which the lattice knows how long a piece may be there.
HEAD = 4


@dataclass
class Model:
    """A piece table: rank (smaller merges first) and id of every piece, and the ids of bytes."""

    rank: dict[str, int]
    ids: dict[str, int]
    byte_ids: list[int]
    text_of: list[bytes | None]  # by id; None: no text
    longest: int = 0
    pairs: set[str] = field(default_factory=set)
    pattern: re.Pattern | None = None

    @property
    def cut(self) -> tuple[re.Pattern, set[str]]:
        return self.pattern, self.pairs

    def __post_init__(self):
        self.longest = max(map(len, self.rank))
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        odd = "".join(sorted({c for p in self.rank for c in p if c.isalnum() and not c.isalpha() and not re.match(r"\d", c)}))
        self.pattern = _unit_pattern(odd)
        if any(" " in p.lstrip(" ") or len(self.pattern.findall(p)) > 1 for p in self.rank):
            raise ValueError("the model has pieces across units")


def load(path: str = MODEL) -> Model:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    rank, ids, text = {}, {}, []
    byte_ids = [0] * 256
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            b = int(piece[3:5], 16)
            byte_ids[b] = i
            text.append(bytes([b]))
        elif m.is_control(i) or m.is_unknown(i):
            text.append(None)
        else:
            piece = piece.replace(SPACE, " ")
            rank[piece], ids[piece] = min(NEVER - 1, int(-m.get_score(i))), i
            text.append(piece.encode())
    if 0 in byte_ids:
        raise ValueError("the model has no byte pieces")
    return Model(rank, ids, byte_ids, text)


def merges(piece: str, rank: dict[str, int]) -> list[tuple[int, int, int]] | None:
    """(rank, start, length) of the merges that make a piece of its characters, in the order they are done: the best rank first, then from the left. None: merging does not give the piece."""
    parts, out = list(piece), []
    while len(parts) > 1:
        r, i = min((rank.get(x + y, NEVER), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
        if r == NEVER:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out.append((r, len("".join(parts[:i])), len(parts[i])))
    return out


def turn(done: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Among merges of one rank, which go from the left: (from the piece's start, by length, how many after that) of the last merge.

    A piece that a merge of its own rank further right completes is merged right after that one.
    """
    r, start, length = done[-1]
    later = 0
    for before in reversed(done[:-1]):
        if before[0] != r or before[1] <= start:
            break
        (_, start, length), later = before, later + 1
    return start, length, later


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    rows = []
    for piece, r in model.rank.items():
        if (done := merges(piece, model.rank)) is not None:
            if done and max(done)[0] > r:
                raise ValueError(f"piece {model.ids[piece]} is made of pieces that are merged after it")
            rows.append((piece, model.ids[piece], r, *(turn(done) if done else (0, 1, 0))))
    return spark.createDataFrame(rows, "piece string, id int, r int, off int, span int, later int")


def _unit_pattern(odd: str) -> re.Pattern:
    """Letters, or everything else but spaces and line feeds, each with the spaces before it. odd: numbers that the pattern for letters would take in."""
    odd = re.escape(odd)
    return re.compile(f" *[^\\W\\d_{odd}]+| *(?:[^\\w \n]|[\\d_{odd}])+| +|\n")


def words_of(text: str | None) -> list[str]:
    """The text between single spaces, as the library sees it: each word stands for a space (the one that encoding adds, for the first) and itself. Further spaces are part of the word after them."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    words = text.split(" ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return words
    out, spaces = [], 0
    for w in words:
        if w:
            out.append(" " * spaces + w)
            spaces = 0
        else:
            spaces += 1
    return [*out, " " * (spaces - 1)] if spaces else out


def units_of(word: str, cut: tuple[re.Pattern, set[str]]) -> list[str]:
    """Units of a word and the space before it. cut: the model's pattern of units, and its pairs of characters."""
    pattern, pairs = cut
    if len(word) < LONG and word.isalpha():
        return [" " + word]
    found = pattern.findall(" " + word)
    if len(word) < LONG or max(map(len, found)) <= LONG:
        return found
    out = []
    for u in found:
        if len(u) <= LONG:
            out.append(u)
            continue
        at = 0
        for i in range(1, len(u)):
            if u[i - 1 : i + 1] not in pairs:
                out.append(u[at:i])
                at = i
        out.append(u[at:])
    return out


def unit_counts(texts: DataFrame, model: Model, tasks: int) -> DataFrame:
    """texts (text) -> (h, unit, c), partitioned by h, a hash of the unit."""
    shared = texts.sparkSession.sparkContext.broadcast(model.cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, words, counts = shared.value, Counter(), defaultdict(int)

        def to_units() -> None:
            for w, n in words.items():
                if len(w) < LONG and w.isalpha():
                    counts[" " + w] += n
                else:
                    for u in units_of(w, cut):
                        counts[u] += n
            words.clear()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["unit", "n"])
            counts.clear()
            return out

        for batch in batches:
            for x in batch.column(0):
                words.update(words_of(x.as_py()))
                if len(words) > TASK_WORDS:
                    to_units()
                    if len(counts) > TASK_UNITS:
                        yield flushed()
        to_units()
        if counts:
            yield flushed()

    counted = texts.mapInArrow(C.trimmed(run), "unit string, n bigint").withColumn("h", F.xxhash64("unit"))
    return counted.repartition(tasks, "h").groupBy("h", "unit").agg(F.sum("n").alias("c"))


def reaches(pieces: DataFrame, model: Model) -> DataFrame:
    """(head, reach): for the first HEAD characters of pieces, the longest piece that has them."""
    return pieces.filter(F.length("piece") >= HEAD).groupBy(F.substring("piece", 1, HEAD).alias("head")).agg(F.max(F.length("piece")).alias("reach"))


def lattice(units: DataFrame, pieces: DataFrame, reach: DataFrame, model: Model) -> DataFrame:
    """units (h, unit, c) partitioned by h -> (unit, c, ids)."""
    # rows carry a number; the unit itself goes with its first edge only. A long unit is cut in blocks first
    units = units.withColumn("k", F.monotonically_increasing_id())
    blocks = units.select("h", "k", "unit", "c", F.length("unit").alias("n"), F.explode(F.expr(f"sequence(0, length(unit) - 1, {RUN})")).alias("from"))
    blocks = blocks.select("h", "k", "n", "from", F.when(F.col("from") == 0, F.struct("unit", "c")).alias("own"), F.expr(f"substring(unit, from + 1, {RUN + model.longest})").alias("part"))
    edges = blocks.select("h", "k", "n", "from", "own", "part", F.explode(F.expr(f"sequence(0, least({RUN}, length(part)) - 1)")).alias("at"))
    edges = edges.select("h", "k", "n", (F.col("from") + F.col("at")).alias("a"), F.when(F.col("at") == 0, F.col("own")).alias("own"), F.expr(f"substring(part, at + 1, {model.longest})").alias("near"))
    edges = edges.withColumn("head", F.substring("near", 1, HEAD)).join(F.broadcast(reach), "head", "left")
    edges = edges.select("h", "k", "n", "a", "near", "own", F.explode(F.expr(f"sequence(1, least(length(near), coalesce(reach, {HEAD - 1})))")).alias("long"))
    edges = edges.select("h", "k", "n", "a", "long", F.when(F.col("long") == 1, F.col("own")).alias("own"), F.expr("substring(near, 1, long)").alias("piece"))
    edges = edges.join(F.broadcast(pieces), "piece", "left").filter("id IS NOT NULL OR long = 1")
    # a character that is no piece is an edge that nothing merges with; it has no id, and its ids are those of its bytes
    # bits of an edge's two boundaries and of those inside it, in the unit's word of boundaries, or from its block of them on
    edges = edges.withColumn("low", F.expr(f"if(n < {LONG}, a, a % {BLOCK})"))
    both = F.expr("shiftleft(1L, low) | shiftleft(1L, low + long)")
    inside = F.expr("shiftleft(shiftleft(1L, long - 1) - 1L, low + 1)")
    edge = F.struct(F.coalesce("r", F.lit(NEVER)).alias("r"), (F.col("a") + F.coalesce("off", F.lit(0))).alias("turn"), "span", "later", "a", both.alias("both"), inside.alias("inside"), "id")
    words = edges.groupBy("h", "k").agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list(edge)).alias("edges"))
    tokens = F.when(F.length("own.unit") < LONG, F.expr(_fold_word())).otherwise(F.expr(_fold_blocks()))
    byte_ids = ", ".join(map(str, model.byte_ids))
    sign = "hex(substring(unit, t.a + 1, 1))"
    of_bytes = f"transform(sequence(1, length({sign}), 2), k -> element_at(array({byte_ids}), 1 + cast(conv(substring({sign}, k, 2), 16, 10) AS int)))"
    words = words.select("own.unit", "own.c", F.sort_array(tokens).alias("tokens"))
    ids = f"if(exists(tokens, t -> t.id IS NULL), flatten(transform(tokens, t -> if(t.id IS NULL, {of_bytes}, array(t.id)))), tokens.id)"
    return words.select("unit", "c", F.expr(ids).alias("ids"))


#: Whether an edge can be merged, where w are the boundaries about it: its ends are boundaries, and one more inside it. And whether it is a token: none inside.
_MERGES = "(w & e.both) = e.both AND bit_count(w & e.inside) = 1"
_IS_TOKEN = "(w & e.both) = e.both AND (w & e.inside) = 0"
_TOKEN = "struct(e.a AS a, e.id AS id)"


def _fold_word() -> str:
    """Tokens (a, id) of a unit whose ``edges`` come by rank and place: at first all boundaries stand, and an edge that can be merged takes the one inside it away. All boundaries are one word of 64 bits."""
    fold = f"aggregate(edges, shiftleft(1L, length(own.unit) + 1) - 1L, (w, e) -> if({_MERGES}, w & ~e.inside, w))"
    return f"get(transform(array({fold}), w -> transform(filter(edges, e -> {_IS_TOKEN}), e -> {_TOKEN})), 0)"


def _fold_blocks() -> str:
    """The same for a unit of any length, with the boundaries in an array of words of ``BLOCK`` bits."""
    n = "length(own.unit)"
    start = f"transform(sequence(0, {n} div {BLOCK} + 1), i -> shiftleft(1L, least({BLOCK}, greatest(0, {n} + 1 - i * {BLOCK}))) - 1L)"
    near = f"get(s, e.a div {BLOCK}) | shiftleft(get(s, e.a div {BLOCK} + 1), {BLOCK})"
    put = f"concat(slice(s, 1, e.a div {BLOCK}), array(w & (shiftleft(1L, {BLOCK}) - 1L) & ~e.inside, shiftrightunsigned(w & ~e.inside, {BLOCK})), slice(s, e.a div {BLOCK} + 3, size(s)))"
    fold = f"aggregate(edges, {start}, (s, e) -> get(transform(array({near}), w -> if({_MERGES}, {put}, s)), 0))"
    is_token = f"get(transform(array({near}), w -> {_IS_TOKEN}), 0)"
    return f"get(transform(array({fold}), s -> transform(filter(edges, e -> {is_token}), e -> {_TOKEN})), 0)"


@dataclass
class Dictionary:
    """Ids of frequent units, by place; the units themselves as Arrow, and which of a range of counts they are."""

    units: pa.Array
    starts: np.ndarray
    ids: np.ndarray
    least: int | None  # frequent units have a step of at least this; None: there are none


def _step() -> Column:
    """Units are ranked by count, in STEPS steps of a doubling."""
    return F.floor(F.log2("c") * STEPS).cast("int")


def dictionary(table: DataFrame, most: int) -> Dictionary:
    """At most ``most`` of the most frequent units of (unit, c, ids): all units of a step, or none."""
    total, least = 0, None
    for r in table.groupBy(_step().alias("s")).count().orderBy(F.desc("s")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["s"]
    kept = table.filter(_step() >= least if least is not None else F.lit(False)).toArrow()
    if not kept.num_rows:
        return Dictionary(pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.int32), least)
    # frequent units first: small codes take less room
    kept = kept.sort_by([("c", "descending"), ("unit", "ascending")])
    flat, starts = _ragged(kept.column("ids").combine_chunks())
    return Dictionary(kept.column("unit").combine_chunks(), starts, flat, least)


def _ragged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list array, and where each list starts (and the last one ends)."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)


def _gathered(at: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``at`` one after another, and their lengths."""
    lengths = starts[at + 1] - starts[at]
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


class _Codes(dict):
    """Codes (bytes of uint32) of words: places in the dictionary, or numbers from its size on for units that it lacks, in the order they come up.

    It holds the words that are one unit of the dictionary (those units stand here alone), and remembers up to ``room`` others that have only such units.
    """

    def __init__(self, known: pa.Array, cut: tuple, room: int = 150_000):
        super().__init__()
        self.n, self.known = len(known), {}
        for at in range(0, self.n, 1 << 14):
            for i, u in enumerate(known.slice(at, 1 << 14).to_pylist(), at):
                if u[0] == " " and u[1:].isalpha():
                    self[u[1:]] = i.to_bytes(4, "little")
                else:
                    self.known[u] = i.to_bytes(4, "little")
        self.cut, self.room, self.rare, self.passing, self.others = cut, room, {}, [], []

    def _unit(self, u: str) -> bytes | None:
        """The code of a unit of the dictionary. A word of letters has a longer code, or a number from n on, where it is none."""
        code = self.known.get(u)
        if code is None and u[0] == " " and u[1:].isalpha():
            code = self.get(u[1:])
            if code is not None and (len(code) != 4 or int.from_bytes(code, "little") >= self.n):
                return None
        return code

    def __missing__(self, word: str) -> bytes:
        if len(word) < LONG and word.isalpha():  # one unit, and none of the dictionary's
            self.passing.append(word)
            self[word] = out = (self.n + self.rare.setdefault(" " + word, len(self.rare))).to_bytes(4, "little")
            return out
        out, before = b"", len(self.passing)
        for u in units_of(word, self.cut):
            code = self._unit(u)
            if code is None:
                code = (self.n + self.rare.setdefault(u, len(self.rare))).to_bytes(4, "little")
                if len(self.passing) == before:
                    self.passing.append(word)
            out += code
        if len(self.passing) == before:
            self.others.append(word)
        self[word] = out
        return out

    def next_chunk(self) -> list[str]:
        """The chunk's units that the dictionary lacks."""
        out = list(self.rare)
        self.rare = {}
        for w in self.passing:
            self.pop(w, None)
        self.passing = []
        if len(self.others) > self.room:
            for w in self.others:
                self.pop(w, None)
            self.others = []
        return out


_kept: list = []


def _codes_for(shared) -> _Codes:
    """The codes of a broadcast dictionary, made once in a worker: its tasks go on with them, and with the words that they have met."""
    if not _kept or _kept[0] is not shared:
        _kept.clear()
        _kept[:] = [shared, _Codes(*shared.value)]
    return _kept[1]


def _forget_codes() -> None:
    _kept.clear()


def _packed(codes: list[bytes]) -> bytes:
    """zstandard of the codes' first bytes, second bytes and so on."""
    return zstandard.ZstdCompressor(level=1).compress(np.frombuffer(b"".join(codes), np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", model: Model | None = None, known: int = KNOWN, keep: list[str] | None = None, decoded_col: str | None = None) -> DataFrame:
    """``df`` with the token ids of its text. ``keep``: the columns that go along (all of them); a text that is not kept is read and never written or shuffled. ``decoded_col``: adds what the ids decode to, as :func:`decode` does, in the same pass."""
    spark, model = df.sparkSession, model or load()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(C.planned_bytes(df) // TASK_BYTES, MOST_TASKS))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks // 4)
    pieces = piece_table(spark, model)
    units = unit_counts(C.only(df, text=text_col), model, tasks)
    encoded = C.written(lattice(units, pieces, reaches(pieces, model), model), "encoded", "zstd")
    words = dictionary(encoded, known)
    n_known = len(words.units)
    shared = spark.sparkContext.broadcast((words.units, model.cut))
    keep = [c for c in (df.columns if keep is None else keep) if c not in (out_col, decoded_col)]
    names = [f"c{i}" for i in range(len(keep))]
    base = df.select(df[text_col].cast("string").alias("text"), F.struct(*[df[c].alias(n) for c, n in zip(keep, names)], F.lit(0).alias("none")).alias("row"))
    row_type = base.schema["row"].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _codes_for(shared)
        numbers = C.bucket_numbers(TaskContext.get().partitionId(), buckets)
        for batch in batches:
            texts, rows, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:
                codes, lengths, size, first = [], [], 0, at
                while at < batch.num_rows and size < CHUNK:
                    codes.append(b"".join(map(look.__getitem__, words_of(texts[at].as_py()))))
                    lengths.append(len(codes[-1]) // 4)
                    size += lengths[-1]
                    at += 1
                made = [pa.array([next(numbers)]), pa.ListArray.from_arrays(pa.array([0, at - first], pa.int32()), rows.slice(first, at - first)), pa.array([lengths], pa.list_(pa.int32())), pa.array([_packed(codes)], pa.binary()), pa.array([look.next_chunk()], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(made, names=["chunk", "rows", "lengths", "codes", "rare"])

    # a task's chunks are one bucket of the table, so they meet what comes back to them without a shuffle
    table = C.written_buckets(base.mapInArrow(C.trimmed(chunks), f"chunk bigint, rows array<{row_type}>, lengths array<int>, codes binary, rare array<string>"), "chunks", "chunk", buckets)
    # what the dictionary lacks is joined by unit (a rare one, so no key is hot), and goes back to its chunk
    asked = table.select("chunk", F.posexplode("rare").alias("at", "unit"))
    rare = encoded.filter(_step() < words.least) if words.least is not None else encoded
    found = asked.join(rare.select("unit", "ids"), "unit").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("found"))
    found = C.written(found, "found", "zstd")
    C.forget(spark, encoded)
    whole = table.select("chunk", "rows", "lengths", "codes", F.size("rare").alias("n_rare")).join(found, "chunk", "left")
    lists = spark.sparkContext.broadcast((words.ids, words.starts, model.text_of if decoded_col else None))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_codes()
        flat, starts, text_of = lists.value
        texts = _Texts(text_of) if text_of else None
        for batch in batches:
            for i in range(batch.num_rows):
                rows, lengths, packed, n_rare, found = (batch.column(j).slice(i, 1) for j in range(5))
                codes, n_rare = _unpacked(packed[0].as_py()), n_rare[0].as_py()
                own = found.flatten()
                if len(own) != n_rare:
                    raise RuntimeError(f"{n_rare - len(own)} units have no ids")
                own_flat, own_starts = _ragged(own.field("ids")) if n_rare else (np.zeros(0, np.int32), np.zeros(1, np.int64))
                is_rare = codes >= n_known
                if is_rare.all() or not is_rare.any():
                    ids, sizes = _gathered(codes, flat, starts) if not is_rare.any() else _gathered(codes - n_known, own_flat, own_starts)
                else:
                    sizes = np.empty(len(codes), np.int64)
                    usual, sizes[~is_rare] = _gathered(codes[~is_rare], flat, starts)
                    others, sizes[is_rare] = _gathered(codes[is_rare] - n_known, own_flat, own_starts)
                    ids, here = np.empty(len(usual) + len(others), np.int32), np.repeat(is_rare, sizes)
                    ids[here], ids[~here] = others, usual
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy())])]
                made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([rows.flatten(), made, *([texts(made)] if texts else [])], names=["row", "ids", *(["decoded"] if texts else [])])

    out = whole.select("rows", "lengths", "codes", "n_rare", "found").mapInArrow(C.trimmed(fill), f"row {row_type}, ids array<int>" + (", decoded string" if decoded_col else ""))
    return out.select(*[F.col("row")[n].alias(c) for c, n in zip(keep, names)], F.col("ids").alias(out_col), *([F.col("decoded").alias(decoded_col)] if decoded_col else []))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: Model | None = None) -> DataFrame:
    """``df`` with the text of token ids."""
    model = model or load()
    shared = df.sparkSession.sparkContext.broadcast(model.text_of)
    keep = [c for c in df.columns if c != out_col or c == ids_col]
    # the ids travel once, as a field of the row
    base = df.select(F.struct(*[df[c] for c in keep]).alias("row"))
    place = keep.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), texts(part.column(0).field(place))], names=["row", "decoded"])

    out = base.mapInArrow(run, f"row {base.schema['row'].dataType.simpleString()}, decoded string")
    return out.select(*[F.col("row")[c].alias(c) for c in keep if c != out_col], F.col("decoded").alias(out_col))


class _Texts:
    """Texts of lists of ids: the pieces of all lists are taken at once, and cut where a list ends."""

    def __init__(self, text_of: list[bytes | None]):
        known = [t or b"" for t in text_of]
        self.n = len(known)
        # the same again without the space in front, for the first id of a list; and nothing, for an id outside the model
        self.pieces = pa.array([*known, *[t.removeprefix(b" ") for t in known], b""], pa.binary())

    def __call__(self, lists: pa.Array) -> pa.Array:
        flat, starts = _ragged(lists.cast(pa.list_(pa.int32())).fill_null([]))
        at = np.where((flat >= 0) & (flat < self.n), flat, 2 * self.n).astype(np.int32)
        filled = np.flatnonzero(np.diff(starts))
        heads = starts[:-1][filled]
        at[heads] = np.where(at[heads] < self.n, at[heads] + self.n, at[heads])
        taken = self.pieces.take(pa.array(at))
        ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)[starts] if len(taken) else np.zeros(len(starts), np.int32)
        raw = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.tobytes()), taken.buffers()[2]]) if len(taken) else pa.array([b""] * len(lists), pa.binary())
        try:
            out = raw.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            out = pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())
        return pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.string())) if lists.null_count else out


def text_from(ids: list[int], text_of: dict[int, bytes | None]) -> str:
    raw = b"".join([text_of.get(i) or b"" for i in ids])
    return raw.decode("utf-8", "replace").removeprefix(" ")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the text's SHA-256 goes along in its place
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("sha", text_hash(F.col("text")))
    out = encode(docs, keep=["doc_id", "sha"], decoded_col="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (text_hash(F.col("decoded")) == F.col("sha")).alias("round_trip"))


def text_hash(text: Column) -> Column:
    """SHA-256, as bytes."""
    return F.unhex(F.sha2(C.empty_text(text).cast("binary"), 256))
