"""LM scoring with Brown classes: p(word | word before) = p(class | class before) * p(word | class).

Tokens are ASCII-lower-cased words and one end per document; the end also stands before the first word.

1. Words are counted over all training documents; so are pairs of adjacent *types*. A type is a frequent word (the
   ``CORE`` most frequent) or, for all others, one of ``SHAPES`` buckets of the last bytes of the word.
2. Exchange clustering of types: each in turn moves to the class that raises the likelihood of the class bigrams most, until
   a sweep moves little. The driver holds the type pair counts for it, at most (CORE + SHAPES + 1)^2 numbers.
3. Exchange clustering of the vocabulary: for each word beyond the core that occurs ``OWN`` times or more and is among the
   ``KNOWN`` most frequent, the classes before and after it are counted over all training documents, on the cluster, and it
   moves from its bucket's class to the class that explains them best. Only rarer words stay with their bucket.
4. Class bigrams are counted again, with the final classes, and smoothed towards class frequencies. A word with a class of
   its own has its share of that; a rarer one its share of its bucket; and all that Good and Turing's estimate (words seen once) leaves
   of a bucket goes to one unknown word in it: any new word of the bucket counts as that one.
5. Scoring is one pass over the documents: the known words, with their classes and counts, go along as a dictionary of
   bounded size; the remaining tokens of a document (about one in fourteen) are joined to the counts on the cluster.

Counts are exact and over all training documents. Scores are log10, rounded to 9 decimals, since sums of floats depend on
their order.

Defined results. Null text is empty text: one token, the end. A null id counts as the text ``null``. Without training
documents every count is zero and the model's score is the base's. Repeated rows count, and score, as often as they
occur. A text of any length is scored whole. Empty tables give empty results. Other columns of the input are not carried.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

FOLDS, HELD = 7, 2
CORE = 2048
SHAPES = 512
SHAPE_BYTES = 4
CLASSES = 64
SWEEPS = 8
KNOWN = 1 << 18
#: Occurrences from which on a word's own contexts choose its class.
OWN = 5
#: Pseudo-counts of class frequencies in a transition.
PRIOR = 4.0
END = ""
#: Steps of a doubling in which words are ranked by count, when KNOWN words are chosen.
STEPS = 16


def shape(word: bytes) -> int:
    return zlib.crc32(word[-SHAPE_BYTES:]) % SHAPES


def _shape_column(word: str):
    return F.pmod(F.crc32(F.substring(F.col(word).cast("binary"), -SHAPE_BYTES, SHAPE_BYTES)), F.lit(SHAPES).cast("long")).cast("int")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """texts (text) -> (word, c), the end among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        ends = 0

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            ends += batch.num_rows
            for x in batch.column(0):
                counts.update(words_of(x.as_py()))
                if len(counts) > 250_000:
                    yield flushed()
        if ends:
            counts[END.encode()] = ends
            yield flushed()

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def frequent(vocabulary: DataFrame, most: int = KNOWN) -> dict[bytes, int]:
    """At most ``most`` of the most frequent words (all words of a count, or none), with counts; the end always."""
    step = F.floor(F.log2("c") * STEPS).cast("int")
    total, least = 0, None
    for r in vocabulary.filter(F.col("word") != END).groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["s"]
    kept = vocabulary.filter((F.col("word") == END) | (step >= F.lit(least)) if least is not None else F.col("word") == END)
    table = kept.select("word", "c").toArrow()
    return {w.encode(): c for w, c in zip(table.column(0).to_pylist(), table.column(1).to_pylist())}


def pair_counts(texts: DataFrame, core: dict[bytes, int]) -> np.ndarray:
    """Counts of adjacent types, (types, types): 0 is the end, then the core words, then the shapes."""
    n_types = 1 + CORE + SHAPES
    shared = texts.sparkSession.sparkContext.broadcast(core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_of = _Memo(shared.value, lambda w: 1 + CORE + shape(w))
        tally = Tally(n_types * n_types)
        for batch in batches:
            for x in batch.column(0):
                words = words_of(x.as_py())
                ids = np.zeros(len(words) + 2, np.int64)
                ids[1:-1] = [type_of[w] for w in words]
                tally.add(ids[:-1] * n_types + ids[1:])
        yield tally.rows()

    table = texts.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_types * n_types)  # doubles hold counts exactly up to 2**53
    for part in table.to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out.reshape(n_types, n_types)


class Tally:
    """Counts of codes under ``size``, in one array: 52 MB for pairs of types."""

    def __init__(self, size: int):
        self.counts, self.held, self.n = np.zeros(size, np.int64), [], 0

    def add(self, codes: np.ndarray) -> None:
        self.held.append(codes)
        self.n += len(codes)
        if self.n > 1 << 20:
            self.settle()

    def settle(self) -> None:
        if self.held:
            self.counts += np.bincount(np.concatenate(self.held), minlength=len(self.counts))
            self.held, self.n = [], 0

    def rows(self) -> pa.RecordBatch:
        self.settle()
        code = np.flatnonzero(self.counts)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(self.counts[code])], names=["code", "n"])


class _Memo(dict):
    """A dictionary that works out what it lacks, and forgets that part when it grows large."""

    def __init__(self, known: dict, make, room: int = 300_000):
        super().__init__(known)
        self.known, self.make, self.most = known, make, len(known) + room

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
            self.update(self.known)
        self[word] = out = self.make(word)
        return out


@dataclass
class Classes:
    """Classes of known words, by place (the end at 0), and of buckets."""

    place: dict[bytes, int]
    cls: np.ndarray
    shape_cls: np.ndarray

    def coder(self):
        """A function from words to a class code of each, with the end before and after them: a known word is its place, any other -1 - its bucket."""
        codes = _Memo(self.place, lambda w: -1 - shape(w))
        # negative codes count from the end
        table = np.concatenate([self.cls, self.shape_cls[::-1]])

        def of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            at = np.zeros(len(words) + 2, np.int64)
            at[1:-1] = [codes[w] for w in words]
            return at, table[at]

        return of


def class_pairs(texts: DataFrame, classes: Classes, n_classes: int) -> np.ndarray:
    """Counts of adjacent classes."""
    shared = texts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tally = shared.value.coder(), Tally(n_classes * n_classes)
        for batch in batches:
            for x in batch.column(0):
                _, cls = coder(words_of(x.as_py()))
                tally.add(cls[:-1] * n_classes + cls[1:])
        yield tally.rows()

    out = np.zeros(n_classes * n_classes)
    for part in texts.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out.reshape(n_classes, n_classes)


def context_counts(texts: DataFrame, classes: Classes, n_classes: int, first: int) -> DataFrame:
    """(code, n): how often a class stands before (place * 2 * n_classes + class) and after (n_classes more) the word of each place from ``first`` on."""
    shared = texts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value.coder()
        held: list[np.ndarray] = []
        n = 0

        def flushed() -> pa.RecordBatch:
            code, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], names=["code", "n"])

        for batch in batches:
            for x in batch.column(0):
                at, cls = coder(words_of(x.as_py()))
                here = np.flatnonzero(at[1:-1] >= first) + 1
                base = at[here] * (2 * n_classes)
                held += [base + cls[here - 1], base + n_classes + cls[here + 1]]
                n += 2 * len(here)
                if n > 1 << 22:
                    yield flushed()
                    held, n = [], 0
        if held:
            yield flushed()

    return texts.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def settle(texts: DataFrame, classes: Classes, between: np.ndarray, first: int) -> np.ndarray:
    """Classes of the words, those from place ``first`` on anew: of each, the one that explains best which classes stand before and after it, with all else as it is."""
    n_classes = len(between)

    smooth = between + 0.1
    after = np.log(smooth / smooth.sum(1, keepdims=True))  # [c, k]: k after c
    size = smooth.sum(0)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            places, row = np.unique(code // (2 * n_classes), return_inverse=True)
            table = np.zeros((len(places), 2 * n_classes))
            table[row, code % (2 * n_classes)] = n
            total = table[:, :n_classes].sum(1, keepdims=True)
            gain = table[:, :n_classes] @ after + table[:, n_classes:] @ after.T - total * np.log(size + total)
            gain[:, 0] = -np.inf  # the end's own
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(gain.argmax(1))], names=["place", "cls"])

    # a word's counts are one row, so a word is whole in its batch
    place = F.floor(F.col("code") / (2 * n_classes))
    rows = context_counts(texts, classes, n_classes, first).groupBy(place.alias("place")).agg(F.collect_list(F.struct("code", "n")).alias("c"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                flat = batch.column(0).slice(at, 4096).flatten()
                if len(flat):
                    yield from best(iter([pa.RecordBatch.from_arrays([flat.field("code"), flat.field("n")], names=["code", "n"])]))

    found = rows.select("c").mapInArrow(each, "place bigint, cls bigint").toArrow()
    out = classes.cls.copy()
    for part in found.to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each type. The end keeps a class of its own, class 0."""
    n_types = len(pairs)
    weight = pairs.sum(1) + pairs.sum(0)
    order = [t for t in np.argsort(-weight, kind="stable").tolist() if t]
    of = np.zeros(n_types, np.int64)
    # a random start (the same one each time): from an even one, no single move may gain
    of[order] = 1 + np.random.default_rng(0).integers(0, classes - 1, len(order))
    one = np.zeros((n_types, classes))
    one[np.arange(n_types), of] = 1
    after = pairs @ one  # after[t, c]: t, then a type of c
    before = pairs.T @ one  # before[t, c]: a type of c, then t
    between = one.T @ after
    everything = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for t in order:
            if not weight[t]:
                continue
            a, self_n = of[t], float(pairs[t, t])
            r, left = after[t].copy(), before[t].copy()
            r[a] -= self_n
            left[a] -= self_n
            between[a] -= r
            between[:, a] -= left
            between[a, a] -= self_n
            rows, cols = between.sum(1), between.sum(0)
            gain_row = _xlogx(between + r) - _xlogx(between)
            gain_col = _xlogx(between + left[:, None]) - _xlogx(between)
            own = between[everything, everything]
            gain = gain_row.sum(1) - gain_row[everything, everything] + gain_col.sum(0) - gain_col[everything, everything]
            gain += _xlogx(own + r + left + self_n) - _xlogx(own)
            gain -= _xlogx(rows + r.sum() + self_n) - _xlogx(rows) + _xlogx(cols + left.sum() + self_n) - _xlogx(cols)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            between[b] += r
            between[:, b] += left
            between[b, b] += self_n
            if b != a:
                moved += 1
                of[t] = b
                after[:, a] -= pairs[:, t]
                after[:, b] += pairs[:, t]
                before[:, a] -= pairs[t]
                before[:, b] += pairs[t]
        if moved * 200 < n_types:
            break
    return of


@dataclass
class Model:
    total: int
    distinct: int
    words: dict[bytes, int]  # place in the arrays below; the end is at 0
    cls: np.ndarray
    word_log: np.ndarray  # log10 p(word | class), of frequent words
    base_log: np.ndarray
    transition: np.ndarray
    shape_cls: np.ndarray
    shape_log: np.ndarray  # log10 p(shape | class)
    shape_total: np.ndarray
    shape_new: np.ndarray  # share of a shape's tokens that new words have

    @property
    def room(self) -> int:
        return self.total + self.distinct + 1

    @property
    def trained(self) -> bool:
        return self.total > 0


def train(texts: DataFrame) -> tuple[Model, DataFrame]:
    """texts (text) of the training documents -> the model, and the table of all word counts."""
    vocabulary = C.written(word_counts(texts), "words")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    known = frequent(vocabulary) if total else {}
    ranked = sorted((w for w in known if w), key=lambda w: (-known[w], w))
    core = {w: k + 1 for k, w in enumerate(ranked[:CORE])}
    pairs = pair_counts(texts, core) if total else np.zeros((1 + CORE + SHAPES,) * 2)
    of = exchange(pairs)
    n_classes = CLASSES
    words = [END.encode(), *ranked]
    c = np.array([known.get(w, 0) for w in words], float)
    shapes = np.array([shape(w) for w in words])
    shape_cls = of[1 + CORE + np.arange(SHAPES)]
    # words come by count, so those with a class of their own are the first ones: the end, the core, and what is frequent enough
    n_core = min(len(words), 1 + CORE)
    n_own = max(n_core, 1 + int((c[1:] >= OWN).sum()))
    classes = Classes({w: k for k, w in enumerate(words[:n_own]) if k}, np.concatenate([of[:n_core], shape_cls[shapes[n_core:n_own]]]), shape_cls)
    one = np.zeros((len(of), n_classes))
    one[np.arange(len(of)), of] = 1
    between = one.T @ (pairs @ one)
    if n_own > n_core:
        classes.cls = settle(texts, classes, between, n_core)
        between = class_pairs(texts, classes, n_classes)

    # buckets: all other words
    t, once = np.zeros(SHAPES), np.zeros(SHAPES)
    rest = vocabulary.filter(F.col("word") != END).withColumn("shape", _shape_column("word"))
    if total:
        for r in rest.groupBy("shape").agg(F.sum("c").alias("t"), F.count_if(F.col("c") == 1).alias("once")).collect():
            t[r["shape"]], once[r["shape"]] = r["t"], r["once"]
        np.subtract.at(t, shapes[1:n_own], c[1:n_own])
        np.subtract.at(once, shapes[1:n_own], c[1:n_own] == 1)
    overall = (once.sum() + 0.5) / (t.sum() + 1)
    new = np.where(t > 0, np.clip((once + 2 * overall) / (t + 2), 1e-6, 0.999), 1.0)

    mass = np.concatenate([c[:n_own], t]) + 0.1
    type_cls = np.concatenate([classes.cls, shape_cls])
    type_log = np.log10(mass / np.bincount(type_cls, mass, n_classes)[type_cls])
    class_n = between.sum(0)
    share = (class_n + 0.5) / (class_n + 0.5).sum()
    transition = np.log10((between + PRIOR * share) / (between.sum(1, keepdims=True) + PRIOR))
    others = shapes[n_own:]
    log = np.concatenate([type_log[:n_own], type_log[n_own + others] + np.log10((1 - new[others]) * c[n_own:] / np.maximum(t[others], 1))])
    cls = np.concatenate([classes.cls, shape_cls[others]])
    room = total + distinct + 1
    model = Model(int(total), int(distinct), {w: k for k, w in enumerate(words)}, cls, log, np.log10((c + 1) / room), transition, shape_cls, type_log[n_own:], t, new)
    return model, vocabulary


def score(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """docs (id, text, ...) -> id, the other columns, n_tokens, n_known, base_score, score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "text"]
    kept = docs.select("text", *keep)
    end_known = int(model.trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place, shape_cls = m.words, m.shape_cls
        for batch in batches:
            n_tokens, n_known, base, own, rare = [], [], [], [], []
            for x in batch.column(0):
                words = words_of(x.as_py())
                at = np.array([place.get(w, -1) for w in words], np.int64)
                odd = np.flatnonzero(at < 0).tolist()
                others = [words[i] for i in odd]
                cls = np.zeros(len(words) + 2, np.int64)
                cls[1:-1] = m.cls[at]
                if odd:
                    cls[1 + np.array(odd)] = shape_cls[[shape(w) for w in others]]
                seen = at[at >= 0]
                n_tokens.append(len(words) + 1)
                n_known.append(len(seen) + end_known)
                base.append(m.base_log[seen].sum() + m.base_log[0])
                own.append(m.transition[cls[:-1], cls[1:]].sum() + m.word_log[seen].sum() + m.word_log[0])
                rare.append([w.decode("utf-8", "replace") for w in others])
            made = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64()), pa.array(rare, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*batch.schema.names[1:], "n_tokens", "n_known", "base", "own", "rare"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    passed = kept.mapInArrow(run, f"{fields}, n_tokens bigint, n_known bigint, base double, own double, rare array<string>")
    rows = C.written(passed.withColumn("row", F.monotonically_increasing_id()), "lm")
    # what the dictionary lacks: a bounded share of a word's rows meets in one task, since frequent words are in it
    tokens = rows.select("row", F.explode("rare").alias("word"))
    met = tokens.join(vocabulary.select("word", "c"), "word", "left").withColumns({"c": F.coalesce("c", F.lit(0)), "shape": _shape_column("word")})
    per_shape = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(model.shape_log, model.shape_total, model.shape_new))], "shape int, s_log double, s_total double, s_new double")
    met = met.join(F.broadcast(per_shape), "shape")  # SHAPES rows
    in_shape = F.when(F.col("c") > 0, (1 - F.col("s_new")) * F.col("c") / F.col("s_total")).otherwise(F.col("s_new"))
    sums = met.groupBy("row").agg(F.count_if(F.col("c") > 0).alias("more"), F.sum(F.log10((F.col("c") + 1) / F.lit(float(model.room)))).alias("base2"), F.sum(F.col("s_log") + F.log10(in_shape)).alias("own2"))
    out = rows.drop("rare").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = F.round(F.col("base") + zero("base2"), 9)
    own = F.round(F.col("own") + zero("own2"), 9) if model.trained else base
    return out.select(*keep, "n_tokens", (F.col("n_known") + zero("more")).alias("n_known"), base.alias("base_score"), own.alias("score"))


def perplexity(scored: DataFrame) -> float:
    """10 to the negative mean log10 probability of a token."""
    s, n = scored.agg(F.sum("score"), F.sum("n_tokens")).first()
    return 10 ** (-s / n)


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", C.crc_mod(F.col("doc_id"), FOLDS) == HELD)
    model, vocabulary = train(docs.filter("NOT held_out").select("text"))
    out = score(docs, model, vocabulary)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
