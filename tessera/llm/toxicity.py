"""Toxicity: compression-distance classification with zstandard dictionaries.

Two dictionaries are trained by zstandard's own trainer: one on windows of ordinary text, one on the word openings of
toxic text that ordinary text hardly has. Every window of a document is compressed twice, primed with the ordinary
dictionary and with both, so the difference of the two lengths is what the toxic dictionary saves. Literals stay
uncompressed (zstandard's fast mode), so that lengths differ by matches alone. A document's score is a logistic function
of its savings per byte, per window and at most, and of the share of windows above length thresholds; the weights are
calibrated on labelled documents that the dictionaries did not see.

Bound: ``TRAIN_ROWS`` labelled documents of each class, drawn by hash of the id, train and calibrate (the model is a
classifier fitted on a bounded sample), each with its whole text. Every window of every document is scored.

Defined results. Null and empty texts are one window holding a space, and score as such (0 to 1, never null). Labels
that are null or belong to no document are not used; a document labelled twice counts with its larger label. Without
labels of both classes the score of every text is the share of label 1 in the sample, or 0. Repeated rows score alike.
Empty tables give empty results; other columns pass through :func:`score`, which replaces a column ``toxicity``.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Labelled documents of each class at most.
TRAIN_ROWS = 4000
FOLDS = 5
WINDOW = 512
#: A word opening: the space before the word and its first bytes.
OPENING = 8
MIN_OPENING = 6
#: An opening tells if this many times as frequent in toxic documents, and in so many percent of them.
RATIO = 8.0
LEAST_SHARE = 3
ORDINARY_BYTES = 16_384
TOXIC_BYTES = 4096
#: The trainer cuts some openings; so many times their size in all makes room for each of them whole.
SPARE = 2
THRESHOLDS = (3, 5, 8)


def normal(text: str | None) -> bytes:
    return b" " + b"".join(w + b" " for w in (text or "").lower().encode("utf-8", "replace").split())


def openings(text: bytes) -> list[bytes]:
    """Openings of a text's words, short words with the space after them; shorter than a match: none."""
    return [o for w in text.split() if len(o := (b" " + w + b" ")[:OPENING]) >= MIN_OPENING]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None
    base: float

    def scorer(self):
        """A function from text to score, with its compressors made once."""
        if self.weights is None:
            return lambda text: self.base
        lengths = _lengths(self.ordinary, self.toxic)

        def one(text: str | None) -> float:
            z = float(self.weights @ features(normal(text), lengths))
            return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

        return one


def _lengths(ordinary: bytes, toxic: bytes):
    params = zstandard.ZstdCompressionParameters(
        compression_level=1, strategy=zstandard.STRATEGY_FAST, min_match=6, target_length=1, window_log=17, hash_log=14,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )

    def primed(content: bytes):
        kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        kept.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=kept, compression_params=params).compress

    # zstandard ignores a dictionary of under 8 bytes
    plain, both = primed(ordinary.rjust(64)), primed((ordinary + toxic).rjust(64))
    return lambda window: (len(plain(window)), len(both(window)))


def features(text: bytes, lengths) -> np.ndarray:
    """Per document: mean savings of a window, savings per byte (long texts count more surely), largest, shares above the thresholds, 1."""
    saved = np.array([a - b for a, b in (lengths(text[i : i + WINDOW]) for i in range(0, max(1, len(text)), WINDOW))], float)
    top = float(saved.max())
    n = len(text)
    rate = (saved.sum() - 1) / (n + 200) * 100
    return np.array([saved.mean() / 4, rate, min(rate, 1.0), math.log1p(max(top, 0.0)), *[(saved >= t).mean() for t in THRESHOLDS], 1.0])


def _trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """The content of a dictionary that zstandard trains; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size + 300, samples, **how).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    in_ordinary = Counter(o for t in ordinary for o in set(openings(t)))
    in_toxic = Counter(o for t in toxic for o in set(openings(t)))
    least = max(3, len(toxic) * LEAST_SHARE // 100)
    telling = {o for o, n in in_toxic.items() if n >= least and (in_ordinary[o] + 0.5) * len(toxic) * RATIO <= n * len(ordinary)}
    # each sample is one opening after bytes that occur once, so that the trainer's segments are whole openings
    found = sorted(o.ljust(OPENING) for t in toxic for o in set(openings(t)) & telling)
    samples = sorted(hashlib.blake2b(b"%d" % i, digest_size=8).digest() + o for i, o in enumerate(found))
    size = min(TOXIC_BYTES, SPARE * OPENING * len(telling))
    windows = [t[i : i + 256] for t in ordinary for i in range(0, len(t), 256)]
    return _trained(windows, ORDINARY_BYTES, k=64, d=8), _trained(samples, size, k=OPENING, d=8) if samples else b""


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton's method; the penalty spares the constant."""
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """rows: (text, 0 or 1). Copies count once. Two thirds train the dictionaries, one third calibrates."""
    unique = sorted({(normal(t), int(y)) for t, y in rows})
    base = sum(y for _, y in unique) / len(unique) if unique else 0.0
    toxic, ordinary = [t for t, y in unique if y], [t for t, y in unique if not y]
    if min(len(toxic), len(ordinary)) < 6:
        return Model(b"", b"", None, base)
    for_dictionary = lambda texts: [t for i, t in enumerate(texts) if i % 3]
    held = [(t, 1) for t in toxic[::3]] + [(t, 0) for t in ordinary[::3]]
    o, t = _dictionaries(for_dictionary(toxic), for_dictionary(ordinary))
    lengths = _lengths(o, t)
    x = np.array([features(t, lengths) for t, _ in held])
    return Model(o, t, _logistic(x, np.array([y for _, y in held], float)), base)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: bool = True) -> Model:
    """Fit on at most TRAIN_ROWS documents of each class; ``held_out`` spares ids whose crc32 modulo 5 is 0. The sample, bounded in rows, comes to the driver with its whole texts."""
    marks = C.only(labels, id=id_col, y=label_col).filter("id IS NOT NULL AND y IS NOT NULL")
    if held_out:
        marks = marks.filter(C.crc_mod(F.col("id"), FOLDS) != 0)
    marks = marks.groupBy("id").agg(F.max(F.col("y").cast("int")).alias("y")).filter("y IN (0, 1)")
    draw = marks.withColumn("draw", F.md5(C.id_text(F.col("id")).cast("binary")))
    drawn = C.union_all([draw.filter(F.col("y") == y).orderBy("draw", "id").limit(TRAIN_ROWS) for y in (0, 1)])
    texts = C.only(docs, id=id_col, text=text_col).join(F.broadcast(drawn), "id").select(F.col("text").cast("string").alias("text"), "y")
    return fit([(r.text, r.y) for r in texts.toLocalIterator()])


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``df`` with a score from 0 to 1 for every text."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")
        C.trim()

    return df.withColumn(out_col, scored(df[text_col].cast("string")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, out_col="score")
    return out.select("doc_id", (C.crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
