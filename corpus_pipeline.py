"""The corpus pipeline: each stage works on all that the one before it kept.

Toxic documents go; of equal texts one stays; of near copies one document of each group stays; sources are mixed to their
target weights (a document that the mix takes twice has two rows); texts become token ids, and are decoded again.

Defined results. Each stage is an operator of :mod:`tessera.llm`, with its results for nulls, empty and long texts, ties and
repeated rows; without labels no document is toxic, and an empty table stays empty. Other columns go along to the end, but
for ``text`` and for names that the last stage gives (``ids``, ``n_tokens``, ``round_trip``); names that begin with two
underscores are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _common as C
from tessera.llm import exact_dedup, mixing, pieces, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out_col="__toxicity").filter("__toxicity < 0.5").drop("__toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, the one with the smallest id."""
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes."""
    return mixing.mix(docs).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The other columns with token ids in place of the text, their number, and whether they decode to the text."""
    docs = docs.withColumn("__sha", pieces.text_hash(F.col("text")))
    out = pieces.encode(docs, keep=[c for c in docs.columns if c != "text"], decoded_col="__decoded")
    round_trip = pieces.text_hash(F.col("__decoded")) == F.col("__sha")
    return out.withColumns({"n_tokens": F.size("ids").cast("long"), "round_trip": round_trip}).drop("__decoded", "__sha")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_texts),
]
#: No stage but the exact dedup is SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
