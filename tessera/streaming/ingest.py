"""A stream of documents into chunks: the batch operators on a streaming frame, and upserts of what arrives.

A document that comes again replaces its older chunks. Each batch's chunks go to a folder of its own, so a batch that is
run again replaces itself; :func:`current` reads, of each document, the chunks of the last batch that has it. Inside a
batch the row with the largest ``version`` stands (any column that orders a document's rows), and of equal ones the one with
the larger text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import chunking


def chunks(docs: DataFrame, target: int = chunking.TARGET) -> DataFrame:
    """A stream (doc_id, text) -> its chunks. No state: a document's chunks are made in its own row."""
    return chunking.chunk_sections(docs.select("doc_id", chunking.whole_text_sections(F.col("text")).alias("sections")), target)


def latest(batch: DataFrame, version: str | None = None) -> DataFrame:
    """(doc_id, text) of each document's last row."""
    order = F.struct(*([F.col(version)] if version else []), F.col("text"))
    return batch.groupBy("doc_id").agg(F.max_by("text", order).alias("text"))


def write_chunks(docs: DataFrame, path: str, checkpoint: str, target: int = chunking.TARGET, version: str | None = None) -> DataStreamWriter:
    """Chunks of each batch under ``path``, and the ids of its documents (one may have no chunk any more) under ``path``/_docs."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = latest(batch, version)
        rows.select("doc_id").write.mode("overwrite").parquet(f"{path}/_docs/batch={batch_id}")
        chunks(rows, target).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, path: str) -> DataFrame:
    """Of each document the chunks of the last batch that has it."""
    last = spark.read.parquet(f"{path}/_docs").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(path).join(last, ["doc_id", "batch"]).drop("batch")
