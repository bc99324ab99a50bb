"""Media columns: bytes kept as lossless WebP images, read back as pixel arrays.

:func:`store` lays bytes out as rows of 8-bit samples, 64 wide (wider where an image would be over 16384 rows high), and
writes a lossless WebP file (see :mod:`.webp`); :func:`pixels` reads any lossless WebP column: it decodes prefix codes,
back-references and colour cache, inverts predictor, cross-colour, subtract-green and palette transforms, and gives
width, height and the ARGB samples as one binary column.

Defined results. Null text is empty text; it is stored as one row of 64 zero bytes. Null media give null pixels; bytes
that are not a valid lossless WebP file give null pixels and the reason in ``error``. Repeated rows give equal files.
Empty tables give empty results. Other columns pass through; a column named like one that is added gives way to it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import webp

ROW = 64


def payload_of(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % ROW if data else ROW)


def pack(payload: bytes) -> bytes:
    rows = len(payload) // ROW
    wide = -(-rows // webp.MOST)
    if wide * ROW > webp.MOST:
        raise ValueError("over 256 MB do not fit one image")
    high = -(-rows // wide)
    samples = np.frombuffer(payload.ljust(high * wide * ROW, b"\0"), np.uint8)
    return webp.encode_samples(samples.reshape(high, wide * ROW))


def unpack(media: bytes, payload_bytes: int) -> tuple[bytes, np.ndarray]:
    """The payload, and the pixels that held it."""
    image = webp.decode(media)
    return ((image >> 8) & 255).astype(np.uint8).tobytes()[:payload_bytes], image


def feature(image: np.ndarray) -> str:
    """Size, mean and deviation of the green samples in 1/100, and a 64-bit average hash over an 8 x 8 grid."""
    g = ((image >> 8) & 255).astype(np.int64)
    h, w = g.shape
    rows = np.linspace(0, h, 9).astype(int)
    whole = np.zeros((h + 1, w + 1), np.int64)
    whole[1:, 1:] = g.cumsum(0).cumsum(1)
    cols = np.linspace(0, w, 9).astype(int)
    low, high = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1).clip(max=h)
    low = np.minimum(low, high - 1)
    cell = whole[high][:, cols[1:]] - whole[low][:, cols[1:]] - whole[high][:, cols[:-1]] + whole[low][:, cols[:-1]]
    mean_cell = cell / ((high - low)[:, None] * (cols[1:] - cols[:-1])[None, :])
    mean, n = whole[-1, -1] / g.size, g.size
    spread = max(0.0, float((g * g).sum()) / n - mean * mean) ** 0.5
    bits = np.packbits((mean_cell > mean).ravel()).tobytes().hex()
    return f"{w}x{h}:{round(mean * 100)}:{round(spread * 100)}:{bits}"


def _map(df: DataFrame, fields: list[T.StructField], one, inputs: list[str]) -> DataFrame:
    """``df`` with ``fields`` that ``one`` gives for the values of ``inputs`` in each row."""
    added = {f.name for f in fields}
    keep = [c for c in df.columns if c not in added or c in inputs]
    base = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], *[df[c].alias(f"i{i}") for i, c in enumerate(inputs)])
    mine = T.StructType([T.StructField(f"a{i}", f.dataType) for i, f in enumerate(fields)])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in mine]
        for batch in batches:
            # a few rows at a time: what is added may be as large as what is read
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [one(*x) for x in zip(*[c.to_pylist() for c in part.columns[n:]])]
                made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=[*part.schema.names[:n], *mine.names])

    out = base.mapInArrow(run, T.StructType([*base.schema.fields[:n], *mine.fields]))
    kept = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep) if c not in added]
    return out.select(*kept, *[F.col(f"a{i}").alias(f.name) for i, f in enumerate(fields)])


def store(df: DataFrame, text_col: str = "text", media_col: str = "media", size_col: str = "media_payload_bytes") -> DataFrame:
    """``df`` with its text's bytes as a media column, and the payload's length."""

    def one(text: str | None):
        payload = payload_of((text or "").encode("utf-8", "surrogatepass"))
        return pack(payload), len(payload)

    return _map(df, [T.StructField(media_col, T.BinaryType()), T.StructField(size_col, T.LongType())], one, [text_col])


def pixels(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with width, height, argb (4 bytes a pixel: blue, green, red, alpha) and error, read from lossless WebP files."""

    def one(media: bytes | None):
        if media is None:
            return None, None, None, None
        try:
            image = webp.decode(media)
        except (ValueError, IndexError) as e:
            return None, None, None, str(e)
        return image.shape[1], image.shape[0], image.astype("<u4").tobytes(), None

    kinds = [("width", T.IntegerType()), ("height", T.IntegerType()), ("argb", T.BinaryType()), ("error", T.StringType())]
    return _map(df, [T.StructField(n, k) for n, k in kinds], one, [media_col])


def digest(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with digests of what is stored and read back; the media themselves pass through one task's memory only."""

    def one(text: str | None):
        data = (text or "").encode("utf-8", "surrogatepass")
        media, n = pack(payload_of(data)), len(payload_of(data))
        back, image = unpack(media, n)
        return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(image)

    kinds = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    return _map(df, [T.StructField(n, k) for n, k in kinds], one, [text_col])


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
