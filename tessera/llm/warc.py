"""WARC archives of pages: written with revisit records, read back, and indexed by an external merge.

1. Payloads are hashed where they are read; digests with copies (of payloads of ``LEAST`` bytes or more) are aggregated,
   with partial counts, so a page with a third of all copies is one row. The copy with the smallest id is the response, the
   others become revisit records, which have no payload. Pages do not shuffle: they meet the copied digests in a
   broadcast where those are few (counted), else by a join in which hot digests are still broadcast.
2. Each task writes its records to files of its own in the order of URL key, time and id: an archive is a sorted *run*. A
   record ends with two line ends, which is what Spark's text writer puts between rows, so archives are written through it:
   to any file system that Spark knows, and with its commit of whole tasks.
3. Archives are read as files and cut by their Content-Length; payloads are hashed again and held against their headers.
4. *Index.* Entries are dealt to ranges of their key and each range merges the runs it got with a loser tree, so the index
   is ordered over all ranges. A run ends where a key is smaller than the one before it: any order of arrival merges right,
   and one that keeps the runs takes the fewest steps.

Defined results. A null payload is empty; payloads under ``LEAST`` bytes are always responses. Null ids come last as
candidates for a response, first in the index; a group of copies without any id has only responses, as has a repeated id
that is the smallest of its group. A null URL writes no target and has the empty key; line ends, tabs and spaces of a URL are
written percent-coded. A null time reads :data:`CAPTURED`. A payload must fit a row (2 GB); an archive holds at least one
record, and on average ``ARCHIVE`` bytes at most. Empty tables write no record and give empty results. Only the columns
named are read, so others cannot clash.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

LEAST = 100
#: Bytes of an archive, on average at most: a task reads an archive whole.
ARCHIVE = 32 << 20
#: Index entries of a range, on average at most.
RANGE = 1 << 16
#: The time of captures in a table that has none.
CAPTURED = "1970-01-01T00:00:00Z"
# The format's own names.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
_NO_ID = "ffffffffffff"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENTRY = ["page_id", "url", "captured", "record_type", "refers_to", "payload_digest", "payload_bytes", "archive", "offset", "length"]
KEY = ["url_key", "captured", "page_id", "archive", "offset"]


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, then the path and query: ``org,example)/a?b``. Scheme, user, default port, ``www.`` and fragment do not count."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)#.*$", "")
    authority = F.regexp_extract(rest, r"^([^/?]*)", 1)
    tail = F.substr(rest, F.length(authority) + 1)
    host = F.regexp_replace(F.regexp_replace(F.translate(authority, _UPPER, _LOWER), r"(?s)^.*@", ""), r":(80|443)$", "")
    labels = F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")), ",")
    return F.coalesce(F.concat(labels, F.lit(")"), F.when(tail.startswith("/"), "").otherwise("/"), tail), F.lit(""))


def record_id(id_: Column) -> Column:
    """A UUID (version 8) that holds the id."""
    h = F.lower(F.lpad(F.hex(F.coalesce(id_, F.lit(0).cast("long"))), 16, "0"))
    part = lambda a, n: F.substring(h, a, n)
    end = F.when(id_.isNull(), f"00-{_NO_ID}").otherwise("00-" + "0" * 12)
    return F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(13, 3), F.lit("-8"), part(16, 1), end)


def id_of(urn: str) -> int | None:
    h = urn.removeprefix("urn:uuid:").replace("-", "")
    if h.endswith(_NO_ID):
        return None
    x = int(h[:12] + h[13:16] + h[17], 16)
    return x - (1 << 64) if x >> 63 else x


def _records(rows: DataFrame) -> DataFrame:
    """rows (id, url, payload, digest, n, captured, first) -> (value, url_key, captured, id): a record without its end."""
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    target = F.col("url")
    for sign, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        target = F.replace(target, F.lit(sign), F.lit(code))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("id")), F.lit(">"))),
        line("WARC-Date", F.col("captured")),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<"), record_id(F.col("first")), F.lit(">"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        size.cast("string"),
        F.lit(END),
    )
    value = F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload")))
    return rows.select(value.alias("value"), url_key(target).alias("url_key"), "captured", "id")


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, compression: str = "none") -> None:
    """Archives of ``df`` under ``path``. ``date_col``: times as WARC writes them. ``compression``: none or gzip (of whole files)."""
    payload = C.empty_text(df[payload_col])
    captured = F.coalesce(df[date_col].cast("string"), F.lit(CAPTURED)) if date_col else F.lit(CAPTURED)
    rows = df.select(df[id_col].cast("long").alias("id"), df[url_col].cast("string").alias("url"), payload.alias("payload"), captured.alias("captured"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    groups = rows.groupBy("digest", (F.col("n") >= LEAST).alias("long")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.sum("n").alias("bytes"))
    groups = C.written(groups, "digests")
    copied = groups.filter("long AND copies > 1").select("digest", "first", "copies")
    n, total, size = groups.agg(F.count_if(F.expr("long AND copies > 1")), F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    met = rows.join(F.broadcast(copied), "digest", "left") if n <= C.BROADCAST_ROWS else C.join_hot(rows, copied, "digest", "copies", total)
    each = max(1, ARCHIVE * total // (size + 600 * total)) if total else 1
    out = _records(met).sortWithinPartitions("url_key", "captured", "id").select("value")
    out.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", each).text(path)


def parse(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers by lower-case name, block) of each record of an archive, which may be gzipped in any number of members; offsets are those of the plain archive."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        first, *lines = raw[at : end if end >= 0 else at].decode("utf-8", "replace").split("\r\n")
        if not re.fullmatch(r"WARC/\d\.\d", first):
            raise ValueError(f"no record at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it should")
        yield at, stop + 4 - at, headers, raw[start:stop]
        at = stop + 4


def entry(headers: dict[str, str], block: bytes) -> tuple[dict, bytes]:
    """Index fields of a record and its payload (empty for a revisit). A payload that is not what the headers say raises."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, said = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha256:")
    size = int(re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)[1])
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if found != said or len(payload) != size:
            raise ValueError(f"payload of {headers.get('warc-record-id')} is not what its record says")
    urn = lambda name: id_of(headers[name].strip("<>")) if name in headers else None
    return {"page_id": urn("warc-record-id"), "url": headers.get("warc-target-uri"), "captured": headers.get("warc-date"), "record_type": kind, "refers_to": urn("warc-refers-to"), "payload_digest": said, "payload_bytes": size}, payload


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """ENTRY columns of every record under ``path``, in the archives' order, and with ``payloads`` their payloads."""
    numbers = ("page_id", "refers_to", "payload_bytes", "offset", "length")
    ddl = ", ".join(f"{c} {'bigint' if c in numbers else 'string'}" for c in ENTRY) + (", payload binary" if payloads else "")
    types = [pa.int64() if c in numbers else pa.string() for c in ENTRY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            cols = [pa.array([r[c] for r in rows], t) for c, t in zip(ENTRY, types)] + ([pa.array(held, pa.binary())] if payloads else [])
            return pa.RecordBatch.from_arrays(cols, names=ENTRY + ["payload"] * payloads)

        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py().rpartition("/")[2]
                rows, held, size = [], [], 0
                for offset, length, headers, block in parse(batch.column(1)[i].as_py()):
                    fields, payload = entry(headers, block)
                    rows.append(fields | {"archive": name, "offset": offset, "length": length})
                    if payloads:
                        held.append(payload)
                        size += len(payload)
                    if len(rows) == 4096 or size > 8 << 20:
                        yield made()
                        rows, held, size = [], [], 0
                if rows:
                    yield made()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, ddl)


class LoserTree:
    """Merges sorted lists: inner nodes hold the losers of their matches, so the next smallest costs one match a level."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.losers, winners = [0] * k, [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        """Run a's head goes before run b's; an empty run loses, and ties go to the earlier run."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator:
        runs, at, k = self.runs, self.at, len(self.runs)
        while k and at[w := self.winner] < len(runs[w]):
            yield runs[w][at[w]]
            at[w] += 1
            node = (w + k) // 2
            while node:
                if self._first(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def sorted_runs(keys: list[tuple]) -> list[list[tuple]]:
    """(key, place) of each entry, cut where a key is smaller than the one before it."""
    runs: list[list[tuple]] = []
    for i, key in enumerate(keys):
        if not i or key < keys[i - 1]:
            runs.append([])
        runs[-1].append((key, i))
    return runs


def merged_index(captures: DataFrame, range_rows: int = RANGE) -> DataFrame:
    """captures (ENTRY) -> with url_key and position, the place in the order of URL key, time, id, archive and offset over all archives."""
    spark = captures.sparkSession
    rows = C.written(captures.withColumn("url_key", url_key(F.col("url"))), "captures")
    n = rows.count()
    ranges = max(1, -(-n // range_rows), min(n // 1024, 2 * spark.sparkContext.defaultParallelism))
    schema = T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if t is None:
            return
        parts = [t[c].to_pylist() for c in KEY]
        keys = [(u, c or "", i is not None, i or 0, a, o) for u, c, i, a, o in zip(*parts)]
        order = [place for _, place in LoserTree(sorted_runs(keys))]
        t = t.take(pa.array(order, pa.int64())).append_column("place", pa.array(range(len(t)), pa.int64()))
        yield from t.to_batches(max_chunksize=8192)

    dealt = rows.repartitionByRange(ranges, *KEY)
    out = C.written(dealt.mapInArrow(merge, schema).withColumn("range", F.spark_partition_id()), "index")
    sizes = out.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    # one row for each range
    shift = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("shift"))
    return out.join(C.small_side(shift, ranges), "range").withColumn("position", F.col("shift") + F.col("place")).drop("range", "shift", "place")


def archive(df: DataFrame, path: str, **columns: str) -> DataFrame:
    """Writes ``df`` as archives under ``path``, reads them back and merges their index."""
    write_archives(df, path, **columns)
    return merged_index(read_archives(df.sparkSession, path))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = archive(pages, f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


SQL = rf"""
WITH r AS (SELECT page_id, coalesce(html, '') AS html, replace(replace(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), chr(9), '%09'), ' ', '%20') AS url FROM pages),
p AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '', 's') AS rest FROM r),
h AS (SELECT *, regexp_extract(rest, '^([^/?]*)', 1) AS authority FROM p),
k AS (SELECT *, substr(rest, length(authority) + 1) AS tail, regexp_replace(regexp_replace(regexp_replace(translate(authority, '{_UPPER}', '{_LOWER}'), '^.*@', '', 's'), ':(80|443)$', ''), '^www\.', '') AS host FROM h),
u AS (SELECT *, coalesce(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN starts_with(tail, '/') THEN '' ELSE '/' END || tail, '') AS url_key,
             min(page_id) OVER (PARTITION BY payload_digest) AS first FROM k),
t AS (SELECT *, payload_bytes >= {LEAST} AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM u)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to, url_key,
       row_number() OVER (ORDER BY url_key, page_id NULLS FIRST) - 1 AS position
FROM t
"""
