"""Secret scans with corpus-wide ownership frequency.

Three base patterns, and one that the method adds (``value``: long mixed strings that look random), give candidates. A
candidate's value is hashed, and hashes are aggregated by distinct repositories and distinct owners over the whole corpus:
a value that several owners have is a widely copied example, one that a single owner has looks like a live credential,
in however many of its repositories it occurs.
Base spans always stay, with their class; of the added kind only owner-specific spans are reported.

In a table of documents ``source`` is the owner, and a source's documents of one language are a repository of it.

Defined results. Null text is empty text. A null owner, and a null repository, is one of its own. Repeated rows repeat
their result; a value that one owner repeats stays owner-specific. Spans are in code points, end exclusive. A text of any length is scanned whole. Empty tables
give empty results. :func:`scan` returns the id and what is added; other columns of the input are not carried.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
VALUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Only texts with one of these have a match of ASSIGN.
WORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "value")
#: Bits a character of the least random value of the added kind.
ENTROPY = 3.5
#: Owners from which on a value is an example.
MANY_OWNERS = 2
_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def _random_looking(value: str) -> bool:
    kinds = bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(_DIGIT.search(value))
    if kinds < 2 or not _DIGIT.search(value):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= ENTROPY


def added_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    out, k = [], 0
    for m in VALUE.finditer(text):
        while k < len(base) and base[k][2] <= m.start():
            k += 1
        # base spans of different kinds may overlap, and then a later one may end sooner
        if any(b[0] < m.end() and b[2] > m.start() for b in base[max(0, k - 2) : k + 3]):
            continue
        if _random_looking(m[0]):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


_SPAN = "struct<start:int,kind:int,stop:int,h:bigint>"


def candidates(df: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column) -> DataFrame:
    """(row, id, owner, repo, n_assign, n_access, n_hex, base_sha256, found) of every document."""
    base = df.select(df[id_col].alias("id"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), df[text_col].cast("string").alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("h", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, found = [], [], []
            for x in batch.column(3):
                text = x.as_py() or ""
                spans = base_spans(text)
                n = Counter(s[1] for s in spans)
                counts.append((n[0], n[1], n[2]))
                shas.append(hashlib.sha256(joined(spans).encode()).hexdigest())
                found.append([{"start": s[0], "kind": s[1], "stop": s[2], "h": _hash(s[3])} for s in sorted(spans + added_spans(text, spans))])
            made = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made, pa.array(shas, pa.string()), pa.array(found, span)], names=["id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    out = base.mapInArrow(run, f"id {id_type}, owner string, repo string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found array<{_SPAN}>")
    return out.withColumn("row", F.monotonically_increasing_id())


def ownership(found: DataFrame) -> DataFrame:
    """(h, owner, repo) of every candidate -> (h, n_rows, n_owners, n_repos). Three aggregations that merge map-side: no hash's rows meet in one task."""
    by_repo = found.groupBy("h", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("h", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"))
    return by_owner.groupBy("h").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repos"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, classes) of every row of ``df``."""
    owner = owner if owner is not None else df["source"]
    repo = repo if repo is not None else F.concat_ws("/", df["source"], df["lang"])
    rows = C.written(candidates(df, id_col, text_col, owner, repo), "secrets")
    found = rows.select("row", "owner", "repo", F.explode("found").alias("s")).select("row", "owner", "repo", "s.*")
    stats = C.written(ownership(found), "ownership")
    met = C.join_hot(found, stats, "h", "n_rows", found.count())
    live = F.col("n_owners") < MANY_OWNERS
    met = met.withColumn("live", live).filter("kind < 3 OR live")
    # one group is one document's spans
    one = F.struct("start", "kind", "stop", "live")
    met = met.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("s"), F.count_if(F.col("live")).alias("n_live"), F.count_if(~F.col("live")).alias("n_example"))
    kinds = F.array(*map(F.lit, KINDS))
    text = lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["stop"])
    met = met.select("row", "n_live", "n_example", F.array_join(F.transform("s", text), ",").alias("spans"), F.array_join(F.transform("s", lambda x: F.when(x["live"], "live").otherwise("example")), ",").alias("classes"))
    head = ["id", "n_assign", "n_access", "n_hex", "base_sha256"]
    empty = [F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"), F.lit("").alias("classes")]
    none = rows.filter(F.size("found") == 0).select(*head, *empty)
    some = rows.filter(F.size("found") > 0).select("row", *head).join(met, "row", "left")
    some = some.select(*head, F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"), F.coalesce("classes", F.lit("")).alias("classes"))
    return none.unionByName(some).withColumnRenamed("id", id_col)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"))
