"""Tables as segments of Parquet under a log of numbered manifests.

A commit writes what changed and nothing else: for each table at most one new *segment* of rows, and one file of *deleted*
keys, which hide the rows of older segments (a row that changes is deleted and added in one commit). ``root/_log/<n>.json``
is the manifest of version n: the segments and deletions of every table, running totals, and which tables the commit
changed. A manifest is published by creating its file, which only one writer can do; the loser sees what the other one
changed, and goes on top of it unless both changed the same table (:class:`Conflict`). So a commit of several tables is seen
whole or not at all, and a reader keeps the version it opened: files go only when ``KEEP`` later versions exist.

Segments of like size are merged when there are ``TIER`` of them, so a table has a number of segments that grows with the
logarithm of its rows, and a row is rewritten as often. Files go through the session's Hadoop file system, so ``root`` may
be any store it knows.
"""

from __future__ import annotations

import json
import os
import uuid
from contextlib import contextmanager
from itertools import takewhile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import bm25

#: Versions whose files stay; segments of one size that are merged, which is also the ratio of sizes.
KEEP, TIER = 10, 8
#: A table is written anew when so many times its deleted documents outnumber the documents.
DELETED = 4
TOTALS = ("documents", "chunks", "tokens", "active_chunks", "active_tokens")


class Locked(RuntimeError):
    pass


class Conflict(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}" if p else self.root)
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("_log"))
        if self.version > schemas.VERSION:
            raise RuntimeError("the catalog was written by a newer version")
        if 0 < self.version < schemas.VERSION:
            from . import migrations

            migrations.migrate(self)

    # manifests

    def _json(self, path: str) -> dict:
        stream = self.fs.open(self._path(path))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        names = [e.getPath().getName() for e in self.fs.listStatus(self._path("_log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def at(self, version: int) -> dict:
        return self._json(f"_log/{version:020}.json")

    @property
    def manifest(self) -> dict:
        if known := self.versions():
            return self.at(known[-1])
        empty = {"version": 0, "schema_version": 0, "tables": {}, "totals": dict.fromkeys(TOTALS, 0), "changed": []}
        if self.fs.exists(self._path("_manifest.json")):  # a catalog of whole snapshots
            old = self._json("_manifest.json")
            return empty | {"schema_version": old["schema_version"], "snapshots": old["tables"]}
        return empty

    @property
    def version(self) -> int:
        return self.manifest["schema_version"]

    def _publish(self, manifest: dict) -> bool:
        """False: another writer has this version."""
        name = f"_log/{manifest['version']:020}.json"
        part = f"_log/.{uuid.uuid4().hex}"
        out = self.fs.create(self._path(part), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        uri = self.fs.makeQualified(self._path(part)).toUri()
        try:
            if uri.getScheme() == "file":
                folder = os.path.dirname(uri.getPath())
                os.link(uri.getPath(), os.path.join(folder, os.path.basename(name)))  # fails if it exists, in one step
                return True
            return self.fs.rename(self._path(part), self._path(name))
        except FileExistsError:
            return False
        finally:
            self.fs.delete(self._path(part), False)

    # reading

    def _read(self, name: str, manifest: dict) -> DataFrame | None:
        """Rows of all segments, deleted ones too, with at_seq, the version they came with."""
        segments = manifest["tables"].get(name, {}).get("segments", [])
        if not segments:
            return None
        ddl = schemas.schema(name)
        places = [T.StructField("at_seq", T.LongType()), T.StructField("at_gen", T.StringType())] + [T.StructField("bucket", T.StringType())] * (name == "llm_cache")
        read = self.spark.read.schema(T.StructType([*ddl.fields, *places])).option("basePath", f"{self.root}/{name}")
        return read.parquet(*[f"{self.root}/{s['path']}" for s in segments]).drop("at_gen")

    def live(self, name: str, rows: DataFrame, manifest: dict | None = None) -> DataFrame:
        """rows (at_seq and the key of the table ``name``) without deleted ones."""
        entry = (manifest or self.manifest)["tables"].get(name, {})
        oldest = min((s["seq"] for s in entry.get("segments", [])), default=0)
        paths = [f"{self.root}/{d['path']}" for d in entry.get("deletes", []) if d["seq"] > oldest]
        if not paths:
            return rows
        key = schemas.KEYS[name]
        gone = self.spark.read.schema(self._deletion(key)).parquet(*paths).select(F.col("k").alias("__k"), "upto")
        return rows.join(gone, (F.col(key) == F.col("__k")) & (F.col("at_seq") < F.col("upto")), "left_anti")

    @staticmethod
    def _deletion(key: str) -> str:
        return f"k {'string' if key in ('hash', 'key') else 'bigint'}, upto bigint"

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        """The rows of a table as they are now, or in a manifest. ``postings``: (chunk_id, term, tf), out of their blocks."""
        manifest = manifest or self.manifest
        if name == "postings":
            blocks = self._read("posting_blocks", manifest)
            if blocks is None:
                return self.spark.createDataFrame([], "chunk_id bigint, term string, tf int")
            return self.live("posting_blocks", bm25.opened(blocks), manifest).select("chunk_id", "term", "tf")
        rows = self._read(name, manifest)
        fields = schemas.schema(name).fieldNames()
        if rows is None:
            return self.spark.createDataFrame([], schemas.schema(name))
        if name == "term_stats":
            return rows.groupBy("term").agg(F.sum("n_all").alias("n_all"), F.sum("n_active").alias("n_active"))
        if name == "llm_cache":
            order = F.struct("at_seq", "created_at", "response")
            return rows.groupBy("key").agg(*[F.max_by(c, order).alias(c) for c in fields[1:]])
        return self.live(name, rows, manifest).select(*fields)

    def blocks(self, manifest: dict | None = None) -> DataFrame | None:
        """Posting blocks with at_seq; their postings may be deleted (:meth:`live`)."""
        return self._read("posting_blocks", manifest or self.manifest)

    def cached(self, key: str) -> DataFrame:
        """Answers of a key, the last one first; reads one bucket of each segment."""
        rows = self._read("llm_cache", self.manifest)
        if rows is None:
            return self.spark.createDataFrame([], schemas.schema("llm_cache"))
        return rows.filter((F.col("bucket") == key[:1]) & (F.col("key") == key)).orderBy(F.desc("at_seq"), F.desc("created_at"), F.desc("response"))

    # writing

    def _bytes(self, path: str) -> int:
        return self.fs.getContentSummary(self._path(path)).getLength()

    def _segment(self, name: str, df: DataFrame, seq: int) -> dict | None:
        fields = schemas.schema(name).fields
        df = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in fields])
        if name in schemas.SORTED:
            df = df.repartitionByRange(*schemas.SORTED[name]).sortWithinPartitions(*schemas.SORTED[name])
        path, seen = f"{name}/at_seq={seq}/at_gen={uuid.uuid4().hex}", Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if name == "llm_cache":
            df.withColumn("bucket", F.substring("key", 1, 1)).write.partitionBy("bucket").parquet(f"{self.root}/{path}")
        else:
            df.write.parquet(f"{self.root}/{path}")
        if not (n := seen.get["n"]):
            self.fs.delete(self._path(path), True)
            return None
        return {"path": path, "seq": seq, "rows": n, "bytes": self._bytes(path)}

    def _deleted(self, key: str, keys: DataFrame, seq: int) -> dict | None:
        path, seen = f"_deletes/{uuid.uuid4().hex}", Observation()
        rows = keys.select(F.col(keys.columns[0]).alias("k")).filter("k IS NOT NULL").distinct()
        kind = "string" if key in ("hash", "key") else "bigint"
        rows.select(F.col("k").cast(kind).alias("k"), F.lit(seq).cast("bigint").alias("upto")).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{path}")
        if not (n := seen.get["n"]):
            self.fs.delete(self._path(path), True)
            return None
        return {"path": path, "seq": seq, "rows": n, "bytes": self._bytes(path)}

    def commit(self, add: dict[str, DataFrame] | None = None, drop: dict[str, DataFrame] | None = None, totals: dict[str, int] | None = None, base: dict | None = None, schema_version: int = schemas.VERSION) -> dict:
        """Add rows and drop keys (frames of one column; one frame may serve several tables), in one step. ``base``: the manifest that the caller has read; ``totals``: what is added to the running totals. The new manifest."""
        add, drop, base = add or {}, drop or {}, base or self.manifest
        seq = base["version"] + 1
        made = {name: s for name, df in add.items() if (s := self._segment(name, df, seq))}
        written: dict[tuple[int, str], dict | None] = {}
        gone = {}
        for name, keys in drop.items():
            at = (id(keys), schemas.KEYS[name])
            if at not in written:
                written[at] = self._deleted(schemas.KEYS[name], keys, seq)
            if written[at]:
                gone[name] = written[at]

        def change(now: dict) -> dict:
            tables = {t: {"segments": [*e["segments"]], "deletes": [*e["deletes"]]} for t, e in now["tables"].items()}
            for name in {*made, *gone}:
                entry = tables.setdefault(name, {"segments": [], "deletes": []})
                entry["segments"] += [made[name]] if name in made else []
                entry["deletes"] += [gone[name]] if name in gone else []
            sums = {t: now["totals"].get(t, 0) + (totals or {}).get(t, 0) for t in TOTALS}
            return now | {"tables": tables, "totals": sums, "schema_version": schema_version, "changed": sorted({*add, *drop})}

        return self._settle(base, {*add, *drop}, change)

    def _settle(self, base: dict, touched: set[str], change) -> dict:
        """Publish ``change`` of the last manifest; other commits since ``base`` must not have touched the same tables."""
        while True:
            now = self.manifest
            for v in range(base["version"] + 1, now["version"] + 1):
                if not self.fs.exists(self._path(f"_log/{v:020}.json")):
                    raise Conflict("the version that was read is too old")
                if clash := (touched & {*self.at(v)["changed"]}) - schemas.APPENDED:
                    raise Conflict(f"version {v} changed {', '.join(sorted(clash))} too")
            new = change(now) | {"version": now["version"] + 1}
            if self._publish(new):
                self._expire(new)
                return new

    @staticmethod
    def _files(manifest: dict) -> set[str]:
        return {x["path"] for e in manifest["tables"].values() for kind in ("segments", "deletes") for x in e[kind]}

    def _expire(self, now: dict) -> None:
        """Delete manifests before the last KEEP, and what only they name."""
        old = [v for v in self.versions() if v <= now["version"] - KEEP]
        if not old:
            return
        kept = set().union(*[self._files(self.at(v)) for v in self.versions() if v > now["version"] - KEEP])
        for v in old:
            for path in self._files(self.at(v)) - kept:
                self.fs.delete(self._path(path), True)
            self.fs.delete(self._path(f"_log/{v:020}.json"), False)

    # merging

    def _merged(self, name: str, rows: DataFrame, manifest: dict) -> DataFrame:
        """Rows of some segments as one segment's."""
        if name == "term_stats":
            return rows.groupBy("term").agg(F.sum("n_all").alias("n_all"), F.sum("n_active").alias("n_active")).filter("n_all <> 0 OR n_active <> 0")
        if name == "tokens":
            return rows.dropDuplicates(["token"])
        if name == "llm_cache":
            order = F.struct("at_seq", "created_at", "response")
            return rows.groupBy("key").agg(*[F.max_by(c, order).alias(c) for c in ("model", "response", "created_at")])
        if name == "posting_blocks":
            return bm25.blocked(self.live(name, bm25.opened(rows), manifest))
        return self.live(name, rows, manifest)

    def compact(self, names: list[str] | None = None, whole: bool = False) -> int:
        """Merge segments of like size, and deletions; ``whole``: all of a table. How many tables changed."""
        n = 0
        for name in names or list(schemas.DDL):
            now = self.manifest
            entry = now["tables"].get(name)
            if not entry:
                continue
            hidden = sum(d["rows"] for d in entry["deletes"]) * DELETED > max(1, now["totals"].get("documents", 0)) and len(entry["deletes"]) > 1
            chosen = entry["segments"] if whole or hidden else _youngest(entry["segments"])
            deletes = len(entry["deletes"]) >= TIER
            if len(chosen) < 2 and not deletes and not (whole and entry["deletes"]):
                continue
            self._merge(name, now, chosen, deletes)
            n += 1
        return n

    def _merge(self, name: str, now: dict, chosen: list[dict], deletes: bool) -> None:
        entry, put, gone = now["tables"][name], [], []
        paths = {s["path"] for s in chosen}
        if chosen:
            part = now | {"tables": now["tables"] | {name: entry | {"segments": chosen}}}
            if made := self._segment(name, self._merged(name, self._read(name, part), part), max(s["seq"] for s in chosen)):
                put = [made]
        left = [s for s in entry["segments"] if s["path"] not in paths] + put
        oldest = min((s["seq"] for s in left), default=now["version"] + 1)
        # what all segments were merged with hides nothing any more
        gone = [d for d in entry["deletes"] if d["seq"] > oldest and len(chosen) < len(entry["segments"])]
        if deletes and len(gone) > 1:
            key, path, seen = schemas.KEYS[name], f"_deletes/{uuid.uuid4().hex}", Observation()
            rows = self.spark.read.schema(self._deletion(key)).parquet(*[f"{self.root}/{d['path']}" for d in gone])
            rows.groupBy("k").agg(F.max("upto").alias("upto")).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{path}")
            gone = [{"path": path, "seq": max(d["seq"] for d in gone), "rows": seen.get["n"], "bytes": self._bytes(path)}]
        old = {x["path"] for kind in ("segments", "deletes") for x in entry[kind]}

        def change(new: dict) -> dict:
            # rows that others have added meanwhile (to a table that allows it) stay
            later = {k: [x for x in new["tables"][name][k] if x["path"] not in old] for k in ("segments", "deletes")}
            tables = new["tables"] | {name: {"segments": left + later["segments"], "deletes": gone + later["deletes"]}}
            return new | {"tables": tables, "changed": [name]}

        self._settle(now, {name}, change)

    def scratch(self, df: DataFrame) -> DataFrame:
        """``df`` written beside the tables and read back: what follows does not depend on how it was computed."""
        at = f"{self.root}/_scratch/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop_scratch(self) -> None:
        self.fs.delete(self._path("_scratch"), True)

    @contextmanager
    def writing(self):
        """One indexing writer at a time."""
        lock = self._path("_lock")
        if not self.fs.createNewFile(lock):
            raise Locked(f"{self.root} is being written; delete _lock if its writer is gone")
        try:
            yield self
        finally:
            self.fs.delete(lock, False)

    def size(self) -> int:
        """Bytes of the segments and deletions that make up the tables now."""
        return sum(x["bytes"] for e in self.manifest["tables"].values() for kind in ("segments", "deletes") for x in e[kind])


def _youngest(segments: list[dict]) -> list[dict]:
    """The last segments in a row, TIER or more of them, that are of one size or smaller; of the least such size."""
    tier = lambda s: (max(1, s["rows"]).bit_length() - 1) // (TIER.bit_length() - 1)
    newest = sorted(segments, key=lambda s: s["seq"], reverse=True)
    for most in sorted({tier(s) for s in segments}):
        run = list(takewhile(lambda s: tier(s) <= most, newest))
        if len(run) >= TIER:
            return run
    return []
