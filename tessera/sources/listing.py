"""Files under a directory, in lexical order, listed and read on the executors.

Spark's own listing loses names that begin with ``_`` or ``.``, so directories are opened here, level by level: a job for
each level of depth, a row for each directory, and no list of paths on the driver. A plain path is opened as a local folder (which
executors must share on a cluster), a URI through Arrow's file systems (hdfs, s3, gs, abfs, file).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of directories that are not entered, and extensions that are read, unless a collection says otherwise.
SKIPPED = (".git", ".hg", ".svn", ".venv", "venv", ".env", "node_modules", "vendor", ".tox", ".mypy_cache", ".pytest_cache", "__pycache__", ".ruff_cache", ".hypothesis", "target", "dist", "build", "out", ".gradle", ".idea", ".vscode", ".DS_Store")
EXTENSIONS = (".md", ".markdown", ".txt", ".text", ".go", ".ts", ".tsx", ".js", ".jsx", ".py", ".rs")
#: Files that one task reads, and directories that one task opens, on average.
FILES_A_TASK, FOLDERS_A_TASK = 256, 64
#: Bytes of bodies that go on together.
BATCH_BYTES = 8 << 20


def is_wanted(name: str, wanted: set[str]) -> bool:
    return os.path.splitext(name)[1].lower() in wanted or (name.startswith(".") and name.count(".") == 1 and name.lower() in wanted)


def located(root: str) -> tuple[pafs.FileSystem | None, str]:
    """The file system of a URI (None for a plain path), and the path in it."""
    if "://" not in root:
        return None, root.rstrip("/") or "/"
    fs, path = pafs.FileSystem.from_uri(quote(root, safe="/:%@?&=+,;~"))
    return fs, path.rstrip("/") or "/"


def entries(folder: str, fs: pafs.FileSystem | None = None) -> list[tuple[str, bool, int]]:
    """(name, is a directory, bytes) of what a folder holds. A link is a file of its own."""
    if fs is None:
        with os.scandir(folder) as found:
            return [(e.name, d := e.is_dir(follow_symlinks=False), 0 if d else _size(e)) for e in found]
    return [(i.base_name, i.type == pafs.FileType.Directory, i.size or 0) for i in fs.get_file_info(pafs.FileSelector(folder))]


def _size(e: os.DirEntry) -> int:
    try:
        return e.stat().st_size
    except OSError:
        return 0


def walk(root: str, extensions: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> Iterator[str]:
    """Paths relative to ``root``, by one process. Ignored names count for directories only, and never for the root; an unreadable directory raises."""
    wanted, skipped = set(extensions or EXTENSIONS), {*SKIPPED, *ignore}

    def enter(folder: str, prefix: str) -> Iterator[str]:
        for name, is_dir, _ in sorted(entries(folder, fs)):
            if is_dir:
                if name not in skipped:
                    yield from enter(f"{folder.rstrip('/')}/{name}", f"{prefix}{name}/")
            elif is_wanted(name, wanted):
                yield prefix + name

    fs, top = located(root)
    yield from enter(top, "")


def order(path: Column) -> Column:
    """What :func:`walk` goes by: names of directories and files from the first on."""
    return F.split(path, "/")


def listed(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), ignore: tuple[str, ...] = (), keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """(path, size) of what :func:`walk` finds. ``keep`` holds a level, so that it is not opened again. An unreadable directory raises."""
    wanted, skipped = set(extensions or EXTENSIONS), {*SKIPPED, *ignore}
    fs, top = located(root)
    entries(top, fs)  # a root that cannot be read raises as what it is

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = located(root)
        for batch in batches:
            for prefix in batch.column(0).to_pylist():
                rows, error = [], None
                try:
                    for name, is_dir, size in entries(f"{top}/{prefix}".rstrip("/") or "/", fs):
                        if is_dir and name not in skipped:
                            rows.append((f"{prefix}{name}/", True, size))
                        elif not is_dir and is_wanted(name, wanted):
                            rows.append((prefix + name, False, size))
                except OSError as e:
                    error = str(e)
                rows = [(*r, None) for r in rows] + [(prefix, True, 0, error)] * (error is not None)
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 4096]), (pa.string(), pa.bool_(), pa.int64(), pa.string()))], names=["path", "is_dir", "size", "error"])

    folders, n, levels = spark.createDataFrame([("",)], "path string"), 1, []
    while n:
        level = keep(folders.repartition(max(1, min(n // FOLDERS_A_TASK + 1, 10_000))).mapInArrow(opened, "path string, is_dir boolean, size bigint, error string"))
        if bad := level.filter("error IS NOT NULL").select("error").first():
            raise OSError(bad[0])
        levels.append(level.filter("NOT is_dir").select("path", "size"))
        folders = level.filter("is_dir").select("path")
        n = folders.count()
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def read(files: DataFrame, root: str) -> DataFrame:
    """files (path, ...) -> (path, body, hash, error): files read on the executors; an unreadable file has an error and no body."""
    n = files.count()

    def body(fs: pafs.FileSystem | None, path: str) -> bytes:
        with open(path, "rb") if fs is None else fs.open_input_stream(path) as f:
            return f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, (fs, top) = [], 0, located(root)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.string()))], names=["path", "body", "error"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    rows.append((path, raw := body(fs, f"{top}/{path}"), None))
                    size += len(raw)
                except OSError as e:
                    rows.append((path, None, str(e)))
                if len(rows) == 256 or size > BATCH_BYTES:
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()

    dealt = files.select("path").repartition(max(1, n // FILES_A_TASK))
    return dealt.mapInArrow(run, "path string, body binary, error string").withColumn("hash", F.sha2("body", 256))


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """:func:`read` of paths that are known."""
    return read(spark.createDataFrame([(p,) for p in paths], "path string"), root)
