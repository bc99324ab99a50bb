"""Commands: init, index, embed, search, query, ask, get, list, stats, delete, doctor, version."""

from __future__ import annotations

import argparse
import os
import sys
import time
from pathlib import Path

from . import config as K
from . import output
from .operators.retrieval import MODES, Options, Searcher
from .plans import answers, catalog, indexing
from .plans.providers import HttpEmbedder, HttpGenerator, HttpReranker
from .plans.store import Store
from .session import session

VERSION = "0.1.0"


def is_path(arg: str) -> bool:
    return arg in (".", "..") or arg.startswith(("/", "./", "../", "~"))


class App:
    def __init__(self, path: str | None):
        self.path = path or str(K.default_path())
        self.config = K.load(self.path)
        self.spark = session()
        self.store = Store(self.spark, self.config.database_path)

    def searcher(self) -> Searcher:
        c = self.config
        return Searcher(self.store, c.search, HttpEmbedder(c.embedding) if c.embedding else None, HttpReranker(c.rerank) if c.rerank else None)

    def at_path(self, directory: str) -> K.Collection:
        """The collection of a directory; a new one is named after it and saved."""
        if not os.path.isdir(directory):
            raise K.ConfigError(f'path "{directory}" does not exist')
        for c in self.config.collections:
            if c.path == directory:
                return c
        new = K.Collection(K.slug(directory), directory)
        if any(c.name == new.name for c in self.config.collections):
            raise K.ConfigError(f'collection "{new.name}" has another path; give a name')
        K.add_collection(self.path, new)
        print(f'Saved collection "{new.name}" at {directory}')
        return new

    def named(self, directory: str, name: str) -> K.Collection:
        if not os.path.isdir(directory):
            raise K.ConfigError(f'path "{directory}" does not exist')
        old = next((c for c in self.config.collections if c.path == directory), None)
        if old and old.name != name:
            K.rename_collection(self.path, old.name, name)
            indexing.rename_collection(self.store, old.name, name)
            print(f'Renamed collection "{old.name}" to "{name}"')
        new = K.Collection(name, directory, *((old.description, old.extensions, old.ignore) if old else ()))
        K.add_collection(self.path, new)
        return new

    def index(self, arg: str | None, name: str | None) -> None:
        directory = os.path.abspath(K.expand_home(arg)) if arg else os.getcwd()
        if name:
            col = self.named(directory, name)
        elif arg is None or is_path(arg):
            col = self.at_path(directory)
        else:
            col = self.config.collection(arg)
        began = time.time()
        run = indexing.index(self.store, col, self.config.search.chunk_size)
        print(f'{col.name}: scanned={run.scanned} added={run.added} updated={run.updated} removed={run.removed} time={time.time() - began:.1f}s')
        if self.config.embedding:
            print(f"embedded={indexing.embed(self.store, HttpEmbedder(self.config.embedding), col.name)}")


def doctor(path: str | None) -> bool:
    fine = True

    def check(label: str, fails: str | None) -> None:
        nonlocal fine
        fine = fine and fails is None
        print(f"  OK    {label}" if fails is None else f"  FAIL  {label}: {fails}")

    at = Path(path or K.default_path())
    check("config file exists", None if at.exists() else str(at))
    cfg = None
    if at.exists():
        try:
            cfg = K.load(at)
            check("config parses", None)
        except ValueError as e:
            check("config parses", str(e))
    try:
        Store(session(), cfg.database_path if cfg else str(K.default_database()))
        check("catalog opens", None)
    except Exception as e:
        check("catalog opens", str(e).splitlines()[0])
    for c in cfg.collections if cfg else ():
        check(f'path of collection "{c.name}" exists', None if os.path.isdir(c.path) else c.path)
    for kind in ("embedding", "generation") if cfg else ():
        if getattr(cfg, kind) is None:
            print(f"  SKIP  {kind} provider (not configured)")
    return fine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tessera")
    p.add_argument("--config")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-f", "--format", default="text")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "list", "stats", "doctor", "version"):
        sub.add_parser(name)
    x = sub.add_parser("index")
    x.add_argument("target", nargs="?")
    x.add_argument("--name")
    for name in ("search", "query", "ask"):
        x = sub.add_parser(name)
        x.add_argument("text")
        x.add_argument("-c", "--collection", default="")
        if name != "ask":
            x.add_argument("-n", type=int, default=10)
        if name == "query":
            x.add_argument("--mode", default="hybrid", choices=MODES)
            x.add_argument("--explain", action="store_true")
    sub.add_parser("get").add_argument("id")
    sub.add_parser("delete").add_argument("collection")
    sub.add_parser("embed").add_argument("collection", nargs="?")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return _run(a)
    except (ValueError, OSError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace) -> int:
    if a.command == "version":
        print(VERSION)
        return 0
    if a.command == "init":
        print("Wrote the config." if K.write_template(a.config) else "The config exists.")
        Store(session(), K.load(a.config).database_path)
        return 0
    if a.command == "doctor":
        return 0 if doctor(a.config) else 1
    app = App(a.config)
    if a.command == "list":
        for c in app.config.collections:
            print(f"{c.name}\t{c.path}")
        if not app.config.collections:
            print("No named collections found.")
    elif a.command == "index":
        app.index(a.target, a.name)
    elif a.command == "embed":
        if not app.config.embedding:
            raise ValueError("no embedding provider is configured")
        print(f"embedded={indexing.embed(app.store, HttpEmbedder(app.config.embedding), a.collection)}")
    elif a.command in ("search", "query"):
        opts = Options(a.text, a.collection, a.n, *(("lexical", False) if a.command == "search" else (a.mode, a.explain)))
        print(output.formatter(a.format)(app.searcher().search(opts).collect()))
    elif a.command == "ask":
        if not app.config.generation:
            raise ValueError("no generation provider is configured")
        found = answers.ask(app.searcher(), HttpGenerator(app.config.generation), a.text, a.collection)
        print(found.text)
        for r in found.sources:
            print(f"- {output.SCHEME}://{r['collection']}/{r['path']}")
    elif a.command == "get":
        rows = catalog.get(app.store, a.id).collect()
        if not rows:
            raise ValueError(f'no document found with ID prefix "{a.id}"')
        for r in rows:
            print(f"# {r['title']}\nID:         #{r['short_id']}\nCollection: {r['collection']}\nPath:       {r['uri']}\nHash:       {r['content_hash']}\n\n{bytes(r['body']).decode('utf-8', 'replace')}")
    elif a.command == "stats":
        rows = catalog.stats(app.store).collect()
        if not rows:
            print("No indexed documents.")
        for r in rows:
            print(f"  Collection: {r['collection']}\n    Documents:  {r['documents']}\n    Chunks:     {r['chunks']}\n    Embeddings: {r['embeddings']}")
        print(f"\n  Catalog size: {catalog.human_bytes(app.store.size())}\n  Last indexed: {catalog.last_run(app.store)}")
    elif a.command == "delete":
        app.config.collection(a.collection)
        indexing.delete_collection(app.store, a.collection)
        K.remove_collection(app.path, a.collection)
        print(f'Deleted collection "{a.collection}"')
    return 0


if __name__ == "__main__":
    sys.exit(main())
