"""Configuration: a YAML file over defaults. Comments survive changes, which edit lines and leave the rest of the file alone."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from .functions.text import slug

__all__ = ["Collection", "Config", "ConfigError", "Provider", "Search", "add_collection", "default_path", "load", "remove_collection", "rename_collection", "slug", "write_template"]
OPENAI_URL = "https://api.openai.com"


class ConfigError(ValueError):
    pass


@dataclass
class Collection:
    name: str
    path: str
    description: str = ""
    extensions: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()


@dataclass
class Provider:
    name: str = ""
    base_url: str = ""
    model: str = ""
    api_key: str = ""
    dimension: int = 0
    batch_size: int = 32


@dataclass
class Search:
    default_mode: str = "hybrid"
    bm25_top_k: int = 50
    vector_top_k: int = 50
    rerank_top_k: int = 10
    rrf_k: int = 60
    chunk_size: int = 512
    chunk_overlap: int = 64  # read by nothing: chunks do not overlap


@dataclass
class Config:
    database_path: str
    collections: list[Collection] = field(default_factory=list)
    embedding: Provider | None = None
    rerank: Provider | None = None
    generation: Provider | None = None
    search: Search = field(default_factory=Search)

    def collection(self, name: str) -> Collection:
        for c in self.collections:
            if c.name == name:
                return c
        raise ConfigError(f'collection "{name}" not found in config')


def default_path() -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "tessera" / "config.yaml"


def default_database() -> Path:
    return Path(os.environ.get("XDG_DATA_HOME") or Path.home() / ".local/share") / "tessera" / "catalog"


def expand_home(path: str) -> str:
    return str(Path.home()) + path[1:] if path.startswith("~") else path


def _placed(path: str, base: Path) -> str:
    path = expand_home(path)
    return path if not path or os.path.isabs(path) or "://" in path else os.path.normpath(base / path)


def _provider(values: dict | None, kind: str) -> Provider | None:
    if not values:
        return None
    p = Provider(**{k: v for k, v in values.items() if k in Provider.__dataclass_fields__})
    if p.name == "openai" and kind in ("embedding", "generation"):
        p.base_url = p.base_url or OPENAI_URL
        p.api_key = p.api_key or os.environ.get("OPENAI_API_KEY", "")
    return p


def load(path: str | Path | None = None) -> Config:
    path = Path(path or default_path()).absolute()
    try:
        raw = yaml.safe_load(path.read_text()) or {}
    except yaml.YAMLError as e:
        raise ConfigError(f"parsing config: {e}") from e
    base = path.parent
    cfg = Config(_placed(raw.get("database_path") or str(default_database()), base))
    for c in raw.get("collections") or []:
        c = c or {}
        cfg.collections.append(Collection(c.get("name") or "", _placed(c.get("path") or "", base), c.get("description") or "", tuple(c.get("extensions") or ()), tuple(c.get("ignore") or ())))
    providers = raw.get("providers") or {}
    cfg.embedding, cfg.rerank, cfg.generation = (_provider(providers.get(k), k) for k in ("embedding", "rerank", "generation"))
    cfg.search = Search(**{k: v for k, v in (raw.get("search") or {}).items() if k in Search.__dataclass_fields__})
    seen = set()
    for c in cfg.collections:
        if not c.name:
            raise ConfigError("invalid config: a collection has no name")
        if not c.path:
            raise ConfigError(f'invalid config: collection "{c.name}" has no path')
        if c.name in seen:
            raise ConfigError(f'invalid config: duplicate collection "{c.name}"')
        seen.add(c.name)
    return cfg


def _scalar(value: str) -> str:
    return yaml.safe_dump(value, default_flow_style=True, width=1 << 20).removesuffix("...\n").strip()


def _nodes(path: str | Path) -> tuple[list[str], yaml.Node, yaml.SequenceNode | None]:
    text = Path(path).read_text()
    root = yaml.compose(text)
    if root is None:
        raise ConfigError("empty config document")
    for key, value in root.value:
        if key.value == "collections":
            return text.split("\n"), root, value if isinstance(value, yaml.SequenceNode) else None
    return text.split("\n"), root, None


def _entry(seq: yaml.SequenceNode | None, name: str) -> dict[str, yaml.Node] | None:
    for item in seq.value if seq else ():
        found = {k.value: v for k, v in item.value}
        if "name" in found and found["name"].value == name:
            return found | {"": item}
    return None


def _write(path: str | Path, lines: list[str]) -> None:
    part = Path(f"{path}.part")
    part.write_text("\n".join(lines))
    os.replace(part, path)


def _set(lines: list[str], node: yaml.Node, value: str) -> None:
    a, b = node.start_mark, node.end_mark
    lines[a.line : b.line + 1] = [lines[a.line][: a.column] + _scalar(value) + lines[b.line][b.column :]]


def add_collection(path: str | Path, col: Collection) -> None:
    """Add an entry, or set the path of the one with this name."""
    lines, root, seq = _nodes(path)
    if (old := _entry(seq, col.name)) is not None:
        if "path" in old:
            _set(lines, old["path"], col.path)
        else:
            mark = old["name"].start_mark
            indent = old[""].start_mark.column
            lines.insert(mark.line + 1, " " * indent + f"path: {_scalar(col.path)}")
        return _write(path, lines)
    indent = seq.start_mark.column if seq and seq.value and not seq.flow_style else 2
    new = [" " * indent + f"- name: {_scalar(col.name)}", " " * indent + f"  path: {_scalar(col.path)}"]
    if col.description:
        new.append(" " * indent + f"  description: {_scalar(col.description)}")
    for key in ("extensions", "ignore"):
        if values := getattr(col, key):
            new.append(" " * indent + f"  {key}: [{', '.join(map(_scalar, values))}]")
    if seq is not None and seq.value and not seq.flow_style:
        last = seq.value[-1].value[-1][1]
        at = last.end_mark.line + (1 if last.end_mark.column else 0)
        lines[at:at] = new
    else:
        for i, line in enumerate(lines):
            if re.match(r"collections\s*:", line):
                lines[i : i + 1] = ["collections:", *new]
                break
        else:
            while lines and not lines[-1].strip():
                lines.pop()
            lines += ["collections:", *new, ""]
    _write(path, lines)


def rename_collection(path: str | Path, old: str, new: str) -> None:
    lines, _, seq = _nodes(path)
    found = _entry(seq, old)
    if found is None:
        raise ConfigError(f'collection "{old}" not found in config')
    _set(lines, found["name"], new)
    _write(path, lines)


def remove_collection(path: str | Path, name: str) -> None:
    lines, _, seq = _nodes(path)
    found = _entry(seq, name)
    if found is None:
        raise ConfigError(f'collection "{name}" not found in config')
    item = found[""]
    last = item.value[-1][1].end_mark
    end = last.line + (1 if last.column else 0)
    del lines[item.start_mark.line : end]
    if len(seq.value) == 1:
        for i, line in enumerate(lines):
            if re.match(r"collections\s*:", line):
                lines[i] = "collections: []"
    _write(path, lines)


TEMPLATE = """\
# Where the catalog's tables are kept.
database_path: {database}

collections:
  - name: notes
    path: ~/notes
    description: Notes and documents
    extensions: [.md, .txt]
    ignore: [drafts]

# Any HTTP service with /v1/embeddings, /v1/rerank and /v1/chat/completions will do.
# providers:
#   embedding:
#     name: local
#     base_url: http://localhost:8080
#     model: some-embedding-model
#     dimension: 768
#   rerank:
#     base_url: http://localhost:8080
#     model: some-rerank-model
#   generation:
#     base_url: http://localhost:8080
#     model: some-chat-model

search:
  bm25_top_k: 50
  vector_top_k: 50
  rerank_top_k: 10
  rrf_k: 60
  chunk_size: 512
"""


def write_template(path: str | Path | None = None) -> bool:
    """Write the template unless the file exists; whether it was written."""
    path = Path(path or default_path())
    if path.exists():
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(TEMPLATE.format(database=default_database()))
    return True
