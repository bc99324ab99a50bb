"""Search results as text, JSON or Markdown."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Row

SCHEME = "tessera"


def _uri(r: Row) -> str:
    return f"{SCHEME}://{r['collection']}/{r['path']}"


def as_text(rows: Iterable[Row]) -> str:
    out = []
    for i, r in enumerate(rows, 1):
        out.append(f"{i}. {r['title']} (score: {r['score']:.4f})")
        out.append(f"   {_uri(r)}" + (f" [{r['heading_path']}]" if r["heading_path"] else ""))
        if r["snippet"]:
            out.append(f"   {r['snippet']}")
        if (e := r["explain"]) is not None:
            line = f"   [explain] bm25={e['bm25_score'] or 0:.4f} rank={e['bm25_rank'] or 0}"
            if e["vector_rank"]:
                line += f" vec_dist={e['vector_distance']:.4f} vec_rank={e['vector_rank']}"
            if e["rrf_score"]:
                line += f" rrf={e['rrf_score']:.4f}"
            if e["rerank_score"]:
                line += f" rerank={e['rerank_score']:.4f}"
            out.append(line)
        out.append("")
    return "\n".join(out) if out else "No results found."


def as_json(rows: Iterable[Row]) -> str:
    """Empty titles, headings and explanations are left out, and so are explained values of nothing."""
    items = []
    for r in rows:
        item = {k: v for k, v in r.asDict(recursive=True).items() if v is not None and (v or k not in ("title", "heading_path"))}
        if "explain" in item:
            item["explain"] = {k: v for k, v in item["explain"].items() if v}
        items.append(item)
    return json.dumps(items, indent=2, ensure_ascii=False)


def as_markdown(rows: Iterable[Row]) -> str:
    out = []
    for r in rows:
        out += [f"### {r['title']}", f"**Location:** `{_uri(r)}`" + (f" › {r['heading_path']}" if r["heading_path"] else "")]
        if r["snippet"]:
            out.append(f"> {r['snippet']}")
        out.append("")
    return "\n".join(out) if out else "_No results found._"


def formatter(name: str):
    return {"json": as_json, "markdown": as_markdown, "md": as_markdown}.get(name.lower(), as_text)
