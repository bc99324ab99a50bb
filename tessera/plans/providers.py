"""Services over HTTP for embeddings, reranking and answers, and an offline one for tests."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd

from ..config import Provider


class Embedder(Protocol):
    model: str
    parallel: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def embed_frames(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


class Reranker(Protocol):
    def rerank(self, query: str, passages: list[str]) -> list[float]: ...


class Generator(Protocol):
    model: str

    def complete(self, system: str, user: str, max_tokens: int = 0) -> str: ...


class ProviderError(RuntimeError):
    pass


def _post(base_url: str, path: str, body: dict, timeout: int, key: str = "") -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(base_url.rstrip("/") + path, json.dumps(body).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            raw = r.read()
    except urllib.error.HTTPError as e:
        raw = e.read()
    except OSError as e:
        raise ProviderError(f"{path}: {e}") from e
    try:
        out = json.loads(raw)
    except ValueError as e:
        raise ProviderError(f"{path}: the answer is not JSON") from e
    if out.get("error"):
        raise ProviderError(f"{path}: {out['error'].get('message', '')}")
    return out


class _Frames:
    parallel = 4

    def embed_frames(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"chunk_id": frame["chunk_id"], "vector": self.embed(frame["text"].tolist())})


@dataclass
class HttpEmbedder(_Frames):
    cfg: Provider
    parallel: int = 4

    @property
    def model(self) -> str:
        return self.cfg.model

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        size = self.cfg.batch_size if self.cfg.batch_size > 0 else 32
        for at in range(0, len(texts), size):
            part = texts[at : at + size]
            data = _post(self.cfg.base_url, "/v1/embeddings", {"model": self.cfg.model, "input": part}, 120, self.cfg.api_key).get("data") or []
            by_index = {d["index"]: d["embedding"] for d in data}
            for i in range(len(part)):
                if by_index.get(i) is None:
                    raise ProviderError(f"missing embedding for index {i}")
                out.append(by_index[i])
        return out


@dataclass
class HttpReranker:
    cfg: Provider

    def rerank(self, query: str, passages: list[str]) -> list[float]:
        results = _post(self.cfg.base_url, "/v1/rerank", {"model": self.cfg.model, "query": query, "documents": passages}, 60).get("results") or []
        by_index = {r["index"]: float(r["relevance_score"]) for r in results}
        return [by_index.get(i, 0.0) for i in range(len(passages))]


@dataclass
class HttpGenerator:
    cfg: Provider

    @property
    def model(self) -> str:
        return self.cfg.model

    def complete(self, system: str, user: str, max_tokens: int = 0) -> str:
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": user}]
        body = {"model": self.cfg.model, "messages": messages} | ({"max_tokens": max_tokens} if max_tokens else {})
        choices = _post(self.cfg.base_url, "/v1/chat/completions", body, 300, self.cfg.api_key).get("choices")
        if not choices:
            raise ProviderError("no completion choices returned")
        return choices[0]["message"]["content"]


@dataclass
class HashEmbedder(_Frames):
    """Unit vectors from hashed words: deterministic and offline."""

    dimension: int = 32
    model: str = "hash"
    parallel: int = 2

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimension)
            for w in text.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "little") % self.dimension] += 1 if h[4] & 1 else -1
            out.append((v / (np.linalg.norm(v) or 1)).astype(np.float32).tolist())
        return out
