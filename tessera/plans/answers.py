"""Questions answered from search results: a prompt with numbered passages, a service, and a cache of its answers."""

from __future__ import annotations

import hashlib
import logging
from dataclasses import dataclass, field

from pyspark.sql import Row
from pyspark.sql import functions as F

from ..operators.retrieval import Options, Searcher
from .store import Store

log = logging.getLogger(__name__)
SYSTEM = "You answer questions about a collection of documents. Rely on the numbered passages alone, and say when they do not hold the answer. Name the passages you used by their addresses, in square brackets."
NOTHING = "Nothing in the indexed documents seems to bear on this question."


@dataclass
class Answer:
    text: str
    sources: list[Row] = field(default_factory=list)


def prompt(question: str, results: list[Row], scheme: str = "tessera") -> tuple[str, str]:
    parts = ["Passages:\n"]
    for i, r in enumerate(results, 1):
        heading = f" ({r['heading_path']})" if r["heading_path"] else ""
        parts.append(f"[{i}] {scheme}://{r['collection']}/{r['path']}{heading}\n{r['snippet']}\n")
    parts.append(f"Question: {question}")
    return SYSTEM, "\n".join(parts)


def key_of(model: str, text: str) -> str:
    return hashlib.sha256(f"{model}\0{text}".encode()).hexdigest()


class Cache:
    def __init__(self, store: Store):
        self.store = store

    def get(self, model: str, text: str) -> str | None:
        row = self.store.cached(key_of(model, text)).select("response").first()
        return row[0] if row else None

    def set(self, model: str, text: str, response: str) -> None:
        """Appends; of answers with one key the last one counts. Concurrent writers both go in."""
        new = self.store.spark.createDataFrame([(key_of(model, text), model, response)], "key string, model string, response string")
        self.store.commit(add={"llm_cache": new.withColumn("created_at", F.date_trunc("second", F.current_timestamp()))})
        self.store.compact(["llm_cache"])


def ask(searcher: Searcher, generator, question: str, collection: str = "") -> Answer:
    mode = "hybrid" if searcher.embedder is not None else "lexical"
    results = searcher.search(Options(question, collection, searcher.config.rerank_top_k, mode)).collect()
    if not results:
        return Answer(NOTHING)
    system, user = prompt(question, results)
    cache, text = Cache(searcher.store), f"{system}\n\n{user}"
    if (known := cache.get(generator.model, text)) is not None:
        return Answer(known, results)
    answer = generator.complete(system, user)
    try:
        cache.set(generator.model, text, answer)
    except Exception as e:
        log.warning("the answer was not cached: %s", e)
    return Answer(answer, results)
