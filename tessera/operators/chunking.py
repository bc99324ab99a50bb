"""Breakpoint chunking, as a fold over lines in column expressions.

A line's score: 100 for a heading, 80 for a fence, 20 for a blank line, else 0. Lines gather until their size (code points,
one more for each line's end) reaches the target, or a scored line's score, weakened by its distance from the target,
still is 20 or more; no chunk ends below a quarter of the target. The line that breaks ends its chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

TARGET = 512
HEADING, FENCE, BLANK, BREAK = 100, 80, 20, 20.0
#: Chunks that the fold's state copies as one.
RUN = 64


def line_score(line: Column) -> Column:
    plain = X.trim(line)
    return F.when(plain.startswith("#"), HEADING).when(plain.startswith("```") | plain.startswith("~~~"), FENCE).when(plain == "", BLANK).otherwise(0)


def decay(size: Column, target: int) -> Column:
    """1 at the target, 0 from twice the target (or nothing) on."""
    return F.greatest(F.lit(0.0), 1 - F.abs(size - target) / target) if target > 0 else F.lit(1.0)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def chunk_bounds(lines: Column, target: int) -> Column:
    """(start, n) of each chunk's lines. Bounds gather in full runs and a last one, so that a step copies little."""
    rows = F.transform(lines, lambda line: F.struct((F.length(line) + 1).alias("n"), line_score(line).alias("score")))
    pairs = "array<struct<start:int,n:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("lines"), F.lit(0).alias("size"), F.array().cast(f"array<{pairs}>").alias("runs"), F.array().cast(pairs).alias("last"))

    def closed(state: Column, lines: Column) -> Column:
        """The state after a chunk of so many lines."""
        full = F.size(state["last"]) >= RUN
        pair = F.struct(state["at"].alias("start"), lines.alias("n"))
        runs = F.when(full, F.array_append(state["runs"], state["last"])).otherwise(state["runs"])
        last = F.when(full, F.array(pair)).otherwise(F.array_append(state["last"], pair))
        return F.struct((state["at"] + lines).alias("at"), F.lit(0).alias("lines"), F.lit(0).alias("size"), runs.alias("runs"), last.alias("last"))

    def step(state: Column, row: Column) -> Column:
        size = state["size"] + row["n"]
        stop = (size >= target // 4) & ((size >= target) | ((row["score"] > 0) & (row["score"] * decay(size, target) >= BREAK)))
        more = F.struct(state["at"].alias("at"), (state["lines"] + 1).alias("lines"), size.alias("size"), state["runs"].alias("runs"), state["last"].alias("last"))
        return F.when(stop, closed(state, state["lines"] + 1)).otherwise(more)

    def finish(state: Column) -> Column:
        done = F.when(state["lines"] > 0, closed(state, state["lines"])).otherwise(state)
        return bound(done, lambda s: F.flatten(F.array_append(s["runs"], s["last"])))

    return F.aggregate(rows, start, step, finish)


def chunk_sections(sections: DataFrame, target: int = TARGET) -> DataFrame:
    """(doc_id, sections: array of (heading_path, text, ordinal)) -> (doc_id, seq, text, heading_path, ordinal, content_length); seq runs on through a document's sections.

    A document's chunks are made in its own row: no shuffle.
    """
    base = sections.withColumn("lines", F.transform("sections", lambda s: F.struct(s["heading_path"].alias("heading_path"), s["ordinal"].alias("ordinal"), F.split(s["text"], "\n", -1).alias("lines"))))

    def of_section(s: Column) -> Column:
        text = lambda c: X.right_trim(F.array_join(F.slice(s["lines"], c["start"] + 1, c["n"]), "\n"))
        made = F.transform(chunk_bounds(s["lines"], target), lambda c: F.struct(text(c).alias("text"), s["heading_path"].alias("heading_path"), s["ordinal"].alias("ordinal")))
        return F.filter(made, lambda c: c["text"] != "")

    chunks = F.flatten(F.transform("lines", of_section))
    out = base.select(*[c for c in sections.columns if c != "sections"], F.posexplode(chunks).alias("seq", "c"))
    return out.select(*[c for c in sections.columns if c != "sections"], "seq", "c.text", "c.heading_path", "c.ordinal", F.octet_length("c.text").alias("content_length"))


def whole_text_sections(text: Column) -> Column:
    """One section: the text, without a heading, at 0; none for a blank text."""
    one = F.array(F.struct(F.lit("").alias("heading_path"), text.alias("text"), F.lit(0).alias("ordinal")))
    return F.when(X.trim(F.coalesce(text, F.lit(""))) != "", one).otherwise(F.slice(one, 1, 0))
