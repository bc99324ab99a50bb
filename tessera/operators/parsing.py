"""Files to sections, by extension. Markdown goes through an Arrow UDF; text and source code are column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import markdown
from .chunking import whole_text_sections

PARSED = "struct<title:string,sections:array<struct<heading_path:string,text:string,ordinal:int>>>"
MARKDOWN = (".md", ".markdown")
TEXT = (".txt", ".text")
SOURCE = (".go", ".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".java", ".c", ".cpp", ".h")
#: A parser: text -> (title, sections).
Parser = Callable[[str], tuple[str, list[markdown.Section]]]
_parsers: dict[str, Parser] = {e: markdown.parse for e in MARKDOWN}


def register(extension: str, parser: Parser) -> None:
    """Files with this extension (lower case, with its dot) go through ``parser``."""
    _parsers[extension.lower()] = parser


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty without one."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\.[^.]*)$", 1))


def parsed(df: DataFrame, path_col: str = "path", body_col: str = "body") -> DataFrame:
    """``df`` with title and sections. Bytes that are no UTF-8 read as U+FFFD. An unknown extension reads as text."""
    custom = dict(_parsers)

    @F.pandas_udf(PARSED)
    def by_parser(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, bodies in batches:
            rows = []
            for kind, body in zip(kinds, bodies):
                title, sections = custom[kind](bytes(body).decode("utf-8", "replace"))
                rows.append((title, [{"heading_path": s.heading_path, "text": s.text, "ordinal": s.ordinal} for s in sections]))
            yield pd.DataFrame(rows, columns=["title", "sections"])

    df = df.withColumn("__kind", extension(df[path_col]))
    special = df.filter(F.col("__kind").isin(*custom)).withColumn("__parsed", by_parser("__kind", body_col))
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    text = F.call_function("try_validate_utf8", F.col(body_col).cast("string"))
    text = F.coalesce(text, F.call_function("make_valid_utf8", F.col(body_col).cast("string")))
    one = F.struct(F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), whole_text_sections(text).alias("sections"))
    plain = df.filter(~F.col("__kind").isin(*custom)).withColumn("__parsed", one.cast(PARSED))
    out = special.unionByName(plain)
    return out.withColumns({"title": X.title_or_name(F.col("__parsed.title"), F.col(path_col)), "sections": F.col("__parsed.sections")}).drop("__kind", "__parsed")
