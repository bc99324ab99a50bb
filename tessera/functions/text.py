"""Column expressions for text: tokens, trimming, names, hashes, query rewriting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a query drops unless nothing else is left.
STOP_WORDS = frozenset(
    """
    a an the
    in on at to for of with from by as into about
    and or but nor
    what who which when where why how
    is are was were be been being
    have has had do does did
    will would could should may might
    it its this that these those
    i me my we our you your he she they them
    not if then so up out
    """.split()
)
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Unicode white space at the end and at the start; Spark's trim knows spaces only.
END_SPACE = r"[\s\p{Z}\x85]+$"
START_SPACE = r"^[\s\p{Z}\x85]+"


def query_terms(query: str, unicode_terms: bool = False) -> list[str]:
    """Terms of a query: characters other than ASCII letters and digits are deleted, stop words dropped unless that leaves nothing; case and repeats stay.

    unicode_terms: keep letters and digits of all scripts instead.
    """
    strip = (lambda t: "".join(c for c in t if c.isalnum())) if unicode_terms else (lambda t: re.sub("[^A-Za-z0-9]", "", t))
    every = [t for t in map(strip, query.split()) if t]
    return [t for t in every if t.lower() not in STOP_WORDS] or every


def query_terms_column(query: Column) -> Column:
    """:func:`query_terms` over a column."""
    every = F.filter(F.transform(F.split(query, r"[\s\p{Z}\x85]+"), lambda t: F.regexp_replace(t, "[^A-Za-z0-9]", "")), lambda t: t != "")
    telling = F.filter(every, lambda t: ~F.lower(t).isin(*sorted(STOP_WORDS)))
    return F.when(F.size(telling) > 0, telling).otherwise(every)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def right_trim(text: Column) -> Column:
    return F.regexp_replace(text, END_SPACE, "")


def trim(text: Column) -> Column:
    return F.regexp_replace(right_trim(text), START_SPACE, "")


def short_id(content_hash: Column) -> Column:
    return F.substring(content_hash, 1, 6)


def uri(collection: Column, path: Column, scheme: str = "tessera") -> Column:
    return F.concat(F.lit(f"{scheme}://"), collection, F.lit("/"), path)


def title_or_name(title: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.element_at(F.split(path, "/"), -1))


def cache_key(model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\0"), prompt), 256)


def hash_prefix(content_hash: Column, prefix: str) -> Column:
    """ASCII-case-insensitive prefix match; % and _ in the prefix are wildcards."""
    return content_hash.ilike(prefix + "%")


def slug(path: str) -> str:
    """Name of a collection from the last part of its path."""
    name = path.rstrip("/").rpartition("/")[2]
    return re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or "collection"


def slug_column(path: Column) -> Column:
    """:func:`slug` over a column."""
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("collection"))
