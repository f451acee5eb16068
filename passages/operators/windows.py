"""Context windows over chunks, and documents fetched in part.

Windows are joined only for the hits: a hit's source and ordinal range meet the
chunks on the source, so texts of other sources are not gathered.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.once import let
from ..schema import EngineError


def _joined(rows: DataFrame, by: list[str], separator: str = "\n\n") -> DataFrame:
    """(by, window_ids, text): chunks of each group in order."""
    grouped = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("n_ordinal", "n_id", "n_text"))).alias("w"))
    return grouped.select(*by, F.transform("w", lambda x: x["n_id"]).alias("window_ids"), F.array_join(F.transform("w", lambda x: x["n_text"]), separator).alias("text"), F.size("w").alias("window_size"))


def neighbours(hits: DataFrame, chunk_rows: DataFrame, expand: int, by: list[str] | None = None, sent: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Hits with window_ids and text: the chunks of the source from ``expand`` before to as many after.

    Ordinals need not be dense: the range is of ranks within the source only if
    they are, which holds for chunks as the engine writes them. ``sent`` may
    mark keys of few hits for a broadcast, so that texts of chunks are not dealt out.
    """
    if expand < 0:
        raise ValueError("expand is 0 or more")
    by = by or ["query_id", "chunk_id"]
    near = chunk_rows.select(F.col("source_id"), F.col("ordinal").alias("n_ordinal"), F.col("chunk_id").alias("n_id"), F.col("content").alias("n_text"))
    # One row for each neighbour's ordinal: an equality join, which hash partitioning serves, in place of a range.
    wanted = hits.select(*by, "source_id", F.explode(F.sequence(F.col("ordinal") - expand, F.col("ordinal") + expand)).alias("n_ordinal"))
    return hits.join(_joined(sent(wanted).join(near, ["source_id", "n_ordinal"]), by), by)


def parents(hits: DataFrame, chunk_rows: DataFrame, expand: int, sent: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """As neighbours, but a hit with a parent has all chunks of that parent for its window."""
    by = ["query_id", "chunk_id"]
    near = chunk_rows.select("source_id", "parent_id", F.col("ordinal").alias("n_ordinal"), F.col("chunk_id").alias("n_id"), F.col("content").alias("n_text"))
    with_parent = hits.where("parent_id IS NOT NULL")
    own = with_parent.join(_joined(sent(with_parent.select(*by, "source_id", "parent_id")).join(near.where("parent_id IS NOT NULL"), ["source_id", "parent_id"]), by), by)
    return own.unionByName(neighbours(hits.where("parent_id IS NULL"), chunk_rows, expand, sent=sent))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def anchor_chunk(chunk_rows: DataFrame, source_id: str, anchor: str) -> int | None:
    """The first ordinal whose text holds the anchor; a-z match A-Z, other letters only themselves; none for a blank anchor."""
    if not anchor.strip():
        return None
    found = chunk_rows.where((F.col("source_id") == source_id) & F.contains(ascii_lower(F.col("content")), ascii_lower(F.lit(anchor))))
    return found.agg(F.min("ordinal")).first()[0]


def fetch_document(chunk_rows: DataFrame, source_id: str, anchor: str | None = None, start_page: int | None = None, expand: int = 1, max_chars: int = 8000) -> dict:
    """A document's text: around an anchor, else from a page on, else whole; clipped.

    An anchor that is not found falls through. Only as many chunks as the clip
    can need come to the driver.
    """
    own = chunk_rows.where(F.col("source_id") == source_id)
    if own.isEmpty():
        raise EngineError(404, f"no source {source_id}")
    expand = min(8, max(0, expand))
    at = anchor_chunk(chunk_rows, source_id, anchor) if anchor is not None else None
    if at is not None:
        own = own.where(F.col("ordinal").between(at - expand, at + expand))
    elif start_page is not None:
        pivot = own.where(F.coalesce("page", F.lit(0)) >= start_page).agg(F.min("ordinal")).first()[0]
        own = own.where(F.lit(pivot is not None) & (F.col("ordinal") >= F.lit(pivot)))
    pages = own.agg(F.min("page").alias("a"), F.max("page").alias("b")).first()
    # One source's chunks, by their lengths; of those beyond the clip only the ids come to the driver.
    before = F.coalesce(F.sum(F.length("content") + 2).over(Window.partitionBy("source_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = own.withColumn("__before", before).select("ordinal", "chunk_id", F.when(F.col("__before") <= max_chars, F.substring("content", 1, max_chars)).alias("content")).collect()
    rows.sort(key=lambda r: r.ordinal)
    text = "\n\n".join(r.content for r in rows if r.content is not None)[:max_chars]
    return {"source_id": source_id, "text": text, "start_page": pages.a, "end_page": pages.b, "chunk_ids": [r.chunk_id for r in rows]}


def snippet(text: Column, terms: Column, width: int = 18) -> Column:
    """The run of at most ``width`` words with the most distinct terms, the earliest of equals; … at cut ends.

    A run gains a term only where its last word is one, so only such runs, and the first, are looked at.
    """

    def found(words: Column) -> Column:
        folded = F.transform(words, lambda w, i: F.struct(i.alias("at"), F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_-]", "")).alias("term")))
        return F.struct(words.alias("words"), F.filter(folded, lambda x: F.array_contains(terms, x["term"])).alias("hits"))

    def chosen(x: Column) -> Column:
        starts = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(x["hits"], lambda h: F.greatest(F.lit(0), h["at"] - width + 1))))
        inside = lambda s: F.size(F.filter(terms, lambda t: F.exists(x["hits"], lambda h: (h["term"] == t) & h["at"].between(s, s + width - 1))))
        best = F.array_min(F.transform(starts, lambda s: F.struct((-inside(s)).alias("misses"), s.alias("at"))))
        return F.struct(x["words"].alias("words"), best["at"].alias("at"))

    def shown(x: Column) -> Column:
        run = F.array_join(F.slice(x["words"], x["at"] + 1, F.lit(width)), " ")
        return F.concat(F.when(x["at"] > 0, "…").otherwise(""), run, F.when(x["at"] + width < F.size(x["words"]), "…").otherwise(""))

    return let(let(let(F.split(X.collapse(text), " "), found), chosen), shown)
