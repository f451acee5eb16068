"""Checks of an answer against its passages, as Column expressions.

A passage is a struct with ``text``, ``score`` and ``citations`` (an array of
citation structs); ``passages`` is an array of them in prompt order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CITATION, AnswerPolicy

REFUSAL_TOKEN = "[NO_ANSWER]"


def markers(answer: Column) -> Column:
    """Numbers of the [n] marks in order; numbers too long for an int are none."""
    return F.transform(F.filter(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: F.length(x) < 10), lambda x: x.cast("int"))


def cited(answer: Column, passages: Column) -> Column:
    """Numbers of the marks that name a passage, each once, in order."""
    return F.array_distinct(F.filter(markers(answer), lambda n: (n >= 1) & (n <= F.size(passages))))


def resolve(answer: Column, passages: Column) -> Column:
    """Citations of the marked passages in order, each chunk once."""
    flat = F.flatten(F.transform(cited(answer, passages), lambda n: F.element_at(passages, n)["citations"]))
    return F.aggregate(
        flat,
        F.array().cast(f"array<{CITATION}>"),
        lambda seen, c: F.when(F.exists(seen, lambda s: s["chunk_id"] == c["chunk_id"]), seen).otherwise(F.concat(seen, F.array(c))),
    )


def confidence(answer: Column, passages: Column) -> Column:
    """Mean score of the distinct passages that are marked, between 0 and 1; 0 for none."""
    marked = cited(answer, passages)
    total = F.aggregate(F.transform(marked, lambda n: F.element_at(passages, n)["score"]), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return F.when(F.size(marked) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / F.size(marked))))


def _share(found: Column, test) -> Column:
    """Share of the elements that pass; 1 if there are none."""
    return F.when(F.size(found) == 0, F.lit(1.0)).otherwise(F.size(F.filter(found, test)) / F.size(found))


def quote_grounding(answer: Column, context: Column) -> Column:
    """Share of the quoted spans that occur in the context word for word; blank quotes count as found."""
    return _share(F.regexp_extract_all(answer, F.lit('"([^"]+)"'), F.lit(1)), lambda q: (F.trim(q) == "") | F.contains(context, q))


def numeric_consistency(answer: Column, context: Column) -> Column:
    """Share of the numbers that occur in the context as substrings."""
    return _share(F.regexp_extract_all(answer, F.lit(r"([0-9]+(?:[.,][0-9]+)*)"), F.lit(1)), lambda n: F.contains(context, n))


def citation_coverage(answer: Column) -> Column:
    """Share of the sentences that hold a mark; a sentence ends at each . ! or ?."""
    parts = F.filter(F.regexp_extract_all(answer, F.lit(r"([^.!?]*[.!?]|[^.!?]+$)"), F.lit(1)), lambda s: F.regexp_replace(s, r"[\s\p{Z}.!?]", "") != "")
    return F.when(F.size(parts) == 0, F.lit(0.0)).otherwise(F.size(F.filter(parts, lambda s: s.rlike(r"\[[0-9]+\]"))) / F.size(parts))


def refused(answer: Column, n_citations: Column, trust: Column, context: Column, policy: AnswerPolicy) -> Column:
    """Whether the policy replaces the answer by its refusal."""
    out = F.contains(answer, F.lit(REFUSAL_TOKEN))
    if policy.require_citations:
        out = out | (n_citations == 0)
    if policy.min_confidence is not None:
        out = out | (trust < policy.min_confidence)
    if policy.min_quote_grounding is not None:
        out = out | (quote_grounding(answer, context) < policy.min_quote_grounding)
    if policy.min_numeric_consistency is not None:
        out = out | (numeric_consistency(answer, context) < policy.min_numeric_consistency)
    return out
