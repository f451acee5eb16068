"""Keeping an expensive expression from being computed twice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(*columns: Column) -> Column:
    """Named columns as one generated row, for use in select().

    Filters on generated columns stay above the generator, so neither a filter
    of one's own nor the one that Spark infers for a later explode() computes the
    expressions a second time.
    """
    return F.inline(F.array(F.struct(*columns)))


def let(value: Column, then) -> Column:
    """then(value) inside an expression, with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
