"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 if either side has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    size = norm(x) * norm(y)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def from_blob(blob: Column) -> Column:
    """array<float> of a little-endian float32 blob; used only where such blobs are imported."""
    @F.pandas_udf("array<float>")
    def read(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return read(blob)


def to_blob(vec: Column) -> Column:
    @F.pandas_udf("binary")
    def write(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return write(vec)
