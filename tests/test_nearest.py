"""Block-wise nearest vectors and MMR equal their definitions, on vectors of odd kinds and in several blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passages.operators import nearest, rank
from passages.operators.rerank import mmr_order
from passages.plans.retrieve import score_vectors
from passages.schema import MMRConfig


def _made(spark, n, odd):
    rng = random.Random(7)
    rows = [(f"k{i:03d}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(n)]
    rows += [(f"k{n + i:03d}", rows[i % 3][1]) for i in range(12)]  # copies
    if odd:
        rows += [("x0", None), ("x1", []), ("x2", [0.0] * 6), ("x3", [1.0, 2.0]), ("x4", [1.0, None, 2.0, 0.0, 0.0, 1.0])]
    return spark.createDataFrame(rows, "key string, vec array<float>"), rows


def test_nearest_equals_all_pairs(spark, monkeypatch):
    rows, _ = _made(spark, 120, True)
    asked = rows.where("key < 'k020' OR key LIKE 'x%' OR key > 'k125'").select(F.xxhash64("key").alias("query_id"), F.col("vec").alias("query_vec"))
    want = rank.top_by(score_vectors(rows, asked, "key").drop("vec"), "query_id", [F.round("score", rank.PLACES).desc(), F.col("key").asc()], 7)
    got = nearest.nearest(rows.repartition(3), asked, "key", 7, block=10)
    of = lambda df: sorted((r.query_id, r["rank"], r.key, round(r.score, 9)) for r in df.collect())
    assert of(got) == of(want)


@pytest.mark.parametrize("weight", [0.0, 0.3, 0.7, 1.0])
def test_mmr_over_all_vectors_is_exact(spark, weight):
    rows, made = _made(spark, 150, False)
    asked = rows.where("key < 'k012'").select(F.col("key").alias("query_id"), F.col("vec").alias("query_vec"))
    got = {}
    for r in nearest.mmr_nearest(rows.repartition(3), asked, "key", MMRConfig(weight, 6), 6, block=5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.key
    vec = {k: np.asarray(v, np.float32).astype(float) for k, v in made}
    unit = {k: v / np.linalg.norm(v) for k, v in vec.items()}
    assert len(got) == 12
    for q, places in got.items():
        near = sorted(vec, key=lambda k: (-round(float(unit[k] @ unit[q]), 9), k))
        order = mmr_order(np.round([float(unit[k] @ unit[q]) for k in near], 12), [vec[k] for k in near], weight, 6)
        assert [places[n] for n in range(1, 7)] == [near[i] for i in order]


def test_no_vector_and_no_pair_is_shuffled(spark):
    """What a search over all vectors deals out is keys and scores; before, MMR sent pools with their vectors."""
    rows, _ = _made(spark, 30, False)
    asked = rows.select(F.col("key").alias("query_id"), F.col("vec").alias("query_vec"))
    plan = nearest.nearest(rows, asked, "key", 3)
    window = plan._jdf.queryExecution().sparkPlan().toString().split("MapInArrow")[0]
    assert "vec" not in window


def test_index_of_fewer_rows_than_places(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "key string, vec array<float>")
    asked = rows.select(F.col("key").alias("query_id"), F.col("vec").alias("query_vec"))
    got = sorted(tuple(r) for r in nearest.mmr_nearest(rows, asked, "key", MMRConfig(0.5, 5), 5).select("query_id", "rank", "key").collect())
    assert got == [("a", 1, "a"), ("a", 2, "b"), ("b", 1, "b"), ("b", 2, "a")]
    assert nearest.nearest(rows.limit(0), asked, "key", 5).count() == 0
