"""Metrics of retrieval and of answers, as aggregates over all queries of a fixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grounding as G
from ..schema import FIXTURE

DEFAULT_K = 5


def fixture(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIXTURE).option("multiLine", True).json(path)


def fixture_queries(fix: DataFrame) -> DataFrame:
    rows = fix.select(F.posexplode("queries").alias("i", "q"))
    return rows.select(F.col("i").cast("long").alias("query_id"), "q.*").withColumn("limit", F.coalesce("limit", F.lit(DEFAULT_K)))


def fixture_documents(fix: DataFrame) -> DataFrame:
    return fix.select(F.explode("documents").alias("d")).select(F.col("d.name").alias("source_id"), "d.name", "d.text", "d.tags")


def retrieval_metrics(found: DataFrame, judged: DataFrame) -> DataFrame:
    """Per query recall, precision, reciprocal rank; found is (query_id, rank, source_id), judged (query_id, must, k).

    Recall counts relevant sources once, precision each hit; queries without
    judgements are not counted.
    """
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source_id"))).alias("l"))
    rows = judged.where(F.size("must") > 0).join(lists, "query_id", "left")
    top = F.filter(F.coalesce("l", F.array().cast(lists.schema["l"].dataType.simpleString())), lambda x: x["rank"] <= F.col("k"))
    sources = F.transform(top, lambda x: x["source_id"])
    hits = F.filter(sources, lambda s: F.array_contains("must", s))
    first = F.array_min(F.transform(F.filter(top, lambda x: F.array_contains("must", x["source_id"])), lambda x: x["rank"]))
    return rows.select(
        "query_id",
        (F.size(F.array_intersect(sources, F.array_distinct("must"))) / F.size(F.array_distinct("must"))).alias("recall"),
        (F.size(hits) / F.col("k")).alias("precision"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"),
    )


def summary(per_query: DataFrame) -> DataFrame:
    """One row of means; 0 for no queries."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return per_query.agg(F.count("*").alias("queries"), mean("recall").alias("recall_at_k"), mean("precision").alias("precision_at_k"), mean("reciprocal_rank").alias("mrr"))


def answer_metrics(answers: DataFrame, judged: DataFrame, refusal_text: str) -> DataFrame:
    """One row: mean citation coverage, share with all expected text, share of right refusals."""
    rows = answers.join(judged, "query_id")
    no: Column = F.contains("text", F.lit(G.REFUSAL_TOKEN)) | F.contains("text", F.lit(refusal_text))
    expected = F.forall(F.coalesce("expected_answer_contains", F.array().cast("array<string>")), lambda e: F.contains(F.lower("text"), F.lower(e)))
    return rows.agg(
        F.count("*").alias("queries"),
        F.coalesce(F.avg(F.when(~no, G.citation_coverage(F.col("text")))), F.lit(0.0)).alias("citation_coverage"),
        F.coalesce(F.avg(F.when(F.size("expected_answer_contains") > 0, expected.cast("double"))), F.lit(0.0)).alias("expected_contained"),
        F.coalesce(F.avg((no == F.coalesce("must_refuse", F.lit(False))).cast("double")), F.lit(0.0)).alias("refusal_correct"),
    )
