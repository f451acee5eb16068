"""Answers with citations: prompts as columns, generation in Arrow batches, checks as expressions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grounding as G
from ..schema import AnswerPolicy, EngineError
from ..sources.generators import TextGenerator
from .retrieve import Searcher

DEFAULT_SYSTEM = "Answer from the numbered passages. Mark each statement with the number of its passage in brackets, as [1]."
STRICT_SYSTEM = DEFAULT_SYSTEM + f" Use nothing else. If the passages do not hold the answer, reply {G.REFUSAL_TOKEN} and nothing more. Quote numbers and names exactly."


def numbered(passages: Column) -> Column:
    """Passages as blocks ``[n] (source — section)`` with their full text."""

    def block(p: Column, i: Column) -> Column:
        cite = F.get(p["citations"], F.lit(0))
        where = F.concat_ws(" — ", cite["source_name"], cite["section_title"])
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), where, F.lit(")\n"), p["text"])

    return F.array_join(F.transform(passages, block), "\n\n")


def prompt(question: Column, passages: Column) -> Column:
    return F.concat(numbered(passages), F.lit("\n\nQuestion: "), question)


def gathered(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, question, passages): each query's few passages in rank order; empty if none."""
    one = F.struct("rank", "source_id", "start_page", "excerpt", "text", "bm25", "cosine", "score", "citations")
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("passages"))
    kind = lists.schema["passages"].dataType.simpleString()
    return queries.join(lists, "query_id", "left").withColumn("passages", F.coalesce("passages", F.array().cast(kind)))


def generate(rows: DataFrame, generator: TextGenerator, system: str, prompt_name: str = "prompt") -> DataFrame:
    names, place = rows.columns, rows.columns.index(prompt_name)
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = [generator.generate([("system", system), ("user", p)]) for p in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string())], names=[*names, "reply"])

    return rows.mapInArrow(run, schema)


def checked(rows: DataFrame, policy: AnswerPolicy) -> DataFrame:
    """(query_id, question, text, citations, passages, confidence, refused) of replies."""
    reply, passages = F.col("reply"), F.col("passages")
    context = F.array_join(F.transform(passages, lambda p: p["text"]), "\n\n")
    out = rows.withColumn("__cites", G.resolve(reply, passages)).withColumn("__trust", G.confidence(reply, passages))
    out = out.withColumn("refused", G.refused(reply, F.size("__cites"), F.col("__trust"), context, policy))
    no = F.col("refused")
    return out.select(
        "query_id", "question", F.when(no, F.lit(policy.refusal_text)).otherwise(reply).alias("text"),
        F.when(no, F.slice("__cites", 1, 0)).otherwise(F.col("__cites")).alias("citations"), "passages",
        F.when(no, F.lit(0.0)).otherwise(F.col("__trust")).alias("confidence"), "refused",
    )


def answer(searcher: Searcher, queries: DataFrame, generator: TextGenerator | None, policy: AnswerPolicy = AnswerPolicy(), limit: int = 5, strict: bool = False, **options) -> DataFrame:
    """Answers of all questions in one job."""
    if generator is None:
        raise EngineError(600, "no generator")
    found = searcher.hybrid(queries, limit, **options)
    rows = gathered(found, queries.select("query_id", "question"))
    rows = rows.withColumn("prompt", prompt(F.col("question"), F.col("passages")))
    return checked(generate(rows, generator, STRICT_SYSTEM if strict else DEFAULT_SYSTEM), policy)


def answer_stream(searcher: Searcher, question: str, generator: TextGenerator | None, policy: AnswerPolicy = AnswerPolicy(), limit: int = 5, strict: bool = False) -> Iterator[tuple[str, object]]:
    """Events of one answer: ("passages", rows), ("text", piece)..., ("done", answer row). Closing the iterator cancels it."""
    if generator is None:
        raise EngineError(600, "no generator")
    spark = searcher.store.spark
    queries = spark.createDataFrame([(0, question)], "query_id long, question string")
    found = searcher.hybrid(queries, limit)
    rows = gathered(found, queries).withColumn("prompt", prompt(F.col("question"), F.col("passages")))
    row = rows.first()
    yield "passages", row.passages
    pieces = []
    for piece in generator.stream([("system", STRICT_SYSTEM if strict else DEFAULT_SYSTEM), ("user", row.prompt)]):
        pieces.append(piece)
        yield "text", piece
    kept = spark.createDataFrame([row], rows.schema).withColumn("reply", F.lit("".join(pieces)))
    yield "done", checked(kept, policy).first()
