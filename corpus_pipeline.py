"""Corpus pipeline: language ID, line dedup, near-duplicate join, decontamination, token counts.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, further columns included. Rows:

* language ID drops a document that it labels ``und``, which is one without a letter;
  short or mixed texts, whose best language is uncertain, stay;
* line dedup deletes later copies of repeated line runs from texts, sets n_chars
  anew, and drops documents of which nothing but white space is left by that;
* the n-gram Jaccard join keeps the document with the least doc_id of each
  group, and every document without words;
* decontamination drops documents contaminated by the benchmark;
* BPE returns doc_id, n_tokens, ids_sha256 and decoded_sha256.

Null texts have no letter, so they go in the first stage; an empty table stays
empty; repeated rows are treated alike until the join keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.bpe import tokens
from passages.llm.common import crc_mod, forget, scratch, written
from passages.llm.decontaminate import decontaminate
from passages.llm.jaccard import one_of_each
from passages.llm.language import fit, predict
from passages.llm.lines import dedup_lines

CORE = ("doc_id", "text", "lang", "source", "n_chars")


def _carried(docs: DataFrame, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """op on docs with further columns under names that cannot clash; these come back."""
    names = docs.columns
    held = [c if c in CORE else f"__x{i}" for i, c in enumerate(names)]
    return op(docs.toDF(*held)).select(*held).toDF(*names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def op(rows: DataFrame) -> DataFrame:
        model = fit(rows, crc_mod("doc_id", 5) != 0)
        labelled = predict(rows, model, rows.columns)
        if model is None:  # nothing to learn from: only texts without letters can be told
            return rows.where(F.col("text").rlike(r"\p{L}"))
        return labelled.where("lang_pred <> 'und'")

    return _carried(docs, op)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def op(rows: DataFrame) -> DataFrame:
        out = dedup_lines(rows)
        emptied = (F.col("n_deleted") > 0) & (F.col("n_deleted") == F.col("n_lines"))
        return out.where(~emptied).withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))

    return _carried(docs, op)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _carried(docs, one_of_each)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _carried(docs, lambda rows: decontaminate(rows, benchmark, rows.columns).where(~F.col("contaminated")))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe),
]

#: SQL cannot express the classifier, the join's groups or the tokenizer; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again.

    A stage's own tables go when it is written, and its predecessor's output then too.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch():
            docs = written(stage(spark, docs, sf_dir), "pipeline", kept=True)
        forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
