"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .common import crc_mod, table
from .oracles import SQL


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import main_text

    return main_text(spread(table(spark, sf_dir, "pages")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, predict

    docs = spread(table(spark, sf_dir, "documents")).withColumn("held_out", crc_mod("doc_id", 5) == 0)
    model = fit(docs, crc_mod("doc_id", 5) != 0)
    return predict(docs, model, ["doc_id", "held_out"])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"), ["doc_id"])


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import interleave

    return interleave(table(spark, sf_dir, "documents"), 24)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"), ["doc_id"]).drop("spans")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import tokens

    return tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html": op1_html,
        "op2_language": op2_language,
        "op3_secrets": op3_secrets,
        "op4_chat": op4_chat,
        "op5_sharding": op5_sharding,
        "op6_jaccard": op6_jaccard,
        "op7_decontaminate": op7_decontaminate,
        "op8_lines": op8_lines,
        "op9_topk": op9_topk,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
