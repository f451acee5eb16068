"""What the operators share: tables, shared folders, and rows for Arrow functions."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in tests a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file:///tmp/passages-checkpoints"
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at.rstrip("/")


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that written() makes inside are deleted at the end; what is read of them must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        forget(*_scopes.pop())


def written(df: DataFrame, name: str, kept: bool = False, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and survives lost executors; ``kept`` by scratch()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if _scopes and not kept:
        _scopes[-1].append(out)
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that written() made; call it once nothing reads them."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Rows and bytes of an Arrow batch, in the JVM and in a worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Make Arrow batches small enough for rows that hold whole texts, unless the session sets their size itself."""
    for key, usual, bound in (("maxRecordsPerBatch", None, BATCH_ROWS), ("maxBytesPerBatch", "64MB", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) in (None, usual, str(64 << 20)):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(bound))


def with_text(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, int]:
    """The kept columns and the text, which is sent only once, and the text's place among them."""
    bounded_batches(docs.sparkSession)
    if text in keep:
        return docs.select(*keep), keep.index(text)
    return docs.select(*keep, F.col(text).alias("__text")), len(keep)


def crc_mod(column: str, mod: int):
    """crc32 of a column's text, modulo."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)
