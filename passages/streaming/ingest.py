"""Incremental ingest: files that arrive in a directory become sources as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..sources.types import uti_of

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_stream(engine: Engine, directory: str, checkpoint: str, glob: str = "*", trigger: dict | None = None) -> StreamingQuery:
    """Watch a directory; each micro-batch is one ingest, which replaces sources of the same name.

    A batch that is run again after a failure replaces what it wrote, so sources
    are ingested exactly once in effect.
    """
    name = F.element_at(F.split("path", "/"), -1)
    files = engine.spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).load(directory)
    rows = files.select(name.alias("source_id"), F.lit("data").alias("kind"), uti_of(F.col("path")).alias("uti"), name.alias("name"), "path", F.lit(None).cast("string").alias("text"), F.col("content").alias("bytes"))

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            engine.ingest(batch)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
