"""Proportional stratified interleaving of documents into shards, by law ``rows``.

Within each source the rows are shuffled by a seeded hash and ranked; the rank's
place as a fraction of the source orders all rows, so any run of the order has
the mixture of the whole; equal cuts of the order are the shards, whose row
counts differ by one at most.

Ranks are exact at any size without a global sort: hashes (and then fractions)
fall into as many buckets as the rows need, about ``BUCKET_ROWS`` each, bucket
counts are summed up, and rows are numbered inside their bucket. No task gets
more than a few buckets, however large a source is.

Defined cases: null sources are one stratum; a null text has size 8 and the
checksum of no bytes (0); a null or repeated doc_id is ordered by the text's
checksum and size, rows that are equal in all of these being interchangeable;
an empty table gives no rows; with fewer rows than shards some shards are
empty; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 17
BUCKET_ROWS = 256


def _offsets(counts: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """counts with ``before``: the rows of the group's earlier buckets, from (group, bucket, n).

    Two levels of sums, so that no window holds more than a square root of the buckets.
    """
    block = counts.withColumn("block", F.floor(F.sqrt(bucket)).cast("long"))
    outer = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*group, "block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    blocks = block.groupBy(*group, "block").agg(F.sum("n").alias("m")).withColumn("blocks_before", F.coalesce(F.sum("m").over(outer), F.lit(0)))
    inside = block.withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return inside.join(blocks.drop("m"), [*group, "block"]).select(*group, bucket, (F.col("inside") + F.col("blocks_before")).alias("before"))


def _digits(of: Column, digits: int) -> Column:
    """The first hexadecimal digits of a checksum, as a number."""
    return F.conv(F.substring(F.md5(of.cast("binary")), 1, digits), 16, 10).cast("long")


def interleave(docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    total = docs.count()
    buckets = max(1, total // BUCKET_ROWS)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("h", _digits(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size"), 13))
    # The hash, as a fraction of its range, chooses the bucket, so buckets ascend with the hash.
    rows = rows.withColumn("b", F.least(F.floor(F.col("h").cast("double") / F.lit(float(1 << 52)) * buckets).cast("long"), F.lit(buckets - 1)))
    counts = rows.groupBy("stratum", "b").agg(F.count("*").alias("n"))
    before = _offsets(counts, ["stratum"], "b")
    strata = counts.groupBy("stratum").agg(F.sum("n").alias("stratum_rows"))
    number = F.row_number().over(Window.partitionBy("stratum", "b").orderBy("h", "doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("number", number).join(before.join(strata, "stratum"), ["stratum", "b"])
    # A place inside the rank's step, chosen by the stratum, so that small strata spread over the order.
    inside = (_digits(F.concat_ws("|", F.lit(seed), "stratum"), 5).cast("double") + 0.5) / float(1 << 20)
    ranked = ranked.withColumn("rank", F.col("before") + F.col("number")).withColumn("fraction", (F.col("rank") - 1 + inside) / F.col("stratum_rows"))
    ranked = ranked.select("doc_id", "stratum", "size", "text_crc32", "rank", "fraction", F.least(F.floor(F.col("fraction") * buckets).cast("long"), F.lit(buckets - 1)).alias("f"))
    # Rows of each bucket of fractions follow from the strata, but counting them is as cheap and always right.
    offsets = _offsets(ranked.groupBy(F.lit(0).alias("all"), "f").agg(F.count("*").alias("n")), ["all"], "f").drop("all")
    place = F.row_number().over(Window.partitionBy("f").orderBy("fraction", "stratum", "rank"))
    placed = ranked.withColumn("number", place).join(offsets, "f").withColumn("p", F.col("before") + F.col("number") - 1)
    n = max(1, total)
    shard = F.expr(f"p * {shards} div {n}")
    start = F.expr(f"((p * {shards} div {n}) * {n} + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id",
        "size",
        F.col("text_crc32").cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("p") - start).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
