"""Line dedup by the windows of line-ID sequences.

A document is the sequence of the names of its non-blank lines (trimmed). A run
of ``MIN_WORDS`` words or more is deleted where any earlier position has a copy of
it; earlier means a lower (doc_id, text hash, line), so the first copy always
stays, and a run may repeat inside one document.

A part of a run with an earlier copy has one too, and every line of a run of
MIN_WORDS words or more is in a window of it that has MIN_WORDS words and would have
less without its last or without its first line. So the lines to delete are those
of such windows with an earlier copy, however far the runs of different copies
reach. A window has at most MIN_WORDS lines, and a line begins one and ends one.

A name is 128 bits of two hashes with different seeds, so that two different
windows never meet at any size that is stored (at 10**12 windows 64 bits would
let tens of thousands of pairs meet, and their texts be deleted).

All of it is DataFrame functions on rows of one position each: no document or
group of copies is gathered in a task, except a document's own runs.

Defined cases: a null text has no lines and stays null; blank lines are no part
of a run and are kept; rows with equal doc_id and text are one document and
get the same result each; a null doc_id comes before all others; other columns
of the input are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

MIN_WORDS = 20
#: White space that is trimmed from lines.
_SPACE = " \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
POSITION = ["d", "t", "i"]
NAME = ["name", "proof"]
#: Seed of the second hash.
PROOF = 40503


def _key(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("t")


def _lines(text: Column) -> Column:
    """Array of the trimmed lines; blank ones are empty strings."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)))


def _words(line: Column) -> Column:
    return F.size(F.split(line, r"[\s\p{Z}]+"))


def _repeated(rows: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Rows (d, t, i, n, name, proof) whose name occurs at two positions or more, with the earliest (fd, ft, fi).

    The names' table is written, so that a frequent name is a skewed side that the join can split.
    """
    at = F.struct(*POSITION)
    first = rows.groupBy(*NAME).agg(F.min(at).alias("f"), F.max(at).alias("l")).where("f < l").select(*NAME, F.col("f.d").alias("fd"), F.col("f.t").alias("ft"), F.col("f.i").alias("fi"))
    made.append(written(first, "line-names"))
    return rows.join(made[-1], NAME)


def _windows(least: int) -> Column:
    """Array of (i, n, name, proof) of the least windows of ``least`` words from each line on and up to each line, of h and g (hashes) and w (words)."""
    # Lines are reached by get(), as slice() in a lambda reads the whole array each time.
    size = "aggregate(sequence(0, {k} - 1), struct(0 AS s, 0 AS m), (a, j) -> if(a.s >= {k} OR {at} NOT BETWEEN 0 AND size(w) - 1, a, struct(a.s + get(w, {at}) AS s, a.m + 1 AS m)), a -> if(a.s >= {k}, a.m, 0))"
    ahead, back = size.format(k=least, at="i + j"), size.format(k=least, at="i - j")
    # A window is the number i * (least + 1) + n, as numbers are made distinct by hash.
    code = f"transform(sequence(0, size(w) - 1), i -> (i * {least + 1}L + {ahead})), transform(transform(sequence(0, size(w) - 1), i -> struct(i AS e, {back} AS m)), x -> ((x.e - x.m + 1) * {least + 1}L + x.m))"
    pairs = f"transform(array_distinct(concat({code})), c -> struct(CAST(c DIV {least + 1} AS INT) AS i, CAST(c % {least + 1} AS INT) AS n))"
    chain = "aggregate(sequence(0, x.n - 1), CAST(x.n AS BIGINT), (a, j) -> xxhash64(a, get({of}, x.i + j)))"
    named = f"transform(filter({pairs}, x -> x.n > 0), x -> struct(x.i AS i, x.n AS n, {chain.format(of='h')} AS name, {chain.format(of='g')} AS proof))"
    return F.expr(f"if(size(w) > 0, {named}, CAST(array() AS array<struct<i:int,n:int,name:bigint,proof:bigint>>))")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, runs): windows of n non-blank lines from line i that have min_words words and an earlier copy; written."""
    kept = F.filter(_lines(F.col("text")), lambda x: x != "")
    whole = docs.where(F.col("text").isNotNull()).select(*_key(docs), F.inline(F.array(F.struct(F.transform(kept, lambda x: F.xxhash64(x)).alias("h"), F.transform(kept, lambda x: F.xxhash64(F.lit(PROOF), x)).alias("g"), F.transform(kept, _words).alias("w")))))
    whole = written(whole.select("d", "t", _windows(max(1, min_words)).alias("windows")), "lines")
    made: list[DataFrame] = []
    copies = _repeated(whole.select("d", "t", F.inline("windows")), made).where(F.struct("fd", "ft", "fi") < F.struct(*POSITION))
    out = written(copies.groupBy("d", "t").agg(F.collect_set(F.struct("i", "n")).alias("runs")), "line-runs")
    forget(whole, *made)
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated line runs deleted from text, and n_lines, n_deleted."""
    runs = repeated_runs(docs, min_words)
    d, t = _key(docs)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)], d.alias("__d"), t.alias("__t"))
    text = F.col(f"__c{docs.columns.index('text')}")
    runs = runs.select(F.col("d").alias("__d"), F.col("t").alias("__t"), "runs")
    rows = rows.join(runs.hint("shuffle_hash"), ["__d", "__t"], "left").withColumn("__lines", _lines(text))
    some = F.col("runs").isNotNull()
    full = F.filter("__lines", lambda x: x != "")
    rows = rows.withColumn("__n", F.size(full))
    gone = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["i"], r["i"] + r["n"] - 1))))
    rows = rows.withColumn("__gone", F.when(some, gone))
    # Numbers of the raw lines that are not blank; deleted lines are counted among these.
    numbers = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda r: F.get("__lines", r) != "")
    rows = rows.withColumn("__numbers", F.when(F.size("__gone") > 0, numbers))
    rows = rows.withColumn("__raw", F.array_sort(F.transform(F.when(F.size("__gone") > 0, F.col("__gone")), lambda g: F.get("__numbers", g))))
    rest = F.filter(F.split(text, "\n", -1), lambda x, r: ~F.array_contains("__raw", r))
    deduped = F.when(F.col("__raw").isNotNull(), F.array_join(rest, "\n")).otherwise(text)
    # One generated struct: a filter on the counts then does not compute the lines a second time.
    n_deleted = F.when(some, F.size("__gone")).otherwise(0).cast("long")
    n_lines = F.when(text.isNull(), 0).otherwise(F.col("__n")).cast("long")
    made = F.inline(F.array(F.struct(deduped.alias("__text"), n_lines.alias("n_lines"), n_deleted.alias("n_deleted"))))
    rows = rows.select(*[f"__c{i}" for i, c in enumerate(docs.columns) if c != "text"], made)
    out = [F.col("__text").alias(c) if c == "text" else F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return rows.select(*out, "n_lines", "n_deleted")
