import pytest
from pyspark.sql import functions as F

from passages.functions import text as X
from passages.operators import match, rank
from passages.operators import index as ix
from passages.plans.engine import Engine
from passages.schema import EngineError

from test_retrieval import EXPRESSIONS, TEXTS

COLUMNS = ("content", "title")


def test_match_from_postings_equals_scan(spark):
    texts = [*TEXTS, "the the the old the old mill", ""]
    rows = spark.createDataFrame([(i, t, f"t{i} the") for i, t in enumerate(texts)], "id long, content string, title string")
    arrays = {"content": X.tokens(F.col("content")), "title": X.tokens(F.col("title"))}
    placed = F.concat(*[ix.spotted(arrays[c], k) for k, c in enumerate(COLUMNS)])
    listed = rows.select("id", placed.alias("p")).withColumn("dl", F.size("p"))
    posts = listed.select("id", "dl", F.inline(rank.term_groups(F.col("p")))).cache()
    stats = listed.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).cache()
    for expression in [*EXPRESSIONS, '"the the"', "th* NOT t9", '"the ol*"', "NEAR(the mill, 2) OR t1*"]:
        scan = sorted((r.id, round(r.bm25, 9)) for r in match.search(rows, "id", arrays, expression).collect())
        found = sorted((r.id, round(r.bm25, 9)) for r in match.search_postings(posts, stats, "id", COLUMNS, ix.GAP, expression).collect())
        assert found == scan, expression


def test_a_writer_that_dies_leaves_the_old_index(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path))
    e.ingest_text("alpha text", "a")
    before = e.store.version()
    real = ix.json.dumps

    def dies(*args, **more):
        raise RuntimeError("lost")

    monkeypatch.setattr(ix.json, "dumps", dies)  # the tables are written, the manifest is not
    with pytest.raises(RuntimeError):
        e.ingest_text("beta text", "a")
    monkeypatch.setattr(ix.json, "dumps", real)
    again = Engine(spark, str(tmp_path))
    assert again.store.version() == before and again.chunks("a").first().content == "alpha text"
    again.store.vacuum()
    assert Engine(spark, str(tmp_path)).chunks("a").first().content == "alpha text"


def test_the_second_of_two_writers_fails(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.ingest_text("alpha text", "a")
    base = e.store.version()
    e.ingest_text("beta text", "b")
    with pytest.raises(EngineError) as err:
        e.store.commit({"tags": (e.store.read("tags"), set())}, base)
    assert err.value.code == 409 and sorted(r.source_id for r in e.sources().collect()) == ["a", "b"]


def test_a_change_writes_only_its_buckets(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.ingest([{"source_id": f"s{i}", "text": f"text number {i}"} for i in range(12)])
    old = e.store._manifest()["chunks"]
    e.ingest_text("another text", "s3")
    new = e.store._manifest()["chunks"]
    mine = {str(b) for b in e.store.of("s3")}
    assert len(old) > 3 and {b for b in old if new[b] != old[b]} == mine
    assert e.store.of("s3 p.7") == e.store.of("s3") and e.store.read("chunks").count() == 12
    e.delete("s3")
    assert e.store.read("chunks").count() == 11 and e.search("another").count() == 0 and e.search("number").count() == 10


def test_term_counts(spark):
    terms = F.array(*[F.lit(t) for t in "b a b c a b".split()])
    row = spark.range(1).select(rank.term_counts(terms).alias("t"), rank.term_counts(F.array().cast("array<string>")).alias("e")).first()
    assert [tuple(x) for x in row.t] == [("a", 2), ("b", 3), ("c", 1)] and row.e is None
