"""An ingest deals out no texts, and its postings are made from small splits of what it wrote."""

import glob

from pyspark.sql import functions as F

from passages.operators import chunking
from passages.operators import index as ix
from passages.plans.engine import Engine
from passages.schema import EngineConfig, IndexingConfig


def _echo():
    class Echo:
        prompted = True

        def __call__(self, chunk):
            return chunk["prompt"][-40:]

    return Echo()


def _rows(spark, n):
    text = F.concat(F.lit("Word "), F.col("id").cast("string"), F.lit(". "), F.repeat(F.lit("plain words go on. "), 120))
    name = F.concat(F.lit("s"), F.col("id").cast("string"))
    none = F.lit(None).cast("string")
    return spark.range(0, n, 1, 3).select(name.alias("source_id"), F.lit("text").alias("kind"), F.lit("public.plain-text").alias("uti"), name.alias("name"), none.alias("path"), text.alias("text"), none.cast("binary").alias("bytes"))


def _plans(spark, monkeypatch):
    """Physical plans of what is written from now on, and the settings then."""
    seen, kind = [], type(spark.range(0).write)
    put = kind.parquet

    def parquet(writer, path, *args, **more):
        plan = writer._df._jdf.queryExecution().executedPlan().toString()
        seen.append((path, plan, spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        return put(writer, path, *args, **more)

    monkeypatch.setattr(kind, "parquet", parquet)
    return seen


def test_chunks_are_written_where_they_are_made(spark, tmp_path, monkeypatch):
    engine, seen = Engine(spark, str(tmp_path)), _plans(spark, monkeypatch)
    engine.ingest(_rows(spark, 200))
    by = {name: s for s in seen for name in ("chunks", "postings") if f"/{name}-" in s[0]}
    assert "Rebalance" not in by["chunks"][1] and by["chunks"][3] == str(ix.BUCKETS)
    assert int(by["postings"][2].rstrip("b")) == ix.SPLIT_BYTES and "Exchange" not in by["postings"][1]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    files = glob.glob(f"{tmp_path}/chunks-*/__b=*/*.parquet")
    assert len({f.split("__b=")[1].split("/")[0] for f in files}) == 32 and len(files) > 32
    assert engine.store.read("sources").count() == 200 == engine.search("word", 500).select("source_id").distinct().count()


def test_prompts_of_one_page_need_no_window(spark):
    rows = [(f"s{i}", f"s{i}", "public.plain-text", 0, t) for i, t in enumerate(["First one. " * 300, "# A\none " * 40, "last"])]
    pages = spark.createDataFrame(rows, "source_id string, name string, uti string, page int, text string")
    near = chunking.with_prefixes(chunking.chunks(pages, one_page=True, beside=True), pages, _echo())[0]
    window = chunking.with_prefixes(chunking.chunks(pages), pages, _echo())[0]
    assert sorted(map(repr, near.select(*window.columns).collect())) == sorted(map(repr, window.collect()))
    plain = chunking.chunks(pages.where("text NOT LIKE '%#%'"), one_page=True, beside=True)
    assert set(plain.columns) > {"__before", "__after"}


def test_chunks_with_a_model_are_written_once(spark, tmp_path, monkeypatch):
    config = EngineConfig(indexing=IndexingConfig(context_fn=_echo()))
    engine, seen = Engine(spark, str(tmp_path), config=config), _plans(spark, monkeypatch)
    engine.ingest(_rows(spark, 5))
    assert not [p for p, *_ in seen if "prefixed" in p]  # texts and prompts are no table of their own
    kept = {r.key: r.value for r in engine.store.read("prefixes").collect()}
    assert kept and set(kept.values()) == {r.context_prefix for r in engine.store.read("chunks").collect()}
    engine.ingest(_rows(spark, 6))
    again = {r.key: r.value for r in engine.store.read("prefixes").collect()}
    assert again.items() > kept.items()
