"""Chunks, postings and texts made by the batch are those of the expressions, and are made in one pass."""

from pyspark.sql import functions as F

from passages.functions import text as X
from passages.operators import chunking, inrow, rank
from passages.operators import index as ix
from passages.plans.engine import Engine
from passages.schema import ChunkingConfig

ODD = [
    "", "\x85", "a \x85", "x  y\x85\n\x85", "# A\x85\nb", "# A\nb\n## B \x85c\nd. e! f?\n#  \n# #x\n####### no\n  ## in dented \nz", "page 3\nPage 4\npage  7 \x85\nreal",
    "a\tb|c  d. e\n\n f", "a\xa0b c.　d", "w. " * 90, "A. B!　C? D.\xa0E", "one.\x0btwo.\x0cthree", "\n\n# H\n\n# H2\n", "# t\n" + "s. " * 40 + "\n## u\n" + "v! " * 40,
    "́x ́ ΣΑΣ Σ. İİ ﬁx éa \xc9te", "a-\nb x‐\n\xe9 1-\n2", "\xad​ x_1 wind-up -- 中文 q\r\nz\ry w", "a" * 90 + ". " + "b" * 20 + ". " + "c" * 70,
]


def _pages(spark):
    return spark.createDataFrame([(f"s{i}", f"n{i}", 0, t) for i, t in enumerate(ODD)], "source_id string, name string, page int, text string")


def test_chunks_of_one_page_take_one_pass(spark):
    pages, small = _pages(spark), ChunkingConfig(20, 5, least_chars=60)
    for config in (ChunkingConfig(), small, ChunkingConfig(20, 0, least_chars=60)):
        got, want = (chunking.chunks(pages, config, one_page=x, beside=True, header=True) for x in (True, False))
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert "Union" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_are_normalized_as_by_its_parts(spark):
    whole = X.strip_controls(X.join_hyphens(X.newlines(X.compose(F.col("text")))))
    assert _pages(spark).select(X.normalize(F.col("text")).alias("a"), whole.alias("b")).where("NOT a <=> b").count() == 0


def test_postings_are_those_of_the_expressions(spark, monkeypatch, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.ingest([{"source_id": f"s{i}", "text": t} for i, t in enumerate(ODD)] + [{"source_id": "m", "text": "# \xc9te\nx x", "uti": "net.daringfireball.markdown"}])
    rows = engine.store.read("chunks").withColumn("placed", ix.index_terms())
    want = rows.select("chunk_id", F.inline(rank.term_groups(F.col("placed"))), F.size("placed").alias("dl"))
    got = engine.store.read("postings")
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and got.where("tf <> size(spots)").count() == 0
    lengths = {r.chunk_id: r.dl for r in engine.store.read("lengths").collect()}
    assert lengths == {r.chunk_id: r.n for r in rows.select("chunk_id", F.size("placed").alias("n")).collect()}


def test_runs_of_postings_are_sorted(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(inrow, "RUN_TERMS", 40)
    rows = [{"chunk_id": f"c{i}", "source_id": f"s{i}", "__b": i % 3, "text": f"b a \xe9{i} a", "title": ""} for i in range(30)]
    out = [r for b in inrow.poster(ix.GAP)([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    assert len(out) == 30 * 4 and {r["tf"] for r in out if r["term"] == "a"} == {2}
    keys = [(r["__b"], r["term"], r["chunk_id"]) for r in out]
    assert len(set(keys)) == len(keys) and sum(x > y for x, y in zip(keys, keys[1:])) < 10


def test_bags_hash_a_word_once(monkeypatch):
    import hashlib

    import numpy as np

    from passages.sources import embedders

    seen, real = [], hashlib.sha256
    monkeypatch.setattr(embedders, "_held", {}, raising=False)
    monkeypatch.setattr(embedders.hashlib, "sha256", lambda data: (seen.append(data), real(data))[1])
    texts = ["to be or not to be", "", "Be \xc9t\xe9, to"]
    got = embedders.BagEmbedder(8).embed_batch(texts)
    assert sorted(seen) == sorted(w.encode() for w in ("to", "be", "or", "not", "\xe9t\xe9"))
    for text, vec in zip(texts, got):
        v = np.zeros(8)
        for w in text.lower().replace(",", "").split():
            h = real(w.encode()).digest()
            v[int.from_bytes(h[:4], "big") % 8] += 1 if h[4] & 1 else -1
        assert vec == (v / np.linalg.norm(v) if v.any() else v).tolist()
    monkeypatch.setattr(embedders, "HELD_WORDS", 2)
    assert embedders.BagEmbedder(8).embed_batch(texts) == got
