"""The pipeline on a small fixture against the same rules applied by hand."""

import random
import re

import pytest

import corpus_pipeline

CLASH = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, score string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    v = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    made: dict[int, random.Random] = {}

    def prose(seed: int, n: int) -> str:
        """The first n words of a stream of random ones."""
        made[seed] = random.Random(seed)
        return " ".join(made[seed].choice(v) for _ in range(n))

    bench = prose(11, 40)
    rows = [(i, f"{prose(13 * i, 60)}\n{prose(13 * i + 3, 30)} {chr(97 + i)}", "xx") for i in range(10)]
    rows += [
        (20, rows[1][1], "xx"),  # all lines have an earlier copy
        (21, prose(13 * 2, 30) + " tail", "xx"),  # half of a line of document 2
        (22, f"{prose(0, 59)} changed", "xx"),  # near to document 0's first line, but not to the document
        (23, f"intro words {bench} outro", "xx"), (24, f"{prose(200, 900)} {bench}", "xx"), (25, "12 34 !!", None), (26, None, "xx"), (27, "", "xx"),
        (30, prose(77, 50), "xx"), (31, prose(77, 49) + " other", "xx"),
    ]
    spark.createDataFrame([(d, t, lang, "s", len(t) if t is not None else None, "clash", "x") for d, t, lang in rows], CLASH).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stage("language ID")(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert set(ids(docs)) - set(ids(kept)) == {25, 26, 27}
    lines = stage("line dedup")(spark, kept, sf_dir)
    assert set(ids(kept)) - set(ids(lines)) == {20} and lines.columns == docs.columns
    near = stage("n-gram Jaccard join")(spark, lines, sf_dir)
    assert set(ids(lines)) - set(ids(near)) == {31}
    clean = stage("benchmark decontamination")(spark, near, sf_dir)
    assert set(ids(near)) - set(ids(clean)) == {23} and clean.columns == docs.columns
    out = stage("BPE encoding and decoding")(spark, clean, sf_dir)
    assert ids(out) == ids(clean) and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, out.collect()))


def test_repeated_rows_ties_and_long_texts(spark, sf_dir, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    long, lines, other = text(60_000), "\n".join(text(12) for _ in range(6)), text(40)
    rows = [(1, long), (1, long), (2, long), (3, lines), (3, lines), (4, other), (4, text(40)), (None, text(30)), (5, None), (6, "x " * 30_000), (7, f"{other} more")]
    spark.createDataFrame([(d, t, "xx", "s", len(t or ""), str(i), "x") for i, (d, t) in enumerate(rows)], CLASH).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Of equal rows one stays, of copies the one with the least id; two texts that share an id are two documents, and 7 is near to 4.
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 3, 4, 4, 6]
    assert max(r.n_tokens for r in got if r.doc_id == 1) >= 60_000


def test_empty(spark, sf_dir, tmp_path):
    spark.createDataFrame([], CLASH).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_operators_do_not_swallow_import_errors():
    assert not re.search(r"except (ImportError|ModuleNotFoundError)", open(corpus_pipeline.__file__).read())
