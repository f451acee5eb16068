import sqlite3

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passages.functions import grounding as G
from passages.functions import text as X
from passages.operators import match, rerank
from passages.plans.engine import Engine
from passages.schema import AnswerPolicy, EngineConfig, EngineError, MMRConfig, RetrievalFilter
from passages.sources.embedders import BagEmbedder, ConstantEmbedder
from passages.sources.generators import CannedGenerator, FirstSentenceGenerator

TEXTS = [
    "the river runs by the old mill near town", "a mill stone turns in the river", "town hall and the old clock", "clock tower the river the river again",
    "nothing of note here", "old old old mill", "multi-agent systems by the river", "riverbank walk",
]
EXPRESSIONS = [
    "river", "river mill", "river OR clock", "river NOT mill", '"the river"', "riv*", "NEAR(river mill, 4)", "NEAR(old town, 3)", "(river OR clock) AND town", '"multi-agent"',
    "content:river", "title:t1", "{title content}: river", "old AND NOT_A_WORD", "river AND (mill OR clock)", '"the old" + mill',
]


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(content, title, tokenize=\"unicode61 remove_diacritics 2 tokenchars '-_'\")")
    con.executemany("insert into f(rowid, content, title) values (?,?,?)", [(i, t, f"t{i}") for i, t in enumerate(TEXTS)])
    return con


@pytest.mark.parametrize("expression", EXPRESSIONS)
def test_match_language_equals_fts5(spark, fts, expression):
    rows = spark.createDataFrame([(i, t, f"t{i}") for i, t in enumerate(TEXTS)], "id long, content string, title string")
    got = match.search(rows, "id", {"content": X.tokens(F.col("content")), "title": X.tokens(F.col("title"))}, expression)
    want = fts.execute("select rowid, bm25(f) from f where f match ?", (expression,)).fetchall()
    assert sorted((r.id, round(r.bm25, 9)) for r in got.collect()) == sorted((i, round(s, 9)) for i, s in want)


@pytest.mark.parametrize("expression", ["", '"open', "a AND", "multi-agent", "what?", "nope:x"])
def test_match_errors(spark, expression):
    rows = spark.createDataFrame([(1, "x")], "id long, content string")
    with pytest.raises(EngineError):
        match.search(rows, "id", {"content": X.tokens(F.col("content"))}, expression)


def test_mmr_small():
    v = [np.array([1.0, 0]), np.array([1.0, 0]), np.array([0, 1.0])]
    rel = np.array([1.0, 0.99, 0.4])
    assert rerank.mmr_order(rel, v, 0.2, 3) == [0, 2, 1] and rerank.mmr_order(rel, v, 1.0, 3) == [0, 1, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.lists(st.floats(-1, 1), min_size=2, max_size=2)), min_size=1, max_size=12), st.floats(0, 1), st.integers(1, 12))
def test_mmr_is_a_choice(rows, weight, k):
    out = rerank.mmr_order(np.array([r for r, _ in rows]), [np.array(v) for _, v in rows], weight, k)
    assert len(out) == len(set(out)) == min(k, len(rows))


def test_mmr_over_the_index_is_exact(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8))
    q = rng.normal(size=8)
    score = vectors @ q / np.linalg.norm(vectors, axis=1) / np.linalg.norm(q)
    rows = spark.createDataFrame([(0, i, float(s), v.tolist()) for i, (s, v) in enumerate(zip(score, vectors))], "query_id int, id long, score double, vec array<double>")
    order = np.lexsort((np.arange(300), -score))
    want = [int(order[i]) for i in rerank.mmr_order(score[order], [vectors[i] for i in order], 0.3, 6)]
    got = rerank.mmr_index(rows, MMRConfig(0.3, 6), 6, start=8).orderBy("rank").collect()
    assert [r.id for r in got] == want


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, provider=BagEmbedder(32), generator=FirstSentenceGenerator())
    e.ingest(
        [
            {"source_id": "guide", "text": "# Guide\nWelcome to the river.\n## Install\nFit the pump near the river bank.\n## Use\nTurn the valve slowly."},
            {"source_id": "notes", "text": "# Notes\nSnow falls in winter.\n## Goats\nMountain goats climb rocks.", "uti": "public.markdown"},
            {"source_id": "rows", "bytes": b"name,river\nann,yes\n", "uti": "public.comma-separated-values-text"},
        ],
        {"guide": ["red", " "], "notes": ["blue", "red"]},
    )
    return e


def test_metadata(engine):
    got = {r.source_id: (r.file_type, r.pages, r.chunks) for r in engine.sources().collect()}
    assert got == {"guide": ("text", 1, 3), "notes": ("markdown", 1, 2), "rows": ("comma-separated-values-text", 1, 1)}
    assert engine.tags("guide") == ["red"] and engine.index_info() == ("bag", 32)


def test_filters(engine):
    ask = lambda **f: {r.source_id for r in engine.search_with_context("river winter", where=RetrievalFilter(**f)).collect()}
    assert ask() == {"guide", "notes", "rows"}
    assert ask(tags=frozenset({"blue"})) == {"notes"} and ask(tags=frozenset()) == {"guide", "notes", "rows"}
    assert ask(file_types=frozenset({"markdown"})) == {"notes"} and ask(source_ids=frozenset({"rows"})) == {"rows"}
    assert ask(page_range=(1, 5)) == {"rows"}


def test_search_kinds(engine):
    hit = engine.search("river", 5).orderBy("rank").collect()
    assert {r.source_id for r in hit} == {"guide", "rows"} and all(r.score < 0 for r in hit)
    hybrid = engine.search_hybrid("pump river bank").orderBy("rank").first()
    assert hybrid.source_id == "guide" and hybrid.cosine is not None and 0 <= hybrid.score <= 1 and "Fit the pump" in hybrid.text
    vec = engine.search_vectors("mountain goats climb").orderBy("rank").first()
    assert vec.source_id == "notes" and vec.bm25 == 0 and vec.score == vec.cosine
    assert engine.search_hybrid("zzz").count() == 0 and engine.retrieve("???").count() == 0


def test_windows(engine):
    narrow = engine.search_with_context("pump", expand=0).first().text
    wide = engine.search_with_context("pump", expand=1).first().text
    assert narrow == "Fit the pump near the river bank." and wide == "Welcome to the river.\n\nFit the pump near the river bank.\n\nTurn the valve slowly."
    assert engine.search_with_context("pump", expand=2, to_parent=True).first().text == narrow


def test_fetch(engine):
    assert engine.fetch_document("guide", anchor="VALVE", expand=0)["text"] == "Turn the valve slowly."
    assert len(engine.fetch_document("guide", anchor="nowhere")["chunk_ids"]) == 3
    assert engine.fetch_document("guide", start_page=1)["text"] == "" and engine.fetch_document("guide", max_chars=7)["text"] == "Welcome"
    with pytest.raises(EngineError) as e:
        engine.fetch_document("none")
    assert e.value.code == 404


def test_answers(engine):
    rows = {r.query_id: r for r in engine.answer(["where is the pump fitted?", "zzz"]).collect()}
    assert not rows[0].refused and rows[0].citations[0].source_id == "guide" and rows[0].confidence > 0
    assert rows[1].refused and rows[1].text == AnswerPolicy().refusal_text and rows[1].confidence == 0
    events = list(engine.answer_stream("pump"))
    assert events[0][0] == "passages" and events[-1][0] == "done" and "".join(p for k, p in events if k == "text") == events[-1][1].text


def test_upkeep_and_errors(spark):
    e = Engine(spark, provider=ConstantEmbedder(3))
    e.ingest_text("alpha text", "a", ["x"])
    e.ingest_text("beta text", "b")
    ids = [r.chunk_id for r in e.chunks("a").collect()]
    e.ingest_text("alpha text", "a")
    assert [r.chunk_id for r in e.chunks("a").collect()] == ids and e.tags("a") == ["x"] and e.store.read("vectors").count() == 2
    e.provider = ConstantEmbedder(4)
    with pytest.raises(EngineError) as err:
        e.backfill()
    assert err.value.code == 530
    e.provider = None
    with pytest.raises(EngineError) as err:
        e.backfill()
    assert err.value.code == 410
    with pytest.raises(EngineError) as err:
        e.search_vectors("x")
    assert err.value.code == 412
    lexical = e.retrieve("alpha").first()
    assert lexical.cosine is None and lexical.score == lexical.bm25 < 0
    with pytest.raises(EngineError) as err:
        e.answer("x")
    assert err.value.code == 600
    e.delete("a")
    assert e.tags("a") == [] and e.sources().count() == 1 and e.store.read("vectors").count() == 1
    e.store.vacuum()
    assert e.chunks("b").count() == 1


def test_put_vectors(spark):
    from passages.operators.index import put_vectors
    from passages.schema import EmbeddingModel

    e = Engine(spark)
    e.ingest_text("alpha", "a")
    chunk = e.chunks("a").first().chunk_id
    rows = lambda v: spark.createDataFrame([(chunk, "a", v)], "chunk_id string, source_id string, vec array<float>")
    put_vectors(e.store, "i", EmbeddingModel("m", 2), rows([1.0, 2.0]))
    put_vectors(e.store, "i", EmbeddingModel("m", 2), rows([3.0, 4.0]))
    assert [list(r.vec) for r in e.store.read("vectors").collect()] == [[3.0, 4.0]]
    for model, v in ((EmbeddingModel("m", 2), [1.0]), (EmbeddingModel("n", 2), [1.0, 2.0])):
        with pytest.raises(EngineError) as err:
            put_vectors(e.store, "i", model, rows(v))
        assert err.value.code == 530


def test_prefix_terms_stay_in_the_index(spark):
    e = Engine(spark)
    e.ingest_text("alpha", "first")
    e.ingest_text("beta", "second")
    assert [r.source_id for r in e.search('"first"').collect()] == ["first"]


PASSAGE = "struct<text:string,score:double,citations:array<struct<source_id:string,source_name:string,file_type:string,page:int,section_title:string,chunk_id:string,parent_id:string,excerpt:string>>>"


def check(spark, reply, passages, fn):
    rows = [(reply, [(t, s, [(c, c, None, None, None, c, None, None)]) for t, s, c in passages])]
    return spark.createDataFrame(rows, f"a string, p array<{PASSAGE}>").select(fn(F.col("a"), F.col("p")).alias("x")).first().x


def test_grounding(spark):
    two = [("It opened in 1985 here", 0.9, "c1"), ("other", 0.5, "c2")]
    assert check(spark, "It runs [2]. It stops [2], as told [1].", two, G.confidence) == pytest.approx(0.7)
    assert check(spark, "[9]", two, G.confidence) == 0 and check(spark, "[99999999999]", two, G.confidence) == 0
    three = [*two, ("x", 2.0, "c3")]
    assert [c.chunk_id for c in check(spark, "Rain [3], wind [1] and rain [3] again, or sun [2]", three, G.resolve)] == ["c3", "c1", "c2"]
    assert [c.chunk_id for c in check(spark, "Fog [17] or hail [1]", two[:1], G.resolve)] == ["c1"]
    text = lambda p: F.array_join(F.transform(p, lambda x: x["text"]), "\n")
    assert check(spark, '"opened in 1985" and "invented"', two, lambda a, p: G.quote_grounding(a, text(p))) == 0.5
    assert check(spark, "1985 or 9999", two, lambda a, p: G.numeric_consistency(a, text(p))) == 0.5
    assert check(spark, "none", two, lambda a, p: G.numeric_consistency(a, text(p))) == 1


def test_eval(spark, tmp_path):
    import json

    from passages.plans import evaluate

    fix = {"name": "f", "documents": [{"name": "d1", "text": "Rivers flow to the sea."}, {"name": "d2", "text": "Goats climb."}],
           "queries": [{"question": "rivers sea", "must_cite_source_ids": ["d1"], "expected_answer_contains": ["FLOW"]}, {"question": "zzz", "must_refuse": True}]}
    (tmp_path / "f.json").write_text(json.dumps(fix))
    rows = evaluate.fixture(spark, str(tmp_path / "f.json"))
    e = Engine(spark, provider=BagEmbedder(16), generator=FirstSentenceGenerator())
    e.ingest([{"source_id": r.source_id, "text": r.text} for r in evaluate.fixture_documents(rows).collect()])
    asked = evaluate.fixture_queries(rows)
    found = e.search_hybrid(asked.select("query_id", "question")).select("query_id", "rank", "source_id")
    judged = asked.select("query_id", F.coalesce("must_cite_source_ids", F.array().cast("array<string>")).alias("must"), F.col("limit").alias("k"))
    m = evaluate.summary(evaluate.retrieval_metrics(found, judged)).first()
    assert (m.queries, m.recall_at_k, m.precision_at_k, m.mrr) == (1, 1.0, 0.2, 1.0)
    answers = e.answer(asked.select("query_id", "question"))
    a = evaluate.answer_metrics(answers, asked, AnswerPolicy().refusal_text).first()
    assert (a.expected_contained, a.refusal_correct) == (1.0, 1.0) and a.citation_coverage > 0


def test_hybrid_lexical_gate_and_fusion(spark):
    from passages.operators import rank

    rows = spark.createDataFrame([(0, 1, -3.0, None), (0, 2, -1.0, 1.0), (1, 1, -2.0, 0.0)], "query_id int, id int, bm25 double, cosine double")
    got = {(r.query_id, r.id): r.score for r in rank.fuse(rows).collect()}
    assert got == {(0, 1): 1.0, (0, 2): 0.5, (1, 1): 0.75}


def test_canned_stream():
    assert "".join(CannedGenerator("a b c").stream([])) == "a b c" and EngineConfig().chunking.max_chars == 2340
