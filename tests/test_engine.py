import json
import time

import pytest
from pyspark.sql import functions as F

from passages.plans.engine import Engine
from passages.schema import EmbeddingModel, EngineConfig, EngineError, IndexingConfig
from passages.sources.embedders import BagEmbedder, LocalEmbedder
from passages.sources.generators import CannedGenerator, FirstSentenceGenerator, LocalGenerator, ModelPrefix


def test_prefixes_of_a_batch(spark):
    class Many:
        def many(self, chunks):
            return [f"about {c['name']} of {len(chunks)}\nin one line" if "good" in c["text"] else None for c in chunks]

    e = Engine(spark, config=EngineConfig(indexing=IndexingConfig(context_fn=Many())))
    e.ingest([{"source_id": "a", "text": "good text"}, {"source_id": "b", "text": "other text"}])
    got = {r.source_id: r.context_prefix for r in e.store.read("chunks").collect()}
    assert got["a"].startswith("about a of ") and got["a"].endswith(" in one line") and got["b"].startswith("[b · p.1 · other text]")


def test_prefixes_by_a_model(spark):
    class Echo:
        def generate(self, messages):
            prompt = messages[-1][1]
            assert messages[0][0] == "system"
            if "Passage:\nlast" in prompt:
                raise ValueError("no model")
            return f"Answer: {len(prompt.split('Before:')[1].split('Passage:')[0].strip())} before.\n"

    e = Engine(spark, config=EngineConfig(indexing=IndexingConfig(context_fn=ModelPrefix(Echo()))))
    e.ingest([{"source_id": "a", "text": "# One\nfirst words here\n# Two\nsecond words\n# Three\nlast words"}])
    got = [r.context_prefix for r in e.store.read("chunks").orderBy("ordinal").collect()]
    assert got[:2] == ["0 before", "16 before"] and got[2].startswith("[a ")


def test_models_load_once_in_a_worker(spark):
    def load():
        import os

        path = f"/tmp/passages-loaded-{os.getpid()}"
        assert not os.path.exists(path)
        open(path, "w").close()
        os.unlink(path)
        return lambda texts: [[float(len(t)), 1.0, 7.0] for t in texts]

    e = Engine(spark, provider=LocalEmbedder(EmbeddingModel("len", 2), load))
    e.ingest([{"source_id": "a", "text": "abc"}])
    v = e.store.read("vectors").first().vec
    assert len(v) == 2 and abs(v[0] ** 2 + v[1] ** 2 - 1) < 1e-6 and v[0] > v[1]
    g = LocalGenerator("canned", lambda: CannedGenerator("one two"))
    assert g.generate([]) == "one two" and list(g.stream([])) == ["one ", "two"]


def test_cancelled_ingest_leaves_the_index(spark):
    class Slow:
        def many(self, chunks):
            time.sleep(60)
            return [None] * len(chunks)

    e = Engine(spark)
    e.ingest_text("alpha text", "a")
    slow = Engine(spark, e.store.path, config=EngineConfig(indexing=IndexingConfig(context_fn=Slow())))
    task = slow.ingest_async([{"source_id": "b", "text": "beta text"}])
    time.sleep(3)
    started = time.time()
    task.cancel()
    with pytest.raises(EngineError) as err:
        task.result()
    assert err.value.code == 499 and time.time() - started < 40 and task.done()
    assert [r.source_id for r in e.sources().collect()] == ["a"]
    done = Engine(spark, e.store.path).ingest_async([{"source_id": "c", "text": "gamma"}])
    assert [r.source_id for r in done.result().collect()] == ["c"]


def test_evaluation_in_one_call(spark, tmp_path):
    path = tmp_path / "fixture.json"
    path.write_text(json.dumps({
        "name": "small",
        "documents": [{"name": "pump", "text": "The pump stands by the river. It needs oil.", "tags": ["wet"]}, {"name": "mill", "text": "The mill grinds corn in town."}],
        "queries": [{"question": "where does the pump stand", "must_cite_source_ids": ["pump"], "expected_answer_contains": ["RIVER"]}, {"question": "zzz", "must_refuse": True}],
    }))
    e = Engine(spark, provider=BagEmbedder(32), generator=FirstSentenceGenerator())
    got = e.evaluate(str(path))
    assert got["recall_at_k"] == 1 and got["mrr"] == 1 and got["refusal_correct"] == 1 and got["expected_contained"] == 1
    assert e.tags("pump") == ["wet"] and e.tags("mill") == []


def test_fetched_text_is_clipped(spark):
    e = Engine(spark)
    e.ingest([{"source_id": "a", "text": "\n".join(f"# H{i}\n{'É' if i == 7 else 'x'}{i} " + "word " * 30 for i in range(12))}])
    whole = e.fetch_document("a", max_chars=100_000)
    assert len(whole["chunk_ids"]) == 12 and whole["text"].count("\n\n") == 11
    assert e.fetch_document("a", max_chars=300)["text"] == whole["text"][:300] and len(e.fetch_document("a", max_chars=300)["chunk_ids"]) == 12
    assert e.fetch_document("a", anchor="É7")["text"].count("É7") == 1 and e.fetch_document("a", anchor="X5 WORD", expand=0)["text"].startswith("x5")
    assert len(e.fetch_document("a", anchor="é7")["chunk_ids"]) == 12  # only a-z and A-Z match each other, and what is not found falls through
