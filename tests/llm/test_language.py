import random

import numpy as np
from pyspark.sql import functions as F

from passages.llm.language import codewords, fit, predict

SCHEMA = "doc_id long, text string, lang string, lang_pred string"
VOCABULARY = {"xx": "ka lo mi tanu sore", "yy": "bzr qwx jkl vvt grz", "zz": "éa ùo çi ôu ëy"}


def rows(n):
    rng = random.Random(1)
    return [(i, " ".join(rng.choice(VOCABULARY[lang].split()) for _ in range(rng.randint(3, 60))), lang, "clash") for i, lang in ((i, list(VOCABULARY)[i % 3]) for i in range(n))]


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12):
        code = codewords(n)
        apart = (code[:, None] != code[None]).sum(2) + 99 * np.eye(n, dtype=int)
        assert apart.min() >= (1 if n == 2 else 2)


def test_held_out_accuracy_and_edges(spark):
    held = F.col("doc_id") % 5 == 0
    extra = [(900, None, "xx", None), (901, "", None, None), (902, "12 !? 34", "xx", None), (None, "ka lo mi tanu", None, None), (0, "ka lo mi", "xx", None), (903, "ka lo " * 50_000, None, None)]
    docs = spark.createDataFrame(rows(300) + extra, SCHEMA)
    model = fit(docs, ~held)
    got = predict(docs.drop("lang_pred"), model, ["doc_id", "lang"]).collect()
    assert len(got) == 306
    out = [(r.lang, r.lang_pred) for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 5 == 0]
    assert np.mean([a == b for a, b in out]) >= 0.95
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].ambiguous for i in (900, 901, 902))
    assert by[None].lang_pred == "xx" and by[903].lang_pred == "xx" and 0 < by[903].score <= 1
    again = predict(docs, fit(docs, ~held), ["doc_id"]).collect()
    assert sorted((r.lang_pred, r.score) for r in again) == sorted((r.lang_pred, r.score) for r in got)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None, None)], SCHEMA)
    assert fit(docs, F.lit(True)) is None
    assert predict(docs, None, ["doc_id"]).first().lang_pred == "und"
    empty = spark.createDataFrame([], SCHEMA)
    assert predict(empty, fit(empty, F.lit(True)), ["doc_id"]).count() == 0
    one = spark.createDataFrame([(i, "ka lo", "xx", None) for i in range(9)], SCHEMA)
    assert predict(one, fit(one, F.lit(True)), ["doc_id"]).first().lang_pred == "xx"


def test_more_than_64_languages(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02}": ["".join(rng.choice(letters) for _ in range(5)) for _ in range(6)] for i in range(80)}
    data = [(lang, " ".join(rng.choice(ws) for _ in range(20))) for i, (lang, ws) in enumerate(words.items()) for _ in range(30 if i < 60 else 8)]
    docs = spark.createDataFrame([(i, t, lang, None) for i, (lang, t) in enumerate(data)] + [(1, "one row only qqqq", "rare", None)], SCHEMA).repartition(4)
    model = fit(docs, F.lit(True))
    assert model.languages == sorted([*words, "rare"])
    got = predict(docs, model, ["doc_id", "lang"]).collect()
    for few in (True, False):
        assert np.mean([r.lang == r.lang_pred for r in got if (r.lang >= "l60") == few]) >= 0.95


def test_rows_without_letters_do_not_count_for_a_label(spark):
    data = [("12 34 ?!", "xx")] * 3000 + [(t, lang) for _, t, lang, _ in rows(120)]
    docs = spark.createDataFrame([(i, t, lang, None) for i, (t, lang) in enumerate(data)], SCHEMA).repartition(4)
    model = fit(docs, F.lit(True))
    got = predict(docs.where("doc_id >= 3000"), model, ["doc_id", "lang"]).collect()
    assert model.languages == ["xx", "yy", "zz"] and np.mean([r.lang == r.lang_pred for r in got]) >= 0.95
