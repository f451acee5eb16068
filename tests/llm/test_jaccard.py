import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from passages.llm import jaccard

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, inverted = {d: shingles(t) for d, t in rows}, defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inverted[x].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, s in sets.items():
        for o, n in Counter(o for x in s for o in inverted[x] if o > d).items():
            if 100 * n >= 80 * (len(s) + len(sets[o]) - n):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = []

    def put(words):
        rows.append((len(rows) * 3, " ".join(words)))

    for _ in range(50):
        size = rng.choice([1, 3, 5, 6, 8, 9, 10, 12, 14, 20, 30, 45, 80, 150, 300])
        first = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(rng.randint(1, 12)):
            w = list(first)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, size // 50, size // 33])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            put(w[: max(1, int(len(w) * rng.uniform(0.75, 1)))] if rng.random() < 0.3 else w)
    common, near = [[rng.choice(vocabulary) for _ in range(n)] for n in (60, 120)]
    for _ in range(100):
        put([rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] + common + [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))])
    for _ in range(60):
        w = list(near)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(120)] = rng.choice(vocabulary)
        put(w)
    return rows + [(100_001, None), (100_002, ""), (100_003, " \n "), (100_004, rows[5][1]), (100_005, rows[5][1].upper()), (100_006, "w " * 60_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows) and len(got) == len(rows)


def test_large_groups_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 7)
    rows = corpus(3)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_edges(spark):
    schema = "doc_id long, text string, key string, root string"
    assert jaccard.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c d e f", "x", "y"), (5, "a b c d e f", "x", "y"), (None, "a b c d e f", None, None), (3, "A B C D E F", "x", "y"), (9, None, None, None), (None, None, None, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 0, -1), (-1, 2, 3), (3, 2, 3), (5, 2, 3), (5, 2, 3), (9, 0, 9)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.key or "") for r in kept) == [(-1, ""), (3, "x"), (9, "")]


def test_other_texts_with_the_same_id_stay(spark):
    rows = [(1, "a b c d e f g"), (1, "other words that stand here alone"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (3, None), (4, " ")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([rows[0], rows[1], *rows[4:]], key=repr)


def test_sets_without_enough_segments_are_compared_with_all(spark, monkeypatch):
    """With one segment for everything and no deletions, nearly every set is beyond the allocation."""
    real = jaccard._bands

    def few(largest):
        tops, segments, band = real(largest)
        return tops, np.full_like(segments, 1), band

    monkeypatch.setattr(jaccard, "_bands", few)
    rows = [np.arange(40, dtype=np.uint64) * np.uint64(977)]
    _, _, beyond = jaccard.entries(rows, jaccard.fingerprint(rows))
    assert len(beyond)
    monkeypatch.undo()
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60))), (2, " ".join(f"w{i}" for i in range(58))), (3, "x y z a b c")], "doc_id long, text string")
    members = jaccard._members(docs, 5)
    links = jaccard._against_all(docs, members, members.select("key").where("n_shingles > 0"), 5).collect()
    assert {frozenset((r.a, r.b)) for r in links} == {frozenset(r.key for r in members.collect() if r.doc_id in (1, 2))}
