import random
from collections import defaultdict

from passages.llm.lines import dedup_lines


def brute(rows, min_words=20):
    docs = {(d, t): ((raw := t.split("\n")), [x.strip() for x in raw], [x.strip() for x in raw if x.strip()]) for d, t in rows if t is not None}
    order, pos, out = sorted(docs), defaultdict(list), {}
    for o, k in enumerate(order):
        for i, x in enumerate(docs[k][2]):
            pos[x].append((o, i))

    def lcp(p, q):
        n = 0
        for x, y in zip(docs[order[p[0]]][2][p[1] :], docs[order[q[0]]][2][q[1] :]):
            if x != y:
                break
            n += 1
        return n

    for o, k in enumerate(order):
        raw, lines, full = docs[k]
        gone = set()
        for i in range(len(full)):
            # The definition: the longest common prefix with any earlier position, whichever that is.
            n = max((lcp((o, i), q) for q in pos[full[i]] if q < (o, i)), default=0)
            if sum(len(x.split()) for x in full[i : i + n]) >= min_words:
                gone |= set(range(i, i + n))
        c, rest = 0, []
        for r, x in zip(raw, lines):
            if not x or c not in gone:
                rest.append(r)
            c += bool(x)
        out[k] = ("\n".join(rest), len(full), len(gone))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    rows = []
    for d in range(50):
        lines = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 35)
            lines += base[a : a + rng.randint(1, 12)]
            if rng.random() < 0.4:
                lines.append("  " + rng.choice(base) + " ")
            if rng.random() < 0.3:
                lines.append("")
        rows.append((d, "\n".join(lines)))
    rows += [(60, None), (61, ""), (62, rows[3][1]), (62, rows[3][1]), (63, "\n".join([base[0]] * 30)), (64, "long " * 60_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, runs string").repartition(3)
    got, want = dedup_lines(df).collect(), brute(rows)
    assert len(got) == len(rows) and all(r.runs == "clash" for r in got)
    for r in got:
        text = next(t for d, t in rows if d == r.doc_id)
        assert (r.text, r.n_lines, r.n_deleted) == ((None, 0, 0) if text is None else want[(r.doc_id, text)])


def test_edges(spark):
    schema = "doc_id long, text string"
    assert dedup_lines(spark.createDataFrame([], schema)).count() == 0
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(2, f"head\n{passage}\ntail"), (None, passage), (1, f"one\n\n {passage} ")]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, schema)).collect()}
    assert got == {None: passage, 1: "one\n", 2: "head\ntail"}


def longest(rows, min_words):
    """Deleted line numbers of each document by the longest match with any earlier position."""
    docs, out = sorted(rows), {}
    lines = [t.split("\n") for _, t in docs]
    for o, (d, _) in enumerate(docs):
        gone = set()
        for i in range(len(lines[o])):
            for p in range(o + 1):
                for q in range(i if p == o else len(lines[p])):
                    n = 0
                    while i + n < len(lines[o]) and q + n < len(lines[p]) and lines[o][i + n] == lines[p][q + n]:
                        n += 1
                    if sum(len(x.split()) for x in lines[o][i : i + n]) >= min_words:
                        gone |= set(range(i, i + n))
        out[d] = "\n".join(x for i, x in enumerate(lines[o]) if i not in gone)
    return out


def test_longest_of_several_earlier_copies(spark):
    x, y, z, p = (" ".join(f"{c}{i}" for i in range(7)) for c in "xyzp")
    rows = [(1, f"{x}\n{y}\n{p}"), (2, f"{x}\n{y}\n{z}"), (3, f"{x}\n{y}\n{z}")]
    rng = random.Random(8)
    base = [" ".join(f"b{i}_{j}" for j in range(rng.randint(1, 9))) for i in range(15)]
    for d in range(10, 50):
        cut = [(rng.randint(0, 12), rng.randint(1, 7)) for _ in range(3)]
        rows.append((d, "\n".join(line for a, n in cut for line in base[a : a + n])))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[3] == "" and got[2] == rows[1][1]
    assert got == longest(rows, 20)
