import random

import pyarrow as pa
import pyarrow.parquet as pq

from passages import catalogue


def test_mmr_whole_index_asks_every_fiftieth_vector(spark, tmp_path):
    rng = random.Random(4)
    made = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(301)]
    pq.write_table(pa.table({"vec_id": pa.array(range(301), pa.int64()), "embedding": pa.array(made, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    got = {}
    for r in catalogue.mmr_whole_index(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    vec = pq.read_table(tmp_path / "embeddings.parquet").column("embedding").to_pylist()

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    assert sorted(got) == list(range(0, 301, 50))
    for q, ranks in got.items():
        chosen = []
        while len(chosen) < 5:
            left = [i for i in range(301) if i not in chosen]
            chosen.append(max(left, key=lambda i: 0.7 * cosine(vec[i], vec[q]) - 0.3 * max([0.0, *(cosine(vec[i], vec[c]) for c in chosen)])))
        assert [ranks[n] for n in range(1, 6)] == chosen
