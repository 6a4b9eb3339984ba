import math
import random

import pytest

from tessera.llm import knn


def by_hand(rows, k, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"pivots": 3, "chunk": 16, "block": 4}])
def test_knn(spark, sizes):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 4]]) for i in range(200)]
    rows += [(200 + i, [1.0] * 8) for i in range(20)]  # ties
    rows += [(300, None), (310, [None] * 8), (320, [float("nan")] * 8), (330, [float("inf")] * 8), (None, [1.0] * 8), (340, [1.0, 2.0]), (350, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    df = df.withColumn("embedding", df.embedding)
    stored = [(r.vec_id, r.embedding) for r in df.collect()]
    found = knn.knn_join(df, df.filter("vec_id % 10 = 0"), 5, **sizes)
    assert sorted(map(tuple, found.collect())) == by_hand(stored, 5, 10)


def test_small_samples(spark, monkeypatch):
    monkeypatch.setattr(knn, "SAMPLE", 20)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(i % 5 * 3, 1) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, knn.knn_join(df, df.filter("vec_id % 20 = 0"), 5, pivots=5).collect())) == by_hand(rows, 5, 20)
    one = spark.createDataFrame([(7, [1.0])] * 50 + [(8, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in knn.knn_join(one, one.filter("vec_id = 8"), 2).collect()] == [(8, 1, 7, 256 * 512), (8, 2, 7, 256 * 512)]


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn.knn_join(df, df.filter("vec_id = 0"), 5).collect()] == [(0, 1, 1, 128 * 256 - 256 * 512)]
    assert knn.knn_join(df.filter("false"), df, 5).count() == 0
    assert knn.knn_join(df, df.filter("false"), 5).count() == 0


def test_clusters_are_pruned(spark):
    """Queries among clustered vectors reach their own cluster only; vectors without clusters are sent once."""
    rng = random.Random(8)
    centres = [[10 * rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    clustered = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 6]]) for i in range(600)]
    plain = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)]
    for rows in (clustered, plain):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = knn.knn_join(df, df.filter("vec_id % 10 = 0"), 5, pivots=6)
        assert sorted(map(tuple, found.collect())) == by_hand(rows, 5, 10)
