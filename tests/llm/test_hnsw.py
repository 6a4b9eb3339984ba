import math
import random

import numpy as np

from tessera.llm import hnsw


def by_hand(rows, threshold=0.95):
    good = lambda v: v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
    near = [set() for _ in rows]
    for a, (_, x) in enumerate(rows):
        for b, (_, y) in enumerate(rows):
            if a != b and good(x) and good(y) and len(x) == len(y):
                dot = sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x)) / math.sqrt(sum(p * p for p in y))
                if dot >= threshold:
                    near[a].add(b)
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((i, len(near[a]), min(ids) if ids else None))
    return sorted(out, key=str)


def clustered(rng, n, dim=16):
    """Vectors of which some have near ones, one group of them many."""
    rows = []
    while len(rows) < n:
        centre = [rng.gauss(0, 1) for _ in range(dim)]
        for _ in range(rng.choice([1, 1, 1, 2, 3, 40])):
            rows.append([c + rng.gauss(0, rng.choice([0.05, 0.2, 0.3])) for c in centre])
    return [(i, v) for i, v in enumerate(rows[:n])]


def test_several_shards(spark):
    rng = random.Random(2)
    rows = clustered(rng, 500)
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [None] * 16), (605, [float("inf")] + [1.0] * 15), (None, rows[0][1]), (3, rows[3][1]), (606, [2 * c for c in rows[3][1]])]
    rows += [(607, [1.0, 2.0]), (608, [2.0, 4.0]), (609, [1.0]), (610, [-1.0]), (None, [5.0, -3.0]), (None, None)] + [(700 + i, [1.0] * 16) for i in range(30)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cid string, v int")
    for options in ({}, {"least": 60, "block_bytes": 20000}):
        assert sorted(map(tuple, hnsw.near_duplicates(df, **options).collect()), key=str) == by_hand(rows)


def test_empty_and_alone(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.near_duplicates(df).count() == 0
    assert hnsw.near_duplicates(spark.createDataFrame([(4, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect() == [(4, 0, 4)]


def planted(n, dim=32):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dim))
    x[: n // 8] = x[n // 8 : n // 4] + 0.2 * rng.normal(size=(n // 8, dim))  # near pairs
    x[n // 2 : n // 2 + 300] = x[n // 2] + 0.15 * rng.normal(size=(300, dim))  # a dense group
    return hnsw.unit(x)


def test_recall_of_graphs():
    """Searches find nearly all that a scan finds, and compare far fewer vectors."""
    x = planted(4000)
    order, sizes = hnsw.Graph.order(len(x))
    x = x[order].astype(np.float32)
    graph = hnsw.Graph.build(x, sizes)
    beam, recall = graph.audit(0.95)
    assert recall >= hnsw.RECALL and beam * hnsw.SCAN < len(x)
    rows, found = graph.within(x, 0.95, beam)
    want = set(zip(*np.nonzero(x @ x.T >= 0.95)))
    got = set(zip(rows.tolist(), found.tolist()))
    assert got <= want and len(got) >= 0.99 * len(want)
    ids, _ = graph.search(x[:500], beam)
    assert ids.shape == (500, beam) and (ids[:, 0] == np.arange(500)).mean() > 0.99


def test_every_row_is_reachable():
    x = planted(1600).astype(np.float32)
    order, sizes = hnsw.Graph.order(len(x))
    for links in hnsw.Graph.build(x[order], sizes).layers:
        seen, todo = {0}, [0]
        while todo:
            for row in links[todo.pop()]:
                if row >= 0 and row not in seen:
                    seen.add(int(row))
                    todo.append(int(row))
        assert len(seen) == len(links)


def test_narrow_beams_fail_the_audit(monkeypatch):
    """A graph without useful links: the audit widens until nothing but a scan is left."""
    x = planted(1200).astype(np.float32)
    graph = hnsw.Graph(x, [np.full((len(x), 4), -1, dtype=np.int32)])
    beam, recall = graph.audit(0.95)
    assert recall == 1.0 and beam * hnsw.SCAN >= len(x)


def test_local_links_connect_the_same():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, 80), rng.integers(0, 60, 80)
    x, y = hnsw.local_links(a, b)
    parts = lambda p, q: {frozenset(i for i in range(60) if r[i] == r[j]) for r in [label(p, q)] for j in range(60)}

    def label(p, q):
        r = list(range(60))
        for _ in range(60):
            for i, j in zip(p, q):
                r[i] = r[j] = min(r[i], r[j])
        return r

    assert parts(a, b) == parts(x, y) and len(x) < len(set(a) | set(b))


def test_dense_shards_in_parts(monkeypatch):
    """However many vectors are near each other, a part has a bounded number of links, and all parts together have every one."""
    monkeypatch.setattr(hnsw, "FOUND", 4000)
    monkeypatch.setattr(hnsw, "GATHERED", 3200)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x[:700] = x[0] + 0.1 * rng.normal(size=(700, 32))
    order, sizes = hnsw.Graph.order(len(x))
    x = hnsw.unit(x)[order].astype(np.float32)
    graph = hnsw.Graph.build(x, sizes)
    got, owner = set(), {}
    for part, (rows, found) in enumerate(graph.parts_within(x, 0.95, 32)):
        assert len(rows) <= 4000
        assert all(owner.setdefault(r, part) == part for r in rows.tolist())
        got |= set(zip(rows.tolist(), found.tolist()))
    want = set(zip(*(i.tolist() for i in np.nonzero(x @ x.T >= 0.95))))
    assert got <= want and len(got) >= 0.99 * len(want)


def test_graphs_in_pieces(spark):
    """No row of a shard's graph is large, and searches put it together again."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 512))
    x[:200] = x[200:400] + 0.2 * rng.normal(size=(200, 512))
    classes = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "cid long, v array<double>, weight long")
    rows = hnsw.graphs(classes, 1, 0.95).selectExpr("piece", "octet_length(vectors) AS bytes", "size(cids) AS n").orderBy("piece").collect()
    assert len(rows) == 3 and max(r.bytes for r in rows) <= hnsw.PIECE_BYTES and sum(r.n for r in rows) == 600
    got = {r.id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(classes, id_col="cid", vector_col="v").collect()}
    near = hnsw.unit(x) @ hnsw.unit(x).T >= 0.95
    assert got == {i: (int(near[i].sum()) - 1, int(np.flatnonzero(near[i]).min())) for i in range(600)}
