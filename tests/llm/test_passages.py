import random

import pytest

from tessera.llm import anchors, passages

SCHEMA = "doc_id long, text string, seg long, ranges string"


def by_hand(rows, window):
    first = {}
    order = lambda i: 2**63 if i is None else i
    split = [(order(i), (t or "").encode().split()) for i, t, *_ in rows]
    for i, words in split:
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, words), row in zip(split, rows):
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone).decode()
        out.append((repr(row[0]), len(words), len(gone), kept))
    return sorted(out)


def passage_rows(seed, window):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "\u0085x"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [some(rng.randint(window - 2, 3 * window)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = some(rng.randint(0, 2 * window))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 3)
            words += p[a : len(p) - rng.randint(0, len(p) // 3)] + some(rng.randint(0, 9))
        rows.append((i * 7 % 60, rng.choice([" ", "\n", " \t"]).join(words), 1, "x"))
    rows += [(100, rows[0][1], 1, None), (101, rows[0][1], 1, None), (101, rows[1][1], 1, None), (101, rows[1][1], 1, None)]
    rows += [(200, None, None, None), (201, "", None, None), (None, rows[3][1], None, None), (None, rows[4][1] + " z", None, None)]
    rows += [(300, "a " * 400, None, None), (301, "a " * 401, None, None), (302, "b a " * 200, None, None)]
    return rows


@pytest.mark.parametrize("window,phrase,shard", [(50, 12, 200_000), (8, 3, 300), (5, 5, 100)])
def test_passages(spark, window, phrase, shard):
    rows = passage_rows(window, window)
    df = spark.createDataFrame(rows, SCHEMA)
    found = passages.remove_repeated_passages(df, window=window, phrase=phrase, shard_words=shard).collect()
    assert sorted((repr(r.id), r.n_words, r.n_removed, r.kept) for r in found) == by_hand(rows, window)
    assert sum(r.n_removed for r in found) > 0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert passages.remove_repeated_passages(df).count() == 0


def test_anchor_ranges(monkeypatch):
    import numpy as np

    monkeypatch.setattr(anchors, "PIECE", 64)
    units = np.random.default_rng(1).integers(0, 5, 500).astype(np.uint64)
    covered = []
    for s, n, at, h in anchors.anchor_ranges(units, 20, 6):
        for a, b, p in zip(s, n, at):
            covered += range(a, a + b)
            assert a + b - 1 <= p and p + 6 <= a + 20
    assert covered == list(range(500 - 20 + 1))
    assert not list(anchors.anchor_ranges(units[:19], 20, 6))


def test_occurrences():
    texts = [[b"a", b"b", b"a", b"b", b"a"], [b"b", b"a", b"b"], [], [b"a", b"bb", b"a"]]
    assert passages.occurrences(texts, [b"a b a"], 3) == [[0, 2], [], [], []]
    assert passages.occurrences(texts, [], 3) == [[], [], [], []]
    assert [sorted(x) for x in passages.occurrences(texts, [b"a b a", b"b a b"], 3, 1)] == [[0, 1, 2], [0], [], []]


def test_very_many_different_words():
    words = [b"w%d" % i for i in range(1_200_000)]
    assert passages.occurrences([words, words[5:]], [b" ".join(words[i : i + 12]) for i in range(0, 1_199_000, 600_000)], 12) == [[0, 600_000], [599_995]]


def test_places_come_from_the_automata(spark, monkeypatch):
    """Phrases that the automata do not find are not removed."""
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, "a " + passage), (2, "b " + passage + " c")], "doc_id long, text string")
    assert {r.id: r.n_removed for r in passages.remove_repeated_passages(df).collect()} == {1: 0, 2: 60}
    stream = passages._stream
    monkeypatch.setattr(passages, "_stream", lambda k, n, names: stream(k + 1, n, names))  # finds every phrase one word too early
    assert {r.id: r.n_removed for r in passages.remove_repeated_passages(df).collect()} == {1: 0, 2: 0}


def test_null_string_ids(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(None, passage), ("z", passage + " x"), ("a", "y " + passage)], "doc_id string, text string")
    assert {r.id: r.n_removed for r in passages.remove_repeated_passages(df).collect()} == {"a": 0, "z": 60, None: 60}
