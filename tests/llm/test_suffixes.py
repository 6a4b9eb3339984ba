import random
from collections import Counter

import pytest

from tessera.llm import suffixes

SCHEMA = "doc_id long, text string, h long, kept string"


def by_hand(rows, window):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[p : p + window] for _, t in texts for p in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        runs = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((repr(i), len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out)


def string_rows(seed, window):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [some(rng.randint(window // 2, 3 * window)) for _ in range(6)]
    rows = []
    for i in range(50):
        text = some(rng.randint(0, window))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            text += p[rng.randint(0, len(p) // 3) : len(p) - rng.randint(0, len(p) // 3)] + some(rng.randint(0, 9))
        rows.append((i, text, 1, "x"))
    rows += [(60, rows[0][1], 1, None), (60, rows[0][1], 1, None), (60, rows[1][1], 1, None), (None, rows[2][1], 1, None), (None, rows[2][1], 1, None)]
    return rows + [(70, None, 1, None), (71, "", 1, None), (72, "z" * (4 * window), 1, None), (73, "z" * window, 1, None), (74, "yz" * window, 1, None)]


@pytest.mark.parametrize("window,sizes", [(400, {}), (40, {"gram": 20}), (12, {"gram": 5, "largest": 3, "share": 10}), (9, {"gram": 9, "share": 50})])
def test_strings(spark, window, sizes):
    rows = string_rows(window, window)
    df = spark.createDataFrame(rows, SCHEMA)
    found = suffixes.remove_repeated_strings(df, window=window, **sizes).collect()
    assert sorted((repr(r.id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == by_hand(rows, window)
    assert sum(r.n_removed for r in found) > 0


def test_empty(spark):
    assert suffixes.remove_repeated_strings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_collisions_are_verified():
    some = suffixes.Strings([b"abcd", b"abxd", b"abc", b""])
    some.prefixes = [[7] * len(d) for d in some.data]  # every hash collides
    assert some.common(0, 1) == 2 and some.common(0, 2) == 3 and some.common(0, 3) == 0
    plain = suffixes.Strings([b"abcd", b"abxd", b"abc", b"", b"abcd"])
    assert plain.extensions().tolist()[0] == [0, 2, 3, 0, 4]
