"""The near-duplicate stage against a brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline as cp
import numpy as np

from tessera.llm import simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def five_words(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def test_every_pair(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 20))) for f in fps for _ in range(3)]
    signed = np.array(sorted(set(fps)), dtype=np.uint64).view(np.int64).tolist()
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 16}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for tile_rows in (8192, 7):
        found = {(min(r), max(r)) for r in simhash.link(df, 16, 17, tile_rows=tile_rows, every=True).collect()}
        assert found == want


def test_near_stage(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(150, 400))]
        texts.append(words)
        for n in range(3):
            copy = list(words)
            for at in rng.sample(range(len(copy)), 1 + (i + n) % 9):
                copy[at] = rng.choice(vocabulary)
            texts.append(copy)
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts] + [None, "", " ", "one two", "One two"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    sets = [five_words(t) for t in texts]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs, shown = set(), 0
    for i in range(len(rows)):
        for j in range(i):
            whole = len(sets[i] | sets[j])
            if not whole or len(sets[i] & sets[j]) / whole >= 0.8:
                pairs.add((j, i))
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                fps = [simhash.fingerprint((texts[x] or "").encode()) for x in (i, j)]
                shown += bin(fps[0] ^ fps[1]).count("1") <= 4
    assert shown < len(pairs) * 0.7  # the rule of op3 does not do
    docs = spark.createDataFrame(rows, COLUMNS)
    stay = {r.doc_id for r in cp.near_stage(spark, docs, "").collect()}
    want = {i for i in range(len(rows)) if find(i) == i}
    # No text is dropped without a similar one; the bits lose less than one pair in a hundred.
    assert stay >= want
    assert len(rows) - len(stay) >= 0.98 * (len(rows) - len(want))
    print("pairs", len(pairs), "within 4 bits", shown, "to drop", len(rows) - len(want), "dropped", len(rows) - len(stay))


def made_of(spark, monkeypatch, texts):
    """Components of similar_duplicates(), and the rows of every table that it writes."""
    made, keep = [], simhash.keep

    def counted(df, name):
        made.append((name, (out := keep(df, name)).count()))
        return out

    monkeypatch.setattr(simhash, "keep", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.id: r.component_id for r in simhash.similar_duplicates(docs).collect()}, made


def test_a_large_group_makes_no_row_for_each_pair(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(w if i != at else f"new{n}" for i, w in enumerate(words)) for n, at in enumerate(rng.choices(range(200), k=400))]
    found, made = made_of(spark, monkeypatch, texts)
    assert set(found.values()) == {0}
    assert all(n < 4 * len(texts) for name, n in made if name.endswith("pairs")), made


def test_no_link_is_lost(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for g in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 260))]
        texts.append(" ".join(words))
        # Each is near the limit of the first, and mostly beyond it of the others.
        for _ in range(12):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randint(0, max(1, len(copy) // 45))):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy[rng.randint(0, len(copy) // 20) :]))
    texts = list(dict.fromkeys([*texts, "", " ", "one", "One"]))
    rng.shuffle(texts)
    sets = [five_words(t) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            whole = len(sets[i] | sets[j])
            if want[i] != want[j] and (not whole or len(sets[i] & sets[j]) / whole >= 0.8):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    found, _ = made_of(spark, monkeypatch, texts)
    assert found == dict(enumerate(want))


def test_sketches_of_all_rows_are_not_written(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f {i % 3}", "en", "s", 1) for i in range(30)] + [(None, None, None, None, None)], COLUMNS)
    written = []
    keep = simhash.keep
    simhash.keep = lambda df, name: written.append((name, keep(df, name))) or written[-1][1]
    try:
        found = simhash.similar_duplicates(docs).collect()
    finally:
        simhash.keep = keep
    # One row for each text at most, however often it stands.
    assert max(df.count() for _, df in written if "tally" in df.columns) == 4
    assert sorted((r.id, r.component_id) for r in found if r.id is not None) == [(i, i % 3) for i in range(30)] and len(found) == 31
