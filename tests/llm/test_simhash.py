import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash


def by_hand(text, k=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, max_bits):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_fingerprint():
    rng = random.Random(1)
    words = ["Ab", "ÀÉ", "x y", "\u0085", "z", "the", "\x1c"]
    texts = ["", " \t\n\x0b\x0c\r", "one", "One two", "ONE two three"] + [
        rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(n)) for n in (3, 4, 5, 40, 300)
    ]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == by_hand(t)
    long = " ".join(str(i % 977) for i in range(70000))
    assert simhash.fingerprint(long.encode()) == by_hand(long)


@pytest.mark.parametrize("blocks", [1, 2, 5, 6, 7])
@pytest.mark.parametrize("tile_rows", [8192, 7])
def test_links(spark, blocks, tile_rows, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 100)
    rng = random.Random(blocks)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(12):
            fps.add(at)
            for _ in range(rng.randint(1, 6)):
                at ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in fps], "fp long")
    got = {(r.a % 2**64, r.b % 2**64) for r in simhash.link(df, 4, blocks, shard_rows=8, tile_rows=tile_rows).collect()}
    assert all(bin(a ^ b).count("1") <= 64 for a, b in got)
    label = {f: f for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for a, b in got:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    want = roots(fps, 4)
    assert [root(f) for f in fps] == [fps[i] for i in want]


def test_near_duplicates(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, base = [], None
    for i in range(120):
        if i % 6 == 0:
            base = [rng.choice(vocabulary) for _ in range(400)]
        text = list(base)
        if i % 6 > 2:
            text[rng.randrange(400)] = "changed"
        rows.append((i * 7 % 120, " ".join(text), "x"))
    rows += [(500, None, "y"), (501, "", "y"), (502, "\n", None), (None, "one", "z"), (503, "one", "z"), (0, rows[0][1], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    fps = [by_hand(t) for _, t, _ in rows]
    labels = roots(fps, 4)
    smallest = {}
    for (i, _, _), c in zip(rows, labels):
        smallest[c] = min(x for x in (smallest.get(c), i) if x is not None) if i is not None or smallest.get(c) is not None else None
    want = sorted((repr(i), f, smallest[c]) for (i, _, _), f, c in zip(rows, fps, labels))
    assert sorted((repr(r.id), r.fp % 2**64, r.component_id) for r in found) == want
    assert simhash.near_duplicates(df.filter("false")).count() == 0


def test_blocks_grow():
    assert [simhash.blocks_for(n, 4) for n in (0, 10**6, 10**8, 10**11)] == [5, 5, 6, 7]
    assert len(simhash.masks_of(6, 2)) == 15 and all(bin(m).count("1") >= 20 for m in simhash.masks_of(6, 2))


def test_all_pairs(spark):
    rng = random.Random(9)
    some = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({f ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) for f in some for _ in range(8)})
    df = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in fps], "fp long")
    want = {(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 4}
    for blocks in (5, 6):
        got = {tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.link(df, 4, blocks, shard_rows=8, every=True).collect()}
        assert got == want
