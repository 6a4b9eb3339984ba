import random
import re
import zlib
from collections import Counter

from tessera.llm import spelling


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes one word of the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def by_hand(rows, every=97, shortest=5, rarest=3):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= shortest and c >= rarest}
    form, out = {}, []
    for w in n:
        others = sorted((-n[v], v) for v in n if near(w, v))
        form[w] = (others[0][1] if others and -others[0][0] >= 2 * n[w] else None, len(others))
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, form[w][0], root, n[w], form[w][1], n.get(form[w][0])))
    return sorted(out, key=str)


def found(docs, **options):
    return sorted(map(tuple, spelling.variants(spelling.vocabulary(docs, **options)).collect()), key=str)


def test_made_words(spark):
    rng = random.Random(4)
    stems = ["banana", "banans", "Éclairé", "aaaaa", "aaaaaa", "zzéézz", "kitten", "sitten", "sittin", "sitting", "ÀÀÀÀÀ", "ààààà"]
    words = []
    for w in stems:
        for _ in range(60):
            i = rng.randrange(len(w))
            words += [w] * rng.randint(1, 9) + [w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w.upper()]
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::300]) + rng.choice([".", "", "'s", " 12x"])) for i in range(300)]
    rows += [(None, "banana banana"), (None, "banana"), (5, None), (6, ""), (7, "banana " * 5000), (7, "x" * 20000)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    want = by_hand(rows)
    assert found(docs) == want and any(w[1] for w in want) and any(w[2] != w[1] and w[1] for w in want)
    assert found(docs, every=2) == by_hand(rows, 2)
    assert found(docs, every=None, rarest=1) == by_hand(rows, None, rarest=1)


def test_longer_chains(spark):
    words = [("abcdefgh"[:5] + "z" * i, 3 * 2 ** (12 - i)) for i in range(12)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert all(r.root == "abcde" for r in got.values()) and got["abcde"].form is None and got["abcdez"].form == "abcde"


def test_ties_and_nothing(spark):
    got = spelling.variants(spark.createDataFrame([("house", 3), ("houseb", 6), ("housea", 6), ("lonely", 3)], "word string, n long"))
    rows = {r.word: tuple(r) for r in got.collect()}
    assert rows["house"] == ("house", "housea", "housea", 3, 2, 6)
    assert rows["housea"] == ("housea", None, "housea", 6, 2, None) and rows["lonely"] == ("lonely", None, "lonely", 3, 0, None)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert found(empty) == []
