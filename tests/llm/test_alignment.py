import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import alignment, queries

ODD = ["", None, "  ", " ", "a ", " a  b ", "\n a\n  b\n", "x\t y", "<|endoftext|> a <s>", "▁ b", "b ▁", "a\xa0 b", "\x1c b c", "日本語 テキスト", "don't it's", "x 's 't", " " * 700, "ab" * 700, "a\x00 b", "😀 x😀"]


@pytest.fixture(scope="module")
def sides():
    return alignment.load()


def by_hand(text, sides):
    """Both tokenizations of the whole text at once, and their common ends as sets."""
    o = sides.open
    if not text:
        return None
    a, b, raw = o.slow.encode(" " + text, add_special_tokens=False).ids, o.pieces.encode(text), (" " + text).encode()
    if b"".join(o.a_bytes[i] for i in a) != raw or b"".join(o.b_bytes[i] for i in b) != raw:
        return None
    ends = [np.cumsum([len(size[i]) for i in ids]).tolist() for size, ids in ((o.a_bytes, a), (o.b_bytes, b))]
    groups, before = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        groups.append(tuple([i for i, e in zip(ids, side) if before < e <= cut] for ids, side in zip((a, b), ends)))
        before = cut
    return a, b, groups


def facts_by_hand(rows, sides):
    found = [(i, by_hand(t, sides)) for i, t in rows]
    counts = Counter((x[-1], y[-1]) for _, f in found if f for x, y in f[2])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x[-1], y[-1]) for x, y in f[2]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        out.append((i, len(f[0]), len(f[1]), len(f[2]), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_texts(spark, sides):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(7, "a b c"), (7, "a b c"), (None, "a c")]
    rows += [(100 + i, "".join(rng.choice("ab \n\té's1!▁\xa0あ") for _ in range(rng.randint(1, 30)))) for i in range(200)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, links int, row string")
    aligned = queries.keep(alignment.align(docs, sides), "test").withColumn("sha", queries.F.expr("if(groups = '', '', sha2(groups, 256))"))
    found = alignment.link_facts(aligned, alignment.pair_counts(aligned, sides))
    got = found.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha").collect()
    assert sorted(map(tuple, got), key=str) == facts_by_hand(rows, sides)


def test_query_on_tables(spark, sides):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = queries.op11_alignment(spark, d).collect()
    assert sorted(map(tuple, got), key=str) == facts_by_hand(rows, sides)


def test_counts_of_both_sides(spark, sides):
    docs = spark.createDataFrame([(1, "the cat the cat"), (2, "the dog")], "doc_id long, text string")
    counts = alignment.pair_counts(queries.keep(alignment.align(docs, sides), "test"), sides).collect()
    assert sum(c["count"] for c in counts) == 6 and max(c["count"] for c in counts) == 3
    for side in "ab":
        for c in counts:
            assert c[f"{side}_most"] == max(x["count"] for x in counts if x[side] == c[side])


def test_remembered_segments_change_nothing(sides, monkeypatch):
    texts = ["one two three " * 5, "two three four", "five"]
    want = [alignment.align_texts([t], sides).iloc[0].groups for t in texts]
    monkeypatch.setattr(alignment, "REMEMBERED", 0)
    assert [alignment.align_texts([t], sides).iloc[0].groups for t in texts] == want
    assert alignment.align_texts(texts, sides).groups.tolist() == want


def test_merge_of_ends():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        at, bt = alignment.merge_ends(a, b)
        assert a[at].tolist() == b[bt].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_empty_table(spark, sides):
    docs = spark.createDataFrame([], "doc_id long, text string")
    aligned = queries.keep(alignment.align(docs, sides), "test")
    assert alignment.link_facts(aligned, alignment.pair_counts(aligned, sides)).count() == 0
