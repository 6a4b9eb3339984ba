import pickle
from collections import Counter

import pytest
import sentencepiece

from tessera.llm import pieces

TEXTS = [
    "",
    " ",
    "Hello  world\n\tx",
    "  lead and trail  ",
    "thntonth wh.  \n\n  déjà vu 執梦 😀 ▁literal▁ \0 nul",
    "a" * 3000,
    "<s> </s> <unk> <0x41>",
    "line\nline\r\nline",
    "     many     spaces     ",
]


def test_without_dropout_as_the_library():
    own, sp = pieces.load(dropout=0.0), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for t in TEXTS:
        if pieces.SPACE not in t and "\0" not in t and "<" not in t:
            assert own.encode(t.encode()) == sp.encode(t), t


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6, 1.0])
def test_round_trip(dropout):
    own = pieces.load(dropout=dropout)
    again = pickle.loads(pickle.dumps(own))
    for t in [t.encode() for t in TEXTS] + [b"bad \xff\xfe bytes \xe2\x96"]:
        ids = own.encode(t, "7")
        assert own.decode(ids) == t
        assert again.encode(t, "7") == ids
    if dropout == 1.0:
        assert len(own.encode(b"the the", "1")) == 8


def test_both_agendas_agree():
    own = pieces.load(dropout=0.3)
    for i, t in enumerate(TEXTS + ["internationalisation", " onthtionhent,", "Lichkeitéé"]):
        parts = [pieces.SPACE if c == " " else c for c in t[:300]]
        assert own._short(list(parts), 2 * i + 1) == own._long(list(parts), 2 * i + 1)


@pytest.mark.parametrize("dropout", [0.0, 0.3, 1.0])
def test_many_words_at_once(dropout):
    own = pieces.load(dropout=dropout)
    words = [w for t in TEXTS + ["internationalisation of onthtionhent, Lichkeitéé   x  " * 3] for w in pieces.WORDS.findall(" " + t)]
    for v in range(3):
        assert own.split_many(words, v) == [own.split(w, own.key(w, v)) for w in words]
    assert own.split_many([], 0) == []


def test_variants():
    own = pieces.load(dropout=0.3, variants=16)
    ways = {tuple(own.encode(b"international", str(i))) for i in range(50)}
    assert 3 < len(ways) <= 16
    assert own.encode(b"international", "3") == pieces.load(dropout=0.3, variants=16).encode(b"international", "3")
    assert {tuple(pieces.load(dropout=0.3, variants=16, seed=1).encode(b"international", str(i))) for i in range(50)} != ways


def test_frames(spark):
    rows = [(i, t, [1], "x") for i, t in enumerate(TEXTS)] + [(None, None, None, None), (1, "twice", None, None), (1, "twice", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, content string")
    own = pieces.load()
    found = pieces.decode(pieces.encode(df, own), own).collect()
    assert len(found) == len(rows)
    assert all(bytes(r.content) == bytes(r.decoded) for r in found)
    assert sorted(bytes(r.decoded).decode() for r in found) == sorted(t or "" for _, t, *_ in rows)
    assert pieces.encode(df.filter("false"), own).count() == 0
    both = pieces.encode(df, own, round_trip=True)
    assert sorted(map(repr, both.collect())) == sorted(map(repr, found))


def test_draws_do_not_run_out(spark):
    own = pieces.load()
    text = " ".join(["international"] * 400)
    ways = lambda ids: {w for w in pieces_of(own, ids)}
    one, other, again = own.encode(text.encode(), "1"), own.encode(text.encode(), "2"), own.encode(text.encode(), "1", 1)
    assert len(ways(one)) > 1  # in one document
    assert one != other and one != again and one == pieces.load().encode(text.encode(), "1")
    many = set().union(*(ways(own.encode(text.encode(), str(i))) for i in range(40)))
    assert len(many) > 16
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    found = pieces.encode(df.coalesce(1), own).collect()
    assert [r.id for r in found] == [1, 1, None, 2] and len({tuple(r.ids) for r in found}) == 4


def pieces_of(own, ids):
    """The splits of the words of a text of equal words, as tuples."""
    word, size, out = [], 0, []
    for i in ids:
        word.append(i)
        size += len(own._open[2][i])
        if size == len(" international"):
            out.append(tuple(word))
            word, size = [], 0
    return out


def test_rate_of_the_draws():
    own = pieces.load(dropout=0.3)
    found, want = Counter(), Counter()
    for i in range(4000):
        found[tuple(own.encode(b"the", str(i)))] += 1
        want[tuple(own.split(" the", own.key(" the", i)))] += 1  # the agenda with draws by piece and place
    assert found.keys() == want.keys() and all(abs(found[w] - want[w]) < 160 for w in want)


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_walk_is_the_agenda(dropout):
    own, none = pieces.load(dropout=dropout), pieces.load(dropout=0.0)
    for w in [" internationalisation", " onthtionhent,", "Lichkeitéé", "\0執", " x"]:
        assert own.walk(w, ())[0] == none.split(w, 1)
        assert len(own.walk(w, tuple(range(200)))[0]) >= len(none.split(w, 1))


@pytest.mark.parametrize("dropout", [0.1, 0.5, 0.95])
def test_encoding_by_one_agenda_at_a_time(dropout):
    """Every occurrence of a word by the plain agenda, with the same draws."""
    import numpy as np
    import xxhash

    own = pieces.load(dropout=dropout)
    texts = [t.encode() for t in TEXTS] + [("internationalisation of onthtionhent, Lichkeitéé  執 " * 40 + "x" * 60 + " end").encode()]
    names, turns = [str(i) for i in range(len(texts))], [i % 2 for i in range(len(texts))]
    for t, name, turn, found in zip(texts, names, turns, own.encode_many(texts, names, turns)):
        start, want = np.uint64(xxhash.xxh64_intdigest(f"{turn}/{name}", own.seed)), []
        for i, w in enumerate(pieces.WORDS.findall(" " + t.decode()) if t else []):
            h = pieces._mixed(np.array([start]) + np.uint64(i + 1) * np.uint64(pieces._STRIDE))
            if len(w) > pieces.SHORT:
                want += own.split(w, int(h[0]))
                continue
            skips = set()
            at = int(own.gaps(h)[0])
            while at < own.walk(w, tuple(skips))[1]:
                skips.add(at)
                h = pieces._mixed(h + np.uint64(pieces._STRIDE))
                at += 1 + int(own.gaps(h)[0])
            want += own.walk(w, tuple(skips))[0]
        assert found.tolist() == want
        assert own.decode(want) == t


def test_repeated_texts_move_compressed(spark):
    texts = [(i % 3, t) for i, t in enumerate([*TEXTS, None, *TEXTS])] + [(None, "x y"), (None, "x y"), (7, "long words " * 400)] * 2
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    found = pieces.encode(docs, pieces.load(), round_trip=True)
    # Pressed before they move, encoded once they are back.
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    own, seen = pieces.load(), Counter()
    rows = found.collect()
    assert [r.id for r in rows] == [i for i, _ in texts]
    for r, (i, text) in zip(rows, texts):
        content = (text or "").encode()
        assert r.content == r.decoded == content
        assert r.ids == own.encode(content, "" if i is None else str(i), seen[i, content])
        seen[i, content] += 1
