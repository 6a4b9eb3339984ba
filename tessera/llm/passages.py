"""Removing passages of words that an earlier document has, with repeated-phrase automata.

1. Every document's anchor phrases (anchors.py) are counted over the corpus; those that stand in one document are
   no part of any repeated window and drop out. The others are confirmed phrases; their words are cut from one document each.
2. Equal segments of a phrase are a class, a recurring passage. If a phrase has one class, its windows are equal wherever it
   stands, and the smallest document keeps them; else one segment of each class is cut into windows, which are combined by a 128-bit
   hash of their words: that gives the smallest document that has a window, for all members of its class.
3. The documents that may hold confirmed phrases are streamed, in shards, through Aho-Corasick automata of those
   phrases, over words. Where the automata find a phrase, and nowhere else, the windows around it that an earlier document has go.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import anchor_ranges, find_anchors, packed, per_text, text_rows, unpack, with_texts
from .common import keep

WINDOW, PHRASE = 50, 12
#: Phrases of an automaton, at most.
PHRASES = 50_000
NO_ID = 2**63 - 1


def _line(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words joined by a space, and where each one begins (and one would after the last)."""
    lengths = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
    return b" ".join(words), np.concatenate([[0], np.cumsum(lengths + 1)])


def word_anchors(window: int, k: int):
    def anchors_of(content: bytes):
        words = content.split()
        if len(words) < window:
            return
        line, begin = _line(words)
        units = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
        for s, n, at, h in anchor_ranges(units, window, k):
            a, b = begin[s].tolist(), (begin[s + n - 1 + window] - 1).tolist()
            seg = np.fromiter((xxhash.xxh3_64_intdigest(line[x:y]) for x, y in zip(a, b)), dtype=np.uint64, count=len(s))
            yield h, seg, s, n, at

    return anchors_of


def occurrences(texts: list[list[bytes]], phrases: list[bytes], k: int, most: int = PHRASES) -> list[list[int]]:
    """Per text the positions at which any of the phrases (k words, joined by a space) occurs.

    Each different word of the phrases becomes one character, so that the automaton has a node per word and a match
    is a match of whole words; all other words are one character that no phrase has. An automaton has `most` phrases at most.
    """
    found: list[list[int]] = [[] for _ in texts]
    for at in range(0, len(phrases), most):
        codes: dict[bytes, str] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in phrases[at : at + most]:
            line = []
            for w in phrase.split(b" "):
                c = codes.get(w)
                if c is None:
                    n = len(codes) + 1
                    c = codes[w] = chr(n if n < 0xD800 else n + 0x800)
                line.append(c)
            automaton.add_word("".join(line))
        automaton.make_automaton()
        for words, places in zip(texts, found):
            places += [end - k + 1 for end, _ in automaton.iter("".join([codes.get(w, "\0") for w in words]))]
    return found


def _stream(k: int, shard_words: int, names: list[str]):
    """mapInArrow function: id, tid, z, xs(h, seg, s, n, at, phrase) to id, tid, h, seg, s, n of the xs whose phrase an automaton finds at `at`."""

    def shard(batch, rows, texts):
        xs = [batch.column(3)[i].values for i in rows]
        fields = [{n: x.field(n) for n in ("h", "seg", "s", "n", "at")} for x in xs]
        phrases = sorted({p for x in xs for p in x.field("phrase").to_pylist()})
        for i, x, places in zip(rows, fields, occurrences(texts, phrases, k)):
            good = pa.array(np.isin(x["at"].to_numpy(), np.array(places, dtype=np.int64)))
            own = batch.select([0, 1]).take(pa.array(np.full(good.true_count, i, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([*own.columns, *[x[n].filter(good) for n in ("h", "seg", "s", "n")]], names=names)

    def run(batches):
        for batch in batches:
            rows, texts, size = [], [], 0
            for i, z in enumerate(batch.column(2)):
                rows.append(i)
                texts.append(unpack(z.as_py()).split())
                size += len(texts[-1])
                if size > shard_words or i == batch.num_rows - 1:
                    yield from shard(batch, rows, texts)
                    rows, texts, size = [], [], 0

    return run


def merged(ranges) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def duplicate_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, shard_words: int = 200_000) -> DataFrame:
    """id, tid, ranges: the word ranges (s inclusive, e exclusive) to remove, for texts that have any."""
    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType
    if isinstance(kind, (T.LongType, T.IntegerType)):
        order = F.coalesce(F.col("id").cast("long"), F.lit(NO_ID))
    else:
        order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    anchors = keep(find_anchors(rows, word_anchors(window, phrase)), "anchors")
    # What a join needs is kept just as it joins: Spark then knows its size, and either sends it to all tasks or deals both sides
    # anew and splits the rows of a very common phrase.
    groups = keep(
        anchors.groupBy("h")
        .agg(F.min(order).alias("owner"), F.max(order).alias("last"), F.min("seg").alias("first"), F.max("seg").alias("seg_b"))
        .filter("owner < last")
        .select("h", "first", (F.col("first") == F.col("seg_b")).alias("alike")),
        "groups",
    )
    found = keep(anchors.join(groups, "h"), "found")
    member = F.struct("id", "tid", "s", "n", "at")
    classes = keep(
        found.groupBy("h", "seg").agg(F.min(order).alias("owner"), F.max(order).alias("last"), F.min(member).alias("r"), F.first("alike").alias("alike"), (F.first("first") == F.col("seg")).alias("first")),
        "classes",
    )
    texts = packed(rows, lambda content: b" ".join(content.split()))
    wanted = classes.filter("first or not alike").select("r.id", "r.tid", F.struct("h", "seg", "alike", "first", "r.s", "r.n", "r.at").alias("x"))
    names = ["h", "seg", "phrase", "w1", "w2", "j"]

    def cut(batches):
        for batch in batches:
            for z, xs in zip(batch.column(2), batch.column(3)):
                line, begin = _line(unpack(z.as_py()).split())
                out = [[] for _ in names]
                for x in xs.as_py():
                    if x["first"]:
                        words = line[begin[x["at"]] : begin[x["at"] + phrase] - 1]
                        for c, v in zip(out, (x["h"], x["seg"], words, None, None, None)):
                            c.append(v)
                    if not x["alike"]:
                        a, e = begin[x["s"] : x["s"] + x["n"]].tolist(), (begin[x["s"] + window : x["s"] + x["n"] + window] - 1).tolist()
                        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(line[i:j]) for i, j in zip(a, e)]), dtype="<i8").reshape(-1, 2)
                        n = x["n"]
                        for c, v in zip(out, ([x["h"]] * n, [x["seg"]] * n, [None] * n, both[:, 0].tolist(), both[:, 1].tolist(), range(n))):
                            c += v
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    cuts = keep(with_texts(texts, per_text(wanted, F.collect_set("x").alias("xs"))).mapInArrow(cut, "h long, seg long, phrase binary, w1 long, w2 long, j int"), "cuts")
    phrases = keep(cuts.filter("phrase is not null").select("h", "phrase"), "phrases")

    held = per_text(found.join(phrases, "h"), F.collect_set(F.struct("h", "seg", "s", "n", "at", "phrase")).alias("xs"))
    fields = [("id", kind), ("tid", T.LongType()), ("h", T.LongType()), ("seg", T.LongType()), ("s", T.IntegerType()), ("n", T.IntegerType())]
    places = with_texts(texts, held).mapInArrow(_stream(phrase, shard_words, [n for n, _ in fields]), T.StructType([T.StructField(n, t) for n, t in fields]))
    places = keep(places, "places")

    windows = cuts.filter("w1 is not null").drop("phrase").join(classes.filter("not alike").select("h", "seg", "owner", "last"), ["h", "seg"])
    windows = keep(windows, "windows")
    owners = keep(windows.groupBy("w1", "w2").agg(F.min("owner").alias("first"), F.max("last").alias("to")).filter("first < to").drop("to"), "owners")
    late = windows.join(owners, ["w1", "w2"]).filter("first < last").groupBy("h", "seg").agg(F.sort_array(F.collect_set(F.struct("j", "first"))).alias("js"))
    none = F.lit(None).cast(late.schema["js"].dataType)
    results = keep(
        classes.filter("alike and owner < last").select("h", "seg", "owner", none.alias("js")).unionByName(late.select("h", "seg", F.lit(None).cast(classes.schema["owner"].dataType).alias("owner"), "js")),
        "results",
    )
    span = lambda a, e: F.struct((F.col("s") + a).alias("s"), (F.col("s") + e + window).alias("e"))
    mine = F.transform(F.filter("js", lambda x: x["first"] < order), lambda x: x["j"])
    run = F.array(span(F.get("mine", F.lit(0)), F.element_at("mine", -1)))
    several = F.transform("mine", lambda j: span(j, j))
    in_a_row = F.element_at("mine", -1) - F.get("mine", F.lit(0)) + 1 == F.size("mine")
    spans = F.when(F.col("js").isNull(), F.when(order > F.col("owner"), F.array(span(F.lit(0), F.col("n") - 1)))).when(F.size("mine") > 0, F.when(in_a_row, run).otherwise(several))
    out = places.join(results, ["h", "seg"]).withColumn("mine", mine).select("id", "tid", spans.alias("spans")).filter("spans is not null")
    return per_text(out, F.array_distinct(F.flatten(F.collect_list("spans"))).alias("ranges"))


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **sizes) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if a window of `window` words that covers it also starts in a document with a smaller id,
    judged on the input. Null texts have no words; null ids are larger than all others and equal to each other; rows that
    share their id do not take from each other. An empty table gives an empty result.
    """
    rows = text_rows(docs, id_col, text_col)
    found = duplicate_ranges(docs, id_col, text_col, window, **sizes)
    texts = packed(rows, lambda content: b" ".join(content.split()))

    def run(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            for z, ranges in zip(batch.column(2), batch.column(3)):
                words = unpack(z.as_py()).split()
                spans = merged((r["s"], r["e"]) for r in ranges.as_py() or [])
                stay, at = [], 0
                for s, e in spans:
                    stay += words[at:s]
                    at = e
                stay += words[at:]
                total.append(len(words))
                gone.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return with_texts(texts, found, "left").mapInArrow(run, schema)


