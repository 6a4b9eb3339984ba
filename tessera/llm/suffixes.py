"""Removing bytes that repeated strings cover, by a hash-compared suffix sort.

Two equal strings of `window` bytes have equal anchors (anchors.py), so only suffixes that begin at anchors, and
the reversed text before them, need sorting, and only among anchors of equal hash. Anchors that occur once drop out. Equal
segments of an anchor, by their hash, are a class; one segment of a class, or two if it stands more than once, are
sorted in groups of equal anchors: a merge sort whose comparisons find the common extension of
two suffixes by binary search on prefix polynomial hashes, and verify it on the bytes. The
common extensions of sorted neighbours give those of all pairs; an anchor's repeated bytes reach as far left and
right as any partner with which both extensions together make up a window. What is found of a class holds for all
that belong to it.

A group with very many classes is not gathered in a task: its windows are grouped by their bytes.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import anchor_ranges, find_anchors, packed, per_text, text_rows, unpack, with_texts
from .common import keep
from .passages import merged

WINDOW, GRAM = 400, 200
#: Segments of a group that one task sorts at most, and segments that a task's share has about.
LARGEST, SHARE = 4096, 4000

_rng = np.random.default_rng(400)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.cumprod(np.full(1 << 12, 0xD1342543DE82EF95, dtype=np.uint64))


def byte_anchors(window: int, k: int, seed: int = 0):
    def anchors_of(content: bytes):
        if len(content) < window:
            return
        units = _BYTE[np.frombuffer(content, dtype=np.uint8)]
        for s, n, at, h in anchor_ranges(units, window, k):
            ends = (s + n - 1 + window).tolist()
            seg = np.fromiter((xxhash.xxh3_64_intdigest(content[a:b], seed) for a, b in zip(s.tolist(), ends)), dtype=np.uint64, count=len(s))
            yield h, seg, s, n, at

    return anchors_of


class Strings:
    """Strings that are compared from their starts by prefix hashes."""

    def __init__(self, data: list[bytes]):
        self.data = data
        self.prefixes = [self._hashes(d) for d in data]

    @staticmethod
    def _hashes(d: bytes) -> list[int]:
        powers = _POWERS[: len(d)] if len(d) <= len(_POWERS) else np.cumprod(np.full(len(d), 0xD1342543DE82EF95, dtype=np.uint64))
        return np.cumsum(_BYTE[np.frombuffer(d, dtype=np.uint8)] * powers).tolist()

    def common(self, i: int, j: int) -> int:
        """Length of the common prefix: the longest with equal hashes, verified on the bytes."""
        a, b = self.prefixes[i], self.prefixes[j]
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            if a[mid - 1] == b[mid - 1]:
                low = mid
            else:
                high = mid - 1
        x, y = self.data[i], self.data[j]
        if x[:low] != y[:low]:  # hashes that collide
            low = next(n for n in range(low) if x[n] != y[n])
        return low

    def compare(self, i: int, j: int) -> int:
        n = self.common(i, j)
        x, y = self.data[i][n : n + 1], self.data[j][n : n + 1]
        return (x > y) - (x < y)

    def extensions(self) -> np.ndarray:
        """Common prefix lengths of all pairs: the least of those between neighbours in sorted order."""
        n = len(self.data)
        order = sorted(range(n), key=cmp_to_key(self.compare))
        step = np.array([self.common(a, b) for a, b in zip(order, order[1:])], dtype=np.int32)
        out = np.zeros((n, n), dtype=np.int32)
        for i in range(n - 1):
            reach = np.minimum.accumulate(step[i:])
            out[order[i], order[i + 1 :]] = reach
            out[order[i + 1 :], order[i]] = reach
        return out


def repeated(segments: list[bytes], at: list[int], window: int) -> list[tuple[int, int] | None]:
    """For each segment the range around its anchor (at) that it shares, in windows, with any other segment."""
    right = Strings([d[a:] for d, a in zip(segments, at)]).extensions()
    left = Strings([d[:a][::-1] for d, a in zip(segments, at)]).extensions()
    enough = right + left >= window
    np.fill_diagonal(enough, False)
    back, ahead = np.where(enough, left, -1).max(axis=1), np.where(enough, right, -1).max(axis=1)
    return [(a - int(x), a + int(y)) if x >= 0 else None for a, x, y in zip(at, back, ahead)]


def class_ranges(h: list[int], seg: list[int], at: list[int], data: list[bytes], window: int) -> list[tuple[int, int, int, int]]:
    """h, seg, first and last + 1 repeated byte of each class of segments (from the segment's start), of whole groups of equal h.

    A class that stands more than once has two members here; that they are equal is verified on the bytes.
    """
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(h):
        groups.setdefault(x, []).append(i)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for x, group in groups.items():
        first: dict[int, int] = {}
        for i in group:
            if data[first.setdefault(seg[i], i)] != data[i]:
                raise ValueError("two different strings have one hash: run again with another seed")
        for i, r in zip(group, repeated([data[i] for i in group], [at[i] for i in group], window)):
            if r is not None:
                a, e = found.get((x, seg[i]), r)
                found[x, seg[i]] = (min(a, r[0]), max(e, r[1]))
    return [(*k, *r) for k, r in found.items()]


def repeated_ranges(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, largest: int = LARGEST, share: int = SHARE, seed: int = 0
) -> DataFrame:
    """id, tid, ranges: the byte ranges (s inclusive, e exclusive) to remove, for texts that have any."""
    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType
    anchors = keep(find_anchors(rows, byte_anchors(window, gram, seed)), "anchors")
    # What a join needs is kept just as it joins: Spark then knows its size, and either sends it to all tasks or deals both sides
    # anew and splits the rows of a very common string.
    groups = keep(anchors.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "groups")
    found = keep(anchors.join(groups, "h"), "found")
    member = F.struct("id", "tid", "s", "n", "at")
    segments = keep(found.groupBy("h", "seg").agg(F.count("*").alias("c"), F.min(member).alias("r"), F.max(member).alias("r2")), "segments")
    sizes = segments.groupBy("h").agg(F.sum(F.when(F.col("c") > 1, 2).otherwise(1)).alias("of"))
    big = keep(sizes.filter(F.col("of") > largest), "big")
    one, total = big.limit(1).count() > 0, segments.agg(F.sum(F.when(F.col("c") > 1, 2).otherwise(1))).first()[0] or 0
    shares = max(1, -(-total // share))

    texts = packed(rows)
    if rows.groupBy("id", "tid").count().filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["id", "tid"])
    fields = [("h", T.LongType()), ("seg", T.LongType()), ("c", T.LongType()), ("at", T.IntegerType()), ("data", T.BinaryType())]

    def cut(batches):
        for batch in batches:
            for z, xs in zip(batch.column(2), batch.column(3)):
                content, xs = unpack(z.as_py()), xs.as_py()
                column = lambda f, t: pa.array([x[f] for x in xs], t)  # noqa: B023,E731
                data = pa.array([content[x["s"] : x["s"] + x["n"] - 1 + window] for x in xs], pa.binary())
                at = pa.array([x["at"] - x["s"] for x in xs], pa.int32())
                yield pa.RecordBatch.from_arrays([column("h", pa.int64()), column("seg", pa.int64()), column("c", pa.int64()), at, data], names=[n for n, _ in fields])

    def cuts(members: DataFrame) -> DataFrame:
        """The bytes of h, seg, c and the member r."""
        wanted = per_text(members.select("r.id", "r.tid", F.struct("h", "seg", "c", "r.s", "r.n", "r.at").alias("x")), F.collect_list("x").alias("xs"))
        return with_texts(texts, wanted).mapInArrow(cut, T.StructType([T.StructField(n, t) for n, t in fields]))

    def solve(table: pa.Table) -> pa.Table:
        out = class_ranges(*[table.column(n).to_pylist() for n in ("h", "seg", "at", "data")], window)
        return pa.table({n: pa.array(x, t) for (n, t), x in zip((("h", pa.int64()), ("seg", pa.int64()), ("a", pa.int32()), ("e", pa.int32())), zip(*out) if out else [[]] * 4)})

    small = segments.join(big.select("h"), "h", "left_anti") if one else segments
    pairs = small.select("h", "seg", "c", F.explode(F.when(F.col("c") > 1, F.array("r", "r2")).otherwise(F.array("r"))).alias("r"))
    ranges = cuts(pairs).withColumn("share", F.pmod(F.xxhash64("h"), F.lit(shares))).groupBy("share").applyInArrow(solve, "h long, seg long, a int, e int")

    def split(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(4)[i].as_py()
                n = len(data) - window + 1
                own = batch.select([0, 1, 2]).take(pa.array(np.full(n, i, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.arange(n, dtype=np.int32)), pa.array([data[j : j + window] for j in range(n)], pa.binary())], names=["h", "seg", "c", "a", "w"])

    if one:
        windows = keep(cuts(segments.join(big.select("h"), "h", "left_semi").select("h", "seg", "c", "r")).mapInArrow(split, "h long, seg long, c long, a int, w binary"), "windows")
        again = keep(windows.groupBy("w").agg(F.sum("c").alias("n")).filter("n > 1").select("w"), "again")
        ranges = ranges.unionByName(windows.join(again, "w").select("h", "seg", "a", (F.col("a") + window).alias("e")))
    ranges = keep(ranges, "ranges")
    spans = found.join(ranges, ["h", "seg"]).select("id", "tid", F.struct((F.col("s") + F.col("a")).alias("s"), (F.col("s") + F.col("e")).alias("e")).alias("span"))
    return per_text(spans, F.collect_set("span").alias("ranges"))


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **sizes) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    A byte of the UTF-8 text goes if a string of `window` bytes that covers it also starts anywhere else, in this
    or another document; strings do not cross documents and are judged on the input. n_spans counts the maximal
    runs removed. Null texts are empty; ids may be null or repeat; of rows that repeat both id and text
    each counts. An empty table gives an empty result.
    """
    rows = text_rows(docs, id_col, text_col)
    found = repeated_ranges(docs, id_col, text_col, window, **sizes)

    def run(batches):
        for batch in batches:
            total, gone, spans, kept = [], [], [], []
            for z, ranges in zip(batch.column(2), batch.column(3)):
                content = unpack(z.as_py())
                cuts = merged((r["s"], r["e"]) for r in ranges.as_py() or [])
                parts, at = [], 0
                for s, e in cuts:
                    parts.append(content[at:s])
                    at = e
                stay = b"".join([*parts, content[at:]])
                total.append(len(content))
                gone.append(len(content) - len(stay))
                spans.append(len(cuts))
                kept.append(stay)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (total, gone, spans)], pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])
    return with_texts(packed(rows), found, "left").mapInArrow(run, schema)
