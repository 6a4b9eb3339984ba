"""Content-defined anchors: few positions that any two equal windows have in common.

Of the k-grams inside a window of `window` units (words or bytes) the one with the smallest hash is the window's
anchor. Equal windows have equal anchors at equal places, and neighbouring windows mostly share theirs, so a text
has about 2 / (window - k + 2) anchors per unit. An anchor's range is the windows that it anchors, its segment the
units that those windows cover: if two anchors have equal segments, all their windows are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole

BASE = 0x9E3779B97F4A7C15
_MASK = np.uint64((1 << 24) - 1)
#: Windows handled at once; a longer text is cut, which may split a range in two.
PIECE = 1 << 20

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i below n."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        base, back = np.full(size, BASE, dtype=np.uint64), np.full(size, pow(BASE, -1, 1 << 64), dtype=np.uint64)
        base[0] = back[0] = 1
        _powers, _inverse = np.cumprod(base), np.cumprod(back)
    return _powers[:n], _inverse[:n]


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k units in a row, from prefix sums of a polynomial; units: uint64."""
    up, down = _power_tables(len(units) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * up[: len(units)])])
    h = (sums[k:] - sums[:-k]) * down[: len(units) - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchor_ranges(units: np.ndarray, window: int, k: int):
    """Yields first window, number of windows, anchor position and gram hash, as arrays, for pieces of the units."""
    for at in range(0, max(0, len(units) - window + 1), PIECE):
        h = gram_hashes(units[at : at + PIECE + window - 1], k)
        w = window - k + 1
        # The smallest hash, of equal ones the first: the position stands in the low bits.
        keys = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
        n = len(keys) - w + 1
        padded = np.full(-(-len(keys) // w) * w, ~np.uint64(0))
        padded[: len(keys)] = keys
        blocks = padded.reshape(-1, w)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        pos = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & _MASK).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        count = np.diff(np.concatenate([first, [n]]))
        yield at + first, count, at + pos[first], h[pos[first]]


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tid (with id it names the text), content as UTF-8 bytes."""
    text = whole(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tid"), text.cast("binary").alias("content"))


def find_anchors(rows: DataFrame, anchors_of) -> DataFrame:
    """id, tid, h, seg, s, n, at for every anchor; anchors_of(content) yields arrays or lists of the last five."""
    kind = rows.schema["id"].dataType
    fields = [("id", kind), ("tid", T.LongType()), ("h", T.LongType()), ("seg", T.LongType()), ("s", T.IntegerType()), ("n", T.IntegerType()), ("at", T.IntegerType())]

    def run(batches):
        for batch in batches:
            where, cols, size = [], [[], [], [], [], []], 0

            def out(where, cols, batch=batch):
                base = batch.take(pa.array(np.repeat([i for i, _ in where], [c for _, c in where]).astype(np.int64)))
                arrays = [np.concatenate(c) for c in cols]
                return pa.RecordBatch.from_arrays(
                    [base.column(0), base.column(1), *[pa.array(a.view(np.int64)) for a in arrays[:2]], *[pa.array(a.astype(np.int32)) for a in arrays[2:]]],
                    names=[n for n, _ in fields],
                )

            small = batch.select([0, 1])
            for i, content in enumerate(batch.column(2)):
                for h, seg, s, n, at in anchors_of(content.as_py()):
                    where.append((i, len(h)))
                    for c, x in zip(cols, (h, seg, s, n, at)):
                        c.append(x)
                    size += len(h)
                if size > 100_000:
                    yield out(where, cols, small)
                    where, cols, size = [], [[], [], [], [], []], 0
            if size:
                yield out(where, cols, small)

    return rows.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def packed(rows: DataFrame, squeeze=lambda content: content) -> DataFrame:
    """id, tid, z: the contents compressed, to be shuffled."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([press.compress(squeeze(x.as_py())) for x in batch.column(2)], pa.binary())], names=["id", "tid", "z"]
            )

    kind = rows.schema["id"].dataType
    return rows.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("tid", T.LongType()), T.StructField("z", T.BinaryType())]))


def unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def same_text(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.tid") == F.col(f"{b}.tid"))


def per_text(rows: DataFrame, *lists: Column) -> DataFrame:
    """One row for each id and tid with the given aggregates."""
    return rows.groupBy("id", "tid").agg(*lists)


def with_texts(texts: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """found joined to packed() texts."""
    return texts.alias("t").join(found.alias("f"), same_text("t", "f"), how).select("t.*", *[F.col(f"f.{c}") for c in found.columns if c not in ("id", "tid")])
