"""Alignment of two tokenizers over the same texts, and how often their tokens go together.

Both tokenizers cut the same bytes (a space and the text). Where a token of A and one of B end at the same byte the text
falls into groups, and the two tokens are linked. A merge of both sides' ends, with a pointer into each side, finds these places. Texts are cut into segments
before single spaces that follow other characters: no token of either side goes over these places, so a segment is encoded and merged
alike wherever it stands, and its result is remembered. Links are counted by pair over the corpus; counts and the largest count of each token, on either
side, are joined back to the links of every text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how byte-level tokenizers of this kind cut texts into words before merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Places where neither side's tokens go across, with a character left for B, which puts the space there itself.
SEGMENTS = re.compile(r"(?<=\S)(?= (?s:.))")
#: Characters of text that are aligned together; segments above LONG characters go to the slower reader of A's file,
#: whose time does not grow with the square of a word's length; links of the segments that a worker remembers.
SLICE, LONG, REMEMBERED = 500_000, 500, 1_200_000
SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Sides:
    """Both tokenizers as the bytes of their files, opened once in each worker."""

    a: bytes
    b: bytes

    @property
    def open(self) -> "_Open":
        return _opened(self.a, self.b)


def load(a_path: str = A_PATH, b_path: str = B_PATH) -> Sides:
    """Both files, read by the driver."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return Sides(a.read(), b.read())


@lru_cache(maxsize=2)
def _opened(a: bytes, b: bytes) -> "_Open":
    return _Open(a, b)


class _Open:
    """Both tokenizers, and the segments whose alignment is remembered."""

    def __init__(self, a: bytes, b: bytes):
        model, letters = json.loads(a)["model"], byte_letters()
        ranks = {}
        for token, i in model["vocab"].items():
            if all(c in letters for c in token):
                ranks[bytes(letters[c] for c in token)] = i
        for t in json.loads(a)["added_tokens"]:
            ranks.pop(t["content"].encode(), None)
        self.slow = tokenizers.Tokenizer.from_str(a.decode())
        self.slow.encode_special_tokens = True  # their strings in a text are ordinary text
        # Ids in the order of the merges make the ids ranks, which the faster reader needs.
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        in_order = [model["vocab"][m.replace(" ", "")] for m in merges]
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order == sorted(set(in_order)) else None
        self.a_bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.b_bytes = []
        for i in range(self.pieces.vocab_size()):
            piece = self.pieces.id_to_piece(i)
            if "\u2581" in piece.lstrip(SPACE) and not self.pieces.is_control(i):
                raise ValueError("a piece of this model goes over the end of a word")
            self.b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.pieces.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        # Numbers with what may follow them: within a side, after it.
        self.a_text = np.array([f"{i}{s}" for i in range(len(self.a_bytes)) for s in ",|"], dtype="S")
        self.b_text = np.array([f"{i}{s}" for i in range(len(self.b_bytes)) for s in ",;"], dtype="S")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.links, self.facts = array("q"), [array("q") for _ in range(5)]

    def encode(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both sides for strings that begin with a space; none where either side's bytes are others."""
        for segment, b in zip(segments, self.pieces.encode([x[1:] for x in segments], num_threads=1)):
            a = self.slow.encode(segment, add_special_tokens=False).ids if self.fast is None or len(segment) > LONG else self.fast.encode_ordinary(segment)
            raw = segment.encode()
            same = b"".join([self.b_bytes[i] for i in b]) == raw and b"".join([self.a_bytes[i] for i in a]) == raw
            yield (a, b) if same else ([], [])

    def learn(self, segments: list[str]) -> None:
        """Aligns segments and remembers their groups, their links and how many of everything they have."""
        coded = list(self.encode(segments))
        n_a, n_b = (np.fromiter((len(x[side]) for x in coded), dtype=np.int64, count=len(coded)) for side in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(x[side] for x in coded), dtype=np.int64) for side in (0, 1))
        # Segments follow each other on both sides, so the end of each is an end on both.
        at, bt = merge_ends(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        a_before, b_before = (np.concatenate([[0], x[:-1] + 1])[: len(x)] for x in (at, bt))
        a_last, b_last = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        a_last[at], b_last[bt] = 1, 1
        # Groups one after the other, each with its tokens of A and then those of B.
        shown = np.empty(len(a) + len(b), dtype=max(self.a_text.dtype, self.b_text.dtype))
        shown[np.arange(len(a)) + np.repeat(b_before, at + 1 - a_before)] = self.a_text[2 * a + a_last]
        shown[np.arange(len(b)) + np.repeat(at + 1, bt + 1 - b_before)] = self.b_text[2 * b + b_last]
        sizes = np.char.str_len(shown)
        line, ends = shown.tobytes().translate(None, b"\0").decode(), np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(n_a + n_b)].tolist()
        self.groups += [line[i : max(i, j - 1)] for i, j in zip([0, *ends], ends)]
        segment = np.searchsorted(np.cumsum(n_a), at, side="right")
        n_links = np.bincount(segment, minlength=len(segments))
        self.number.update(zip(segments, range(len(self.number), len(self.groups))))
        for fact, n in zip(self.facts, (len(self.links) + np.cumsum(n_links) - n_links, n_links, n_a, n_b, n_a == 0)):
            fact.frombytes(n.astype(np.int64).tobytes())
        self.links.frombytes((a[at] * len(self.b_bytes) + b[bt]).tobytes())


def merge_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in two ascending lists where the same numbers stand. A stable sort of two ascending runs merges them, with a pointer into
    each; the same ends of both sides are then neighbours, that of A first."""
    order = np.argsort(np.concatenate([a_ends, b_ends]), kind="stable")
    ends = np.concatenate([a_ends, b_ends])[order]
    both = np.flatnonzero(ends[1:] == ends[:-1])
    return order[both], order[both + 1] - len(a_ends)


def align_texts(texts: list[str], sides: Sides) -> pd.DataFrame:
    """n_a, n_b, n_groups, groups, links (pair numbers, ascending) and times (of each of them) of some texts."""
    opened = sides.open
    parts = [SEGMENTS.split(" " + x) if x else [] for x in texts]
    opened.learn(sorted(set(chain.from_iterable(parts)) - opened.number.keys()))
    at = np.fromiter(map(opened.number.__getitem__, chain.from_iterable(parts)), dtype=np.int64)
    first, n_links, n_a, n_b, wrong = (np.frombuffer(x, dtype=np.int64)[at] for x in opened.facts)
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in parts])
    total = lambda x: np.bincount(doc, weights=x, minlength=len(texts)).astype(np.int64)
    good = total(wrong) == 0
    ends = np.cumsum([len(x) for x in parts])
    groups = [";".join([opened.groups[i] for i in at[e - len(p) : e].tolist()]) if g else "" for p, e, g in zip(parts, ends, good)]
    # The links of all segments, one after the other.
    kept = np.where(good[doc], n_links, 0)
    place = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept) + np.repeat(first, kept)
    every = len(opened.a_bytes) * len(opened.b_bytes)
    keys, times = np.unique(np.repeat(doc, kept) * every + np.frombuffer(opened.links, dtype=np.int64)[place], return_counts=True)
    cut = np.searchsorted(keys // every, np.arange(1, len(texts)))
    found = pd.DataFrame(
        {"n_a": total(n_a) * good, "n_b": total(n_b) * good, "n_groups": total(n_links) * good, "groups": groups, "links": np.split(keys % every, cut), "times": np.split(times.astype(np.int32), cut)}
    )
    if len(opened.links) > REMEMBERED:
        opened.forget()
    return found


def align(docs: DataFrame, sides: Sides, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, row (a number of its own), n_a and n_b (tokens), n_groups, groups (`a1,a2|b1;a3|b2,b3`, ids in order),
    links (each linked pair of ids once, as a * (size of B) + b) and times (how often each is linked in the text).

    Texts that are null or empty, or that either tokenizer does not give back to the byte, have no tokens. Rows that
    repeat are rows of their own; other columns are ignored; an empty table gives an empty result. row is only steady in
    a table that has been written.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), whole(F.col(text_col)).alias("text"))

    def run(frames):
        for frame in frames:
            sizes = frame["text"].str.len().to_numpy(dtype=np.int64, na_value=0)
            part = (np.cumsum(sizes) - sizes) // SLICE
            for _, some in frame.groupby(part, sort=False):
                found = align_texts(some["text"].tolist(), sides)
                yield pd.concat([some[["id", "row"]].reset_index(drop=True), found], axis=1)

    whole_numbers = [T.StructField(n, T.LongType()) for n in ("row", "n_a", "n_b", "n_groups")]
    more = [T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
    return rows.mapInPandas(run, T.StructType([rows.schema["id"], *whole_numbers, *more]))


def _links(aligned: DataFrame) -> DataFrame:
    return aligned.select("row", F.explode(F.arrays_zip("links", "times")).alias("l")).select("row", F.col("l.links").alias("link"), F.col("l.times").alias("times"))


def pair_counts(aligned: DataFrame, sides: Sides) -> DataFrame:
    """link, a, b, count (links of the pair over all texts), a_most and b_most (the highest count that the pair's token of A, of B, has).

    Tasks add up what they hold before anything moves, and there are no more pairs than the two vocabularies make.
    """
    size = F.lit(len(sides.open.b_bytes))
    counts = _links(aligned).groupBy("link").agg(F.sum("times").cast("long").alias("count"))
    counts = counts.select("link", F.floor(F.col("link") / size).alias("a"), F.pmod("link", size).alias("b"), "count")
    for side in "ab":
        counts = counts.join(counts.groupBy(side).agg(F.max("count").alias(f"{side}_most")), side)
    return counts.select("link", "a", "b", "count", "a_most", "b_most")


def link_facts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of aligned without links and times, with n_links, n_best (links whose count is the highest of their token of B), a_best (of A) and count_sum
    (counts added up over the links). Pairs that nearly every text has are joined in parts."""
    per = _links(aligned).join(counts.select("link", "count", "a_most", "b_most"), "link")
    some = lambda most: F.sum(F.when(F.col("count") == F.col(most), F.col("times")).otherwise(0)).cast("long")
    sums = per.groupBy("row").agg(
        F.sum("times").cast("long").alias("n_links"), some("b_most").alias("n_best"), some("a_most").alias("a_best"), F.sum(F.col("times") * F.col("count")).cast("long").alias("count_sum")
    )
    joined = aligned.drop("links", "times").join(sums, "row", "left")
    return joined.fillna(0, ["n_links", "n_best", "a_best", "count_sum"])
