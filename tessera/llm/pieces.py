"""Encoding texts as SentencePiece BPE pieces with seeded merge-dropout, and decoding them.

The agenda of a word holds its candidate merges by score, then from the left. Every candidate that comes up is skipped with the
dropout's chance, by a hash of seed, document, pass over the document, place of the word in it and number of the candidate in the
agenda: the same in every run, and another draw at every occurrence. What a word and its skips lead to is remembered. Spaces become part of the pieces, all other characters that have no piece become bytes,
so decoding gives back the text to the byte.
"""

from __future__ import annotations

import heapq
import math
import re
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import whole

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 42
#: Words that a worker remembers, of at most so many characters.
REMEMBERED, SHORT = 320_000, 40
SPACE = "▁"
#: The character SPACE itself, which must not become a space: never part of a piece.
LITERAL = "\0" + SPACE
WORDS = re.compile(r"\n| *[^ \n]+| +")
_M, _STRIDE = (1 << 64) - 1, 0x9E3779B97F4A7C15
_NEVER = np.iinfo(np.int32).max
_SLOTS = 1 << 20
_STRIDES = np.cumprod(np.full(SHORT, _STRIDE, dtype=np.uint64)) * np.uint64(pow(_STRIDE, -1, 1 << 64))


def _slot(pair):
    """Place of a pair in the hash table."""
    if isinstance(pair, int):
        return (pair * _STRIDE & _M) >> 44
    return ((pair.astype(np.uint64) * np.uint64(_STRIDE)) >> np.uint64(44)).astype(np.int64)


#: Texts that are encoded together.
BATCH_BYTES = 2_500_000


class Numbers(dict):
    """Numbers words in the order in which they come up; fresh: those that have come up since it was emptied."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Pieces:
    """The pieces of a model. It is sent to the workers as the bytes of its file and opened there."""

    def __init__(self, model: bytes, dropout: float = DROPOUT, variants: int | None = None, seed: int = SEED):
        """variants: if given, a word is split in so many ways at most, one for each document."""
        self.model, self.dropout, self.variants, self.seed = model, dropout, variants, seed

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("model", "dropout", "variants", "seed")}

    @cached_property
    def _open(self):
        sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        ids, scores, table, of_byte, marks = {}, {}, [], [0] * 256, {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                of_byte[int(piece[3:-1], 16)] = i
                table.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                table.append(b"")
            else:
                ids[piece], scores[piece] = i, -sp.get_score(i)
                marks[piece] = xxhash.xxh64_intdigest(piece, self.seed)
                table.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) or "\n" in p or "\0" in p for p in ids):
            raise ValueError("a piece of this model goes over the end of a word")
        return ids, scores, table, of_byte, marks

    @cached_property
    def _seen(self) -> list[dict]:
        return [{} for _ in range(self.variants)]

    @cached_property
    def _roots(self) -> dict:
        """What is remembered of words: number of each word; where its ids without skips are, and how many candidates come up
        without skips, -1 for words that are not merged together with others."""
        return {"number": Numbers(), "ids": np.zeros(0, np.int32), "begin": np.zeros(0, np.int64), "size": np.zeros(0, np.int64), "left": np.zeros(0, np.int64)}

    @cached_property
    def _gaps(self) -> np.ndarray:
        """Bounds of the hash, ascending: as many candidates are taken before the next skip as bounds lie above it. A short
        word has fewer candidates than there are bounds."""
        return np.array([min(int((1 - self.dropout) ** g * 2**64), _M) for g in range(4 * SHORT, 0, -1)], dtype=np.uint64)

    def gaps(self, h: np.ndarray) -> np.ndarray:
        if not self.dropout:
            return np.full(len(h), 4 * SHORT)
        return len(self._gaps) - np.searchsorted(self._gaps, h, side="right")

    def walk(self, word: str, skips: tuple[int, ...]) -> tuple[list[int], int]:
        """The ids of a word whose agenda skips the candidates of these numbers, and how many candidates came up."""
        ids, scores, _, of_byte, _ = self._open
        parts = [SPACE if c == " " else LITERAL if c == SPACE else c for c in word]
        never, n, left = math.inf, 0, set(skips)
        rank = [scores.get(a + b, never) for a, b in zip(parts, parts[1:])]
        while rank:
            best = min(rank)
            if best == never:
                break
            i = rank.index(best)
            n += 1
            if n - 1 in left:
                rank[i] = never
                continue
            parts[i] = piece = parts[i] + parts[i + 1]
            del parts[i + 1], rank[i]
            if i < len(rank):
                rank[i] = scores.get(piece + parts[i + 1], never)
            if i:
                rank[i - 1] = scores.get(parts[i - 1] + piece, never)
        out = []
        for s in parts:
            if s in ids:
                out.append(ids[s])
            else:
                out += [of_byte[x] for x in (SPACE if s == LITERAL else s).encode("utf-8", "surrogateescape")]
        return out, n

    def split(self, word: str, key: int) -> list[int]:
        """The ids of a word (spaces first), by agenda; key: of the dropout's hash.

        A candidate is skipped if (hash of its piece + its place) * key, modulo 2**64, is below the rate.
        """
        ids, _, _, of_byte, _ = self._open
        symbols = [SPACE if c == " " else LITERAL if c == SPACE else c for c in word]
        out = []
        for s in self._short(symbols, key | 1) if len(symbols) <= SHORT else self._long(symbols, key | 1):
            if s in ids:
                out.append(ids[s])
            else:
                out += [of_byte[x] for x in (SPACE if s == LITERAL else s).encode("utf-8", "surrogateescape")]
        return out

    def _short(self, parts: list[str], key: int) -> list[str]:
        """The agenda as a list: the score of each pair in order, infinite if it is no candidate."""
        scores, marks, below = self._open[1], self._open[4], int(self.dropout * 2**64)
        never = math.inf
        rank = [scores.get(a + b, never) for a, b in zip(parts, parts[1:])]
        place = list(range(len(parts)))
        while rank:
            best = min(rank)
            if best == never:
                break
            i = rank.index(best)
            piece = parts[i] + parts[i + 1]
            if ((marks[piece] + place[i] * _STRIDE) * key & _M) < below:
                rank[i] = never
                continue
            parts[i] = piece
            del parts[i + 1], place[i + 1], rank[i]
            if i < len(rank):
                rank[i] = scores.get(piece + parts[i + 1], never)
            if i:
                rank[i - 1] = scores.get(parts[i - 1] + piece, never)
        return parts

    def _long(self, symbols: list[str], key: int) -> list[str]:
        """The agenda as a heap, for words that are too long to look through for every merge."""
        scores, marks, below = self._open[1], self._open[4], int(self.dropout * 2**64)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(scores[a + b], i, i + 1, a + b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, piece = heapq.heappop(agenda)
            if after[a] != b or not symbols[a] or symbols[a] + symbols[b] != piece:
                continue  # a part of it has been merged with another
            if ((marks[piece] + a * _STRIDE) * key & _M) < below:
                continue
            symbols[a], symbols[b] = piece, ""
            after[a] = c = after[b]
            if c >= 0:
                before[c] = a
                longer = piece + symbols[c]
                if longer in scores:
                    heapq.heappush(agenda, (scores[longer], a, c, longer))
            if (c := before[a]) >= 0:
                longer = symbols[c] + piece
                if longer in scores:
                    heapq.heappush(agenda, (scores[longer], c, a, longer))
        return [s for s in symbols if s]

    @cached_property
    def _pairs(self):
        """For split_many: symbol of each character, sorted pairs of symbols, and what they make."""
        ids, scores, _, _, marks = self._open
        symbol = np.full(0x110000, -1, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                symbol[ord(" " if piece == SPACE else piece)] = i
        symbol[ord(SPACE)] = -1
        rows = sorted(
            (ids[a] << 32 | ids[b], scores[piece], i, marks[piece])
            for piece, i in ids.items()
            for a, b in ((piece[:n], piece[n:]) for n in range(1, len(piece)))
            if a in ids and b in ids
        )
        rank = np.unique([r[1] for r in rows], return_inverse=True)[1] if rows else []
        mark = np.zeros(len(self._open[2]), dtype=np.uint64)
        # An open hash table of the pairs; depth: the most steps that one is away from its place.
        keys, ranks, made = np.full(_SLOTS, -1, dtype=np.int64), np.full(_SLOTS, _NEVER, dtype=np.int32), np.zeros(_SLOTS, dtype=np.int32)
        depth = 0
        for (pair, _, piece, m), r in zip(rows, rank):
            at, d = _slot(pair), 0
            while keys[at] >= 0:
                at, d = (at + 1) % _SLOTS, d + 1
            keys[at], ranks[at], made[at], mark[piece], depth = pair, r, piece, m, max(depth, d)
        return symbol, keys, ranks, made, mark, depth

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or never) and piece of each pair of symbols."""
        _, keys, ranks, made, _, depth = self._pairs
        pair = a.astype(np.int64) << 32 | b
        at = _slot(pair)
        found = keys[at]
        away = np.flatnonzero((found != pair) & (found >= 0) & (pair >= 0))
        for _ in range(depth):
            if not len(away):
                break
            at.flat[away] = (at.flat[away] + 1) % _SLOTS
            now = keys[at.flat[away]]
            away = away[(now != pair.flat[away]) & (now >= 0)]
        good = keys[at] == pair
        return np.where(good, ranks[at], _NEVER), made[at]

    def key(self, word: str, variant: int) -> int:
        """The dropout's key of a word: odd, from its characters, the seed and the variant."""
        h = 0
        for c in reversed(word):
            h = (h * _STRIDE + ord(c) + 1) & _M
        h ^= xxhash.xxh64_intdigest(str(variant), self.seed)
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & _M
        return h ^ h >> 32 | 1

    def _alike(self, words: list[str]):
        """Yields, for words of about one length: their numbers, how many symbols they have, whether all characters are pieces, and
        their symbols and character codes (+1) as rows, shorter ones filled up with a symbol that no pair has. Longer words are left out."""
        symbol = self._pairs[0]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(sizes, kind="stable")
        sizes = sizes[order]
        at = 0
        while at < len(order):
            longest = int(sizes[at]) + (int(sizes[at]) > 12) * (-int(sizes[at]) % 4)
            if longest > SHORT:
                break
            some = order[at : min(np.searchsorted(sizes, longest, side="right"), at + 8_000)]
            n = sizes[at : at + len(some)]
            at += len(some)
            codes = np.frombuffer("".join([words[i] for i in some.tolist()]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            inside = np.arange(longest)[None, :] < n[:, None]
            start = np.full(inside.shape, -2, dtype=np.int64)
            start[inside] = symbol[codes]
            # Characters without a piece become bytes, one word at a time.
            yield some, inside, (start != -1).all(axis=1), start, codes

    def split_many(self, words: list[str], variant: int) -> list[list[int]]:
        """split() of each word (of any length) with its key(); words of about one length are merged together, a step of all agendas at a time."""
        own = np.uint64(xxhash.xxh64_intdigest(str(variant), self.seed))
        out: list[list[int] | None] = [None] * len(words)
        for some, inside, plain, start, codes in self._alike(words):
            key = np.zeros(inside.shape, dtype=np.uint64)
            key[inside] = codes + np.uint64(1)
            h = (key * _STRIDES[: inside.shape[1]]).sum(axis=1, dtype=np.uint64) ^ own
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32)) | np.uint64(1)
            flat, ends = self._merge(start[plain], key=h[plain] if self.dropout else None)
            flat, ends = flat.tolist(), ends.tolist()
            for i, x, y in zip(some[plain].tolist(), [0, *ends], ends):
                out[i] = flat[x:y]
        return [self.split(w, self.key(w, variant)) if ids is None else ids for w, ids in zip(words, out)]

    def _merge(self, sym: np.ndarray, key: np.ndarray | None = None, draws: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The final ids of all rows, one after the other, and where each row's end.

        Every round takes the best candidate of each row's agenda. It is skipped by its piece, place and the row's key, or if draws, the
        row's hash, says so: gaps() of it are taken, one is skipped, and the hash goes on. A merged symbol stands at the place of its left part.
        """
        n, mark = sym.shape[1], self._pairs[4]
        below = np.uint64(min(int(self.dropout * 2**64), _M))
        rank, new = np.full(sym.shape, _NEVER, dtype=np.int32), np.zeros(sym.shape, dtype=np.int32)
        rank[:, :-1], new[:, :-1] = self._look(sym[:, :-1], sym[:, 1:])
        after = np.broadcast_to(np.arange(1, n + 1, dtype=np.int32), sym.shape).copy()
        before = np.broadcast_to(np.arange(-1, n - 1, dtype=np.int32), sym.shape).copy()
        rows, step = np.arange(len(sym)), 0
        if draws is not None:
            draws, due = draws.copy(), self.gaps(draws)
        # The arrays flat: a place is row * n + column.
        s, r, w, f, b = (x.reshape(-1) for x in (sym, rank, new, after, before))
        while len(rows):
            i = rank[rows].argmin(axis=1)
            at = rows * n + i
            live = r[at] != _NEVER
            if not live.all():
                rows, i, at = rows[live], i[live], at[live]
            m, piece = rows, w[at]
            if key is not None:
                skip = (mark[piece] + i.astype(np.uint64) * np.uint64(_STRIDE)) * key[rows] < below
            elif draws is not None:
                skip = due[rows] == step
                again = rows[skip]
                draws[again] = _mixed(draws[again] + np.uint64(_STRIDE))
                due[again] = step + 1 + self.gaps(draws[again])
            if key is not None or draws is not None:
                r[at[skip]] = _NEVER
                m, i, at, piece = m[~skip], i[~skip], at[~skip], piece[~skip]
            step += 1
            base = at - i
            right = base + f[at]
            k = f[right]
            s[at], s[right], r[at], r[right], f[at] = piece, -3, _NEVER, _NEVER, k
            ok = np.flatnonzero(k < n)
            x, z = at[ok], base[ok] + k[ok]
            b[z] = i[ok]
            p = b[at]
            ok2 = np.flatnonzero(p >= 0)
            y = base[ok2] + p[ok2]
            # Both new neighbours of each merged symbol in one look.
            places = np.concatenate([x, y])
            r[places], w[places] = self._look(np.concatenate([piece[ok], s[y]]), np.concatenate([s[z], piece[ok2]]))
        alive = sym >= 0
        return sym[alive].astype(np.int32), np.cumsum(alive.sum(axis=1))

    def _learn(self) -> None:
        """Remembers the words that came up."""
        found = self._roots
        words, found["number"].fresh = found["number"].fresh, []
        ids, begin, size, left = [found["ids"]], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), -1)
        at = len(found["ids"])
        for some, inside, plain, start, _ in self._alike(words):
            flat, ends = Pieces._merge(self, start[plain])
            some = some[plain]
            begin[some], size[some] = at + np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
            # A piece is one symbol less for each merge.
            left[some] = inside[plain].sum(axis=1) - size[some]
            ids.append(flat)
            at += len(flat)
        for i in np.flatnonzero(left < 0).tolist():
            if len(words[i]) <= SHORT:
                flat, n = self.walk(words[i], ())
                if not n:  # no candidate, nothing to skip
                    begin[i], size[i], left[i] = at, len(flat), 0
                    ids.append(np.array(flat, dtype=np.int32))
                    at += len(flat)
        for k, x in (("begin", begin), ("size", size), ("left", left)):
            found[k] = np.concatenate([found[k], x])
        found["ids"] = np.concatenate(ids)

    def drawn(self, word: str, h: int) -> list[int]:
        """The ids of one word by the draws of its hash, as _merge() makes them for many."""
        if len(word) > SHORT:
            return self.split(word, h)
        skips, h = (), np.array([h], dtype=np.uint64)
        while True:
            ids, n = self.walk(word, skips)
            at = (skips[-1] + 1 if skips else 0) + int(self.gaps(h)[0])
            if at >= n:
                return ids
            skips, h = (*skips, at), _mixed(h + np.uint64(_STRIDE))

    def _encode(self, contents: list[bytes], names: list[str], turns: list[int]) -> list[np.ndarray]:
        split = [WORDS.findall(" " + c.decode("utf-8", "surrogateescape")) if c else [] for c in contents]
        every = list(chain.from_iterable(split))
        found = self._roots
        words = np.fromiter(map(found["number"].__getitem__, every), dtype=np.int64, count=len(every))
        self._learn()
        sizes = np.array([len(x) for x in split], dtype=np.int64)
        own = np.array([xxhash.xxh64_intdigest(f"{t}/{n}", self.seed) for n, t in zip(names, turns)], dtype=np.uint64)
        place = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        h = _mixed(np.repeat(own, sizes) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_STRIDE))
        begin, size, left = found["begin"][words], found["size"][words], found["left"][words]
        ids, at = [found["ids"]], len(found["ids"])
        # Only words of which some candidate is skipped need an agenda of their own.
        apart = np.flatnonzero(self.gaps(h) < left)
        for some, _, _, start, _ in self._alike([every[i] for i in apart.tolist()]):
            some = apart[some]
            flat, ends = self._merge(start, draws=h[some])
            begin[some], size[some] = at + np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
            ids.append(flat)
            at += len(flat)
        for i in np.flatnonzero(left < 0).tolist():
            flat = self.drawn(every[i], int(h[i]))
            begin[i], size[i] = at, len(flat)
            ids.append(np.array(flat, dtype=np.int32))
            at += len(flat)
        ids, done = np.concatenate(ids), np.cumsum(size)
        out = ids[np.repeat(begin - (done - size), size) + np.arange(int(size.sum()))]
        if len(found["size"]) > REMEMBERED:
            del self.__dict__["_roots"]
        return np.split(out, np.concatenate([[0], done])[np.cumsum(sizes)[:-1]]) if len(contents) else []

    def encode_many(self, contents: list[bytes], names: list[str], turns: list[int] | None = None) -> list[np.ndarray]:
        """The ids of UTF-8 texts; names: of the documents, turns: the passes over them, for their draws."""
        if self.variants is None:
            return self._encode(contents, names, turns or [0] * len(names))
        seen, split, missing = self._seen, [], [set() for _ in range(self.variants)]
        for content, name in zip(contents, names):
            words = WORDS.findall(" " + content.decode("utf-8", "surrogateescape")) if content else []
            v = xxhash.xxh64_intdigest(name, self.seed) % self.variants
            split.append((v, words))
            missing[v].update(words)
        for v, words in enumerate(missing):
            new = list(words - seen[v].keys())
            seen[v].update(zip(new, self.split_many(new, v)))
        out = [np.array(list(chain.from_iterable(map(seen[v].__getitem__, words))), dtype=np.int32) for v, words in split]
        for s in seen:
            if len(s) > REMEMBERED:
                s.clear()
        return out

    def encode(self, content: bytes, name: str = "", turn: int = 0) -> list[int]:
        return self.encode_many([content], [name], [turn])[0].tolist()

    def decode(self, ids) -> bytes:
        table = self._open[2]
        return b"".join([table[i] for i in ids])[1:]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _turns(rows: DataFrame) -> DataFrame:
    """rows (id, content, name) with turn: which of the rows alike in id and text it is, in the same order as before; and z, the content compressed,
    in the place of content if rows repeat. Texts move twice then, to their like and back to their places."""
    keyed = rows.withColumn("key", F.xxhash64("content"))
    if not keyed.groupBy("id", "key").count().filter("count > 1").limit(1).count():
        return rows.withColumn("turn", F.lit(0))
    schema = T.StructType([keyed.schema["id"], T.StructField("z", T.BinaryType()), keyed.schema["name"], keyed.schema["key"]])
    placed = keyed.mapInArrow(_press, schema).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33).cast("int"))
    parts = rows.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0] + 1
    counted = placed.withColumn("turn", F.row_number().over(W.partitionBy("id", "key").orderBy("at")) - 1)
    return counted.repartitionById(parts, F.least("part", F.lit(parts - 1))).sortWithinPartitions("at").select("id", "z", "name", "turn")


def _press(batches):
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = pa.array([press.compress(x.as_py()) for x in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), z, *batch.columns[2:]], names=["id", "z", "name", "key"])


def load(path: str = MODEL, **options) -> Pieces:
    """The model of a file that the driver can read."""
    with open(path, "rb") as f:
        return Pieces(f.read(), **options)


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """id, content (the text as UTF-8), ids of each row. Null texts are empty and have no ids; the result depends
    on id, text, how often both come before, and options only; other columns are ignored. round_trip: adds decoded, as decode() does, in the
    same pass, which spares a second Python worker beside each task's."""
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).cast("binary").alias("content"), F.col(id_col).cast("string").alias("name"))
    schema, rows = rows.schema, _turns(rows)
    pressed = "z" in rows.columns

    def run(batches):
        unpress = zstandard.ZstdDecompressor().decompress if pressed else bytes
        for batch in batches:
            at, texts, size = 0, [], 0
            for i in range(batch.num_rows):
                texts.append(unpress(batch.column(1)[i].as_py()))
                size += len(texts[-1])
                if size > BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(at, len(texts))
                    ids = pieces.encode_many(texts, [x or "" for x in part.column(2).to_pylist()], part.column(3).to_pylist())
                    ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                    columns = {"id": part.column(0), "content": pa.array(texts, pa.binary()) if pressed else part.column(1), "ids": pa.ListArray.from_arrays(ends, np.concatenate(ids))}
                    if round_trip:
                        columns["decoded"] = pa.array([pieces.decode(x.tolist()) for x in ids], pa.binary())
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                    at, texts, size = i + 1, [], 0

    more = [T.StructField("decoded", T.BinaryType())] if round_trip else []
    return rows.mapInArrow(run, T.StructType([schema["id"], T.StructField("content", T.BinaryType()), T.StructField("ids", T.ArrayType(T.IntegerType())), *more]))


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """Adds decoded, the text of ids, to the columns of encode()."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = pa.array([pieces.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in part.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
