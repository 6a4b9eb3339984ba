"""Near duplicates of vectors by cosine, through hierarchical navigable small-world graphs.

Vectors are dealt into shards by hash, and each shard gets a graph: layers of which each holds a hash-drawn part of the one below, every
vector linked to near ones that are not near each other. Every vector is then searched in every shard, from the top layer down, with a
beam of the best vectors seen so far. How wide the beam must be is measured in each shard: probes at the threshold's distance from some of its vectors are
searched and compared with a scan, and the beam is doubled until they find what the scan finds. A query whose beam is full of links is
searched again with a wider one. Links are confirmed in double precision. Equal vectors are one vertex.

A task searches a block of queries in one shard. It returns a count for each query and links that connect what it has linked, fewer
than there are vectors in it, so a group of copies of any size never becomes pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep
from .graph import components

THRESHOLD = 0.95
#: Bytes of a shard's vectors and of a block of queries at most; small tables are dealt into SHARDS shards of LEAST rows or more.
SHARD_BYTES, BLOCK_BYTES, SHARDS, LEAST = 32 << 20, 8 << 20, 8, 1024
#: Links of a vector in a layer, beam while graphs are built, first beam of searches, and vectors that are searched together.
DEGREE, BUILD_BEAM, BEAM, TOGETHER = 24, 48, 32, 256
#: Columns of a vector's links for bridges to rows that nothing else leads to.
BRIDGES = 4
#: Probes of a shard and the part of their links that a beam must find.
PROBES, RECALL = 128, 0.995
#: Above a shard's rows over this the beam is no faster than a scan.
SCAN = 6
#: What a task holds at once beside its shard and block, however dense the vectors: numbers gathered to compare, slots of the beams of queries that are
#: searched together, links. A shard's graph travels in pieces of so many bytes of vectors.
GATHERED, SLOTS, FOUND, PIECE_BYTES = 1 << 22, 1 << 19, 1 << 20, 1 << 20
_NONE = -np.inf


def top(sims: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n highest of each row, highest first."""
    if n < sims.shape[1]:
        at = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        return np.take_along_axis(at, np.argsort(-np.take_along_axis(sims, at, 1), axis=1, kind="stable"), 1)
    return np.argsort(-sims, axis=1, kind="stable")


def similar(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of each row of q with its own rows of x."""
    return np.matmul(x, q[:, :, None])[:, :, 0]


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (-1: none) and inner products of the best that a beam finds for each query in one layer, best first. start: rows to begin from, a row of
    them for each query. All queries take their steps together; a wider beam opens more vertices at a step."""
    n, many = len(links), max(2, beam // 16)
    ids, sims = np.full((len(q), beam), -1), np.full((len(q), beam), _NONE, dtype=np.float32)
    done, seen = np.ones((len(q), beam), dtype=bool), np.zeros((len(q), n), dtype=bool)
    start = np.sort(start, axis=1)[:, :beam]
    first = np.ones(start.shape, dtype=bool)
    first[:, 1:] = start[:, 1:] != start[:, :-1]
    width = start.shape[1]
    ids[:, :width], done[:, :width] = start, ~first
    sims[:, :width] = np.where(first, similar(q, x[start]), _NONE)
    np.put_along_axis(seen, start, True, 1)
    rows = np.arange(len(q))
    while len(rows):
        waiting = np.where(done[rows], _NONE, sims[rows])
        pick = top(waiting, min(many, beam))
        good = np.take_along_axis(waiting, pick, 1) > _NONE
        some = good.any(axis=1)
        rows, pick, good = rows[some], pick[some], good[some]
        if not len(rows):
            break
        done[rows[:, None], pick] = True
        new = np.where(good[:, :, None], links[np.where(good, ids[rows[:, None], pick], 0)], -1).reshape(len(rows), -1)
        new.sort(axis=1)
        fresh = new >= 0
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        fresh &= ~seen[rows[:, None], np.maximum(new, 0)]
        r, c = np.nonzero(fresh)
        seen[rows[r], new[r, c]] = True
        found = np.full(new.shape, _NONE, dtype=np.float32)
        at_once = max(1, GATHERED // x.shape[1])
        for i in range(0, len(r), at_once):
            a, b = r[i : i + at_once], c[i : i + at_once]
            found[a, b] = np.einsum("ij,ij->i", q[rows[a]], x[new[a, b]])
        every = np.concatenate([sims[rows], found], axis=1)
        best = top(every, beam)
        sims[rows] = np.take_along_axis(every, best, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], new], axis=1), best, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~fresh], axis=1), best, 1)
    best = top(sims, beam)
    sims, ids = np.take_along_axis(sims, best, 1), np.take_along_axis(ids, best, 1)
    return np.where(sims > _NONE, ids, -1), sims


def spread_out(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each row of candidates (-1: none; best first) those to link: at first candidates that no linked one is nearer to than the vertex itself, then the
    best of the others."""
    apart = x[np.maximum(ids, 0)]
    between = np.matmul(apart, apart.transpose(0, 2, 1))
    valid, chosen = ids >= 0, np.zeros(ids.shape, dtype=bool)
    for c in range(ids.shape[1]):
        nearest = np.where(chosen, between[:, c], _NONE).max(axis=1)
        chosen[:, c] = valid[:, c] & (nearest < sims[:, c]) & (chosen.sum(axis=1) < degree)
    order = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :degree]
    out = np.full((len(ids), degree), -1)
    out[:, : order.shape[1]] = np.take_along_axis(np.where(valid, ids, -1), order, 1)
    return out


class Graph:
    """A shard's graph. Rows come in the order of their layers, so each layer holds the first rows of the one below."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers  # layers: from the bottom, links of each row, -1: none

    @staticmethod
    def order(n: int, degree: int = DEGREE, seed: int = 7) -> tuple[np.ndarray, list[int]]:
        """The order of n rows by layer, and the rows of each layer from the bottom."""
        height = (-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(degree)).astype(int)
        sizes = [int((height >= h).sum()) for h in range(height.max(initial=0) + 1)]
        return np.argsort(-height, kind="stable"), [s for i, s in enumerate(sizes) if not i or s > degree]

    @classmethod
    def build(cls, x: np.ndarray, sizes: list[int], degree: int = DEGREE, beam: int = BUILD_BEAM) -> "Graph":
        """x: unit rows in the order of order(). Layers are made from the top; rows enter a layer in batches, none larger than what the layer holds."""
        graph = cls(x, [])
        for size in reversed(sizes):
            links = np.full((size, degree), -1, dtype=np.int32)
            at = 0
            while at < size:
                to = min(size, at + min(max(at, 64), TOGETHER))
                q = x[at:to]
                among = q @ q.T
                np.fill_diagonal(among, _NONE)
                near = top(among, min(degree, to - at))
                ids, sims = near + at, np.take_along_axis(among, near, 1)
                if at:
                    start = np.where((s := graph.enter(q)) < at, s, 0)
                    old, old_sims = beam_search(x, links[:at], q, start, beam)
                    ids, sims = np.concatenate([old, ids], axis=1), np.concatenate([old_sims, sims], axis=1)
                best = top(sims, min(beam, sims.shape[1]))
                ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
                links[at:to] = spread_out(x, np.where(sims > _NONE, ids, -1), sims, degree)
                graph.link_back(links, at, to)
                at = to
            graph.layers.insert(0, graph.bridged(links))
        return graph

    def bridged(self, links: np.ndarray) -> np.ndarray:
        """The links of a layer with columns for bridges: rows that its first row does not lead to get a link from the most similar row that it
        leads to and that has a column left."""
        n = len(links)
        links = np.concatenate([links, np.full((n, BRIDGES), -1, dtype=np.int32)], axis=1)
        reached, free = np.zeros(n, dtype=bool), np.full(n, BRIDGES)

        def reach(rows: np.ndarray) -> None:
            while len(rows):
                reached[rows] = True
                rows = np.unique(links[rows])
                rows = rows[rows >= 0]
                rows = rows[~reached[rows]]

        reach(np.zeros(min(n, 1), dtype=np.int64))
        for row in range(n):
            if not reached[row]:
                sims = np.where(reached & (free > 0), self.x[:n] @ self.x[row], _NONE)
                best = int(sims.argmax())
                links[best, -free[best]] = row
                free[best] -= 1
                reach(np.array([row]))
        return links

    def link_back(self, links: np.ndarray, at: int, to: int) -> None:
        """Links the targets of new rows back to them. A target with too many is given the best spread of all."""
        degree = links.shape[1]
        target, source = links[at:to].ravel(), np.repeat(np.arange(at, to), degree)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):
            _, first, place = np.unique(target, return_index=True, return_inverse=True)
            turn = np.arange(len(target)) - first[place]
            now = turn < degree
            which = np.unique(target[now])
            new = np.full((len(which), degree), -1)
            new[np.searchsorted(which, target[now]), turn[now]] = source[now]
            ids = np.concatenate([links[which], new], axis=1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids >= 0, similar(self.x[which], self.x[np.maximum(ids, 0)]), _NONE)
            best = top(sims, sims.shape[1])
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            width = max(1, int((ids >= 0).sum(axis=1).max()))
            links[which] = spread_out(self.x, ids[:, :width], sims[:, :width], degree)
            source, target = source[~now], target[~now]

    def enter(self, q: np.ndarray, layers: list[np.ndarray] | None = None, beam: int = 4) -> np.ndarray:
        """Rows to begin from in the layer below the given ones, a few for each query."""
        start = np.zeros((len(q), 1), dtype=np.int64)
        for links in reversed(self.layers if layers is None else layers):
            found = beam_search(self.x, links, q, start, beam)[0]
            start = np.where(found < 0, found[:, :1], found)
        return start

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return beam_search(self.x, self.layers[0], q, self.enter(q, self.layers[1:]), beam)

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Query numbers and rows of inner products of at least `least`."""
        parts = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), *self.parts_within(q, least, beam)]
        return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])

    def parts_within(self, q: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """within() in parts of FOUND links or so; those of a query are in one part. A beam that such rows fill to a half may not have seen the end of
        them: these queries go on with a wider one, and from a share of the shard on with a scan."""
        scan = beam * SCAN >= len(self.x)
        step = max(1, FOUND // len(self.x) if scan else min(TOGETHER, SLOTS // beam))
        again = []
        for at in range(0, len(q), step):
            some = q[at : at + step]
            if scan:
                a, b = np.nonzero(some @ self.x.T >= least)
                yield a + at, b
                continue
            ids, sims = self.search(some, beam)
            full = sims[:, beam // 2] >= least
            a, b = np.nonzero((sims >= least) & ~full[:, None])
            yield a + at, ids[a, b]
            again.append(np.flatnonzero(full) + at)
        again = np.concatenate([np.zeros(0, dtype=np.int64), *again])
        if len(again):
            for a, b in self.parts_within(q[again], least, 4 * beam):
                yield again[a], b

    def audit(self, threshold: float, probes: int = PROBES, recall: float = RECALL) -> tuple[int, float]:
        """A beam that finds so much of what a scan finds, and how much it finds. Probes are rows from all over the shard, and vectors just
        within the threshold of them in random directions, the hardest links there are."""
        x = self.x[np.unique(np.linspace(0, len(self.x) - 1, probes).astype(int))]
        side = np.random.default_rng(11).normal(size=x.shape).astype(np.float32)
        side -= (side * x).sum(axis=1)[:, None] * x
        side /= np.maximum(np.linalg.norm(side, axis=1), 1e-12)[:, None]
        cos = min(1.0, threshold + 0.1 * (1 - threshold))
        q = np.concatenate([x, (cos * x + math.sqrt(1 - cos * cos) * side).astype(np.float32)])
        truth = sum(int((one @ self.x.T >= threshold).sum()) for one in np.array_split(q, 8))
        beam = BEAM
        while True:
            got = sum(len(rows) for rows, _ in self.parts_within(q, threshold, beam)) / max(truth, 1)
            if got >= recall or beam * SCAN >= len(self.x):
                return beam, got
            beam *= 2


def local_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given ones connect, fewer than they have ends."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, a, b = np.arange(len(names)), ends[: len(a)], ends[len(a) :]
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label = label[label]
        a, b = label[a], label[b]
        differ = a != b
        a, b = a[differ], b[differ]
    linked = np.flatnonzero(label != np.arange(len(names)))
    return names[linked], names[label[linked]]


def usable(vector: Column) -> Column:
    """The vector in double precision; null if it is null, empty or zero or holds null or no finite number."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists(x, lambda c: c != 0)
    return F.when(fine, x)


def _rows(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # squares of very large or small numbers are none
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def graphs(classes: DataFrame, shards: int, threshold: float) -> DataFrame:
    """dim, shard, piece, cids, weights, vectors, layers (of the piece's rows), beam, recall (of the shard): a shard's graph in pieces, so that no row is
    large. classes: cid, v, weight."""

    def build(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        held = held.sort_by("cid")
        order, sizes = Graph.order(held.num_rows)
        x = unit(_rows(held.column("v"), dim))[order]
        graph = Graph.build(x.astype(np.float32), sizes)
        beam, recall = graph.audit(threshold)
        cids, weights = (held.column(name).to_numpy()[order] for name in ("cid", "weight"))
        step = max(1, PIECE_BYTES // (8 * dim))

        def piece(number: int) -> pa.RecordBatch:
            rows = slice(number * step, (number + 1) * step)
            layers = [[links[rows].tobytes() for links in graph.layers]]
            return pa.RecordBatch.from_arrays(
                [pa.array(values, field.type) for values, field in zip(([dim], [key[1].as_py()], [number], [cids[rows]], [weights[rows]], [x[rows].tobytes()], layers, [beam], [recall]), kinds)], schema=kinds
            )

        return pa.Table.from_batches(map(piece, range(-(-len(x) // step))), kinds)

    kinds = pa.schema(
        [
            ("dim", pa.int32()),
            ("shard", pa.int32()),
            ("piece", pa.int32()),
            ("cids", pa.list_(pa.int64())),
            ("weights", pa.list_(pa.int64())),
            ("vectors", pa.binary()),
            ("layers", pa.list_(pa.binary())),
            ("beam", pa.int32()),
            ("recall", pa.float64()),
        ]
    )
    dealt = classes.select("cid", "v", "weight", F.size("v").alias("dim"), F.pmod(F.xxhash64(F.lit("shard"), "cid"), F.lit(shards)).cast("int").alias("shard"))
    schema = "dim int, shard int, piece int, cids array<long>, weights array<long>, vectors binary, layers array<binary>, beam int, recall double"
    return dealt.groupBy("dim", "shard").applyInArrow(build, schema)


def assembled(pieces: pa.Table) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray, int]:
    """A shard's graph, its unit rows in double precision, their ids and weights, and the beam."""
    pieces = pieces.sort_by("piece")
    dim = pieces.column("dim")[0].as_py()
    flat = lambda column: np.concatenate([np.asarray(part.flatten()) for part in column.chunks])
    bytes_of = lambda parts, kind, width: np.concatenate([np.frombuffer(part.as_buffer(), dtype=kind).reshape(-1, width) for part in parts])
    x = bytes_of(pieces.column("vectors"), np.float64, dim)
    layers = [bytes_of([piece[n] for piece in pieces.column("layers")], np.int32, DEGREE + BRIDGES) for n in range(len(pieces.column("layers")[0]))]
    return Graph(x.astype(np.float32), layers), x, flat(pieces.column("cids")), flat(pieces.column("weights")), pieces.column("beam")[0].as_py()


def searched(classes: DataFrame, shards: DataFrame, n_shards: int, blocks: int, threshold: float) -> DataFrame:
    """a, b, n: for each vector a count n of rows of other vectors that it links with (b is null), and links a-b that connect them."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = classes.select("cid", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64(F.lit("block"), "cid"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.select("*", every(n_shards).alias("shard"))
    held = shards.select("*", every(blocks).alias("block"))
    key = ["dim", "shard", "block"]

    def run(key: tuple[pa.Scalar, ...], graph: pa.Table, queries: pa.Table) -> pa.Table:
        ends, counts, linked = ([], []), ([], []), 0
        if graph.num_rows and queries.num_rows:
            g, x, cids, weights, beam = assembled(graph)
            q, qid = unit(_rows(queries.column("v"), x.shape[1])), queries.column("cid").to_numpy()
            at_once = max(1, GATHERED // x.shape[1])
            for at in range(0, len(q), TOGETHER):
                for rows, found in g.parts_within(q[at : at + TOGETHER].astype(np.float32), threshold - 1e-4, beam):
                    rows = rows + at
                    good = qid[rows] != cids[found]
                    for i in range(0, len(rows), at_once):
                        part = slice(i, i + at_once)
                        good[part] &= np.einsum("ij,ij->i", q[rows[part]], x[found[part]]) >= threshold
                    rows, found = rows[good], found[good]
                    number = np.bincount(rows, weights=weights[found], minlength=0).astype(np.int64)
                    counts[0].append(qid[np.flatnonzero(number)])
                    counts[1].append(number[np.flatnonzero(number)])
                    a, b = local_links(qid[rows], cids[found])
                    ends[0].append(a)
                    ends[1].append(b)
                    linked += len(a)
                    if linked > FOUND:
                        # Fewer than the block and the shard have vectors.
                        for to, links in zip(ends, local_links(*map(np.concatenate, ends))):
                            to[:] = [links]
                        linked = len(ends[0][0])
        whole = lambda parts: np.concatenate([np.zeros(0, dtype=np.int64), *parts])
        a, b = local_links(whole(ends[0]), whole(ends[1]))
        n = whole(counts[1])
        nothing = lambda x: pa.nulls(len(x), pa.int64())
        return pa.table({"a": pa.chunked_array([a, whole(counts[0])], pa.int64()), "b": pa.chunked_array([pa.array(b), nothing(n)], pa.int64()), "n": pa.chunked_array([nothing(a), pa.array(n)], pa.int64())})

    return held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, least: int = LEAST
) -> DataFrame:
    """One row per row of vectors: id, n_links (other rows whose vector has a cosine of at least `threshold` with its own), component_id (smallest id
    reachable by links, itself included).

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, nor do vectors of different lengths.
    Rows that repeat are rows of their own. A row without an id is linked like others and gets the smallest id of its component, null if
    there is none. Other columns are ignored; an empty table gives an empty result. What searches miss is measured in every shard (graphs(), column recall).
    """
    rows = keep(vectors.select(F.col(id_col).alias("id"), usable(F.col(vector_col)).alias("v")), "vectors")
    classes = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    classes = keep(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n, dim = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    n_shards = max(1, -(-n * dim * 8 // shard_bytes), min(SHARDS, n // least))
    blocks = max(1, -(-n * dim * 8 // block_bytes))
    shards = keep(graphs(classes, n_shards, threshold), "graphs")
    found = keep(searched(classes, shards, n_shards, blocks, threshold), "links")
    stars = components(found.filter("b IS NOT NULL").select("a", "b"))
    counts = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    joined = classes.join(counts, "cid", "left").join(stars, F.col("cid") == F.col("node"), "left")
    joined = joined.select("v", "first", F.coalesce("root", "cid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = joined.join(smallest, "root").select("v", "n_links", "component_id", F.lit(True).alias("linked"))
    every = rows.join(facts, "v", "left")
    return every.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
