"""Near duplicates by SimHash and vantage-point trees.

A vantage-point tree splits fingerprints by their Hamming distance to a vantage point: within mu left, beyond
it right. By the triangle inequality a fingerprint can have a partner within r only on the sides that
its distance to the vantage point, give or take r, still reaches; it visits those shards and no others.

On 64 random bits nearly all distances are close to 32, so a single tree with r = 4 prunes almost
nothing. The trees therefore measure distance on a block of the bits, one tree a block: of two fingerprints
within max_bits, some block differs in at most max_bits // blocks bits, which is that tree's r. With
max_bits + 1 blocks r is 0 and nobody visits a second shard. With more blocks still, several of them agree, and there is a tree for
every choice of so many: more copies of each fingerprint, far fewer comparisons. The number of blocks grows with that of the
fingerprints. Each tree is fitted on a bounded sample and then holds every fingerprint; where r is 0 a shard is cut further by
a hash of the tree's bits. Pairs are confirmed on all 64 bits inside the shards.

similar_duplicates() has no contract and does without fingerprints: it joins sets of shingles by prefixes, which loses no pair.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, sampled, unused, whole
from .graph import components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Fingerprints that the trees are fitted on, at most; shards hold about SHARD_ROWS, TILE_ROWS at most.
SAMPLE, SHARD_ROWS, TILE_ROWS = 16384, 512, 8192
#: For similar texts without a contract: words of a shingle, Jaccard similarity, remainders of a tally; texts that frequent shingles
#: are looked for in, and these shingles, at most.
SIMILAR_SHINGLE, SIMILARITY, TALLY, MOST_SAMPLED, COMMON = 5, 0.8, 64, 1 << 18, 1 << 17
#: Comparisons that a copy of a fingerprint in a further tree must save to be worth its shuffle; copies at most.
COPY, MOST_TREES = 1000, 40
_STEP = 32768


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: the bits set in over half of its shingles' XXH64. No words: zero."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    k = min(shingle, len(words))
    line = b" ".join(words)
    ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
    begins = [0, *(x + 1 for x in ends[:-1])]
    n = len(words) - k + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _STEP):
        to = min(n, at + _STEP)
        some = np.fromiter(
            (xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(begins[at:to], ends[at + k - 1 : to + k - 1])), dtype="<u8", count=to - at
        )
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tid (a hash of the text), fp (the 64 bits as a signed number) of each row; a null text is empty."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["id", "tid", "fp"])

    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tid"), text.cast("binary").alias("content"))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("tid", T.LongType()), T.StructField("fp", T.LongType())]))


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Tree:
    """A vantage-point tree on the bits of mask. Children below zero are shards: -1 is shard 0."""

    mask: np.uint64
    vantage: list
    mu: list
    children: list

    def shards(self, fps: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and shards that the fingerprints reach within r."""
        if not self.vantage:
            return np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
        part, rows, shards = fps & self.mask, [], []
        todo = [(0, np.arange(len(fps)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                shards.append(np.full(len(at), -1 - node, dtype=np.int64))
                continue
            d = bits_apart(part[at], self.vantage[node]).astype(np.int64)
            todo.append((self.children[node][0], at[d - r <= self.mu[node]]))
            todo.append((self.children[node][1], at[d + r > self.mu[node]]))
        return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(shards or [np.zeros(0, np.int64)])


def grow(sample: np.ndarray, mask: int, shards: int) -> Tree:
    """A tree with about this many shards. Of a few candidates the vantage point that splits most evenly is taken."""
    tree, made = Tree(np.uint64(mask), [], [], []), 0
    least = max(1, len(sample) // max(1, shards))
    todo = [(None, 0, sample & np.uint64(mask))]
    while todo:
        parent, side, part = todo.pop()
        best = None
        if len(part) > least:
            for v in np.unique(part[:: max(1, len(part) // 4)])[:4]:
                d = bits_apart(part, v)
                # Half-distances move a boundary to either side of the median.
                for mu in {int(np.median(d)), int(np.median(d)) - 1}:
                    left = int((d <= mu).sum())
                    if 0 < left < len(part) and (best is None or abs(2 * left - len(part)) < best[0]):
                        best = (abs(2 * left - len(part)), v, mu, d <= mu)
        if best is None:
            made += 1
            node = -made
        else:
            node = len(tree.vantage)
            tree.vantage.append(best[1])
            tree.mu.append(best[2])
            tree.children.append([0, 0])
            todo += [(node, 0, part[best[3]]), (node, 1, part[~best[3]])]
        if parent is not None:
            tree.children[parent][side] = node
    return tree


def blocks_of(n: int) -> list[int]:
    """Masks of n blocks of the 64 bits, as even as can be."""
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def masks_of(blocks: int, agree: int) -> list[int]:
    """Masks of every choice of `agree` of the blocks."""
    return [sum(some) for some in combinations(blocks_of(blocks), agree)]


def blocks_for(n: int, max_bits: int) -> int:
    """Blocks for so many fingerprints: one more than max_bits at first, which costs a copy for each; more when comparisons
    inside the shards, about n * n / 2 ** (64 * agree / blocks) for each tree, outweigh the copies of more trees."""
    def cost(blocks: int) -> float:
        trees = math.comb(blocks, blocks - max_bits)
        return trees * n * (COPY + n / 2 ** (64 * (blocks - max_bits) / blocks))

    return min((b for b in range(max_bits + 1, max_bits + 4) if math.comb(b, max_bits) <= MOST_TREES), key=cost)


def local_links(homes: np.ndarray, visitors: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that pairs of a home and any other within max_bits connect: fewer than there are rows."""
    every = np.concatenate([homes, visitors])
    label = np.arange(len(every))
    for at in range(0, len(homes), 256):
        a, b = np.nonzero(bits_apart(homes[at : at + 256, None], every[None, at:]) <= max_bits)
        a, b = label[a + at], label[b + at]
        while len(a):
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(label, label[label]):
                label = label[label]
            a, b = label[a], label[b]
    linked = np.flatnonzero(label != np.arange(len(every)))
    return every[linked], every[label[linked]]


def local_pairs(fps: np.ndarray, max_bits: int, masks: list[int], t: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within max_bits whose first equal block is that of tree t."""
    left, right = [fps[:0]], [fps[:0]]
    for at in range(0, len(fps), 256):
        a, b = np.nonzero(bits_apart(fps[at : at + 256, None], fps[None, at:]) <= max_bits)
        a, b = fps[at:][a[a < b]], fps[at:][b[a < b]]
        good = (a ^ b) & np.uint64(masks[t]) == 0
        for m in masks[:t]:
            good &= (a ^ b) & np.uint64(m) != 0
        left.append(a[good])
        right.append(b[good])
    return np.concatenate(left), np.concatenate(right)


def link(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None, shard_rows: int = SHARD_ROWS, tile_rows: int = TILE_ROWS, every: bool = False) -> DataFrame:
    """a, b: links that connect exactly the fingerprints that chains of pairs within max_bits connect.
    every: all pairs within max_bits instead, each at least once; needs more blocks than max_bits.

    fps: fp, each once. A shard above tile_rows is cut into parts by hash and every two parts meet in a task of
    their own, so no task grows with a hot shard.
    """
    spark = fps.sparkSession
    n = fps.count()
    blocks = blocks or blocks_for(n, max_bits)
    r = max_bits // blocks
    if every and r:
        raise ValueError("every pair needs more blocks than max_bits")
    masks = masks_of(blocks, max(1, blocks - max_bits))
    sample = np.array([x.fp for x in sampled(fps.select("fp"), F.col("fp"), n, SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    shards = min(max(1, n // shard_rows), max(1, SAMPLE // 4))
    forest = [grow(sample, m, shards) for m in masks]
    # Parts of a shard by the tree's bits, where partners agree on all of them.
    cuts = 1 if r else max(1, n // shards // shard_rows)

    def place(batches):
        for batch in batches:
            mine = np.asarray(batch.column(0)).view(np.uint64)
            for t, tree in enumerate(forest):
                home = np.zeros(len(mine), dtype=np.int64)
                rows, where = tree.shards(mine, 0)
                home[rows] = where
                if r:
                    rows, where = tree.shards(mine, r)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), t, dtype=np.int32)),
                        pa.array(where * cuts + ((mine[rows] & tree.mask) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % cuts),
                        pa.array(mine[rows].view(np.int64)),
                        pa.array(home[rows] == where),
                    ],
                    names=["tree", "shard", "fp", "home"],
                )

    placed = fps.select("fp").mapInArrow(place, "tree int, shard long, fp long, home boolean")
    # Large shards only: at most n / tile_rows a tree.
    parts = placed.groupBy("tree", "shard").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("parts"))
    big = {(x.tree, x.shard): x.parts for x in parts.filter("parts > 1").collect()}
    placed = placed.withColumn("tile_a", F.lit(0)).withColumn("tile_b", F.lit(0))
    if big:
        cut = F.broadcast(spark.createDataFrame([(t, s, p) for (t, s), p in big.items()], "tree int, shard long, parts int"))
        placed = placed.drop("tile_a", "tile_b").join(cut, ["tree", "shard"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        placed = placed.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        placed = placed.withColumn("tile_a", F.least("part", "other")).withColumn("tile_b", F.greatest("part", "other"))

    def confirm(table: pa.Table) -> pa.Table:
        fp, home = np.asarray(table.column("fp")).view(np.uint64), np.asarray(table.column("home"))
        if every:
            a, b = local_pairs(fp, max_bits, masks, table.column("tree")[0].as_py())
        else:
            a, b = local_links(fp[home], fp[~home], max_bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return placed.groupBy("tree", "shard", "tile_a", "tile_b").applyInArrow(confirm, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    blocks: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    **sizes,
) -> DataFrame:
    """One row per row of docs: id, tid, fp, component_id (the smallest id reachable, itself included).

    Texts link when their fingerprints differ in at most max_bits bits; texts without words have fingerprint
    zero and link like others. Links are found between different fingerprints, so copies cost nothing. Null
    texts are empty; a null id gets the smallest id of its component, null if there is none. An empty
    table gives an empty result; other columns are ignored.
    """
    all_fps = keep(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    firsts = keep(all_fps.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    stars = components(link(firsts, max_bits, blocks, **sizes))
    linked = firsts.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = linked.join(smallest, "root").select("fp", "component_id")
    return all_fps.join(classes, "fp").select("id", "tid", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with all their columns. Of a component without
    ids all rows stay; so do all rows that share the smallest id."""
    return _firsts(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)


def _firsts(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    stay = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).select("id", "tid").distinct().alias("s")
    (tid,) = unused(docs, "tid")
    rows = docs.withColumn(tid, F.xxhash64(whole(F.col(text_col)))).alias("d")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("s.id")) & (F.col(f"d.{tid}") == F.col("s.tid"))
    return rows.join(stay, same, "left_semi").select(*docs.columns)


def shingles(text: bytes, shingle: int = SIMILAR_SHINGLE) -> set[bytes]:
    """The runs of so many words of a text, of all its words if it has fewer."""
    words = text.lower().split()
    k = min(shingle, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def prefix(hashes: np.ndarray, common: np.ndarray, weights: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first of a set's hashes in an order that all sets share, so many that two sets whose Jaccard similarity is at least
    `similarity` have one of them in common. common: hashes of frequent shingles, ascending, which come last, by their weights.
    Sets without shingles have hash zero."""
    n = len(hashes)
    if not n:
        return np.zeros(1, dtype=np.uint64)
    rank = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, weights[at], 0)
    return hashes[np.lexsort((hashes, rank))[: n - math.ceil(n * similarity - 1e-9) + 1]]


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    some = shingles(text, shingle)
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in some), dtype="<u8", count=len(some))


def common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and numbers of texts of the shingles that most of a sample's texts share, COMMON at most. They only set the
    order in which prefixes are taken: any order finds all pairs. The sample has an eighth of the texts, but SAMPLE at least and
    MOST_SAMPLED at most, about, by hash. texts: tid, content."""
    n = max(1, texts.count())
    share = min(max(SAMPLE, n // 8), MOST_SAMPLED) / n
    sample = texts.filter(F.pmod(F.xxhash64(F.lit("sample"), "tid"), F.lit(1 << 30)) < int(min(1, share) * (1 << 30)))

    def run(batches):
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(x.as_py(), shingle).view(np.int64))], names=["h"])

    counts = sample.select("content").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    found = sorted((int(np.array(x.h).view(np.uint64)), x.n) for x in counts.orderBy(F.desc("n"), "h").limit(COMMON).collect())
    return np.array([h for h, _ in found], dtype=np.uint64), np.array([n for _, n in found], dtype=np.int64)


def _sketches(docs: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """id, tid, n (size of the set of shingles), tally (how many of its hashes have each remainder by TALLY) and keys (its prefix)."""
    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tid"), text.cast("binary").alias("content"))
    common, weights = common_shingles(rows, shingle)

    def run(batches):
        for batch in batches:
            sizes, tallies, keys = [], [], []
            for x in batch.column(2):
                h = _hashes(x.as_py(), shingle)
                sizes.append(len(h))
                tallies.append(np.bincount((h % np.uint64(TALLY)).astype(np.int64), minlength=TALLY).astype("<i4").tobytes())
                keys.append(prefix(h, common, weights, similarity).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(tallies, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "tid", "n", "tally", "keys"]
            )

    more = [T.StructField("tid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("tally", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), *more]))


def _may_be_similar(similarity: float) -> F.Column:
    """Of a and b, which share a key: whether the sizes, and what is left of the sets from the key on, allow the similarity. True at the
    first key that similar sets share."""
    a, b = F.col("a.n"), F.col("b.n")
    left = F.least(a - F.col("a.pos"), b - F.col("b.pos"))
    return (F.least(a, b) >= F.greatest(a, b) * F.lit(similarity) - 1e-6) & (left >= (a + b) * F.lit(similarity / (1 + similarity)) - 1e-6)


def similar_duplicates(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, tid, component_id, as near_duplicates().

    Texts link when the Jaccard similarity of their sets of shingles is at least `similarity`. Similar sets share a key of their
    prefixes, rare shingles first. Of the texts with a key, each first meets only the one whose keys are shared most; texts
    of one component by then need no look, and only those of different components meet each other. Sizes, places of the keys and tallies
    rule out pairs that cannot be similar enough, and the shingles themselves confirm the others: no link is lost.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(whole(F.col(text_col))).alias("tid"))
    # Only what is left of each text is written: the sketches of all rows would stand beside it until the end.
    sketches = _sketches(docs, shingle, similarity, id_col, text_col)
    texts = keep(sketches.groupBy("tid").agg(F.min("id").alias("first"), F.min("n").alias("n"), F.min("tally").alias("tally"), F.min("keys").alias("keys")), "texts")
    postings = texts.select("tid", "n", F.posexplode("keys").alias("pos", "key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("texts")).filter("texts > 1")
    shared = keep(postings.join(sizes, "key"), "shared")
    weight = shared.groupBy("tid").agg(F.sum("texts").alias("weight"))
    shared = keep(shared.join(weight, "tid").select("key", "tid", "n", "pos", "weight"), "weighted")
    content = docs.select(F.xxhash64(whole(F.col(text_col))).alias("tid"), whole(F.col(text_col)).cast("binary").alias("content")).dropDuplicates(["tid"])

    def possible(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<i4").reshape(-1, TALLY) for c in (2, 3))
            # The sets differ in at least as many shingles as their tallies do.
            good = np.abs(x - y).sum(axis=1) <= (x.sum(axis=1) + y.sum(axis=1)) * (1 - similarity) / (1 + similarity) + 1e-6
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["hi", "lo"])

    def confirm(batches):
        for batch in batches:
            seen: dict = {}

            def parts(tid, text):
                if tid not in seen:
                    if len(seen) > 64:
                        seen.clear()
                    seen[tid] = shingles(text, shingle)
                return seen[tid]

            hi, lo, x, y = (c.to_pylist() for c in batch.columns)
            good = [jaccard(parts(h, s), parts(o, t)) >= similarity for h, o, s, t in zip(hi, lo, x, y)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda c: texts.select(F.col("tid").alias(c), F.col("tally").alias(f"tally_{c}"))
        some = pairs.join(side("hi"), "hi").join(side("lo"), "lo").select("hi", "lo", "tally_hi", "tally_lo")
        some = keep(some.mapInArrow(possible, "hi long, lo long"), "possible-pairs")
        wide = some.join(content.select(F.col("tid").alias("hi"), F.col("content").alias("x")), "hi").join(content.select(F.col("tid").alias("lo"), F.col("content").alias("y")), "lo")
        return keep(wide.select("hi", "lo", "x", "y").mapInArrow(confirm, "a long, b long"), "similar-pairs")

    pair = [F.greatest("a.tid", "b.tid").alias("hi"), F.least("a.tid", "b.tid").alias("lo")]
    best = shared.groupBy("key").agg(F.max(F.struct("weight", "tid", "n", "pos")).alias("best")).select("key", "best.tid", "best.n", "best.pos")
    met = shared.alias("a").join(best.alias("b"), "key").filter((F.col("a.tid") != F.col("b.tid")) & _may_be_similar(similarity))
    met = keep(met.select(*pair).distinct(), "first-pairs")
    links = confirmed(met)
    known = components(links).select(F.col("node").alias("tid"), "root")
    placed = keep(shared.join(known, "tid", "left").withColumn("root", F.coalesce("root", "tid")), "placed")
    open_keys = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("key")
    placed = keep(placed.join(open_keys, "key", "left_semi"), "open")
    rest = placed.alias("a").join(placed.alias("b"), "key").filter((F.col("a.root") < F.col("b.root")) & _may_be_similar(similarity))
    rest = keep(rest.select(*pair).distinct().join(met, ["hi", "lo"], "left_anti"), "other-pairs")
    stars = components(links.unionByName(confirmed(rest)))
    linked = texts.join(stars, F.col("tid") == F.col("node"), "left").select("tid", "first", F.coalesce("root", "tid").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(linked.join(smallest, "root").select("tid", "component_id"), "tid").select("id", "tid", "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """drop_near_duplicates() by the rule of similar_duplicates()."""
    return _firsts(docs, similar_duplicates(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)


def hex_fingerprint(fp) -> "F.Column":
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
