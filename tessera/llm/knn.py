"""Exact top-k by inner product: a Voronoi join of queries and data.

Pivots are fitted on a bounded sample; every vector belongs to its nearest pivot. For each group of queries a
few numbers are summed up: the pivot p, the largest distance rho of a query to it, and theta, the smallest k-th
best score that any of its queries has among the sample rows. A data vector x can be among the answers of the
group only if p.x + rho |x| >= theta, so it is sent there and nowhere else. Groups whose bound leaves out less than half of the
sample become one, to which every vector is sent once: where bounds say little (vectors without clusters), data are not copied for
them. Groups are solved in blocks of queries and chunks of data, whose best k are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import keep, sampled

#: Rows that pivots and first bounds are taken from, and the number of pivots.
SAMPLE, PIVOTS = 4096, 24
#: Rows of a chunk of data and queries of a block.
CHUNK, BLOCK = 16384, 2048
#: Groups that more of the sample reaches than this are solved together.
WIDE = 0.5


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, as double; null for vectors that are null or hold null or no finite number."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("double")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 5) -> np.ndarray:
    """Pivots by a few rounds of k-means from evenly spaced rows."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = sample[np.linspace(0, len(sample) - 1, min(pivots, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, centres)[0]
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = sample[near == c].mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)
    cell = apart.argmin(axis=1)
    # Not from the expanded form, which loses digits: bounds must hold.
    return cell, np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores above -inf, ties to the smaller id, in order."""
    if len(scores) > k:
        least = -np.partition(-scores, k - 1)[k - 1]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    at = at[scores[at] > -np.inf]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def knn_join(
    data: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, chunk: int = CHUNK, block: int = BLOCK
) -> DataFrame:
    """query_id, rank (from 1), id, score: the k best rows of data for each query, by inner product of whole_numbers().

    A query is not its own answer: rows with its id take no part. Fewer rows than k give all of them. Vectors
    without a whole_numbers() value or with a null id take no part; shorter vectors count as filled with zeros;
    a query row that is repeated as it is gets one answer list. Scores are exact while they stay below 2**53.
    """
    spark = data.sparkSession

    def prepared(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col)).alias("v"))
        return keep(rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()), name)

    rows = prepared(data, "vectors")
    asked = prepared(queries.dropDuplicates([id_col, vector_col]), "queries")
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(dim, asked.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0], 1)
    id_type = rows.schema["id"].dataType
    if not n:
        return spark.createDataFrame([], T.StructType([T.StructField("query_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType())]))
    some = sampled(rows, F.col("id"), n, SAMPLE).toArrow()
    if not some.num_rows:  # rows that repeat a few ids
        some = rows.limit(SAMPLE).toArrow()
    sample, sample_ids = _matrix(some.column("v").combine_chunks(), dim), some.column("id").to_numpy()
    centres = fit_pivots(sample, pivots)

    def group(batches):
        for batch in batches:
            x, ids = _matrix(batch.column(1), dim), batch.column(0).to_numpy(zero_copy_only=False)
            cell, apart = nearest(x, centres)
            scores = x @ sample.T
            scores[ids[:, None] == sample_ids[None, :]] = -np.inf
            # The k-th best of some of the rows is never above the k-th best of all.
            theta = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if scores.shape[1] >= k else np.full(len(x), -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(apart), pa.array(theta)], names=["id", "v", "cell", "apart", "theta"])

    id_name = id_type.simpleString()
    grouped = keep(asked.mapInArrow(group, f"id {id_name}, v array<double>, cell int, apart double, theta double"), "groups")
    # A row for each pivot at most.
    bounds = grouped.groupBy("cell").agg(F.max("apart").alias("rho"), F.min("theta").alias("theta"), F.count("*").alias("n")).collect()
    if not bounds:
        return spark.createDataFrame([], T.StructType([T.StructField("query_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType())]))
    cells = np.array([b.cell for b in bounds], dtype=np.int32)
    rho, theta = np.array([b.rho for b in bounds]), np.array([b.theta for b in bounds])
    blocks = {b.cell: -(-b.n // block) for b in bounds}

    def reach(x: np.ndarray) -> np.ndarray:
        """Which groups the vectors are sent to."""
        norm = np.sqrt((x * x).sum(axis=1))
        upper = x @ centres[cells].T + norm[:, None] * rho[None, :]
        return upper * (1 + 1e-9 * np.sign(upper)) + 1e-3 >= theta[None, :]

    wide = reach(sample).mean(axis=0) > WIDE
    if wide.sum() > 1:
        common = [int(c) for c in cells[wide]]
        grouped = grouped.withColumn("cell", F.when(F.col("cell").isin(common), -1).otherwise(F.col("cell")))
        blocks = {c: n for c, n in blocks.items() if c not in common} | {-1: -(-sum(b.n for b in bounds if b.cell in common) // block)}
        cells, rho, theta = np.append(cells[~wide], np.int32(-1)), np.append(rho[~wide], 0.0), np.append(theta[~wide], -np.inf)

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(reach(_matrix(batch.column(1), dim)).sum(axis=0).astype(np.int64))], names=["cell", "n"])

    sent = {r.cell: r.n for r in rows.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    chunks = np.array([max(1, -(-sent.get(int(c), 0) // chunk)) for c in cells])

    def send(batches):
        for batch in batches:
            at, where = np.nonzero(reach(_matrix(batch.column(1), dim)))
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells[where]), pa.array(chunks[where].astype(np.int32))], names=["id", "v", "cell", "chunks"])

    replicas = rows.mapInArrow(send, f"id {id_name}, v array<double>, cell int, chunks int")
    replicas = replicas.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    of = F.create_map(*[F.lit(int(x)) for pair in blocks.items() for x in pair])
    replicas = replicas.withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(of, F.col("cell")) - 1)))
    per = F.create_map(*[F.lit(int(x)) for pair in zip(cells, chunks) for x in pair])
    sides = grouped.withColumn("block", F.pmod(F.xxhash64("id"), F.element_at(of, F.col("cell"))).cast("int"))
    sides = sides.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.element_at(per, F.col("cell")) - 1)))
    key = ["cell", "block", "chunk"]

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "v": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("v").combine_chunks(), dim), _matrix(right.column("v").combine_chunks(), dim)
            qid, xid = left.column("id").to_numpy(), right.column("id").to_numpy()
            shown = left.column("v").combine_chunks()
            for at in range(0, len(q), 64):
                scores = q[at : at + 64] @ x.T
                for i, row in enumerate(scores, at):
                    row[xid == qid[i]] = -np.inf
                    top = best(row, xid, k)
                    out["query_id"] += [qid[i]] * len(top)
                    out["v"] += [shown[i].as_py()] * len(top)
                    out["id"] += list(xid[top])
                    out["score"] += [int(s) for s in row[top]]
        return pa.table(out, schema=pa.schema([("query_id", left.schema.field("id").type), ("v", pa.list_(pa.float64())), ("id", left.schema.field("id").type), ("score", pa.int64())]))

    found = (
        sides.select("id", "v", *key)
        .groupBy(*key)
        .cogroup(replicas.select("id", "v", *key).groupBy(*key))
        .applyInArrow(solve, f"query_id {id_name}, v array<double>, id {id_name}, score long")
    )
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "v").orderBy(F.col("score").desc(), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
