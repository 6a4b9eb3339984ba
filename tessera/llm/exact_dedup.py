"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Rows are combined three times: inside each task (Spark's partial aggregation), for each salted digest
group, and then across the salts of a digest. Every one of these steps has the full content in its
grouping key, so rows are only ever combined when their texts are identical; the digest merely decides
where they meet. A group that holds a third of all rows sends at most `salts` rows per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keep, unused, whole

SALTS = 16


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("content"))
    return rows.withColumn("digest", digest(F.col("content")))


def contents(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each different content: digest, content, keep_id, group_size."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    local = salted.groupBy("digest", "salt", "content").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    # By digest alone: one exchange serves this step and the count of contents per digest.
    return (
        local.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    )


def dedup_decisions(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: id, digest, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The row with the largest id stays (null ids are
    smaller than any); of rows that share that id and text exactly one stays. An empty table gives an empty
    result; other columns are ignored, whatever their names. A digest that stands for several contents is
    resolved by joining on the content as well.
    """
    rows = _rows(docs, id_col, text_col, digest)
    each = contents(rows, salts)
    winners = keep(
        each.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("contents")),
        "winners",
    )
    if winners.filter("contents > 1").limit(1).count():
        joined = rows.join(each, ["digest", "content"], "left")
    else:
        joined = rows.join(winners.drop("contents"), "digest", "left")
    sha = F.col("digest") if digest is sha256 else F.sha2("content", 256)
    found = keep(joined.select("id", "digest", "keep_id", "group_size", sha.alias("text_sha256")), "dedup")
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    dropped = found.filter(~stays).withColumn("kept", F.lit(False))
    # Rows that repeat both id and text: one of them stays.
    candidates = found.filter(stays).groupBy("id", "digest", "keep_id", "group_size", "text_sha256").agg(F.count("*").alias("n"))
    one = candidates.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("kept", F.col("i") == 1)
    return dropped.unionByName(one.drop("n", "i"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names. See dedup_decisions for which these are; of rows that
    share id and text that with the smallest other columns stays."""
    stay_id, stay_digest, digest, copy = unused(docs, "stay_id", "stay_digest", "digest", "copy")
    stay = dedup_decisions(docs, id_col, text_col, salts).filter("kept").select(F.col("id").alias(stay_id), F.col("digest").alias(stay_digest))
    rows = docs.withColumn(digest, sha256(whole(F.col(text_col))))
    joined = rows.join(stay, F.col(id_col).eqNullSafe(F.col(stay_id)) & (F.col(digest) == F.col(stay_digest)), "left_semi")
    repeated = W.partitionBy(id_col, digest).orderBy(*[F.col(c) for c in docs.columns if c not in (id_col, text_col)] or [F.lit(1)])
    return joined.withColumn(copy, F.row_number().over(repeated)).filter(F.col(copy) == 1).select(*docs.columns)
