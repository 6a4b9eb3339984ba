"""Scans of relational tables, and rewrites that stand for deletes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine alone it may be unset, and becomes a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to the shared folder and read again, for steps that use them several times: nothing is worked out twice, and a lost executor costs
    no more than its tasks."""
    path = f"{shared_dir(rows.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def written_by(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """written(), in buckets by keys: groups, windows and joins by them (and more columns) need no shuffle. As many buckets as shuffles have partitions."""
    spark, made = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/tessera/{made}"
    rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(f"tessera_{made}")
    found = spark.table(f"tessera_{made}")
    # Only the name goes; the files are the shared folder's.
    spark.sql(f"DROP TABLE tessera_{made}")
    return found


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def live(rows: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    """Rows that are not deleted; tables without the column have only such rows [S7]."""
    return rows.filter(F.col(deleted).isNull()) if deleted in rows.columns else rows


def soft_delete(rows: DataFrame, where: Column, at: Column, deleted: str = "deleted_at") -> DataFrame:
    """Sets the time of deletion of live rows that meet a condition [S15]."""
    before = F.col(deleted) if deleted in rows.columns else F.lit(None).cast("timestamp")
    return rows.withColumn(deleted, F.when(before.isNull() & where, at).otherwise(before))


def without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys are not among those of gone: a hard delete or purge [S14, S16]."""
    return rows.join(gone.select(*on).distinct(), on, "left_anti")


def only(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys are among those given [J5]."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a few small files dealt over all threads before costly expressions; others as they are."""
    threads = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(threads) if rows.rdd.getNumPartitions() < threads else rows


def small(rows: DataFrame, most: int = 100_000, chars: int = 1 << 26) -> DataFrame:
    """rows marked for broadcast if they are no more than `most`, of no more than `chars` characters together; else as they are, to be joined by key.
    They are looked at once; no more than most + 1 of them are."""
    seen = rows.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("chars")).first()
    return F.broadcast(rows) if seen.n <= most and seen.chars <= chars else rows
