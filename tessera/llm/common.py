"""What the corpus operators share: scratch tables in the shared folder, and word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir

#: A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: later steps neither recompute it nor depend on
    the executors that made it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with _ before those that columns of docs have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def sampled(rows: DataFrame, by: Column, n: int, bound: int) -> DataFrame:
    """About `bound` of n rows, by hash, twice as many at most. A sort with a limit would send the driver so many of every task."""
    if n <= bound:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), by), F.lit(1 << 30)) < int(bound / n * (1 << 30))).limit(2 * bound)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")
