"""Selections that must cover what a comparing question asks for, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def best_headings(sections: DataFrame, question: str, scored: str, depth: str, n: int = 5) -> DataFrame:
    """The n best qualifying headings of each question: by score, hits in the title, depth [K6]."""
    s = F.col(scored)
    w = W.partitionBy(question).orderBy(s["score"].desc(), s["title_hits"].desc(), F.col(depth).desc(), "key")
    return sections.filter(s["qualifies"]).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def most_specific(headings: Column, gap: int = 3) -> Column:
    """Of headings in order, the first, replaced by descendants of it that score at most `gap` less [Q14].
    headings: array of struct(number, score)."""
    def step(best: Column, h: Column) -> Column:
        below = h["number"].startswith(F.concat(best["number"], F.lit(".")))
        return F.when(below & (best["score"] - h["score"] <= gap), h).otherwise(best)

    return F.aggregate(F.slice(headings, F.lit(2), F.greatest(F.size(headings) - 1, F.lit(0))), F.get(headings, F.lit(0)), step)


def cover_labels(selected: DataFrame, pool: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """selected with, for every wanted label that none of its rows has, the best row of the pool that has it; the
    last rows go if there are too many [R15].

    selected, pool: question, key, score, labels; wanted: question, label. All are bounded by question.
    """
    have = selected.select("question", F.explode("labels").alias("label")).distinct()
    missing = wanted.join(have, ["question", "label"], "left_anti")
    fresh = pool.join(selected.select("question", "key"), ["question", "key"], "left_anti")
    offers = fresh.select("question", "key", "score", "labels", F.explode("labels").alias("label")).join(missing, ["question", "label"])
    w = W.partitionBy("question", "label").orderBy(F.desc("score"), "key")
    added = offers.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("question", "key", "score", "labels").dropDuplicates(["question", "key"])
    every = selected.select("question", "key", "score", "labels", F.lit(0).alias("_added")).unionByName(added.withColumn("_added", F.lit(1)))
    order = W.partitionBy("question").orderBy(F.desc("_added"), F.desc("score"), "key")
    return every.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).select("question", "key", "score", "labels", (F.col("_added") == 1).alias("added"))


def other_source(selected: DataFrame, pool: DataFrame, source: list[str]) -> DataFrame:
    """Questions whose selected rows all come from one source, with the least noisy row of another one [R16].
    pool: question, key, noise and the columns of source."""
    s = F.struct(*source)
    single = selected.groupBy("question").agg(F.min(s).alias("a"), F.max(s).alias("b")).filter("a = b")
    offers = pool.withColumn("_s", s).join(single, "question").filter("_s != a").join(selected.select("question", "key"), ["question", "key"], "left_anti")
    w = W.partitionBy("question").orderBy("noise", "key")
    return offers.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("question", "key", "noise", *source)


def noise(row_codes: Column, asked: Column) -> Column:
    """Codes of a row that the question does not name [U4]."""
    return F.size(F.array_except(row_codes, asked))


def overlap(a: Column, b: Column) -> Column:
    """Common elements as a share of the smaller set [U3]."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / F.when(least > 0, least)).otherwise(F.lit(0.0))


def export_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header, quotes doubled inside quotes [S11]."""
    rows.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def session_json(turns: DataFrame, session: str, order: str, *columns: str) -> DataFrame:
    """session, json: the turns of each session in order [S12]."""
    listed = F.sort_array(F.collect_list(F.struct(order, *columns)))
    return turns.groupBy(session).agg(F.to_json(F.struct(F.col(session).alias("session"), listed.alias("turns"))).alias("json"))


def charts(series: DataFrame, day: str, value: str) -> DataFrame:
    """The series with each value as a share of the largest, 0 where all are 0 [X12]."""
    best = F.max(value).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))  # a row for each day
    return series.withColumn("height", F.when(best > 0, F.col(value) / F.when(best > 0, best)).otherwise(F.lit(0.0))).orderBy(day)
