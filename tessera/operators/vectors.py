"""Cosine search and hybrid ranking of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import small


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if one of them is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / F.when(size > 0, size)).otherwise(F.lit(0.0))


def nearest(vectors: DataFrame, questions: DataFrame, k: int, key: str, tenant: str, vector: str) -> DataFrame:
    """question, key, cosine, rank: the k nearest vectors of the question's tenant [V1, S8].

    questions: question, tenant, asked (a vector), a bounded table. Each task keeps the k best of its part
    of a tenant before anything is shuffled by question.
    """
    k = max(1, min(30, k))
    pairs = vectors.select(F.col(key).alias("key"), F.col(tenant).alias("tenant"), F.col(vector).alias("v")).join(small(questions), "tenant")
    scored = pairs.select("question", "key", cosine(F.col("v"), F.col("asked")).alias("cosine")).filter("cosine is not null")
    parts = scored.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64)))
    order = [F.desc("cosine"), F.col("key")]
    first = parts.withColumn("r", F.row_number().over(W.partitionBy("question", "part").orderBy(*order))).filter(F.col("r") <= k)
    return first.withColumn("rank", F.row_number().over(W.partitionBy("question").orderBy(*order))).filter(F.col("rank") <= k).drop("part", "r")


def merge_hits(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """question, key, source (VECTOR, KEYWORD or BOTH), vector (1 or 0), keyword (score or 0) [J9]."""
    v = vector_hits.groupBy("question", "key").agg(F.lit(1.0).alias("vector"))
    k = keyword_hits.groupBy("question", "key").agg(F.max("score").alias("keyword"))
    both = v.join(k, ["question", "key"], "full_outer")
    source = F.when(F.col("vector").isNull(), "KEYWORD").when(F.col("keyword").isNull(), "VECTOR").otherwise("BOTH")
    return both.select("question", "key", source.alias("source"), F.coalesce("vector", F.lit(0.0)).alias("vector"), F.coalesce("keyword", F.lit(0.0)).alias("keyword"))


def lexical(candidates: DataFrame, terms: str = "terms", hay: str = "hay") -> DataFrame:
    """candidates with lexical: the sum of ln((n + 1) / (df + 1)) of the terms that hay holds, as a share of the best [R11].

    n and df count the candidates of the question.
    """
    held = candidates.select("question", "key", F.explode(terms).alias("term"), hay).filter(F.col(hay).contains(F.col("term"))).select("question", "key", "term")
    n = candidates.groupBy("question").agg(F.count("*").alias("n"))
    df = held.groupBy("question", "term").agg(F.count("*").alias("df"))
    weight = held.join(df, ["question", "term"]).join(n, "question").withColumn("w", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)))
    sums = weight.groupBy("question", "key").agg(F.sum("w").alias("w"))
    best = sums.groupBy("question").agg(F.max("w").alias("best"))
    score = F.coalesce(F.when(F.col("best") > 0, F.col("w") / F.col("best")), F.lit(0.0))
    return candidates.join(sums, ["question", "key"], "left").join(best, "question", "left").withColumn("lexical", score).drop("w", "best")


def fused(rerank: Column | None = None, hybrid: bool = True) -> Column:
    """Final score of vector, keyword and lexical shares, and a reranker's where there is one [R11]."""
    v, k, x = F.col("vector"), F.col("keyword"), F.col("lexical")
    plain = 0.35 * v + 0.35 * k + 0.30 * x if hybrid else 0.7 * x + 0.3 * v
    if rerank is None:
        return plain
    ranked = 0.35 * v + 0.35 * k + 0.30 * rerank if hybrid else 0.6 * rerank + 0.3 * x + 0.1 * v
    return F.when(rerank.isNotNull(), ranked).otherwise(plain)


def cheap_score(signals_in_hay: Column, kind: Column, has_cells: Column) -> Column:
    """First score of a candidate, before the costly ones; signals_in_hay: points for codes, labels, n-grams found [R7]."""
    both = F.when((F.col("vector") > 0) & (F.col("keyword") > 0), 3.0).otherwise(0.0)
    row = F.when(kind == "normalized_table_row", 2.0 + F.when(has_cells, 1.0).otherwise(0.0)).when(kind == "table_summary", 0.5).otherwise(0.0)
    return 8.0 * F.col("vector") + 8.0 * F.col("keyword") + both + row + signals_in_hay


def scoring_budget(rows: DataFrame, size: int, sure: str, score: str, tail: int = 40) -> DataFrame:
    """Per question at most `size` rows: sure ones first, all but `tail` places, then by score [R8, K5]."""
    by_score = [F.desc(score), F.col("key")]
    nth_sure = F.row_number().over(W.partitionBy("question", sure).orderBy(*by_score))
    first = F.col(sure) & (nth_sure <= size - tail)
    ordered = rows.withColumn("_first", first)
    w = W.partitionBy("question").orderBy(F.desc("_first"), *by_score)
    return ordered.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size).drop("_first", "_n")


def rerank_is_worth_it(rows: DataFrame, score: str) -> DataFrame:
    """question, candidates, gap between the two best, worth: whether a reranker may change much [R9, W13]."""
    w = W.partitionBy("question").orderBy(F.desc(score), "key")
    top = rows.withColumn("nth", F.row_number().over(w))
    at = lambda n: F.max(F.when(F.col("nth") == n, F.col(score)))
    out = top.groupBy("question").agg(F.count("*").alias("candidates"), (at(1) - F.coalesce(at(2), F.lit(0.0))).alias("gap"))
    return out.withColumn("worth", (F.col("candidates") > 5) & (F.col("gap") < 0.35))


def select_within(rows: DataFrame, score: str, length: str, most: int, chars: int) -> DataFrame:
    """The best rows of each question, at most `most`, while their lengths fit; the first always does [R13, W6]."""
    w = W.partitionBy("question").orderBy(F.desc(score), "key")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    ranked = rows.withColumn("rank", F.row_number().over(w)).withColumn("chars", F.sum(length).over(run))
    return ranked.filter((F.col("rank") <= most) & ((F.col("chars") <= chars) | (F.col("rank") == 1)))


def presentation_order(rows: DataFrame, document: str, section_order: str, order: str, summaries_first: Column | None = None) -> DataFrame:
    """Document order, summaries first if given [K8, K9, R17]."""
    first = [] if summaries_first is None else [summaries_first.desc()]
    return rows.orderBy("question", *first, document, F.coalesce(section_order, F.lit(0)), F.coalesce(order, F.lit(0)))


def first_by(rows: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """The first row of each key in the order given [W4, W5]."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
