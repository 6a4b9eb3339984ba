"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source gets a target of words by its weight, at most `most` times its size. Its documents stand on a
line in a keyed random order, and the mix walks that line, a second time if need be, until the target is
reached; the last document counts in part. Each source also has a weight schedule over training time 0..1;
its integral, scaled to the target, is the source's cumulative demand for words, and inverting it gives the
moment at which a document is due. Documents are then range-sorted by that position.

Running sums over a large source are taken in two steps, over ranges of the random order and inside each
range, so that no task needs a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keep, unused, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Weight at equally spaced moments of training, linear in between; sources take these in turn.
SCHEDULES = ((1.5, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0))
RANGE_ROWS = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, rank, weight, source_size, docs, target and all_words (of all sources) for each source. sizes: source, size.

    Sources are ordered by code point, null last. The targets fill up like water: in order of cap by weight,
    a source is capped if the level that the rest would reach is not below its cap. One row per source
    passes the unpartitioned windows here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(pick, (F.col("rank") % len(weights) + 1).cast("int")))
    cap = F.lit(float(most)) * F.col("source_size")
    by_level = W.orderBy(cap / F.col("weight"), "rank")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    filled = ranked.withColumn("cap", cap).withColumn("left", left).withColumn("rest", F.sum("weight").over(rest))
    filled = filled.withColumn("free", F.col("cap") * F.col("rest") > F.col("left") * F.col("weight"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "rank", "left", "rest"))).over(everything)
    level = filled.withColumn("first", first)
    target = F.when(F.col("free"), F.col("first.left") * F.col("weight") / F.col("first.rest")).otherwise(F.col("cap"))
    total = F.sum("source_size").over(everything)
    return level.select("source", "rank", "weight", "source_size", "docs", target.alias("target"), total.alias("all_words"))


def due(share_done: Column, schedule: Column) -> Column:
    """The moment in 0..1 at which the integral of a schedule reaches this share of the whole.

    schedule: array of weights at equally spaced moments, not negative, not all zero.
    """
    n = F.size(schedule) - 1
    area = F.transform(F.sequence(F.lit(1), n), lambda i: (F.get(schedule, i - 1) + F.get(schedule, i)) / 2)
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    ahead = F.transform(F.sequence(F.lit(0), n - 1), lambda i: total(F.slice(area, F.lit(1), i)))
    goal = share_done * total(area)
    piece = F.size(F.filter(ahead, lambda x: x <= goal)) - 1
    at = {"i": piece, "before": F.get(ahead, piece)}
    a, slope = F.get(schedule, at["i"]), F.get(schedule, at["i"] + 1) - F.get(schedule, at["i"])
    y = F.greatest(goal - at["before"], F.lit(0.0))
    root = a + F.sqrt(F.greatest(a * a + 2 * slope * y, F.lit(0.0)))
    inside = F.when(root > 0, 2 * y / root).otherwise(F.lit(0.0))
    return F.least((at["i"] + F.least(inside, F.lit(1.0))) / n, F.lit(1.0))


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    schedules=SCHEDULES,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, passes, position.

    passes: array of struct(pass, words, position), one for each time the mix reaches the document; position
    is the first of them on the scale 0 .. share * all words, null if the mix takes nothing. The order of a
    source depends only on seed, id and text, so reruns agree; rows alike in both have equal results in some
    order. Null ids and null sources are values like others; null texts have no words. An empty table gives
    an empty result.
    """
    rows = keep(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
            F.xxhash64(F.col(text_col)).alias("h2"),
        ),
        "sizes",
    )
    targets = keep(source_targets(rows, weights, share, most), "targets")
    ranges = F.ceil(F.col("docs") / F.lit(range_rows))
    # h as a number in 0..1, in the same order.
    u = (F.shiftright("h", 11).cast("double") + F.lit(float(2**52))) / F.lit(float(2**53))
    placed = (
        rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("range", F.floor(u * ranges))
    )
    ahead = W.partitionBy("rank").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("rank", "range").agg(F.sum("size").alias("in_range")).withColumn("offset", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)))
    )
    inside = W.partitionBy("rank", "range").orderBy("h", "id", "size", "h2").rowsBetween(W.unboundedPreceding, 0)
    lined = placed.join(offsets.select("rank", "range", "offset"), ["rank", "range"]).withColumn(
        "start", F.col("offset") + F.sum("size").over(inside) - F.col("size")
    )
    goal = F.floor("target")
    schedule = F.element_at(
        F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in schedules]), (F.col("rank") % len(schedules) + 1).cast("int")
    )

    def reached(k: Column) -> Column:
        begin = F.col("start") + k * F.col("source_size")
        words = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), goal - begin))
        moment = due(begin / F.col("target"), F.col("schedule"))
        return F.struct(k.cast("int").alias("pass"), words.alias("words"), (moment * F.col("budget")).alias("position"))

    turns = F.sequence(F.lit(0), F.lit(max(0, int(-(-most // 1)) - 1)))
    out = lined.withColumn("budget", F.col("all_words") * F.lit(float(share))).withColumn("schedule", schedule)
    out = out.withColumn(
        "passes",
        F.when(F.col("target") > 0, F.filter(F.transform(turns, reached), lambda p: p["words"] > 0)).otherwise(
            F.expr("array()").cast("array<struct<pass:int,words:bigint,position:double>>")
        ),
    )
    return out.select(
        "id",
        "source",
        "size",
        "source_size",
        "target",
        F.aggregate("passes", F.lit(0).cast("long"), lambda s, p: s + p["words"]).alias("taken"),
        "passes",
        F.get("passes", F.lit(0))["position"].alias("position"),
        "h2",
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """The documents range-sorted by their first position; those that the mix leaves out come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "source", "id", "h2", "taken")


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: the columns of docs, one row for each time the mix takes a document, in training order.
    A document that is taken in part keeps its first words."""
    mixed = keep(mix(docs, id_col=id_col, text_col=text_col, **options), "mixed")
    of, h, size, turn, key, copy = unused(docs, "of", "h2", "size", "turn", "key", "copy")
    turns = mixed.filter("taken > 0").select(F.col("id").alias(of), F.col("h2").alias(h), F.col("size").alias(size), F.explode("passes").alias(turn))
    base = docs.withColumn(key, F.xxhash64(F.col(text_col)))
    if mixed.groupBy("id", "h2").count().filter("count > 1").limit(1).count():
        # Rows alike in id and text become one row, with the turns of all of them.
        alike = W.partitionBy(id_col, key).orderBy(*[F.col(c) for c in docs.columns if c not in (id_col, text_col)] or [F.lit(1)])
        base = base.withColumn(copy, F.row_number().over(alike)).filter(F.col(copy) == 1)
    joined = base.join(turns, F.col(id_col).eqNullSafe(F.col(of)) & (F.col(key) == F.col(h)))
    part = F.expr(f"regexp_extract(`{text_col}`, concat('^(?>[\\\\x20\\\\x09-\\\\x0D]*+[^\\\\x20\\\\x09-\\\\x0D]++){{0,', `{turn}`.words, '}}+'), 0)")
    text = F.when(F.col(f"{turn}.words") < F.col(size), part).otherwise(F.col(text_col))
    return joined.withColumn(text_col, text).orderBy(f"{turn}.position", id_col, key).select(*docs.columns)
