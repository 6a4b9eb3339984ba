"""Neighbours, section families and runs: how passages around an anchor are found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def neighbours(chunks: DataFrame, anchors: DataFrame, document: str, order: str, back: int = 1, ahead: int = 2) -> DataFrame:
    """anchor, and the chunks up to `back` before and `ahead` after it in its document [J6].

    anchors: anchor, document, order. Each anchor asks for its few places, so the join is on equal keys.
    """
    places = F.sequence(F.greatest(F.col("order") - back, F.lit(0)), F.col("order") + ahead)
    wanted = anchors.select("anchor", F.col("document").alias(document), F.explode(places).alias(order))
    return wanted.join(chunks, [document, order])


def linked(chunks: DataFrame, document: str, order: str, key: str) -> DataFrame:
    """chunks with previous and next key in their document [J14]."""
    w = W.partitionBy(document).orderBy(order)
    return chunks.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def section_number(title: Column) -> Column:
    """The number that a title begins with; null without one [B8]."""
    return F.nullif(F.regexp_extract(title, r"^(\d+(?:\.\d+)*)[.\s]", 1), F.lit(""))


def parent_number(number: Column) -> Column:
    """1.2 of 1.2.3; null at the top."""
    return F.when(number.contains("."), F.regexp_replace(number, r"\.[^.]+$", ""))


def section_level(number: Column) -> Column:
    return F.size(F.split(number, r"\."))


def ancestors(number: Column) -> Column:
    """A section's number and those above it."""
    parts = F.split(number, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def descendants(sections: DataFrame, roots: DataFrame, document: str, number: str) -> DataFrame:
    """root and every section whose number is it or begins with it and a dot [J7].

    Every section names its own ancestors, so the join is on equal numbers and not on prefixes.
    """
    family = sections.withColumn("root", F.explode(ancestors(F.col(number))))
    return family.join(roots.select(F.col("document").alias(document), F.col("number").alias("root")), [document, "root"])


def with_parents(sections: DataFrame, document: str, number: str, title: str) -> DataFrame:
    """sections with the title of the parent section, if it exists [J8]."""
    parents = sections.select(F.col(document), F.col(number).alias("_up"), F.col(title).alias("parent_title"))
    return sections.withColumn("_up", parent_number(F.col(number))).join(parents, [document, "_up"], "left").drop("_up")


def section_heads(chunks: DataFrame, anchors: DataFrame, document: str, section: str, order: str, n: int = 12) -> DataFrame:
    """The first n chunks of the sections that anchors are in, each section once [W7]."""
    wanted = anchors.select(F.col("document").alias(document), F.col("section").alias(section)).distinct()
    w = W.partitionBy(document, section).orderBy(order)
    return chunks.join(wanted, [document, section]).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def children_of(chunks: DataFrame, ids: str, key: str) -> DataFrame:
    """key and child of a comma-separated list [J17]."""
    return chunks.select(key, F.explode(F.split(ids, r"\s*,\s*")).alias("child")).filter("child != ''")


def runs(rows: DataFrame, partition: str, order: str, flag: Column, least: int = 3) -> DataFrame:
    """run, first, last, size of each run of at least `least` rows in a row that meet a condition [W8]."""
    w = W.partitionBy(partition).orderBy(order)
    marked = rows.withColumn("_on", flag).withColumn("run", F.sum(F.when(flag, 0).otherwise(1)).over(w))
    sizes = marked.filter("_on").groupBy(partition, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("size"))
    return sizes.filter(F.col("size") >= least)


def equal_runs(rows: DataFrame, partition: str | list[str], order: str, value: str, least: int = 3) -> DataFrame:
    """rows with in_run: part of a run of at least `least` equal neighbours [W9]."""
    keys = [partition] if isinstance(partition, str) else partition
    w = W.partitionBy(*keys).orderBy(order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    marked = rows.withColumn("_change", change).withColumn("_run", F.sum("_change").over(w))
    size = F.count("*").over(W.partitionBy(*keys, "_run"))
    return marked.withColumn("in_run", size >= least).drop("_change", "_run")


def numbered_copies(rows: DataFrame, keys: list[str], order: str, name: str, mark: str = "_") -> DataFrame:
    """rows with unique: the name, from the second on with its number [W10, T7]."""
    nth = F.row_number().over(W.partitionBy(*keys, name).orderBy(order))
    return rows.withColumn("unique", F.when(nth == 1, F.col(name)).otherwise(F.concat_ws(mark, F.col(name), nth.cast("string"))))


def carried(rows: DataFrame, partition: str, order: str, value: str) -> DataFrame:
    """rows with carried: the last value that was not null [W11]."""
    w = W.partitionBy(partition).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(w))


def best_overlap(cells: DataFrame, slots: DataFrame, table: str) -> DataFrame:
    """cell, slot: the slot of the same table that shares most of its width with a cell, else the one with the
    nearest centre; the first of equals [J13].

    cells: table, cell, x, x_end; slots: table, slot, s, s_end.
    """
    # A table's slots, a bounded number, stay beside its cells: no row for each pair of them.
    held = slots.groupBy(table).agg(F.collect_list(F.struct("slot", "s", "s_end")).alias("_slots"))

    def rank(s: Column) -> Column:
        shared = F.greatest(F.lit(0.0), F.least(F.col("x_end"), s["s_end"]) - F.greatest(F.col("x"), s["s"]))
        apart = F.abs((F.col("x") + F.col("x_end") - s["s"] - s["s_end"]) / 2)
        return F.struct(shared.alias("shared"), (-apart).alias("near"), (-s["slot"]).alias("first"), s["slot"].alias("slot"))

    best = cells.join(held, table).select(table, "cell", F.array_max(F.transform("_slots", rank)).alias("_best"))
    return best.groupBy(table, "cell").agg(F.max("_best").alias("_best")).select(table, "cell", "_best.slot", "_best.shared")


def upper_medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median: sorted[n / 2] of the values that are not null [A14].

    Equal values are counted before they are shuffled, and the counts summed up in order, so no group is gathered.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys)
    running = counts.withColumn("_until", F.sum("_n").over(w.orderBy(value))).withColumn("_of", F.sum("_n").over(w))
    return running.filter(F.col("_until") > F.floor(F.col("_of") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))
