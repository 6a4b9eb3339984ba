"""The stretch of a document that a section without chunks of its own number covers: headings found in the chunks themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import fold, squeeze
from .signals import let

#: Chunks of a section or range at most, and for questions that take whole sections.
MOST, MOST_EXPANDED = 12, 30
# A numbered heading inside folded text, and words of which a number before them is none.
HEADING = r"(?<!\d)(\d+(?:\.\d+)*)\.?\s+([\p{L}][\p{L}\p{N}\s/&+\-()]{3,120})"
NO_TITLE = r"\b(phut|ngay|request|page|trang)\b"


def heading_of(content: Column) -> Column:
    """struct(number, level) of the first heading in a chunk's text; null without one."""
    text = squeeze(fold(F.coalesce(content, F.lit(""))))
    pairs = let(text, lambda t: F.zip_with(F.regexp_extract_all(t, F.lit(HEADING), F.lit(1)), F.regexp_extract_all(t, F.lit(HEADING), F.lit(2)), lambda n, title: F.struct(n.alias("number"), F.trim(title).alias("title"))))
    first = F.get(F.filter(pairs, lambda p: (F.length(p["title"]) >= 4) & ~p["title"].rlike(NO_TITLE)), F.lit(0))
    return let(first["number"], lambda n: F.when(n.isNotNull(), F.struct(n.alias("number"), F.size(F.split(n, r"\.")).alias("level"))))


def _above(heads: Column) -> Column:
    """For each heading the place of the last one before it of a lower level, -1 without one: a fold that keeps the headings that are still open."""
    start = F.struct(F.slice(heads, 1, 0).alias("open"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        left = F.filter(acc["open"], lambda o: o["level"] < h["level"])
        return let(left, lambda l: F.struct(F.array_append(l, h).alias("open"), F.array_append(acc["out"], F.coalesce(F.try_element_at(l, F.lit(-1))["place"], F.lit(-1))).alias("out")))

    return F.aggregate(heads, start, step, lambda acc: acc["out"])


def _inside(number: Column, root: Column) -> Column:
    return (number == root) | number.startswith(F.concat(root, F.lit(".")))


def heading_ranges(placed: DataFrame, document: str, most: int = MOST_EXPANDED) -> DataFrame:
    """document, start, root, stop, n: for each heading where the range that it belongs to begins and the place of the next heading that does not belong to it, among
    the next `most` (null without one); n is the document's chunks. A heading of a lower level climbs to the one above it if that one's number begins its own.

    placed: document, pos, heading. Only headings are gathered, a document's at a time.
    """
    n = placed.groupBy(document).agg(F.count("*").alias("n"))
    heads = placed.filter("heading IS NOT NULL").groupBy(document).agg(F.sort_array(F.collect_list(F.struct("pos", "heading.number", "heading.level"))).alias("hs"))
    numbered = F.transform("hs", lambda h, i: F.struct(i.alias("place"), h["pos"].alias("pos"), h["number"].alias("number"), h["level"].alias("level")))
    both = heads.select(document, numbered.alias("hs")).withColumn("up", _above(F.col("hs")))

    def of(h: Column) -> Column:
        above = F.get("hs", F.get("up", h["place"]))
        climbs = (h["level"] >= 2) & above.isNotNull() & h["number"].startswith(F.concat(above["number"], F.lit(".")))
        return let(F.when(F.coalesce(climbs, F.lit(False)), above).otherwise(h), lambda r: F.struct(h["pos"].alias("start"), r["pos"].alias("root"), stop(r).alias("stop")))

    def stop(r: Column) -> Column:
        ahead = F.slice("hs", r["place"] + 2, F.lit(most))
        return F.get(F.filter(ahead, lambda x: ~_inside(x["number"], r["number"]) & (x["level"] <= r["level"])), F.lit(0))["pos"]

    return both.select(document, F.explode(F.transform("hs", of)).alias("r")).select(document, "r.*").join(n, document)


def section_ranges(chunks: DataFrame, anchors: DataFrame, document: str = "document", order: str = "order", key: str = "key", content: str = "content") -> DataFrame:
    """question, key: the chunks of the ranges around anchors, each range of a question once [R5].

    From the nearest heading at or before an anchor, or the one above it, to before the next heading that is no part of it, `most` chunks at most. An anchor
    before any heading has no range. anchors: question, document, key, most.
    """
    w = W.partitionBy(document).orderBy(order, key)
    placed = chunks.select(document, key, order, heading_of(F.col(content)).alias("heading")).withColumn("pos", F.row_number().over(w) - 1)
    placed = placed.withColumn("start", F.last(F.when(F.col("heading").isNotNull(), F.col("pos")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    at = anchors.select("question", document, key, "most").join(placed.select(document, key, "start"), [document, key]).filter("start IS NOT NULL")
    found = at.join(heading_ranges(placed, document), [document, "start"])
    last = F.when(F.col("stop").isNull(), F.col("n") - 1).otherwise(F.greatest("root", F.col("stop") - 1))
    end = F.least(last, F.col("root") + F.col("most") - 1, F.col("n") - 1)
    ranges = found.select("question", document, "root", end.alias("end")).distinct()
    # A bounded number of places for each range, joined on equal keys.
    return ranges.select("question", document, F.explode(F.sequence("root", "end")).alias("pos")).join(placed.select(document, "pos", key), [document, "pos"]).select("question", key).distinct()


def section_expansion(chunks: DataFrame, anchors: DataFrame, document: str = "document", order: str = "order", key: str = "key", section: str = "section") -> DataFrame:
    """question, key: what anchors stand for [R22]: of a section that is met for the first time its first chunks, `most` at most; for other anchors, and those without a
    section, the range around them. anchors: question, document, key, section, most, rank (their order)."""
    some = F.coalesce(F.trim(F.col(section)) != "", F.lit(False))
    first = W.partitionBy("question", document, section).orderBy("rank", key)
    marked = anchors.withColumn("_own", some & (F.row_number().over(first) == 1))
    w = W.partitionBy("question", document, section).orderBy(order, key)
    wanted = marked.filter("_own").select("question", document, section, "most").distinct()
    heads = chunks.select(document, section, order, key).join(wanted, [document, section]).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= F.col("most"))
    return heads.select("question", key).unionByName(section_ranges(chunks, marked.filter("NOT _own"), document, order, key)).distinct()
