"""Tables in texts: parsing, headers, data rows, quality and their texts.

A table is one row of a frame, its rows an array of arrays of cells; tables are independent, so all of this runs
where the table is, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import match_form, slug, squeeze
from .signals import let

NONE = "array<array<string>>"
# Codes and row numbers in front of rows.
ROW_NUMBER = r"^\s*\d{1,4}\s*([.|)]\s*)?$"
IDENTIFIER = r"^(?=.*[A-Z])(?=.*\d)[A-Z][A-Z0-9._-]{2,20}$"


def split_row(line: Column) -> Column:
    """The trimmed cells between the pipes of a line."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def is_separator(cells: Column) -> Column:
    """A row of nothing but dashes and colons [T21]."""
    return (F.size(cells) > 0) & F.forall(cells, lambda c: c.rlike(r"^:?-{2,}:?$"))


def parse_markdown(text: Column) -> Column:
    """struct(rows, separator, columns) of a pipe table: its rows without the separator, the separator's place (-1
    without one) and the most cells of a row [T1]."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") | x.rlike(r"\|.*\|"))

    def of(all_rows: Column) -> Column:
        split = lambda marks: F.struct(F.filter(all_rows, lambda r, i: ~F.get(marks, i)).alias("rows"), (F.array_position(marks, True) - 1).cast("int").alias("separator"))
        return let(let(F.transform(all_rows, is_separator), split), with_columns)

    def with_columns(t: Column) -> Column:
        return F.struct(t["rows"].alias("rows"), t["separator"].alias("separator"), F.coalesce(F.array_max(F.transform(t["rows"], lambda r: F.size(r))), F.lit(0)).alias("columns"))

    return let(F.transform(lines, split_row), of)


def has_data(cells: Column) -> Column:
    """Any cell that is not blank [P18]."""
    return F.exists(cells, lambda c: F.trim(c) != "")


def numeric_cells(cells: Column) -> Column:
    """Cells that are numbers, dates, times or codes."""
    like = r"^(?:[-+]?\d[\d.,]*%?|\d{1,4}[/.:-]\d{1,2}(?:[/.:-]\d{1,4})?)$"
    return F.size(F.filter(cells, lambda c: F.trim(c).rlike(like) | F.trim(c).rlike(IDENTIFIER)))


def starts_data(cells: Column) -> Column:
    """A row number or code in front, or half of the cells numeric [T21, T25]."""
    first = F.trim(F.get(cells, F.lit(0)))
    return first.rlike(r"^\d{1,4}\.?$") | first.rlike(IDENTIFIER) | (numeric_cells(cells) >= F.greatest(F.lit(2), F.ceil(F.size(cells) / 2).cast("int")))


def header_rows(table: Column) -> Column:
    """How many rows are header: those before the separator, else those before the first data or group row of six [T4]."""
    first = F.filter(F.transform(table["rows"], lambda r, i: F.when(starts_data(r) | is_group_row(r), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    guessed = F.least(F.coalesce(F.get(first, F.lit(0)), F.lit(1)), F.lit(6), F.size(table["rows"]))
    return F.when(table["separator"] > 0, table["separator"]).otherwise(F.greatest(guessed, F.lit(1)))


def clean_header(text: Column) -> Column:
    """Without neighbouring words that repeat; six or more words, or any word twice, make it ambiguous: '' [T5]."""
    words = F.filter(F.split(squeeze(text), " "), lambda w: w != "")

    def of(ws: Column) -> Column:
        kept = F.filter(ws, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.get(ws, i - 1))))
        bad = (F.size(kept) >= 6) | (F.size(F.array_distinct(F.transform(kept, F.lower))) < F.size(kept))
        return F.when(bad, F.lit("")).otherwise(F.array_join(kept, " "))

    return let(words, of)


def headers(table: Column, count: Column) -> Column:
    """One name a column: the last usable header cell, col_N where there is none, later equals numbered [T5, T7]."""
    def name(i: Column) -> Column:
        cells = F.filter(F.transform(F.slice(table["rows"], F.lit(1), count), lambda r: clean_header(F.coalesce(F.get(r, i), F.lit("")))), lambda c: c != "")
        return F.coalesce(F.when(F.size(cells) > 0, F.element_at(cells, -1)), F.concat(F.lit("col_"), (i + 1).cast("string")))

    def unique(names: Column) -> Column:
        nth = lambda n, i: F.size(F.filter(F.slice(names, F.lit(1), i + 1), lambda x: F.lower(x) == F.lower(n)))
        return F.transform(names, lambda n, i: F.when(nth(n, i) == 1, n).otherwise(F.concat(n, F.lit("_"), nth(n, i).cast("string"))))

    empty = F.array().cast("array<string>")
    return F.when(table["columns"] > 0, let(F.transform(F.sequence(F.lit(0), F.greatest(table["columns"] - 1, F.lit(0))), name), unique)).otherwise(empty)


def merge_wrapped(rows: Column) -> Column:
    """Rows whose first cell is blank are the rest of the row before, cell by cell [T8]."""
    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.zip_with(last, r, lambda a, b: F.trim(F.concat_ws(" ", a, F.nullif(F.trim(b), F.lit("")))))
        rest = (F.size(acc) > 0) & (F.trim(F.coalesce(F.get(r, F.lit(0)), F.lit(""))) == "") & has_data(r)
        before = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(rest, F.concat(before, F.array(joined))).otherwise(F.array_append(acc, r))

    return F.aggregate(rows, F.array().cast(NONE), step)


def is_group_row(cells: Column) -> Column:
    """A row that names a group: one filled cell, with a colon or long [T9]."""
    filled = F.filter(cells, lambda c: F.trim(c) != "")
    one = F.trim(F.get(filled, F.lit(0)))
    return (F.size(filled) == 1) & (one.rlike(r"^[^:]+:\s*\S") | (F.length(one) > 20)) & (F.size(cells) > 1)


def normalized_rows(tables: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, row_index, group_context, cells (struct key, value in column order), row_text, cells_json: one row per
    data row of each pipe table; why a table gave none stands in problems() [T2, T10, T14, T15]."""
    def data_rows(t: Column) -> Column:
        def below(n: Column) -> Column:
            body = F.filter(F.slice(t["rows"], n + 1, F.greatest(F.size(t["rows"]) - n, F.lit(0))), has_data)
            enough = lambda names: F.size(F.filter(names, lambda h: ~h.rlike(r"^col_\d+$"))) >= 2
            return let(headers(t, n), lambda names: F.when(enough(names), F.struct(names.alias("names"), F.transform(names, slug).alias("slugs"), merge_wrapped(body).alias("rows"))))

        return let(header_rows(t), below)

    # One expression, and no filter above it: a filter would be pushed below and parse every table once more.
    parsed = tables.select(*keys, let(parse_markdown(F.col(text)), data_rows).alias("_parsed"))
    rows = parsed.select(*keys, "_parsed.names", "_parsed.slugs", F.posexplode("_parsed.rows").alias("pos", "cells"))
    rows = rows.withColumn("group", F.when(is_group_row(F.col("cells")), F.concat_ws(" ", F.transform(F.filter("cells", lambda c: F.trim(c) != ""), lambda c: F.trim(c)))))
    # Both by the same keys and order: one sort, and no shuffle where tables already lie by their keys.
    w = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    carried, nth = F.last("group", ignorenulls=True).over(w), F.count(F.when(F.col("group").isNull(), 1)).over(w)
    whole = rows.withColumn("carried", carried).withColumn("nth", nth.cast("int")).filter("group is null")
    name = lambda i: F.coalesce(F.get("names", i), F.concat(F.lit("col_"), (i + 1).cast("string")))
    size = F.greatest(F.size("names"), F.size("cells"))
    pairs = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(name(i).alias("key"), F.coalesce(F.get("cells", i), F.lit("")).alias("value")))
    json = F.transform("pairs", lambda p, i: F.struct(F.coalesce(F.get("slugs", i), slug(p["key"])), p["value"]))
    out = whole.select(*keys, "nth", F.coalesce("carried", F.lit("")).alias("group_context"), "slugs", pairs.alias("pairs"))
    text_of = F.array_join(F.transform(F.filter("pairs", lambda p: p["value"] != ""), lambda p: F.concat_ws(": ", p["key"], p["value"])), "; ")
    return out.select(
        *keys, F.col("nth").alias("row_index"), "group_context", F.col("pairs").alias("cells"), text_of.alias("row_text"), F.to_json(F.map_from_entries(json)).alias("cells_json")
    )


def problems(tables: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, problem: why a table cannot be normalized, null if it can [T2]."""
    parsed = tables.select(*keys, F.col(text).alias("_text"), parse_markdown(F.col(text)).alias("t")).withColumn("n", header_rows(F.col("t")))
    named = F.size(F.filter(headers(F.col("t"), F.col("n")), lambda h: ~h.rlike(r"^col_\d+$")))
    body = F.filter(F.slice("t.rows", F.col("n") + 1, F.greatest(F.size("t.rows") - F.col("n"), F.lit(0))), has_data)
    why = (
        F.when(F.trim(F.coalesce("_text", F.lit(""))) == "", "empty-markdown")
        .when(F.size("t.rows") == 0, "no-rows")
        .when(named < 2, "insufficient-headers")
        .when(F.size(body) == 0, "no-data-rows")
    )
    return parsed.select(*keys, why.alias("problem"))


def quality(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts about the normalized rows of each table [A15]."""
    n = F.size("cells")
    filled = F.size(F.filter("cells", lambda c: c["value"] != ""))
    generic = F.size(F.filter("cells", lambda c: c["key"].rlike(r"^col_\d+$")))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count(F.when(filled == 1, 1)).alias("one_cell_rows"),
        F.sum(n).alias("cells"),
        F.sum(n - filled).alias("empty_cells"),
        F.sum(generic).alias("generic_keys"),
    )


def weighted(stats: DataFrame, weight: str, *means: str) -> DataFrame:
    """Row-weighted means of several tables' figures [A16]."""
    return stats.agg(F.sum(weight).alias(weight), *[(F.sum(F.col(m) * F.col(weight)) / F.sum(weight)).alias(m) for m in means])


def headers_match(a: Column, b: Column) -> Column:
    """Two thirds of the names in common, two at least [T21]."""
    same = F.size(F.array_intersect(F.transform(a, match_form), F.transform(b, match_form)))
    return same >= F.greatest(F.lit(2.0), F.size(a) * F.lit(2.0) / 3)


def table_like_line(line: Column) -> Column:
    """Pipes, tabs, wide gaps, or several codes, dates and numbers [T20]."""
    facts = F.regexp_count(line, F.lit(r"\b(?:\d+(?:[.,/:-]\d+)*|[A-Z]{2,}\d+)\b"))
    return line.contains("|") | line.contains("\t") | line.rlike(r"\S {2,}\S") | (facts >= 3)


def dense(text: Column) -> Column:
    """Three or more lines, of which three in ten look like a table's [T20, C9]."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return let(lines, lambda ls: (F.size(ls) >= 3) & (F.size(F.filter(ls, table_like_line)) >= 0.3 * F.size(ls)))


def admitted(cells: DataFrame, table: str) -> DataFrame:
    """table, admitted, reason by rows, columns, empty share, filled cells and characters [T16, T17].

    cells: table, row, col, text, one row per cell.
    """
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    per = cells.groupBy(table).agg(
        # Sets of a table's places: two distinct counts would write every cell three times.
        F.size(F.collect_set("row")).alias("rows"),
        F.size(F.collect_set("col")).alias("cols"),
        F.avg(F.when(filled, 0.0).otherwise(1.0)).alias("empty"),
        F.count(F.when(filled & (F.col("row") == 0), 1)).alias("headers"),
        F.count(F.when(filled, 1)).alias("filled"),
        F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("chars"),
    )
    reason = (
        F.when(F.col("rows") < 3, "too-few-rows")
        .when(F.col("cols") < 2, "too-few-columns")
        .when(F.col("empty") > 0.6, "too-sparse")
        .when(F.col("headers") < 2, "too-few-headers")
        .when(F.col("filled") < 4, "too-few-cells")
        .when(F.col("chars") < 40, "too-short")
    )
    return per.select(table, reason.isNull().alias("admitted"), reason.alias("reason"))


ROW_TYPE = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
