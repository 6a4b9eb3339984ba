"""Registered queries of sections, chunks and tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import table_rows as R
from ..sources.tables import scan

def tables(spark, d, flawed: bool = False):
    """table_id, markdown: the lines of each order as a pipe table, some of them wrapped into the row above, some in a group; flawed:
    some orders with a table that cannot be normalized."""
    l = scan(spark, d, "lineitem")
    part = F.when(F.col("l_partkey") % 5 == 0, F.lit("")).otherwise(F.col("l_partkey").cast("string"))
    line = F.concat(F.lit("| "), part, F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" | "), "l_returnflag", "l_linestatus", F.lit(" |"))
    group = F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("| Group: "), "l_returnflag", F.lit(" | | |\n"))).otherwise(F.lit(""))
    rows = l.select(F.col("l_orderkey").alias("table_id"), F.struct("l_linenumber", "l_partkey", "l_returnflag", F.col("l_quantity").cast("int").cast("string").alias("q"), F.concat(group, line).alias("line")).alias("r"))
    # The lines of an order: a bounded number.
    body = rows.groupBy("table_id").agg(F.array_join(F.sort_array(F.collect_list("r"))["line"], "\n").alias("body"))
    whole = F.concat(F.lit("| Part | Quantity | Flag |\n|---|---|---|\n"), "body")
    if flawed:
        t = F.col("table_id")
        whole = F.when(t % 11 == 0, F.concat(F.lit("| Part | | |\n|---|---|---|\n"), "body")).when(t % 13 == 0, F.lit("| Part | Flag |\n|---|---|")).when(t % 17 == 0, F.lit("  ")).when(t % 19 == 0, F.lit("no table")).otherwise(whole)
    return body.select("table_id", whole.alias("markdown"))


def _docs(spark, d):
    return scan(spark, d, "documents")


def _headed(spark, d):
    """Documents with numbered headings: the lines of a document, every third of them a section."""
    lines = F.split("text", "\n")
    headed = F.transform(lines, lambda x, i: F.when(i % 3 == 0, F.concat((F.floor(i / 6) + 1).cast("string"), F.when(i % 6 == 3, F.lit(".1")).otherwise(F.lit("")), F.lit(" Part "), i.cast("string"), F.lit("\n"), x)).otherwise(x))
    return _docs(spark, d).select("doc_id", F.array_join(headed, "\n").alias("text"))


def b1_clean(spark, d):
    return _docs(spark, d).select("doc_id", C.clean(F.col("text")).alias("text"))


def b6_sections(spark, d):
    got = C.sections(_headed(spark, d), "doc_id", "text")
    return got.select("doc_id", F.col("section").cast("long").alias("section"), "title", F.col("level").cast("long").alias("level"), "path", F.length("content").cast("long").alias("chars"))


def h3_chunks(spark, d):
    got = C.chunk_texts(_docs(spark, d), "doc_id", "text")
    return got.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("content").cast("long").alias("chars"), F.col("tokens").cast("long").alias("tokens"))


def h6_previews(spark, d):
    return _docs(spark, d).select("doc_id", C.short_preview(F.col("text")).alias("preview"))


def t1_parse(spark, d):
    t = _docs(spark, d).select("doc_id", R.parse_markdown(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t.rows").cast("long").alias("rows"), F.col("t.columns").cast("long").alias("columns"))


def t2_problems(spark, d):
    return R.problems(tables(spark, d, flawed=True), "markdown", "table_id")


def t14_rows(spark, d):
    return R.normalized_rows(tables(spark, d), "markdown", "table_id").select("table_id", F.col("row_index").cast("long").alias("row_index"), "group_context", "row_text", "cells_json")


def a15_quality(spark, d):
    return R.quality(R.normalized_rows(tables(spark, d), "markdown", "table_id"), "table_id")


def t16_admitted(spark, d):
    l = scan(spark, d, "lineitem")
    cells = [F.struct((F.col("l_linenumber") - 1).alias("row"), F.lit(i).alias("col"), F.when(F.col("l_partkey") % (3 + i) > 0, F.col(c).cast("string")).alias("text")) for i, c in enumerate(("l_partkey", "l_returnflag", "l_linestatus"))]
    return R.admitted(l.select(F.col("l_orderkey").alias("t"), F.inline(F.array(*cells))), "t")


def t20_dense(spark, d):
    return _docs(spark, d).select("doc_id", R.dense(F.col("text")).alias("dense"))


QUERIES = {f.__name__: f for f in (b1_clean, b6_sections, h3_chunks, h6_previews, t1_parse, t2_problems, t14_rows, a15_quality, t16_admitted, t20_dense)}

_ROWS = """
l AS (SELECT l_orderkey AS t, l_linenumber AS n, l_partkey AS k, l_quantity::INTEGER::VARCHAR AS q, l_returnflag || l_linestatus AS f, 1 AS part, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE l_partkey::VARCHAR END AS a, l_quantity::INTEGER::VARCHAR AS b, l_returnflag || l_linestatus AS c FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INTEGER::VARCHAR, l_returnflag || l_linestatus, 0, 'Group: ' || l_returnflag, '', '' FROM lineitem WHERE l_partkey % 7 = 0),
g AS (SELECT *, row_number() OVER w AS o, sum(CASE WHEN a <> '' THEN 1 ELSE 0 END) OVER w AS r FROM l WINDOW w AS (PARTITION BY t ORDER BY n, k, f[1], q, f, part ROWS UNBOUNDED PRECEDING)),
m AS (SELECT t, r, coalesce(string_agg(nullif(a, ''), ' ' ORDER BY o), '') AS a, coalesce(string_agg(nullif(b, ''), ' ' ORDER BY o), '') AS b, coalesce(string_agg(nullif(c, ''), ' ' ORDER BY o), '') AS c FROM g GROUP BY t, r),
x AS (SELECT *, (a <> '')::INTEGER + (b <> '')::INTEGER + (c <> '')::INTEGER AS filled, b = '' AND c = '' AND starts_with(a, 'Group: ') AS grp FROM m),
y AS (SELECT *, coalesce(last_value(CASE WHEN grp THEN a END IGNORE NULLS) OVER (PARTITION BY t ORDER BY r ROWS UNBOUNDED PRECEDING), '') AS group_context FROM x),
o AS (SELECT t AS table_id, row_number() OVER (PARTITION BY t ORDER BY r) AS row_index, group_context, filled,
             concat_ws('; ', CASE WHEN a <> '' THEN 'Part: ' || a END, CASE WHEN b <> '' THEN 'Quantity: ' || b END, CASE WHEN c <> '' THEN 'Flag: ' || c END) AS row_text,
             '{"part":"' || a || '","quantity":"' || b || '","flag":"' || c || '"}' AS cells_json FROM y WHERE NOT grp)"""

ORACLES = {
    "b1_clean": """
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]', ' ', 'g'), '[\\x{200b}-\\x{200d}\\x{2060}\\x{feff}]', '', 'g') AS t FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '(?m)^\\s*(?:page|trang)\\s+\\d+(?:\\s*/\\s*\\d+)?\\s*$', '', 'g'),
  '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '\\.\\.+', '.', 'g'), ' ') AS text FROM a
""",
    "t1_parse": """
WITH l AS (SELECT doc_id, trim(unnest(string_split_regex(coalesce(text, ''), '\\r?\\n')), ' ') AS line FROM documents),
     c AS (SELECT doc_id, list_transform(string_split(regexp_replace(trim(line, ' '), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x, ' ')) AS cells
           FROM l WHERE starts_with(line, '|') OR regexp_matches(line, '\\|.*\\|')),
     r AS (SELECT * FROM c WHERE len(list_filter(cells, lambda x: NOT regexp_matches(x, '^:?-{2,}:?$'))) > 0)
SELECT d.doc_id, count(r.doc_id) AS rows, coalesce(max(len(cells)), 0) AS columns FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY 1
""",
    "t2_problems": """
SELECT l_orderkey AS table_id, CASE WHEN l_orderkey % 11 = 0 THEN 'insufficient-headers' WHEN l_orderkey % 13 = 0 THEN 'no-data-rows' WHEN l_orderkey % 17 = 0 THEN 'empty-markdown'
  WHEN l_orderkey % 19 = 0 THEN 'no-rows' END AS problem FROM (SELECT DISTINCT l_orderkey FROM lineitem)
""",
    "t14_rows": f"""
WITH {_ROWS}
SELECT table_id, row_index, group_context, row_text, cells_json FROM o
""",
    "a15_quality": f"""
WITH {_ROWS}
SELECT table_id, count(*) AS rows, count(*) FILTER (filled = 1) AS one_cell_rows, 3 * count(*) AS cells, sum(3 - filled)::BIGINT AS empty_cells, 0::BIGINT AS generic_keys FROM o GROUP BY 1
""",
    "h6_previews": """
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN regexp_matches(text[1:300], '(?s)^.{50,}\\s') THEN regexp_extract(text[1:300], '(?s)^(.{50,})\\s', 1) ELSE text[1:300] END AS preview FROM documents
""",
    "t16_admitted": """
WITH c AS (SELECT l_orderkey AS t, l_linenumber - 1 AS row, i AS col, CASE WHEN l_partkey % (3 + i) > 0 THEN CASE i WHEN 0 THEN l_partkey::VARCHAR WHEN 1 THEN l_returnflag ELSE l_linestatus END END AS text FROM lineitem, range(3) r(i)),
     a AS (SELECT t, count(DISTINCT row) AS rows, count(DISTINCT col) AS cols, avg(CASE WHEN coalesce(trim(text), '') = '' THEN 1.0 ELSE 0 END) AS empty,
                  count(*) FILTER (coalesce(trim(text), '') <> '' AND row = 0) AS headers, count(*) FILTER (coalesce(trim(text), '') <> '') AS filled, sum(length(trim(coalesce(text, '')))) AS chars FROM c GROUP BY 1),
     w AS (SELECT t, CASE WHEN rows < 3 THEN 'too-few-rows' WHEN cols < 2 THEN 'too-few-columns' WHEN empty > 0.6 THEN 'too-sparse' WHEN headers < 2 THEN 'too-few-headers' WHEN filled < 4 THEN 'too-few-cells' WHEN chars < 40 THEN 'too-short' END AS reason FROM a)
SELECT t, reason IS NULL AS admitted, reason FROM w
""",
    "t20_dense": """
WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM documents)
SELECT doc_id, len(ls) >= 3 AND len(list_filter(ls, lambda x: contains(x, '|') OR contains(x, chr(9)) OR regexp_matches(x, '\\S {2,}\\S')
  OR len(regexp_extract_all(x, '\\b(?:\\d+(?:[.,/:-]\\d+)*|[A-Z]{2,}\\d+)\\b')) >= 3)) >= 0.3 * len(ls) AS dense FROM l
""",
}
