"""Registered queries of headings, coverage, sets and exports, and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators import coverage as V
from ..operators import signals as S
from ..operators.vectors import nearest
from ..sources.tables import scan
from .retrieval_queries import QUESTIONS, plain_sql
from .retrieve import retrieve


def q13_headings(spark, d):
    p = scan(spark, d, "part")
    terms = F.array(*[F.lit(t) for t in ("red", "widget", "gear", "economy")])
    s = S.heading_scores(terms, F.lit("red widget"), F.col("p_name"), F.concat_ws(" > ", "p_type", "p_name"))
    rows = p.select(F.lit("q").alias("question"), F.col("p_partkey").alias("key"), s.alias("s"), F.col("p_size").alias("depth"))
    return V.best_headings(rows, "question", "s", "depth", 50).select("key", F.col("s.score").cast("long").alias("score"), F.col("nth").cast("long").alias("nth"))


def r15_cover(spark, d):
    l = scan(spark, d, "lineitem")
    rows = l.select(F.col("l_orderkey").alias("question"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("key"), F.col("l_quantity").alias("score"), F.array(F.concat("l_returnflag", "l_linestatus")).alias("labels"))
    selected = rows.filter("score > 30")
    wanted = rows.select("question", F.explode("labels").alias("label")).distinct()
    got = V.cover_labels(selected, rows, wanted, 4)
    return got.select("question", F.col("key").cast("long").alias("key"), "added")


def r16_other_source(spark, d):
    l = scan(spark, d, "lineitem")
    rows = l.select(F.col("l_orderkey").alias("question"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("key"), F.col("l_returnflag").alias("source"), F.col("l_quantity").alias("noise"))
    return V.other_source(rows.filter("noise > 25"), rows, ["source"]).select("question", F.col("key").cast("long").alias("key"), "source")


def u3_sets(spark, d):
    w = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    t = scan(spark, d, "conversations").select("conv_id", "turn", w.alias("w"))
    first = t.filter("turn = 0").select("conv_id", F.col("w").alias("f"))
    got = t.join(first, "conv_id").select("conv_id", "turn", F.round(V.overlap(F.col("w"), F.col("f")), 6).alias("overlap"), V.noise(F.array_distinct("w"), F.col("f")).cast("long").alias("noise"))
    return got


def s12_sessions(spark, d):
    return V.session_json(scan(spark, d, "conversations"), "conv_id", "turn", "role")


def x12_chart(spark, d):
    s = A.daily(scan(spark, d, "events"), date(2024, 1, 1), date(2024, 1, 31), "ts", "user_id")
    return V.charts(s, "day", "messages").select(F.col("day").cast("string").alias("day"), F.round("height", 9).alias("height"))


def x19_values(spark, d):
    w = F.explode(F.split("text", " ")).alias("w")
    rows = scan(spark, d, "documents").select(w).filter("w rlike '[0-9]'").distinct()
    return rows.select("w", S.is_value(F.lower("w")).alias("value"), S.bare(F.col("w")).alias("bare"))


def r0_retrieve(spark, d):
    """Questions of three languages; a question's vector is that of the vector with its number, and the documents with the ids of
    the vectors nearest to it are what vectors hit."""
    docs = scan(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("tenant"), F.col("doc_id").alias("document"), F.col("text").alias("content"))
    questions = spark.createDataFrame([(f"q{i}", lang, text) for i, (lang, text) in enumerate(QUESTIONS)], "question string, tenant string, text string")
    vectors = scan(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    vectors = vectors.join(docs.select("key", "tenant"), "key")
    asked = scan(spark, d, "embeddings").filter(F.col("vec_id") < len(QUESTIONS)).select(F.concat(F.lit("q"), "vec_id").alias("question"), F.col("embedding").alias("asked"))
    hits = nearest(vectors, asked.join(questions.select("question", "tenant"), "question"), 30, "key", "tenant", "vector").select("question", "key")
    return retrieve(docs, questions, hits).select("question", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (r0_retrieve, q13_headings, r15_cover, r16_other_source, u3_sets, s12_sessions, x12_chart, x19_values)}

ORACLES = {
    "q13_headings": f"""
WITH p AS (SELECT p_partkey AS key, p_size AS depth, {plain_sql('p_name')} AS title, {plain_sql("p_type || ' > ' || p_name")} AS path FROM part),
     h AS (SELECT *, len(list_filter(['red', 'widget', 'gear', 'economy'], lambda t: contains(title, t))) AS th,
                  len(list_filter(['red', 'widget', 'gear', 'economy'], lambda t: NOT contains(title, t) AND contains(path, t))) AS ph FROM p),
     s AS (SELECT *, 3 * th + ph - 2 * (4 - th - ph) + CASE WHEN contains(title, 'red widget') THEN 8 ELSE 0 END + CASE WHEN th = 4 THEN 4 ELSE 0 END AS score FROM h),
     r AS (SELECT key, score, row_number() OVER (ORDER BY score DESC, th DESC, depth DESC, key) AS nth FROM s WHERE score > 0 AND (th >= 2 OR (th >= 1 AND ph >= 1)))
SELECT key, score, nth FROM r WHERE nth <= 50
""",
    "r15_cover": """
WITH r AS (SELECT l_orderkey AS question, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS key, l_quantity AS score, l_returnflag || l_linestatus AS label FROM lineitem),
     s AS (SELECT * FROM r WHERE score > 30),
     m AS (SELECT DISTINCT question, label FROM r ANTI JOIN s USING (question, label)),
     o AS (SELECT r.*, row_number() OVER (PARTITION BY question, label ORDER BY score DESC, key) AS n FROM r JOIN m USING (question, label)),
     e AS (SELECT question, key, score, false AS added FROM s UNION ALL SELECT question, key, score, true FROM o WHERE n = 1)
SELECT question, key, added FROM e QUALIFY row_number() OVER (PARTITION BY question ORDER BY added DESC, score DESC, key) <= 4
""",
    "r16_other_source": """
WITH r AS (SELECT l_orderkey AS question, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS key, l_returnflag AS source, l_quantity AS noise FROM lineitem),
     s AS (SELECT question, min(source) AS a FROM r WHERE noise > 25 GROUP BY 1 HAVING min(source) = max(source))
SELECT question, key, source FROM r JOIN s USING (question) WHERE source <> a AND noise <= 25 QUALIFY row_number() OVER (PARTITION BY question ORDER BY noise, key) = 1
""",
    "u3_sets": """
WITH t AS (SELECT conv_id, turn, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM conversations),
     f AS (SELECT conv_id, w AS f FROM t WHERE turn = 0)
SELECT conv_id, turn, round(CASE WHEN least(len(list_distinct(w)), len(list_distinct(f))) = 0 THEN 0 ELSE len(list_intersect(list_distinct(w), list_distinct(f))) / least(len(list_distinct(w)), len(list_distinct(f))) END, 6) AS overlap,
       len(list_filter(list_distinct(w), lambda x: NOT list_contains(f, x))) AS noise FROM t JOIN f USING (conv_id)
""",
    "s12_sessions": """
SELECT conv_id, to_json({'session': conv_id, 'turns': list({'turn': turn, 'role': role} ORDER BY turn)})::VARCHAR AS json FROM conversations GROUP BY 1
""",
    "x12_chart": """
WITH d AS (SELECT strftime(d.day, '%Y-%m-%d') AS day, count(event_id) AS n FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) d(day)
           LEFT JOIN events ON ts >= d.day AND ts < d.day + INTERVAL 1 DAY GROUP BY d.day)
SELECT day, round(n / max(n) OVER (), 9) AS height FROM d
""",
    "x19_values": r"""
WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents)
SELECT w, regexp_matches(regexp_replace(lower(w), '^[#:/\-.]+|[#:/\-.]+$', '', 'g'), '^(?:\d{1,4}[a-z]?|[a-z]\d{1,4}[a-z0-9]{0,6}|[a-z]{1,8}\d[a-z0-9\-]{1,12})$') AS value,
       regexp_replace(w, '^[#:/\-.]+|[#:/\-.]+$', '', 'g') AS bare FROM w WHERE regexp_matches(w, '[0-9]')
""",
}
