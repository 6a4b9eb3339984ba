"""Registered queries of vector search, fusion, selection and expansion, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import expansion as E
from ..operators import vectors as V
from ..sources.tables import scan


def _questions(spark, d):
    """The vector of the smallest id of each label asks within its label."""
    v = scan(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return v.join(first, ["label", "vec_id"]).select(F.concat(F.lit("q"), F.col("label").cast("string")).alias("question"), F.col("label").alias("tenant"), F.col("embedding").alias("asked"))


def v1_nearest(spark, d):
    got = V.nearest(scan(spark, d, "embeddings"), _questions(spark, d), 10, "vec_id", "label", "embedding")
    return got.select("question", F.col("key").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


def _hits(spark, d):
    """Events as candidates: the type asks, the user is hit; even values come from vectors, low ones from words."""
    e = scan(spark, d, "events").select(F.col("event_type").alias("question"), F.col("user_id").alias("key"), "value", "event_id")
    vector = e.filter("event_id % 3 = 0").select("question", "key").distinct()
    words = e.filter("event_id % 5 = 0").groupBy("question", "key").agg((F.max("value") / 1000).alias("score"))
    return vector, words


def j9_merge(spark, d):
    got = V.merge_hits(*_hits(spark, d))
    return got.select("question", F.col("key").alias("user_id"), "source", "vector", F.round("keyword", 6).alias("keyword"))


def _ranked(spark, d):
    both = V.merge_hits(*_hits(spark, d))
    return both.withColumn("lexical", (F.col("key") % 10) / 10.0).withColumn("final", F.round(V.fused(), 9))


def r11_fusion(spark, d):
    return _ranked(spark, d).select("question", F.col("key").alias("user_id"), "final")


def r9_gap(spark, d):
    got = V.rerank_is_worth_it(_ranked(spark, d), "final")
    return got.select("question", "candidates", F.round("gap", 6).alias("gap"), "worth")


def r13_select(spark, d):
    rows = _ranked(spark, d).withColumn("length", F.col("key") % 37 * 10)
    got = V.select_within(rows, "final", "length", 25, 3000)
    return got.select("question", F.col("key").alias("user_id"), "final", F.col("rank").cast("long").alias("rank"), "chars")


def r8_budget(spark, d):
    rows = _ranked(spark, d).withColumn("sure", F.col("key") % 4 == 0)
    return V.scoring_budget(rows, 60, "sure", "final").select("question", F.col("key").alias("user_id"), "sure")


def r11_lexical(spark, d):
    docs = scan(spark, d, "documents").select(F.lit("q").alias("question"), F.col("doc_id").alias("key"), X.normalize("text").alias("hay"))
    docs = docs.withColumn("terms", F.array(*[F.lit(t) for t in ("the", "license", "apache", "worthless", "trash", "onanin")]))
    got = V.lexical(docs)
    return got.select(F.col("key").alias("doc_id"), F.round("lexical", 6).alias("lexical"))


def _turns(spark, d):
    return scan(spark, d, "conversations")


def j6_neighbours(spark, d):
    anchors = _turns(spark, d).filter("role = 'assistant' and turn % 3 = 1").select(F.col("turn").alias("anchor"), F.col("conv_id").alias("document"), F.col("turn").alias("order"))
    got = E.neighbours(_turns(spark, d), anchors.withColumn("order", F.col("order")), "conv_id", "turn")
    return got.select("conv_id", "anchor", "turn", "role")


def j14_links(spark, d):
    rows = _turns(spark, d).withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    return E.linked(rows, "conv_id", "turn", "key").select("key", "previous", "next")


def _sections(spark, d):
    """Parts as sections: brand and size give a number of up to three levels."""
    p = scan(spark, d, "part")
    n = F.concat_ws(".", F.col("p_size") % 7 + 1, F.when(F.col("p_size") % 3 > 0, F.col("p_partkey") % 5 + 1), F.when(F.col("p_size") % 3 > 1, F.col("p_partkey") % 3 + 1))
    return p.select(F.col("p_brand").alias("document"), n.alias("number"), F.concat_ws(" ", n, "p_name").alias("title"), "p_partkey")


def j7_descendants(spark, d):
    roots = _sections(spark, d).select("document", "number").distinct()
    got = E.descendants(_sections(spark, d), roots, "document", "number")
    return got.select("document", "root", "number", "p_partkey")


def j8_parents(spark, d):
    s = V.first_by(_sections(spark, d), ["document", "number"], ["p_partkey"])
    return E.with_parents(s, "document", "number", "title").select("document", "number", "parent_title")


def b8_numbers(spark, d):
    n = E.section_number(F.col("title"))
    s = _sections(spark, d).select("p_partkey", n.alias("number"), E.parent_number(n).alias("parent"), E.section_level(n).cast("long").alias("level"))
    return s


def w4_first(spark, d):
    rows = scan(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_linenumber")
    # The part settles ties, so that reruns agree; the SQL leaves them open.
    return V.first_by(rows, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_partkey")


def w7_heads(spark, d):
    anchors = _turns(spark, d).filter("turn = 2").select(F.col("conv_id").alias("document"), F.col("role").alias("section"))
    return E.section_heads(_turns(spark, d), anchors, "conv_id", "role", "turn", 2).select("conv_id", "role", "turn")


def w8_runs(spark, d):
    got = E.runs(scan(spark, d, "events"), "user_id", "event_id", F.col("value") > 30, 3)
    return got.select("user_id", "first", "last", "size")


def w9_equal_runs(spark, d):
    return E.equal_runs(scan(spark, d, "events"), "user_id", "event_id", "event_type", 2).select("event_id", "in_run")


def w10_copies(spark, d):
    got = E.numbered_copies(scan(spark, d, "events"), ["user_id"], "event_id", "event_type")
    return got.select("event_id", "unique")


def w11_carried(spark, d):
    e = scan(spark, d, "events").withColumn("mark", F.when(F.col("value") > 50, F.col("event_id")))
    return E.carried(e, "user_id", "event_id", "mark").select("event_id", "carried")


def j13_overlap(spark, d):
    o = scan(spark, d, "lineitem")
    cells = o.select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("cell"), F.col("l_quantity").alias("x"), (F.col("l_quantity") + F.col("l_tax") * 100).alias("x_end"))
    slots = spark.range(5).select(F.col("id").alias("slot"), (F.col("id") * 11.0).alias("s"), (F.col("id") * 11.0 + 10).alias("s_end"))
    tables = o.select(F.col("l_orderkey").alias("t")).distinct().withColumn("slots", F.expr("sequence(0, 4)"))
    own = tables.select("t", F.explode("slots").alias("slot")).join(F.broadcast(slots), "slot")
    got = E.best_overlap(cells, own, "t")
    return got.select("t", F.col("cell").cast("long").alias("cell"), F.col("slot").cast("long").alias("slot"))


def a14_median(spark, d):
    return E.upper_medians(scan(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


QUERIES = {f.__name__: f for f in (v1_nearest, j9_merge, r11_fusion, r9_gap, r13_select, r8_budget, r11_lexical, j6_neighbours, j14_links, j7_descendants, j8_parents, b8_numbers, w4_first, w7_heads, w8_runs, w9_equal_runs, w10_copies, w11_carried, j13_overlap, a14_median)}

_RANKED = """
e AS (SELECT event_type AS question, user_id, value, event_id FROM events),
v AS (SELECT DISTINCT question, user_id, 1.0::DOUBLE AS vector FROM e WHERE event_id % 3 = 0),
k AS (SELECT question, user_id, max(value) / 1000 AS keyword FROM e WHERE event_id % 5 = 0 GROUP BY ALL),
m AS (SELECT question, user_id, CASE WHEN vector IS NULL THEN 'KEYWORD' WHEN keyword IS NULL THEN 'VECTOR' ELSE 'BOTH' END AS source,
             coalesce(vector, 0) AS vector, coalesce(keyword, 0) AS keyword FROM v FULL JOIN k USING (question, user_id)),
f AS (SELECT *, round(0.35::DOUBLE * vector + 0.35::DOUBLE * keyword + 0.30::DOUBLE * ((user_id % 10) / 10.0::DOUBLE), 9) AS final FROM m)"""

_SECTIONS = """
s AS (SELECT p_partkey, p_brand AS document, concat_ws('.', p_size % 7 + 1, CASE WHEN p_size % 3 > 0 THEN p_partkey % 5 + 1 END, CASE WHEN p_size % 3 > 1 THEN p_partkey % 3 + 1 END) AS number, p_name FROM part)"""

from .retrieval_queries import plain_sql  # noqa: E402

ORACLES = {
    "r11_lexical": f"""
WITH c AS (SELECT doc_id, {plain_sql('text')} AS hay FROM documents),
     h AS (SELECT doc_id, term FROM c, (SELECT unnest(['the', 'license', 'apache', 'worthless', 'trash', 'onanin']) AS term) WHERE contains(hay, term)),
     w AS (SELECT term, ln(((SELECT count(*) FROM c) + 1.0) / (count(*) + 1.0)) AS w FROM h GROUP BY 1),
     s AS (SELECT doc_id, sum(w) AS s FROM h JOIN w USING (term) GROUP BY 1)
SELECT doc_id, round(coalesce(s / (SELECT max(s) FROM s), 0), 6) AS lexical FROM c LEFT JOIN s USING (doc_id)
""",
    "v1_nearest": """
WITH a AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS asked FROM embeddings GROUP BY 1),
     s AS (SELECT 'q' || label AS question, vec_id, list_cosine_similarity(embedding::DOUBLE[], asked) AS cosine FROM embeddings JOIN a USING (label))
SELECT question, vec_id, round(cosine, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY question ORDER BY cosine DESC, vec_id) <= 10
""",
    "j9_merge": f"WITH {_RANKED} SELECT question, user_id, source, vector, round(keyword, 6) AS keyword FROM m",
    "r11_fusion": f"WITH {_RANKED} SELECT question, user_id, final FROM f",
    "r9_gap": f"""WITH {_RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY final DESC, user_id) AS n FROM f),
g AS (SELECT question, count(*) AS candidates, round(max(final) FILTER (n = 1) - coalesce(max(final) FILTER (n = 2), 0), 6) AS gap FROM r GROUP BY 1)
SELECT *, candidates > 5 AND gap < 0.35 AS worth FROM g""",
    "r13_select": f"""WITH {_RANKED}, r AS (SELECT question, user_id, final, row_number() OVER w AS rank, sum(user_id % 37 * 10) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS chars
  FROM f WINDOW w AS (PARTITION BY question ORDER BY final DESC, user_id)) SELECT * FROM r WHERE rank <= 25 AND (chars <= 3000 OR rank = 1)""",
    "r8_budget": f"""WITH {_RANKED}, r AS (SELECT *, user_id % 4 = 0 AS sure, row_number() OVER (PARTITION BY question, user_id % 4 = 0 ORDER BY final DESC, user_id) AS n FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY (sure AND n <= 20) DESC, final DESC, user_id) AS k FROM r) SELECT question, user_id, sure FROM t WHERE k <= 60""",
    "j6_neighbours": """
SELECT c.conv_id, a.turn AS anchor, c.turn, c.role FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.role = 'assistant' AND a.turn % 3 = 1
AND c.turn BETWEEN a.turn - 1 AND a.turn + 2
""",
    "j14_links": """
SELECT conv_id || '-' || turn AS key, lag(conv_id || '-' || turn) OVER w AS previous, lead(conv_id || '-' || turn) OVER w AS next FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""",
    "j7_descendants": f"""WITH {_SECTIONS}, r AS (SELECT DISTINCT document, number AS root FROM s)
SELECT document, root, number, p_partkey FROM s JOIN r USING (document) WHERE number = root OR starts_with(number, root || '.')""",
    "j8_parents": f"""WITH {_SECTIONS}, f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY document, number ORDER BY p_partkey) = 1)
SELECT a.document, a.number, p.number || ' ' || p.p_name AS parent_title FROM f a LEFT JOIN f p ON p.document = a.document AND contains(a.number, '.') AND p.number = regexp_replace(a.number, '\\.[^.]+$', '')""",
    "b8_numbers": f"""WITH {_SECTIONS} SELECT p_partkey, number, CASE WHEN contains(number, '.') THEN regexp_replace(number, '\\.[^.]+$', '') END AS parent, len(string_split(number, '.')) AS level FROM s""",
    "w4_first": "SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) = 1",
    "w7_heads": """
SELECT conv_id, role, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations a WHERE a.turn = 2 AND a.conv_id = c.conv_id AND a.role = c.role)
QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) <= 2
""",
    "w8_runs": """
WITH r AS (SELECT *, sum(CASE WHEN value > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS size FROM r WHERE value > 30 GROUP BY user_id, run HAVING count(*) >= 3
""",
    "w9_equal_runs": """
WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS ch FROM events),
     r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)
SELECT event_id, count(*) OVER (PARTITION BY user_id, run) >= 2 AS in_run FROM r
""",
    "w10_copies": """
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
SELECT event_id, CASE WHEN n = 1 THEN event_type ELSE event_type || '_' || n END AS unique FROM r
""",
    "w11_carried": """
SELECT event_id, last_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events
""",
    "j13_overlap": """
WITH c AS (SELECT l_orderkey AS t, l_linenumber::BIGINT AS cell, l_quantity AS x, l_quantity + l_tax * 100 AS xe FROM lineitem),
     p AS (SELECT t, cell, slot, greatest(0.0, least(xe, slot * 11.0::DOUBLE + 10) - greatest(x, slot * 11.0::DOUBLE)) AS shared,
                  abs((x + xe - slot * 11.0::DOUBLE - (slot * 11.0::DOUBLE + 10)) / 2) AS apart FROM c, range(5) r(slot))
SELECT t, cell, slot FROM p QUALIFY row_number() OVER (PARTITION BY t, cell ORDER BY shared DESC, apart, slot) = 1
""",
    "a14_median": "SELECT l_returnflag, l_linestatus, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY 1, 2",
}
