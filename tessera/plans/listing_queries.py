"""Registered queries of listings, projections and names of tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import listings as L
from ..operators import table_rows as R
from ..sources.tables import live, scan
from .ingest_queries import tables
from .retrieval_queries import plain_sql

APART = {"é": "e\u0301", "è": "e\u0300", "ê": "e\u0302", "ü": "u\u0308", "ö": "o\u0308", "ñ": "n\u0303", "à": "a\u0300", "ç": "c\u0327"}
TERMS = ["the", "license", "apache", "und", "nothing has this"]


def k13_listing(spark, d):
    got = L.listed(L.of_keys(scan(spark, d, "conversations"), role="assistant"), ["conv_id"], ["turn"])
    return got.select("conv_id", "turn", F.col("place").cast("long").alias("place"))


def j2_tenants(spark, d):
    o, c = scan(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), scan(spark, d, "customer").filter("c_acctbal > 0")
    rows = lambda wanted: L.in_tenant(o, c, "c_custkey", wanted).agg(F.count("*").alias("n"), F.lit(wanted).alias("joined"))
    return rows(True).unionByName(rows(False))


def s19_of_deleted(spark, d):
    parents = scan(spark, d, "customer").withColumn("deleted_at", F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01").cast("timestamp"))).withColumnRenamed("c_custkey", "o_custkey")
    o = scan(spark, d, "orders")
    seen = L.owned(o, parents, "o_custkey", False).withColumn("seen", F.lit(True))
    return L.owned(o, parents, "o_custkey", True).join(seen.select("o_orderkey", "seen"), "o_orderkey", "left").select("o_orderkey", F.coalesce("seen", F.lit(False)).alias("seen"))


def s15_cascade(spark, d):
    c = scan(spark, d, "customer")
    parts = {"orders": scan(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")}
    got = L.cascade(parts, c, "c_custkey", F.col("c_mktsegment") == "BUILDING", F.lit("2024-01-01").cast("timestamp"))
    count = lambda n: live(got[n]).agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    return count("orders").unionByName(count("parents"))


def p29_config(spark, d):
    got = scan(spark, d, "events").select("event_id", L.stored_config(F.col("props"), {"k": "int", "model": "string"}).alias("c"))
    return got.select("event_id", F.col("c.k").cast("long").alias("k"), "c.model")


def v4_ids(spark, d):
    e, i = scan(spark, d, "events"), F.col("event_id")
    uuid = F.concat(F.lpad(F.hex(i), 8, "0"), F.lit("-0000-4000-8000-00000000000"), (i % 10).cast("string"))
    chunk = F.when(i % 4 == 0, uuid).when(i % 4 == 1, F.lit("not-a-uuid")).when(i % 4 == 2, F.lit("")).otherwise(F.lit("1-a-B-2-3"))
    ids = L.hit_ids(chunk, F.when(i % 5 == 0, F.lit(" ")).otherwise(F.col("event_type")), F.lit(None).cast("string"), uuid, F.when(i % 7 == 0, F.lit(" ")).otherwise(F.lit("x")))
    return e.select("event_id", ids.alias("i")).select("event_id", "i.chunk", "i.section", "i.table", "i.document")


def o10_contexts(spark, d):
    t = scan(spark, d, "conversations")
    kind = F.when(F.col("turn") % 5 == 4, F.lit(" Table_Summary")).otherwise(F.lit("text"))
    kinds = F.collect_set(F.when((F.col("turn") == 2) & (F.col("conv_id") % 3 == 0), F.lit("text_table_like")).otherwise(F.lit("text")))
    asked = F.when(F.col("conv_id") % 2 == 0, F.lit("TABLE_LOOKUP")).otherwise(F.lit("LIST_ALL"))
    got = t.groupBy("conv_id").agg(F.max(L.like_a_table(kind, F.col("text"))).alias("table_like"), kinds.alias("kinds"))
    return got.select("conv_id", "table_like", L.hint(asked, F.col("kinds")).alias("hint"))


def o11_texts(spark, d):
    got = scan(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("  "), "role", F.lit("\n")).alias("t"))))["t"].alias("ts"))
    return got.select("conv_id", F.array_join(L.first_texts(F.col("ts")), "|").alias("texts"))


def o13_failures(spark, d):
    i = F.col("event_id")
    cause = F.when(i % 3 == 0, F.lit("code: rate_limit_exceeded")).when(i % 3 == 1, F.lit("Rate limit reached"))
    got = scan(spark, d, "events").select("event_id", L.failure(F.array(F.col("event_type"), cause), F.when(i % 2 == 0, F.lit("IOException"))).alias("f"))
    return got.select("event_id", "f.code", "f.type")


def q9_variants(spark, d):
    t = scan(spark, d, "conversations").withColumn("v", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" ​"), F.upper("role"))).otherwise(F.col("role")))
    got = L.marked_variants(t.withColumn("key", L.variant_key(F.col("v"), F.lit("s"), F.lit(None).cast("string"))), "conv_id", "turn", "v", "key")
    return got.select("conv_id", "turn", "key", "skipped", "like")


def _apart(text):
    """The text with some of its letters as a base and its marks."""
    for whole, apart in APART.items():
        text = F.replace(text, F.lit(whole), F.lit(apart))
    return text


def q9_composed(spark, d):
    """Documents whose letters are taken apart, and one whose marks stand in either order, as keys of variants."""
    docs = scan(spark, d, "documents")
    mixed = F.concat(_apart(F.coalesce("text", F.lit(""))), F.when(F.col("doc_id") % 2 == 0, F.lit(" Vie\u0323\u0302t")).otherwise(F.lit(" Vie\u0302\u0323t")), F.lit(" x\u0301 \u00ea\u0323"))
    key = L.variant_key(mixed, F.lit("s"), F.lit("m"))
    return docs.select("doc_id", F.md5(key).alias("key"), F.length(key).cast("long").alias("chars"))


def q18_sure(spark, d):
    got = scan(spark, d, "events").select("event_id", L.classification(F.col("event_type"), F.col("value") / 50 - 0.5).alias("c"), L.classification(F.col("event_type")).alias("f"))
    return got.select("event_id", "c.kind", F.round("c.confidence", 9).alias("confidence"), F.col("f.confidence").alias("fallback"))


def x5_letters(spark, d):
    return scan(spark, d, "documents").select("doc_id", F.md5(L.plain_letters(F.concat(F.lit("ĐÂY LÀ Điều Ưu tiên. "), F.coalesce("text", F.lit(""))))).alias("plain"))


def x11_presets(spark, d):
    days = scan(spark, d, "events").select(F.to_date("ts").alias("today")).distinct()
    ranges = [days.select("today", F.lit(n).alias("name"), L.preset(n, F.col("today")).alias("r")) for n in ("7d", "30d", "month")]
    got = ranges[0].unionByName(ranges[1]).unionByName(ranges[2])
    return got.select(*[F.col(c).cast("string").alias(a) for c, a in (("today", "today"), ("name", "name"), ("r.from", "first"), ("r.to", "last"))])


def a11_holding(spark, d):
    return L.holding(scan(spark, d, "documents"), TERMS, "text")


def a22_total(spark, d):
    return scan(spark, d, "events").agg(F.count("*").alias("total"))


def r20_reranked(spark, d):
    e = scan(spark, d, "events").select(F.col("event_type").alias("question"), F.col("user_id").alias("key"), "event_id", F.when(F.col("event_type") != "click", F.round(F.col("value") / 100 + F.col("event_id") / 1e9, 9)).alias("score"))
    got = L.reranked(e, "question", "key", "event_id", "score", 10)
    return got.select("question", "key", F.col("place").cast("long").alias("place"), "max_score", "min_score")


def x23_previews(spark, d):
    return tables(spark, d).select("table_id", L.table_preview(R.parse_markdown(F.col("markdown"))["rows"]).alias("preview"))


def t27_names(spark, d):
    o, k = scan(spark, d, "orders"), F.col("o_orderkey")
    name = L.table_name(F.when(k % 4 == 0, F.concat(F.lit(" "), "o_orderpriority")), F.when(k % 4 == 1, F.lit("carried")).otherwise(F.lit(" ")), F.when(k % 4 == 2, F.col("o_orderstatus")), k % 3, k % 5)
    return o.select("o_orderkey", name.alias("name"))


def a24_headers(spark, d):
    p = scan(spark, d, "part").withColumn("names", F.array("p_name", F.concat_ws(" ", "p_name", "p_name"), F.lit("col_3"), F.lit(""), F.concat_ws(" ", "p_type", "p_brand", F.lit("of six words or more")), F.lit("Plain")))
    about = L.context_of_headers(F.array(F.concat(F.lit("Part:  "), "p_name"), F.lit("short: x"), F.concat(F.lit("Part: "), "p_name"), F.lit("long but has no colon")))
    got = p.select("p_partkey", L.header_figures(F.col("names")).alias("f"), about.alias("context"))
    return got.select("p_partkey", F.col("f.generic").cast("long").alias("generic"), F.round("f.words", 6).alias("words"), F.col("f.noisy").cast("long").alias("noisy"), "context")


def _cells(spark, d):
    """Each line of an order as a row of three cells, those of odd lines with coordinates; some begin with no number, some codes are none, some
    flags are blank."""
    l = scan(spark, d, "lineitem").withColumn("n", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1)
    number = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "No ").otherwise(""), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 3 == 1, ")").otherwise(""))
    code = F.concat(F.when(F.col("l_partkey") % 2 == 0, "AB-").otherwise("ab-"), F.col("l_partkey").cast("string"))
    texts = (number, code, F.when(F.col("l_suppkey") % 3 == 0, " ").otherwise(F.col("l_returnflag")))
    parts = F.array(*[F.struct(F.lit(i).alias("col"), t.alias("text")) for i, t in enumerate(texts)])
    rows = l.select(F.col("l_orderkey").alias("t"), F.col("n").alias("row"), "l_tax", "l_quantity", F.inline(parts))
    x = F.when((F.col("row") % 2 == 1) & (F.col("col") < 2), F.col("col") * 100 + F.col("l_quantity"))
    return rows.withColumn("x", x).withColumn("x_end", x + 10).withColumn("y", F.when(x.isNotNull(), F.col("row") * 20.0 + F.col("col")))


def a13_slots(spark, d):
    """Some orders have no cells in the second column."""
    got = L.slots(_cells(spark, d).filter("t % 5 > 0 OR col <> 1").withColumn("start", F.lit(2)), "t", "start")
    return got.select("t", F.col("col").cast("long").alias("col"), "s", "s_end")


def t24_values(spark, d):
    """The last two columns as one slot of three; the flag alone as one that may be blank, the third without any cell."""
    cells = _cells(spark, d).withColumn("slot", F.when(F.col("l_quantity") % 2 == 0, (F.col("col") > 0).cast("int")).otherwise(F.col("col").cast("int")))
    every = cells.select("t").distinct().withColumn("slot", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    got = L.slot_values(cells, ["t", "row"], "slot", "col", "text", every)
    return got.select("t", F.col("row").cast("long").alias("row"), F.col("slot").cast("long").alias("slot"), "value")


def t26_leading(spark, d):
    rows = _cells(spark, d).groupBy("t", "row").agg(F.collect_list(F.struct("col", "text", "y")).alias("cells"))
    return rows.select("t", F.col("row").cast("long").alias("row"), L.leading(F.col("cells")).alias("l")).select("t", "row", "l.number", "l.code", "l.y")


def w12_numbers(spark, d):
    e = scan(spark, d, "events").select("user_id", "event_type", "event_id")
    return L.row_numbers(e, "user_id", ["event_type", "event_id"]).select("event_id", F.col("row_number").cast("long").alias("row_number"))


QUERIES = {
    f.__name__: f
    for f in (k13_listing, j2_tenants, s19_of_deleted, s15_cascade, p29_config, v4_ids, o10_contexts, o11_texts, o13_failures, q9_variants, q9_composed, q18_sure, x5_letters, x11_presets, a11_holding, a22_total, r20_reranked, x23_previews, t27_names, a24_headers, a13_slots, t24_values, t26_leading, w12_numbers)
}

_CELLS = """
n AS (SELECT l_orderkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS row, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity FROM lineitem),
c AS (SELECT t, row, col, l_quantity, l_linenumber, l_partkey, CASE col WHEN 0 THEN CASE WHEN l_linenumber % 3 = 0 THEN 'No ' ELSE '' END || l_linenumber || CASE WHEN l_linenumber % 3 = 1 THEN ')' ELSE '' END
                WHEN 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 'AB-' ELSE 'ab-' END || l_partkey ELSE CASE WHEN l_suppkey % 3 > 0 THEN l_returnflag END END AS text,
             CASE WHEN row % 2 = 1 AND col < 2 THEN col * 100 + l_quantity END AS x FROM n, range(3) r(col))"""
_TERMS_SQL = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"

ORACLES = {
    "k13_listing": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'assistant'",
    "j2_tenants": "SELECT count(*) AS n, true AS joined FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 UNION ALL SELECT count(*), false FROM orders",
    "s19_of_deleted": "SELECT o_orderkey, c_acctbal >= 0 AS seen FROM orders JOIN customer ON o_custkey = c_custkey",
    "s15_cascade": """
SELECT 'orders' AS name, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'
UNION ALL SELECT 'parents', count(*) FROM customer WHERE c_mktsegment <> 'BUILDING'
""",
    "p29_config": "SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.model' AS model FROM events",
    "v4_ids": """
WITH e AS (SELECT *, lpad(printf('%X', event_id), 8, '0') || '-0000-4000-8000-00000000000' || event_id % 10 AS u FROM events)
SELECT event_id, CASE WHEN event_id % 7 > 0 THEN CASE event_id % 4 WHEN 0 THEN u WHEN 3 THEN '1-a-B-2-3' END END AS chunk, CASE WHEN event_id % 7 > 0 AND event_id % 5 > 0 THEN event_type END AS section,
       NULL::VARCHAR AS table, CASE WHEN event_id % 7 > 0 THEN u END AS document FROM e
""",
    "o10_contexts": """
SELECT conv_id, bool_or(turn % 5 = 4 OR len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2)) > 0) AS table_like,
       CASE WHEN conv_id % 3 = 0 AND bool_or(turn = 2) THEN CASE WHEN conv_id % 2 = 0 THEN 'TABLE_LOOKUP' ELSE 'TABLE_LIKE' END WHEN conv_id % 2 = 0 THEN 'TABLE_LOOKUP' ELSE 'LIST_ALL' END AS hint FROM conversations GROUP BY 1
""",
    "o11_texts": "SELECT conv_id, string_agg(role, '|' ORDER BY first) AS texts FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY 1",
    "o13_failures": """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'rate_limit_exceeded' END AS code,
       CASE WHEN event_id % 3 = 0 THEN 'tokens' WHEN event_id % 3 = 1 THEN 'rate_limit' WHEN event_id % 2 = 0 THEN 'IOException' ELSE 'error' END AS type FROM events
""",
    "q9_variants": """
WITH v AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN ' ' || chr(8203) || upper(role) ELSE role END AS v FROM conversations)
SELECT conv_id, turn, role || '|s|' AS key, row_number() OVER w > 1 AS skipped, CASE WHEN row_number() OVER w > 1 THEN first_value(v) OVER w END AS like FROM v WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)
""",
    "q9_composed": """
WITH t AS (SELECT doc_id, {} || CASE WHEN doc_id % 2 = 0 THEN ' Vie' || chr(803) || chr(770) || 't' ELSE ' Vie' || chr(770) || chr(803) || 't' END || ' x' || chr(769) || ' ê' || chr(803) AS t FROM documents),
     k AS (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(nfc_normalize(t), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')), '\\s+', ' ', 'g')) || '|s|m' AS k FROM t)
SELECT doc_id, md5(k) AS key, length(k) AS chars FROM k
""".format("replace(" * len(APART) + "coalesce(text, '')" + "".join(f", '{w}', '{a}')" for w, a in APART.items())),
    "q18_sure": "SELECT event_id, event_type AS kind, round(greatest(0, least(1, value / 50 - 0.5)), 9) AS confidence, 0.5::DOUBLE AS fallback FROM events",
    "x5_letters": "SELECT doc_id, md5('day la dieu uu tien. ' || " + "translate(lower(coalesce(text, '')), '" + "".join(L.MARKED.values()) + "', '" + "".join(b * len(m) for b, m in L.MARKED.items()) + "')) AS plain FROM documents",
    "x11_presets": """
WITH d AS (SELECT DISTINCT ts::DATE AS today FROM events)
SELECT today::VARCHAR AS today, name, (CASE name WHEN '7d' THEN today - 6 WHEN '30d' THEN today - 29 ELSE date_trunc('month', today)::DATE END)::VARCHAR AS first, today::VARCHAR AS last FROM d, (VALUES ('7d'), ('30d'), ('month')) n(name)
""",
    "a11_holding": f"SELECT term, count(doc_id) AS df FROM (SELECT unnest({_TERMS_SQL}) AS term) LEFT JOIN documents ON contains(text, term) GROUP BY 1",
    "a22_total": "SELECT count(*) AS total FROM events",
    "r20_reranked": """
WITH f AS (SELECT event_type AS question, user_id AS key, event_id, CASE WHEN event_type <> 'click' THEN round(value / 100 + event_id / 1e9, 9) END AS score FROM events),
     u AS (SELECT * FROM f WHERE question <> 'click' QUALIFY row_number() OVER (PARTITION BY question, key ORDER BY event_id) = 1),
     m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY question ORDER BY event_id) <= 50),
     r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, event_id) AS place FROM m QUALIFY place <= 10)
SELECT question, key, place, greatest(0, max(score) OVER w) AS max_score, min(score) OVER w AS min_score FROM r WINDOW w AS (PARTITION BY question)
UNION ALL SELECT question, key, row_number() OVER (ORDER BY event_id), 1, 0 FROM f WHERE question = 'click'
""",
    "x23_previews": """
WITH l AS (SELECT l_orderkey AS t, l_linenumber AS n, l_partkey AS k, l_returnflag AS f, l_quantity::INTEGER::VARCHAR AS q, CASE WHEN l_partkey % 7 = 0 THEN 2 ELSE 1 END AS rows,
                  CASE WHEN l_partkey % 7 = 0 THEN 'Group: ' || l_returnflag || ' / ' ELSE '' END AS g, concat_ws(' | ', CASE WHEN l_partkey % 5 > 0 THEN l_partkey::VARCHAR END, l_quantity::INTEGER::VARCHAR, l_returnflag || l_linestatus) AS line FROM lineitem),
     e AS (SELECT t, n, k, f, q, line, 0 AS part, trim(replace(g, ' / ', '')) AS x FROM l WHERE g <> '' UNION ALL SELECT t, n, k, f, q, line, 1, line FROM l),
     r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n, k, f, q, line, part) AS i FROM e)
SELECT t AS table_id, ('Part | Quantity | Flag / ' || string_agg(x, ' / ' ORDER BY i))[1:200] AS preview FROM r WHERE i <= 2 GROUP BY 1
""",
    "t27_names": """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'carried' WHEN 2 THEN o_orderstatus
  ELSE 'Table page ' || greatest(o_orderkey % 3, 1) || ' #' || (o_orderkey % 5 + 1) END AS name FROM orders
""",
    "a24_headers": """
WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS a, len(string_split(p_type, ' ')) + len(string_split(p_brand, ' ')) + 5 AS b FROM part)
SELECT p_partkey, 1::BIGINT AS generic, round((3 * len(a) + 2 + b) / 6, 6) AS words, (2 + (len(list_distinct(a)) < len(a) OR len(a) >= 6)::INTEGER)::BIGINT AS noisy,
       CASE WHEN len(a) >= 2 AND length('Part: ' || p_name) >= 12 THEN 'Part: ' || p_name ELSE '' END AS context FROM w
""",
    "a13_slots": f"""WITH {_CELLS},
g AS (SELECT t, col, min(x) FILTER (row >= 2) AS a, max(x + 10) FILTER (row >= 2) AS b, min(x) AS c, max(x + 10) AS d FROM c GROUP BY ALL)
SELECT t, col, CASE WHEN t % 5 = 0 AND col = 1 THEN col ELSE coalesce(a, c, col) END::DOUBLE AS s, CASE WHEN t % 5 = 0 AND col = 1 THEN 2 WHEN a IS NOT NULL THEN b WHEN c IS NOT NULL THEN d ELSE col + 1 END::DOUBLE AS s_end FROM g""",
    "t24_values": f"""WITH {_CELLS}, e AS (SELECT DISTINCT t, row, slot FROM c, range(4) r(slot)),
g AS (SELECT t, row, CASE WHEN l_quantity % 2 = 0 THEN (col > 0)::BIGINT ELSE col END AS slot, string_agg(text, ' ' ORDER BY col) AS value FROM c GROUP BY ALL)
SELECT t, row, slot, coalesce(value, '') AS value FROM e LEFT JOIN g USING (t, row, slot)""",
    "t26_leading": f"WITH {_CELLS} SELECT DISTINCT t, row, l_linenumber % 3 > 0 AS number, l_partkey % 2 = 0 AS code, CASE WHEN row % 2 = 1 THEN row * 20.0 ELSE 0 END::DOUBLE AS y FROM c",
    "w12_numbers": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS row_number FROM events",
}
