"""Registered queries of the conversation analytics and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import activity as A
from ..sources.tables import only, scan, soft_delete, without

FIRST, LAST = date(2024, 1, 16), date(2024, 1, 31)


def events(spark, d):
    """Events as messages: the user is the session, the type the bot."""
    return scan(spark, d, "events")


def turns(spark, d):
    return scan(spark, d, "conversations")


def _pairs(spark, d, **how):
    return A.answered_pairs(turns(spark, d), ["conv_id", "turn"], "conv_id", "role", "text", **how)


def a1_summary(spark, d):
    return A.summary(events(spark, d), FIRST, LAST, "ts", "user_id")


def a3_daily(spark, d):
    return A.daily(events(spark, d), date(2024, 1, 1), LAST, "ts", "user_id").select(F.col("day").cast("string").alias("day"), "messages", "sessions")


def a4_shares(spark, d):
    return A.shares(events(spark, d), "event_type", "ts")


def a5_top_nations(spark, d):
    o, c, n = scan(spark, d, "orders"), scan(spark, d, "customer"), scan(spark, d, "nation")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return A.top(joined, ["n_nationkey", "n_name"], 5)


def a6_dashboard(spark, d):
    end = date(2024, 1, 30)
    now, before = A.between_closed("ts", date(2024, 1, 23), end), A.between_closed("ts", date(2024, 1, 16), date(2024, 1, 23))
    e = events(spark, d).agg(
        F.countDistinct("event_type").alias("bots"), F.count(F.when(now, 1)).alias("messages"), F.count(F.when(before, 1)).alias("messages_before")
    )
    return e.withColumn("messages_delta", X.delta_percent("messages", "messages_before"))


def a8_unanswered(spark, d):
    pairs = _pairs(spark, d, newest=None, per_session=True)
    return A.unanswered(pairs, ["turn"], 20, hints=("the", "de la"))


def a9_counts(spark, d):
    return turns(spark, d).groupBy("conv_id", "role").agg(F.count("*").alias("n"))


def a18_parity(spark, d):
    return A.parity(scan(spark, d, "documents").select("doc_id"), scan(spark, d, "labels").select("doc_id"), "doc_id")


def a23_domains(spark, d):
    url = scan(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("domain"))
    return url.filter("domain != ''").distinct()


def w1_pairs(spark, d):
    return _pairs(spark, d)


def w2_last_turn(spark, d):
    return A.last_turns(turns(spark, d), "conv_id", "turn", "text")


def w3_first_turns(spark, d):
    return A.first_turns(turns(spark, d), "conv_id", "turn", 3).select("conv_id", "turn", "role", F.col("nth").cast("long").alias("nth"))


def u1_feed(spark, d):
    orders = scan(spark, d, "orders").withColumn("title", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    events_ = events(spark, d).withColumn("title", F.concat(F.lit("event "), F.col("event_id").cast("string")))
    ships = scan(spark, d, "lineitem").withColumn("title", F.concat_ws(" ", F.lit("line"), "l_orderkey", "l_linenumber"))
    out = A.feed(50, order=(orders, "o_orderdate", "title"), event=(events_, "ts", "title"), ship=(ships, "l_shipdate", "title"))
    return out.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


def k1_latest(spark, d):
    return A.latest(events(spark, d), "ts", 50, "event_id").select("event_id", "user_id", "event_type")


def k2_page(spark, d):
    rows = scan(spark, d, "customer").filter(A.all_of(F.col("c_mktsegment") == "BUILDING", None, F.col("c_acctbal") > 0))
    return A.page(rows, [F.desc("c_acctbal"), F.col("c_custkey")], 1, 20).select("c_custkey", "c_name", F.col("total").cast("long").alias("total"), F.col("pages").cast("long").alias("pages"))


def k12_transcript(spark, d):
    return turns(spark, d).filter("conv_id = 7").select("turn", F.coalesce(F.lower("role"), F.lit("user")).alias("role"), "text").orderBy("turn")


def j3_top_with_domain(spark, d):
    best = A.top(scan(spark, d, "orders"), ["o_custkey"], 10)
    c = scan(spark, d, "customer").filter("c_acctbal > 0")
    return best.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_custkey", "n", F.when(F.col("c_custkey").isNull(), "INACTIVE").otherwise("ACTIVE").alias("status"), "c_name")


def j4_counts_beside(spark, d):
    o, s = scan(spark, d, "orders"), scan(spark, d, "supplier")
    rows = scan(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    customers = scan(spark, d, "customer")
    return A.counts_beside(rows, "nation", customers=(customers, "c_nationkey"), suppliers=(s, "s_nationkey"), orders=(o.join(customers, o.o_custkey == customers.c_custkey), "c_nationkey"))


def j5_chunks_of(spark, d):
    wanted = scan(spark, d, "labels").filter("quality = 0")
    return only(scan(spark, d, "documents"), wanted, ["doc_id"]).select("doc_id", "source")


def j15_tenants_with_rows(spark, d):
    n = scan(spark, d, "nation").withColumnRenamed("n_nationkey", "k")
    return only(n, scan(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("k")), ["k"]).orderBy("k").limit(20).select("k", "n_name")


def s14_purge(spark, d):
    gone = scan(spark, d, "labels").filter("toxic = 1")
    return without(scan(spark, d, "documents"), gone, ["doc_id"]).groupBy("source").agg(F.count("*").alias("n"))


def s15_soft_delete(spark, d):
    o = soft_delete(scan(spark, d, "orders"), F.col("o_orderstatus") == "F", F.lit("2024-02-01").cast("timestamp"))
    return o.groupBy(F.col("deleted_at").isNull().alias("live")).agg(F.count("*").alias("n"))


def p4_search(spark, d):
    like = F.concat(F.lit("%"), F.lower(F.lit("Customer#00000_1")), F.lit("%"))
    props = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    a = scan(spark, d, "customer").filter(F.like(F.lower("c_name"), like)).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("hit"))
    b = events(spark, d).filter(props.like("%42%")).select(F.col("event_id").alias("id"), props.alias("hit"))
    return a.unionByName(b)


def p8_status(spark, d):
    o = scan(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "INDEXED").when(F.col("o_orderstatus") == "O", "PROCESSING").otherwise("FAILED")
    progress = F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "O", 50).otherwise(0)
    return o.groupBy(status.alias("status"), progress.cast("long").alias("progress")).agg(F.count("*").alias("n"))


def p12_initials(spark, d):
    return scan(spark, d, "customer").select("c_custkey", X.initials("c_mktsegment").alias("initials"), X.page_range("c_nationkey", F.nullif(F.col("c_nationkey") % 3, F.lit(0))).alias("pages"))


def p14_settings(spark, d):
    k = F.get_json_object("props", "$.k")
    return events(spark, d).select("event_id", X.number_or(k, "int", 10, 1, 100).cast("long").alias("top_n"))


def p24_json_text(spark, d):
    return events(spark, d).select("event_id", X.json_text("props", "$.k").alias("k"), X.json_text("props", "$.none").alias("none"))


def x1_round(spark, d):
    v = F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")) / 100 - 100
    return scan(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), X.round1(v).alias("v"))


QUERIES = {f.__name__: f for f in (a1_summary, a3_daily, a4_shares, a5_top_nations, a6_dashboard, a8_unanswered, a9_counts, a18_parity, a23_domains, w1_pairs, w2_last_turn, w3_first_turns, u1_feed, k1_latest, k2_page, k12_transcript, j3_top_with_domain, j4_counts_beside, j5_chunks_of, j15_tenants_with_rows, s14_purge, s15_soft_delete, p4_search, p8_status, p12_initials, p14_settings, p24_json_text, x1_round)}

_DELTA = "CASE WHEN {b} <= 0 THEN CASE WHEN {a} > 0 THEN 100.0 ELSE 0.0 END ELSE floor(({a} - {b}) * 100.0::DOUBLE / {b} * 10 + 0.5) / 10.0 END"

ORACLES = {
    "a1_summary": f"""
WITH s AS (SELECT count(*) FILTER (ts >= '2024-01-16') AS messages, count(DISTINCT user_id) FILTER (ts >= '2024-01-16') AS sessions,
                  count(*) FILTER (ts < '2024-01-16') AS messages_before, count(DISTINCT user_id) FILTER (ts < '2024-01-16') AS sessions_before
           FROM events WHERE ts >= '2023-12-31' AND ts < '2024-02-01')
SELECT *, {_DELTA.format(a='messages', b='messages_before')}::DOUBLE AS messages_delta,
       {_DELTA.format(a='sessions', b='sessions_before')}::DOUBLE AS sessions_delta, 0.0::DOUBLE AS fallback_rate FROM s
""",
    "a3_daily": """
SELECT strftime(d.day, '%Y-%m-%d') AS day, count(event_id) AS messages, count(DISTINCT user_id) AS sessions
FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) d(day)
LEFT JOIN events ON ts >= d.day AND ts < d.day + INTERVAL 1 DAY GROUP BY d.day
""",
    "a4_shares": """
SELECT event_type AS bot, count(*) AS messages, floor(count(*) * 100.0::DOUBLE / sum(count(*)) OVER () * 10 + 0.5) / 10.0 AS share FROM events GROUP BY 1
""",
    "a5_top_nations": """
SELECT n_nationkey, n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5
""",
    "a6_dashboard": f"""
WITH s AS (SELECT count(DISTINCT event_type) AS bots, count(*) FILTER (ts BETWEEN '2024-01-23' AND '2024-01-30') AS messages,
                  count(*) FILTER (ts BETWEEN '2024-01-16' AND '2024-01-23') AS messages_before FROM events)
SELECT *, {_DELTA.format(a='messages', b='messages_before')}::DOUBLE AS messages_delta FROM s
""",
    "a8_unanswered": """
WITH p AS (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
     q AS (SELECT trim(question, chr(9) || chr(10) || chr(13) || ' ') AS question, turn, conv_id FROM p
           WHERE role = 'user' AND next_role = 'assistant' AND (contains(replace(strip_accents(lower(answer)), 'đ', 'd'), 'the')
              OR contains(replace(strip_accents(lower(answer)), 'đ', 'd'), 'de la')))
SELECT question, count(*) AS times, arg_min(conv_id, (turn, conv_id)) AS first_session FROM q WHERE question <> '' GROUP BY 1
ORDER BY times DESC, min((turn, conv_id)) LIMIT 20
""",
    "a9_counts": "SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL",
    "a18_parity": """
WITH a AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1)
SELECT doc_id, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows, coalesce(a.n, 0) = coalesce(b.n, 0) AS equal FROM a FULL JOIN b USING (doc_id)
""",
    "a23_domains": "SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS domain FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/?#]+')",
    "w1_pairs": """
WITH t AS (SELECT * FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 500),
     p AS (SELECT conv_id, turn, lower(role) AS role, text AS question, lead(conv_id) OVER w AS c, lower(lead(role) OVER w) AS r, lead(text) OVER w AS answer
           FROM t WINDOW w AS (ORDER BY conv_id, turn))
SELECT conv_id AS session, question, answer, conv_id, turn FROM p WHERE role = 'user' AND r = 'assistant' AND conv_id = c
""",
    "w2_last_turn": "SELECT conv_id AS session, count(*) AS turns, arg_max(text, turn) AS last_text FROM conversations GROUP BY 1",
    "w3_first_turns": "SELECT * FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations) WHERE nth <= 3",
    "u1_feed": """
WITH a AS (SELECT 'order' AS kind, o_orderdate AS "at", 'order ' || o_orderkey AS title FROM orders UNION ALL
           SELECT 'event', ts, 'event ' || event_id FROM events UNION ALL
           SELECT 'ship', l_shipdate, 'line ' || l_orderkey || ' ' || l_linenumber FROM lineitem),
     r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY a."at" DESC, title) AS n FROM a)
SELECT kind, strftime("at", '%Y-%m-%d %H:%M:%S') AS "at", title FROM (SELECT * FROM r WHERE n <= 50 ORDER BY "at" DESC, kind, title LIMIT 50)
""",
    "k1_latest": "SELECT event_id, user_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)",
    "k2_page": """
WITH r AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)
SELECT c_custkey, c_name, (SELECT count(*) FROM r) AS total, (SELECT (count(*) + 19) // 20 FROM r) AS pages FROM r ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20
""",
    "k12_transcript": "SELECT turn, coalesce(lower(role), 'user') AS role, text FROM conversations WHERE conv_id = 7",
    "j3_top_with_domain": """
WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10)
SELECT o_custkey, n, CASE WHEN c_custkey IS NULL THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, c_name FROM t LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
""",
    "j4_counts_beside": """
SELECT n_nationkey AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers,
       (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers,
       (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS orders FROM nation
""",
    "j5_chunks_of": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "j15_tenants_with_rows": "SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) ORDER BY 1 LIMIT 20",
    "s14_purge": "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1",
    "s15_soft_delete": "SELECT o_orderstatus <> 'F' AS live, count(*) AS n FROM orders GROUP BY 1",
    "p4_search": """
SELECT c_custkey AS id, c_name AS hit FROM customer WHERE lower(c_name) LIKE '%customer#00000_1%' UNION ALL
SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') FROM events WHERE coalesce(json_extract_string(props, '$.k'), '') LIKE '%42%'
""",
    "p8_status": """
SELECT CASE o_orderstatus WHEN 'F' THEN 'INDEXED' WHEN 'O' THEN 'PROCESSING' ELSE 'FAILED' END AS status,
       CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 50 ELSE 0 END::BIGINT AS progress, count(*) AS n FROM orders GROUP BY 1, 2
""",
    "p12_initials": """
SELECT c_custkey, upper(c_mktsegment[1:2]) AS initials,
       CASE WHEN c_nationkey % 3 = 0 OR c_nationkey % 3 = c_nationkey THEN c_nationkey::VARCHAR ELSE c_nationkey || '-' || c_nationkey % 3 END AS pages FROM customer
""",
    "p14_settings": "SELECT event_id, least(greatest(coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 10), 1), 100)::BIGINT AS top_n FROM events",
    "p24_json_text": "SELECT event_id, nullif(trim(json_extract_string(props, '$.k')), '') AS k, nullif(trim(json_extract_string(props, '$.none')), '') AS none FROM events",
    "x1_round": """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, floor((l_extendedprice * (1 - l_discount) / 100 - 100) * 10 + 0.5) / 10.0 AS v FROM lineitem
""",
}
