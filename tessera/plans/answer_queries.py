"""Registered queries of row scores, answers, figures and streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import answers as O
from ..operators import cells as C
from ..operators import signals as S
from ..operators import table_rows as R
from ..sources.tables import scan, shared_dir, written
from ..streaming import activity as Z
from .ingest_queries import tables

#: What stands around the turns of conversations, by turn, to make answers of them: (before, after).
ANSWERS = [
    ("", " Không tìm thấy thông tin. AB-123"), ("K-1 ", " KHÔNG CÓ TRONG TÀI LIỆU"), ("1. ", "\n2. a\nkhông có thông tin"), ("không có thông tin\n", "\n 3. b"), ("x: 1\ny: 2\n", "\nz: 3"), ("", ""),
]
PREAMBLES = ["Theo Source 12, ", "  Dựa trên nguồn: ", "theo nguồn 3 – \n", "Theo tài liệu 1, ", "   ", "Dựa vào SOURCE7. "]


def _around(pairs, text):
    """The text with what the pair of its turn puts before and after it."""
    pick = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in pairs]), (F.col("turn") % len(pairs) + 1).cast("int"))
    return F.concat(pick(0), text, pick(1))


def c1_cells(spark, d):
    rows = R.normalized_rows(tables(spark, d), "markdown", "table_id")
    asked = S.with_signals(spark.createDataFrame([("Which part has quantity 17 and flag NO?",), ("part 155 of group r",)], "question string"), "question")
    # Written: the names of all columns are looked at first.
    rows = written(rows.select("table_id", "row_index", "group_context", "cells"), "rows").withColumn("plain", C.plain_cells(F.col("cells"), F.col("group_context"), F.lit("")))
    both = C.with_heads(rows, asked.withColumn("terms", C.asked_terms()), F.col("terms"))
    scored = both.withColumn("s", C.score(F.col("cells"), F.col("group_context"), F.lit(""), F.col("terms"), F.col("plain"), F.col("_heads")))
    return scored.select("question", "table_id", F.col("row_index").cast("long").alias("row_index"), F.round("s.total", 6).alias("total"), "s.codes", "s.labels", "s.conflicts", "s.phrases", "s.exact")


def o1_refusals(spark, d):
    t = scan(spark, d, "conversations").withColumn("answer", _around(ANSWERS, F.col("text")))
    return t.select("conv_id", "turn", O.refusal(F.col("answer")).alias("r"), O.substantive(F.col("answer")).alias("substantive")).select("conv_id", "turn", "r.refuses", "r.leads", "substantive")


def o3_preamble(spark, d):
    raw = _around([(p, "") for p in PREAMBLES], F.col("text"))
    return scan(spark, d, "conversations").select("conv_id", "turn", O.without_preamble(raw).alias("cleaned"))


def o6_prompts(spark, d):
    t = scan(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("question"), "turn", F.concat("role", F.lit(": "), "text").alias("block"))
    return O.prompts(t, "question", "turn", "block")


def o6_full(spark, d):
    """Each turn of a user as a question, the turns around it in its conversation as contexts, every other one a row, and those before it as history."""
    t = scan(spark, d, "conversations")
    of = lambda c: F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col(c).cast("string"))
    asked = t.filter("role = 'user'").withColumn("question", of("turn"))
    kind = F.when(F.col("turn") % 3 == 0, "LIST_ALL").when(F.col("turn") % 3 == 1, "NORMAL_FACT").otherwise(" ")
    questions = asked.select("question", "text", kind.alias("kind"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Part "), "turn")).alias("scope"))
    pairs = asked.select("question", "conv_id", F.col("turn").alias("asked_at")).join(t, "conv_id")
    cells = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in ((" Role ", F.col("role")), ("Nothing", F.lit(" ")), ("Turn", F.col("turn").cast("string")))])
    near = pairs.filter("abs(turn - asked_at) = 1")
    contexts = near.select(
        "question", F.col("turn").alias("rank"), F.when(F.col("turn") % 4 > 0, F.concat(F.lit("f"), "turn")).alias("file"), F.lit("H").alias("heading"), F.col("turn").alias("page_start"), (F.col("turn") + 1).alias("page_end"),
        F.when(F.col("turn") % 4 < 2, "normalized_table_row").otherwise("text").alias("chunk_type"), F.col("text").alias("content"), cells.alias("cells"), F.when(F.col("turn") % 4 == 0, "Turns").alias("table_name"), F.col("turn").alias("row_index"),
        F.lit(" ").alias("group_context"),
    )
    history = pairs.filter("turn < asked_at AND turn >= asked_at - 2").select("question", F.col("turn").alias("at"), "role", "text")
    return O.full_prompts(questions, contexts, history, "Only this part.", {"LIST_ALL": "List all."}, "Rows are single.")


def o7_pipes(spark, d):
    return scan(spark, d, "documents").select("doc_id", O.has_pipe_table(F.col("text")).alias("table"))


def a19_figures(spark, d):
    t = scan(spark, d, "conversations").withColumn("a_ms", F.col("turn") * 7 - 10).withColumn("b_ms", F.col("conv_id") % 13)
    return O.request_figures(t, ["a_ms", "b_ms"], ["text"]).select("conv_id", "turn", F.col("total_ms").cast("long").alias("total_ms"), F.col("chars").cast("long").alias("chars"), F.col("tokens").cast("long").alias("tokens"))


def z4_daily_stream(spark, d):
    """The daily series as a stream over the events, read to its end."""
    base = f"{shared_dir(spark)}/tessera/stream-{uuid.uuid4().hex}"
    schema = scan(spark, d, "events").schema
    rows = Z.daily_counts(spark.readStream.schema(schema).parquet(f"{d}/events.parquet*"))
    Z.latest_result(rows, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.col("day").cast("string").alias("day"), "messages")


QUERIES = {f.__name__: f for f in (c1_cells, o1_refusals, o3_preamble, o6_prompts, o6_full, o7_pipes, a19_figures, z4_daily_stream)}


def _sql(pairs) -> str:
    quoted = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"
    return "CASE turn % " + str(len(pairs)) + " " + " ".join(f"WHEN {i} THEN {quoted(a)} || text || {quoted(b)}" for i, (a, b) in enumerate(pairs)) + " END"


ORACLES = {
    "o3_preamble": f"""
WITH t AS (SELECT conv_id, turn, {_sql([(p, "") for p in PREAMBLES])} AS x FROM conversations),
     b AS (SELECT *, regexp_replace(x, '^\\s+', '') AS y FROM t),
     m AS (SELECT *, regexp_replace(y, '(?is)^(theo\\s+(source|nguồn)\\s*\\d*|dựa\\s+(trên|vào)\\s+(source|nguồn)\\s*\\d*)\\s*[-,:.–—]\\s*', '') AS z FROM b)
SELECT conv_id, turn, CASE WHEN z <> y THEN regexp_replace(z, '^\\s+', '') ELSE x END AS cleaned FROM m
""",
    "o1_refusals": f"""
WITH t AS (SELECT conv_id, turn, {_sql(ANSWERS)} AS x FROM conversations),
     p AS (SELECT *, list_min(list_filter(list_transform(['không tìm thấy thông tin này trong tài liệu', 'không có trong tài liệu', 'không tìm thấy thông tin', 'không có thông tin'],
                       lambda m: strpos(lower(x), m)), lambda i: i > 0)) AS pos,
             length(regexp_extract(x, '(?s)^(.*?)\\b[A-Z][A-Z0-9]*-\\d+\\b', 1)) + 1 AS code, regexp_matches(x, '\\b[A-Z][A-Z0-9]*-\\d+\\b') AS has_code,
             length(regexp_extract(x, '(?sm)\\A(.*?)^\\s*\\d+\\.\\s+\\S', 1)) + 1 AS item, regexp_matches(x, '(?m)^\\s*\\d+\\.\\s+\\S') AS has_item FROM t)
SELECT conv_id, turn, pos IS NOT NULL AS refuses, pos IS NOT NULL AND NOT (has_code AND code < pos) AND NOT (has_item AND item < pos) AS leads,
       has_code OR has_item OR len(list_filter(string_split_regex(x, '\\r\\n|\\r|\\n'), lambda l: contains(l, ':'))) >= 3 AS substantive FROM p
""",
    "o6_prompts": """
WITH b AS (SELECT conv_id, '[' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '] ' || role || ': ' || text AS b, turn FROM conversations)
SELECT conv_id::VARCHAR AS question, concat_ws(chr(10) || chr(10), 'Answer from the passages.', string_agg(b, chr(10) || chr(10) ORDER BY turn), conv_id::VARCHAR) AS prompt FROM b GROUP BY conv_id
""",
    "o6_full": """
WITH n AS (SELECT conv_id || '-' || turn AS question, * FROM conversations WHERE role = 'user'),
p AS (SELECT n.question, n.turn AS asked_at, t.* FROM n JOIN conversations t USING (conv_id)),
b AS (SELECT question, turn, turn % 4 < 2 AS is_row, 'Document: ' || CASE WHEN turn % 4 > 0 THEN 'f' || turn ELSE '' END || chr(10) || 'Section: H' || chr(10) || 'Pages: ' || turn || '-' || (turn + 1) || chr(10) || 'Type: '
             || CASE WHEN turn % 4 < 2 THEN 'normalized_table_row' ELSE 'text' END || chr(10) || chr(10) || 'Content:' || chr(10) || CASE WHEN turn % 4 < 2 THEN CASE WHEN turn % 4 = 0 THEN 'Table: Turns' || chr(10) ELSE '' END
             || 'Row: ' || turn || chr(10) || 'Cells:' || chr(10) || '- Role: ' || role || chr(10) || '- Turn: ' || turn ELSE text END || chr(10) || chr(10) AS b FROM p WHERE abs(turn - asked_at) = 1),
c AS (SELECT question, bool_or(is_row) AS has_row, string_agg('[Source ' || i || ']' || chr(10) || b, '' ORDER BY turn) AS blocks FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY turn) AS i FROM b) GROUP BY 1),
h AS (SELECT question, string_agg(CASE WHEN role = 'user' THEN 'Người dùng' ELSE 'Trợ lý' END || ': ' || text || chr(10), '' ORDER BY turn) AS turns FROM p WHERE turn < asked_at AND turn >= asked_at - 2 GROUP BY 1)
SELECT question, CASE WHEN conv_id % 2 = 0 THEN '[PHẠM VI TÌM KIẾM ĐÃ XÁC ĐỊNH: Part ' || turn || ']' || chr(10) || 'Only this part.' || chr(10) || chr(10) ELSE '' END
  || CASE turn % 3 WHEN 0 THEN '[LOẠI CÂU HỎI: LIST_ALL]' || chr(10) || 'List all.' || chr(10) || chr(10) WHEN 1 THEN '[LOẠI CÂU HỎI: NORMAL_FACT]' || chr(10) || chr(10) || chr(10) ELSE '' END
  || CASE WHEN has_row THEN 'Rows are single.' || chr(10) || chr(10) ELSE '' END || '[TÀI LIỆU THAM KHẢO]' || chr(10) || coalesce(blocks, '')
  || coalesce('[LỊCH SỬ HỘI THOẠI]' || chr(10) || turns || chr(10), '') || '[CÂU HỎI HIỆN TẠI]' || chr(10) || text AS prompt FROM n LEFT JOIN c USING (question) LEFT JOIN h USING (question)
""",
    "o7_pipes": "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2)) > 0 AS table FROM documents",
    "a19_figures": """
SELECT conv_id, turn, (greatest(turn * 7 - 10, 0) + greatest(conv_id % 13, 0))::BIGINT AS total_ms, length(text) AS chars, ceil(length(text) / 4)::BIGINT AS tokens FROM conversations
""",
    "z4_daily_stream": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS messages FROM events GROUP BY 1",
}
