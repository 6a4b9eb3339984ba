"""What larger tables showed: steps that were done twice or shuffled without need."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.operators import cells as C
from tessera.operators import chunks as H
from tessera.operators import continued as N
from tessera.operators import coordinates as P
from tessera.operators import expansion as E
from tessera.operators import keywords as K
from tessera.operators import listings as L
from tessera.operators import signals as S
from tessera.operators import table_rows as R
from tessera.plans import retrieval_queries as Q


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def pipe_tables(spark):
    text = F.concat(F.lit("| Part | Size |\n|---|---|\n| Group: a | |\n| P"), F.col("id").cast("string"), F.lit(" | 7 |\n| | more |\n| Q1 | 8 |"))
    return spark.range(20).select(F.col("id").alias("t"), text.alias("markdown"))


def asked(spark):
    rows = [("q", "all", "part P12 of size 7 and group a"), ("none", "all", "nothing")]
    return S.with_signals(spark.createDataFrame(rows, "question string, tenant string, text string"), "text")


def test_rows_of_a_table_are_parsed_once_and_not_shuffled(spark):
    got = R.normalized_rows(pipe_tables(spark), "markdown", "t")
    # The lines of a table are told from the rest of its text in one place of the plan.
    assert optimized(got).count(r"\|.*\|") == 1
    # A range lies by its key already.
    assert "Exchange" not in planned(got)
    rows = {(r.t, r.row_index): (r.group_context, r.row_text, r.cells_json) for r in got.collect()}
    assert len(rows) == 40
    assert rows[3, 1] == ("Group: a", "Part: P3; Size: 7 more", '{"part":"P3","size":"7 more"}')
    assert rows[3, 2] == ("Group: a", "Part: Q1; Size: 8", '{"part":"Q1","size":"8"}')


def test_terms_of_a_question_are_made_once_for_cell_scores(spark):
    rows = R.normalized_rows(pipe_tables(spark), "markdown", "t")
    both = rows.join(F.broadcast(asked(spark).withColumn("terms", C.asked_terms())))
    none = F.lit("")
    got = both.select("question", "t", "row_index", C.score(F.col("cells"), F.col("group_context"), none, F.col("terms"))["total"].alias("a"), C.score(F.col("cells"), F.col("group_context"), none)["total"].alias("b")).collect()
    assert len(got) == 80 and all(r.a == r.b for r in got) and len({r.a for r in got}) > 2


def test_scores_are_worked_out_once(spark):
    rows = R.normalized_rows(pipe_tables(spark), "markdown", "t")
    chunks = rows.select(F.concat_ws("-", "t", "row_index").alias("row"), F.lit("all").alias("tenant"), F.col("row_text").alias("content"), "cells", F.lit("normalized_table_row").alias("chunk_type"))
    got = K.fallback_search(chunks, asked(spark), "row", "tenant")
    assert optimized(got).count(K.DATE_LIKE) == 1
    assert got.filter("question = 'q'").orderBy("nth").first().key == "12-1"


def test_words_become_cells_by_one_shuffle_and_without_sorts(spark):
    word = lambda t, x, y: F.struct(F.lit(t).alias("text"), F.lit(float(x)).alias("x"), F.lit(x + 8.0).alias("x_end"), F.lit(float(y)).alias("y"), F.lit(y + 10.0).alias("y_end"))
    words = spark.range(6).repartition(3).select(F.col("id").alias("t"), F.inline(F.array(word("b", 10, 0), word("a", 0, 1), word("c", 40, 20), word(" ", 60, 0))))
    got = P.cells_of_words(words, ["t"])
    plan = planned(got)
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan
    rows = {(r.t, r.row, r.col): (r.text, r.x, r.x_end, r.y, r.height) for r in got.collect()}
    assert len(rows) == 24 and rows[5, 0, 0] == ("a b", 0.0, 18.0, 0.0, 11.0) and rows[5, 1, 1] == ("c", 40.0, 48.0, 20.0, 10.0) and rows[5, 0, 1] == ("", 0.0, 0.0, 0.0, 0.0)


def test_cells_of_tables_are_shuffled_once(spark):
    cell = lambda row, col, t: F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), F.lit(t).alias("text"), F.lit(col * 50.0).alias("x"), F.lit(col * 50.0 + 30).alias("x_end"), F.lit(row * 20.0).alias("y"), F.lit(10.0).alias("height"))
    cells = spark.range(6).select(F.col("id").alias("t"), F.inline(F.array(cell(0, 0, "No"), cell(0, 1, "Part"), cell(1, 0, "1"), cell(1, 1, "P12"), cell(2, 0, "2"), cell(2, 1, "P13"))))
    tables = cells.select("t").distinct().withColumn("caption", F.lit("A")).withColumn("title", F.lit("B")).withColumn("page", F.lit(1)).withColumn("index", F.lit(0))
    out, results = P.coordinate_tables(tables, cells, ["t"])
    # Cells, rows and headers lie in buckets; only the tables themselves may move.
    assert planned(out).count("Exchange hashpartitioning") <= 1
    assert {(r.t, r.row_number, r.cells_json) for r in out.collect()} == {(t, n, '{"no":"%d","part":"P1%d"}' % (n, n + 1)) for t in range(6) for n in (1, 2)}
    assert {(r.t, r.problem, r.rows) for r in results.collect()} == {(t, None, 2) for t in range(6)}


def test_slots_and_places_are_gathered_by_table(spark):
    cells = spark.range(40).select((F.col("id") % 4).alias("t"), F.floor(F.col("id") / 8).alias("row"), (F.col("id") % 8 > 3).cast("int").alias("slot"), F.lit(0).alias("col"), F.concat(F.lit(" a "), "id").alias("text"))
    every = cells.select("t").distinct().withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    got = L.slot_values(cells, ["t", "row"], "slot", "col", "text", every)
    assert planned(got).count("Join") == 1
    values = {(r.t, r.row, r.slot): r.value for r in got.collect()}
    assert len(values) == 60 and values[1, 2, 0] == "a 17" and values[1, 2, 1] == "a 21" and values[1, 2, 2] == ""


def test_admission_does_not_write_cells_several_times(spark):
    cells = spark.range(48).select((F.col("id") % 2).alias("t"), F.floor(F.col("id") / 8).alias("row"), F.floor(F.col("id") / 2 % 4).alias("col"), F.concat(F.lit("text "), "id").alias("text"))
    got = R.admitted(cells, "t")
    assert "Expand" not in planned(got)
    assert [(r.t, r.admitted, r.reason) for r in got.orderBy("t").collect()] == [(0, True, None), (1, True, None)]


def test_overlaps_make_no_row_for_each_pair(spark):
    cells = spark.range(30).select((F.col("id") % 3).alias("t"), F.col("id").alias("cell"), (F.col("id") * 1.0).alias("x"), (F.col("id") + 4.0).alias("x_end"))
    slots = spark.range(15).select((F.col("id") % 3).alias("t"), F.floor(F.col("id") / 3).alias("slot"), (F.floor(F.col("id") / 3) * 11.0).alias("s"), (F.floor(F.col("id") / 3) * 11.0 + 10).alias("s_end"))
    got = E.best_overlap(cells, slots, "t")
    assert "array_max" in optimized(got)
    best = {r.cell: (r.slot, r.shared) for r in got.collect()}
    assert len(best) == 30 and best[0] == (0, 4.0) and best[9] == (1, 2.0) and best[29] == (2, 3.0)


def test_idf_of_a_few_terms_lists_no_others(spark, tmp_path):
    spark.createDataFrame([(1, "en", "apache license version"), (2, "en", "the trash"), (3, "de", "unter der Version")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.i5_idf(spark, str(tmp_path))
    assert "ngrams" not in optimized(got) and "Generate explode" in optimized(got) and "_terms" in optimized(got)
    weight = {(r.question, r.term): r.weight for r in got.collect()}
    assert weight["q0", "apache"] == round(math.log(3 / 2) + 1, 6) and weight["q1", "where"] == round(math.log(3) + 1, 6)


def test_rows_of_continued_tables_are_made_with_slugs_of_a_fragment(spark):
    text = "| Part | Size |\n|---|---|\n| Group: a | |\n| P1 | 7 |\n| | more |\n| Q1 | 8 |\n| part | SIZE |"
    f = spark.createDataFrame([(1, 0, text, None, "T", 1, 1), (1, 1, "| P2 | 9 |", None, "T", 2, 2)], "s int, at int, markdown string, caption string, title string, page_start int, page_end int")
    got = N.continued_rows(N.resolved(f, ["s"], "at", "markdown"), ["s"])
    above, below = optimized(got).split("Generate explode(concat", 1)
    # Slugs are made a fragment and not a cell; whether a row is a rule is told a row and not a cell.
    assert "[^a-z0-9]+" not in above and "[^a-z0-9]+" in below and "forall" not in below
    # Rows are merged one by one only if one of them can go on with another.
    assert below.split("\n")[1].count("exists(") >= 1
    rows = [(r.row_number, r["at"], r.group_context, r.cells_json) for r in got.orderBy("row_number").collect()]
    assert rows == [(1, 0, "Group: a", '{"part":"P1","size":"7 more"}'), (2, 0, "Group: a", '{"part":"Q1","size":"8"}'), (3, 1, "Group: a", '{"part":"P2","size":"9"}')]


def test_texts_are_cleaned_once_for_chunks(spark):
    texts = ["", "a  short one", "x" * 90 + "\n\n" + "y" * 90, "z. " * 60, None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = H.chunk_texts(docs, "k", "t", 120, 20)
    assert "Union" not in optimized(got) and optimized(got).count("page|trang") == 1
    rows = [(r.k, r.chunk_index, r.content) for r in got.orderBy("k", "chunk_index").collect()]
    assert rows[0] == (1, 0, "a short one") and rows[1] == (2, 0, "x" * 90) and rows[2] == (2, 1, "x" * 20 + "\n\n" + "y" * 90)
    assert [r[2] for r in rows if r[0] == 3] == H.windows(("z. " * 60).strip(), 120, 20)


def test_runs_of_words_copy_no_list(spark):
    one = spark.createDataFrame([("k", "en", "Apache-2.0 license of the year 12/05/2024, license of -x- it")], "key string, tenant string, content string")
    got = K.postings(one, "key", "tenant")
    assert "slice(" not in optimized(got)
    words = ["apache-2.0", "apache", "license", "of", "the", "year", "12/05/2024", "12", "05", "2024", "x-", "it"]
    words = [w for w in words if w != "x-"]
    assert {r.term for r in got.collect()} >= {"apache-2.0", "apache", "12/05/2024", "2024", "license of the year", "license of", "apache license"}
    assert [r.t for r in one.select(F.explode(K.tokens(F.col("content"))).alias("t")).collect()] == words


def test_texts_are_normalized_once_for_the_fallback(spark):
    chunks = spark.range(30).select(F.col("id"), F.lit("all").alias("tenant"), F.concat(F.lit("Part: P"), "id").alias("content"))
    others = spark.range(5).select(F.col("id") + 100, F.lit("nobody asks"), F.lit("Part: P12"))
    got = K.fallback_search(chunks.unionByName(others.toDF("id", "tenant", "content")), asked(spark), "id", "tenant")
    # Neither once more for the scores nor for every question of a tenant.
    assert "[!-,:-@" not in optimized(got)
    assert got.filter("question = 'q'").orderBy("nth").first().key == 12


def test_column_names_are_compared_once_for_all_rows(spark):
    """Names of columns are met by the questions before the rows are, and values stay apart though they are looked at together."""
    rows = R.normalized_rows(pipe_tables(spark), "markdown", "t")
    asks = asked(spark).withColumn("terms", C.asked_terms())
    both = C.with_heads(rows, asks, F.col("terms"))
    assert both.select("_heads").distinct().count() == 2 and both.count() == 80
    plain = C.plain_cells(F.col("cells"), F.col("group_context"), F.lit(""))
    got = both.withColumn("a", C.score(F.col("cells"), F.col("group_context"), F.lit(""), F.col("terms"), plain, F.col("_heads"))).withColumn("b", C.score(F.col("cells"), F.col("group_context"), F.lit("")))
    assert got.filter("a != b").count() == 0 and got.filter("a.total > 0").count() > 0
    apart = spark.createDataFrame([(1, [("a", "x p"), ("b", "12 y")]), (2, [("a", "x"), ("b", "p 12")]), (3, [("a", None), ("b", "p 123")])], "i int, cells array<struct<key:string,value:string>>")
    one = apart.join(F.broadcast(S.with_signals(spark.createDataFrame([("p 12",)], "text string"), "text")))
    points = {r.i: r.s for r in one.select("i", C.score(F.col("cells"), F.lit(""), F.lit("")).alias("s")).collect()}
    assert (points[1].phrases, points[1].labels) == (0.0, C.COVERED) and points[2].phrases == 2.0 and points[3].labels == 0.0


def test_best_chunks_are_bounded_before_they_move(spark):
    chunks = spark.range(50).select(F.col("id").alias("key"), F.lit("all").alias("tenant"), F.concat(F.lit("part P"), "id").alias("content"))
    got = K.fallback_search(chunks, asked(spark), "key", "tenant")
    assert "WindowGroupLimit" in planned(got)
    assert got.filter("question = 'q'").count() == 30
