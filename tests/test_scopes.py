import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import pool as P
from tessera.operators import ranges as R
from tessera.plans.retrieve import retrieve


def range_by_hand(heads, at, most, n):
    """heads: number or None of each chunk."""
    start = next((i for i in range(at, -1, -1) if heads[i]), None)
    if start is None:
        return None
    number = heads[start]
    if "." in number:
        for i in range(start - 1, -1, -1):
            if heads[i] and heads[i].count(".") < number.count("."):
                if number.startswith(heads[i] + "."):
                    number, start = heads[i], i
                break
    end = min(n - 1, start + most - 1)
    for i in range(start + 1, n):
        h = heads[i]
        if h and not (h == number or h.startswith(number + ".")) and h.count(".") <= number.count("."):
            return start, min(end, max(start, i - 1))
    return start, end


def test_ranges(spark):
    rng = random.Random(3)
    rows, anchors, want = [], [], set()
    for d in range(40):
        n = rng.randint(1, 60)
        heads = [rng.choice([None, None, None, "1", "2", "1.1", "1.2", "2.1", "1.1.1", "3.4"]) for _ in range(n)]
        rows += [(d, i, d * 100 + i, f"{h} Topic of words" if h else rng.choice(["no heading", "in 12 ngay only", None])) for i, h in enumerate(heads)]
        for _ in range(4):
            at, most = rng.randrange(n), rng.choice([3, 12, 30])
            anchors.append((f"q{d % 3}", d, d * 100 + at, most))
            found = range_by_hand(heads, at, most, n)
            if found:
                want |= {(f"q{d % 3}", d * 100 + i) for i in range(found[0], found[1] + 1)}
    chunks = spark.createDataFrame(rows, "document int, order int, key int, content string")
    asked = spark.createDataFrame(anchors, "question string, document int, key int, most int")
    assert {tuple(r) for r in R.section_ranges(chunks, asked).collect()} == want
    assert R.section_ranges(chunks, asked.filter("false")).count() == 0


@pytest.mark.parametrize("text, number", [("1.2. Đường đi chính", "1.2"), ("in 3 phút nữa", None), ("12 abc", None), ("x 7 Words here", "7"), ("2024.5 - no", None), (None, None)])
def test_heading_of(spark, text, number):
    h = spark.createDataFrame([(text,)], "t string").select(R.heading_of(F.col("t")).alias("h")).first().h
    assert (h.number if h else None) == number


CHUNKS = [
    # key, document, section, order, parent, table, content
    (1, "d", "1", 0, None, None, "Shipping rules overview of the shop"), (2, "d", "1.1", 1, "1", None, "Shipping costs abroad are ten"), (3, "d", "1.2", 2, "1", None, "Shipping costs at home are two"),
    (4, "d", "2", 3, None, None, "Returns are taken back for a month"), (5, "d", "2.1", 4, "2", "t1", "Returns table of fees"), (6, "d", "3", 5, None, None, "Opening hours of the shop and more"), (7, "d", "3.1", 6, "3", None, "Holiday hours and notes"),
]
SECTIONS = [("1", "Shipping rules"), ("1.1", "Costs abroad"), ("1.2", "Costs at home"), ("2", "Returns"), ("2.1", "Fees"), ("3", "Opening hours"), ("9", "Empty chapter here")]


@pytest.fixture(scope="module")
def shop(spark):
    chunks = spark.createDataFrame([(k, "t", d, s, o, p, t, c) for k, d, s, o, p, t, c in CHUNKS], "key int, tenant string, document string, section string, order int, parent string, table string, content string")
    sections = spark.createDataFrame([("t", "d", n, t, t) for n, t in SECTIONS], "tenant string, document string, number string, title string, heading_path string")
    return chunks, sections


def ask(spark, text):
    return spark.createDataFrame([("q", "t", text)], "question string, tenant string, text string")


def keys(rows):
    return {r.key: (r.branch, r.locked) for r in rows.collect()}


def test_named_sections_lock(spark, shop):
    chunks, sections = shop
    hits = spark.createDataFrame([("q", 6, 0.9)], "question string, key int, vector double")
    assert [tuple(r) for r in P.heading_scopes(ask(spark, "what are the shipping rules"), sections).collect()] == [("q", "d", "1")]
    got = P.locked_pool(chunks, P.heading_scopes(ask(spark, "what are the shipping rules"), sections), hits.replace(6, 5, ["key"])).collect()
    assert {(r.key, r.branch) for r in got} == {(1, "locked"), (2, "locked"), (3, "locked"), (5, "table")}


def test_scope_without_chunks_unlocks(spark, shop):
    chunks, sections = shop
    hits = spark.createDataFrame([("q", 4, 0.9)], "question string, key int, vector double")
    assert P.heading_scopes(ask(spark, "empty chapter here"), sections).first().number == "9"
    assert P.locked_pool(chunks, P.heading_scopes(ask(spark, "empty chapter here"), sections), hits).count() == 0


def test_sure_hits_lock_in_a_second_pass(spark, shop):
    chunks, sections = shop
    hits = spark.createDataFrame([("q", 3, 0.9), ("q", 6, 0.2)], "question string, key int, vector double")
    question = ask(spark, "how much is it to send a parcel")
    sure = spark.createDataFrame([("q", 3, 1.0), ("q", 6, 0.1)], "question string, key int, rerank double")
    got = keys(retrieve(chunks, question, hits, rerank=sure, sections=sections))
    assert {k for k, (b, _) in got.items() if b == "locked"} == {1, 2, 3} and all(locked for _, locked in got.values())


def test_scopes_of_hits(spark, shop):
    _, sections = shop
    rows = [("a", "NORMAL_FACT", 3, "1.2", 0.7, []), ("a", "NORMAL_FACT", 6, "3", 0.6, []), ("b", "NORMAL_FACT", 3, "1.2", 0.4, []), ("c", "LIST_ALL", 3, "1.2", 0.9, []), ("d", "NORMAL_FACT", 8, "7.1", 0.5, []), ("e", "NORMAL_FACT", 8, None, 0.9, []), ("f", "NORMAL_FACT", 3, "1.2", 0.9, ["AB12"])]
    df = spark.createDataFrame(rows, "question string, intent string, key int, section string, score double, identifiers array<string>").withColumn("document", F.lit("d"))
    for name in ("labels", "dates", "numbers"):
        df = df.withColumn(name, F.array().cast("array<string>"))
    got = {r.question: r.number for r in P.rerank_scopes(df, sections).collect()}
    assert got == {"a": "1", "d": "7.1"}


def test_wide_questions_take_sections_siblings_parents_and_tables(spark, shop):
    chunks, _ = shop
    chunks = chunks.withColumn("chunk_type", F.lit("text"))
    hits = spark.createDataFrame([("q", 2), ("q", 5), ("p", 7)], "question string, key int")
    asked = spark.createDataFrame([("q", "LIST_ALL"), ("p", "NORMAL_FACT")], "question string, intent string")
    anchors = spark.createDataFrame([], "question string, key int, document string, section string, order int, points int")
    got = {}
    for r in P.semantic_pool(chunks, hits, anchors, asked).collect():
        got.setdefault((r.question, r.branch), set()).add(r.key)
    assert got == {("q", "hit_section"): {2, 5}, ("q", "sibling"): {2, 3, 5}, ("q", "parent"): {1, 4}, ("q", "table"): {5}, ("p", "window"): {6, 7}}
    united = {(r.question, r.key): r.branch for r in P.united(P.semantic_pool(chunks, hits, anchors, asked)).collect()}
    assert united[("q", 2)] == "hit_section" and united[("q", 3)] == "sibling" and len(united) == 7
