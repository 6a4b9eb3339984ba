"""Operators on small tables: hand-made cases and properties."""

import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.operators import activity as A
from tessera.operators import answers as O
from tessera.operators import cells as X
from tessera.operators import chunks as C
from tessera.operators import expansion as E
from tessera.operators import keywords as K
from tessera.operators import signals as S
from tessera.operators import table_rows as R
from tessera.operators import vectors as V
from tessera.sources import files, tables


def test_signals(spark):
    q = spark.createDataFrame([("Nhóm 1 phòng E301 ngày 30/03/2026, mã AB-12 K46 CT1234?",), ("  ",), (None,)], "q string")
    one, blank, none = S.with_signals(q, "q").collect()
    assert one.identifiers == ["E301", "CT1234"]
    assert one.dates == ["30/03/2026", "30/03"]
    assert "nhom 1" in one.labels and "phong e301" in one.labels
    assert "phong e301 ngay" in one.ngrams and one.words[0] == "nhom"
    for r in (blank, none):
        assert r.identifiers == r.dates == r.labels == r.ngrams == r.words == []


def test_labels_stop_at_values(spark):
    q = spark.createDataFrame([("lop a1 tiet 3",)], "q string")
    assert S.with_signals(q, "q").first().labels == ["lop a1", "tiet 3"]


def test_variants(spark):
    q = spark.createDataFrame([(" Đâu là gì?? ",), ("abc",)], "q string").select(S.variants(F.col("q")))
    assert [r[0] for r in q.collect()] == [["Đâu là gì??", "Đâu là gì", "dau la gi"], ["abc"]]


def test_tokens(spark):
    got = spark.createDataFrame([("A-12/b x. Đà 3",)], "t string").select(K.tokens(F.col("t"))).first()[0]
    assert got == ["a-12/b", "12", "da"]


def test_postings_of_is_part_of_postings(spark):
    docs = spark.createDataFrame([(1, "en", "one two three one four"), (2, "en", "two three"), (3, "fr", None)], "id int, lang string, content string")
    every = {tuple(r) for r in K.postings(docs, "id", "lang").collect()}
    terms = ["two three", "three four", "one", "two three four", "one two three four", "nothing"]
    some = {tuple(r) for r in K.postings_of(docs, terms, "id", "lang").collect()}
    assert some == {x for x in every if x[2] in terms}
    assert ("en", 1, "three four") in some  # of different tokens in order


def test_unanswered_in_one_timeline(spark):
    rows = [(1, "a", "USER", "Giờ học?"), (2, "a", "ASSISTANT", "Tôi không biết."), (3, "a", "USER", "x"), (4, "b", "USER", "x"), (5, "b", "ASSISTANT", "not found"), (6, "a", "ASSISTANT", "not found")]
    turns = spark.createDataFrame(rows, "at int, s string, role string, text string")
    pairs = A.answered_pairs(turns, ["at"], "s", "role", "text")
    assert [tuple(r) for r in A.unanswered(pairs, ["at"], 10).collect()] == [("Giờ học?", 1, "a"), ("x", 1, "b")]
    own = A.answered_pairs(turns, ["at"], "s", "role", "text", newest=None, per_session=True)
    assert A.unanswered(own, ["at"], 10).first().times == 2
    with pytest.raises(ValueError):
        A.answered_pairs(turns, ["at"], "s", "role", "text", newest=None)


def test_daily_has_every_day(spark):
    events = spark.createDataFrame([("2024-02-28 23:59:59", 1), ("2024-03-01 00:00:00", 1)], "ts string, u int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = A.daily(events, date(2024, 2, 27), date(2024, 3, 1), "ts", "u").orderBy("day").collect()
    assert [(str(r.day), r.messages) for r in got] == [("2024-02-27", 0), ("2024-02-28", 1), ("2024-02-29", 0), ("2024-03-01", 1)]
    assert A.daily(events.filter("false"), date(2024, 2, 27), date(2024, 3, 1), "ts", "u").count() == 4
    with pytest.raises(ValueError):
        A.window_of(date(2024, 2, 2), date(2024, 2, 1))


def test_page_checks_its_parameters(spark):
    rows = spark.range(5)
    assert [r.id for r in A.page(rows, [F.col("id")], 1, 2).collect()] == [2, 3]
    assert A.page(rows, [F.col("id")], 0, 2).first().pages == 3
    for number, size in ((-1, 2), (0, 0), (0, 101)):
        with pytest.raises(ValueError):
            A.page(rows, [F.col("id")], number, size)


def test_selection_keeps_its_bounds(spark):
    rows = spark.range(200).select(F.lit("q").alias("question"), F.col("id").alias("key"), (F.col("id") * 37 % 101).alias("score"), (F.col("id") % 19 * 100).alias("length"))
    got = V.select_within(rows, "score", "length", 12, 2500).collect()
    assert 0 < len(got) <= 12 and sum(r.length for r in got) <= 2500
    big = rows.withColumn("length", F.lit(9999))
    assert V.select_within(big, "score", "length", 12, 2500).count() == 1


def test_neighbours_stay_in_their_document(spark):
    chunks = spark.createDataFrame([(d, i) for d in "ab" for i in range(4)], "doc string, i int")
    anchors = spark.createDataFrame([("a", 0), ("b", 3)], "document string, order int").withColumn("anchor", F.col("order"))
    got = sorted((r.doc, r.anchor, r.i) for r in E.neighbours(chunks, anchors, "doc", "i").collect())
    assert got == [("a", 0, 0), ("a", 0, 1), ("a", 0, 2), ("b", 3, 2), ("b", 3, 3)]


def test_chunks(spark):
    long = "Một câu dài. " * 700
    many = "\n\n".join(f"{i} " + "x" * 900 for i in range(8))
    docs = spark.createDataFrame([(1, "short"), (2, long), (3, many), (4, None), (5, " "), (6, "y" * 9000)], "id int, t string")
    got = {}
    for r in C.chunk_texts(docs, "id", "t").orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.content)
    assert got[1] == ["short"] and 4 not in got and 5 not in got
    assert all(len(c) <= C.SIZE for c in got[2] + got[6])
    assert all(len(c) <= C.SIZE + C.OVERLAP + 2 for c in got[3])
    assert all(f"{i} x" in "".join(got[3]) for i in range(8))
    for a, b in zip(got[6], got[6][1:]):
        assert a[-C.OVERLAP :] == b[: C.OVERLAP]


def test_sections(spark):
    text = "intro\n1 One thing\nbody a\n1.1 Inner part\nbody b\n2 Two things\n1 One back\nlast"
    marks = "# Top\nx\n## Below\ny\n1 Not this\n# Next\nz"
    docs = spark.createDataFrame([(1, text), (2, marks), (3, ""), (4, "no headings"), (5, None)], "id int, t string")
    got = [(r.id, r.path, r.content) for r in C.sections(docs, "id", "t").orderBy("id", "section").collect()]
    assert got == [
        (1, "General", "intro"), (1, "One thing", "body a"), (1, "One thing > Inner part", "body b"), (1, "Two things", "1 One back\nlast"),
        (2, "Top", "x"), (2, "Top > Below", "y\n1 Not this"), (2, "Next", "z"), (4, "General", "no headings"),
    ]


def test_preamble_and_refusals(spark):
    rows = [("Theo Source 12, x", "x"), ("Theo nguồn 14, X", "X"), ("Dựa vào nguồn 5: y.", "y."), ("  ", "  "), (None, None), ("Theo dõi", "Theo dõi")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [tuple(r) for r in df.select(O.without_preamble(F.col("a")), "b").collect()] == [(b, b) for _, b in rows]
    told = [("Không tìm thấy thông tin. AB-123",), ("AB-123 không tìm thấy thông tin",), ("Không có trong tài liệu\n1. x",), ("khong co thong tin AB12",), (None,), (" 1. x Không có thông tin",)]
    r = spark.createDataFrame(told, "t string").select(O.refusal(F.col("t")).alias("r"), O.substantive(F.col("t")).alias("s")).collect()
    assert [tuple(x.r) for x in r] == [(True, True), (True, False), (True, True), (False, False), (False, False), (True, False)]
    assert [x.s for x in r] == [True, True, True, False, False, True]


# Sentences whose preamble is known (FIXTURES.md 1.1).
PREAMBLES = [
    ("Theo Source 12, thời gian học quân sự là từ ngày 30/03/2026 đến ngày 26/04/2026.", "thời gian học quân sự là từ ngày 30/03/2026 đến ngày 26/04/2026."),
    ("Theo nguồn 14, Từ ngày 09/02/2026 đến ngày 01/03/2026.", "Từ ngày 09/02/2026 đến ngày 01/03/2026."),
    ("Dựa trên Source 3, kết quả là 42.", "kết quả là 42."),
    ("Dựa vào nguồn 5: thông tin đã có.", "thông tin đã có."),
    ("Thời gian học quân sự là từ ngày 30/03/2026 đến ngày 26/04/2026.", "Thời gian học quân sự là từ ngày 30/03/2026 đến ngày 26/04/2026."),
    (None, None),
    ("  ", "  "),
    ("  Theo nguồn — x", "x"),
    ("  Theo tài liệu, x", "  Theo tài liệu, x"),
]


def test_known_preambles(spark):
    got = spark.createDataFrame(PREAMBLES, "a string, b string").select(O.without_preamble(F.col("a")).alias("a"), "b").collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_intent(spark):
    asked = [("K46 là gì", "TABLE_LOOKUP", 0.55), ("HK2", "TABLE_LOOKUP", 0.55), ("mục 1.2", "SECTION_SUMMARY", 0.8), ("năm 2024.5678", "NORMAL_FACT", 0.3), (" ", "NORMAL_FACT", 1.0), (None, "NORMAL_FACT", 1.0), ("ab12", "NORMAL_FACT", 0.3)]
    got = spark.createDataFrame(asked, "t string, k string, c double").select(S.intent(F.col("t")).alias("i"), "k", "c").collect()
    assert [(r.i.kind, r.i.confidence) for r in got] == [(r.k, r.c) for r in got]


def test_tables_worked_out_by_hand(spark):
    some = [
        (1, "| Name | Price | Date |\n|---|---|---|\n| AB12 | 10 | 1/2/2024 |\n|  | more | |\n| CD34 | 20 | 3/4/2024 |"),
        (2, "| Class | Teacher |\n| Group: evening | |\n| 1 | Ann |\n| 2 | Bob |"),
        (3, "no table"),
        (4, ""),
        (5, "| a | a | |\n|---|---|---|\n| 1 | 2 | 3 |"),
        (6, "| a | | |\n|---|---|---|\n| 1 | 2 | 3 |"),
    ]
    df = spark.createDataFrame(some, "table_id int, markdown string")
    assert {r.table_id: r.problem for r in R.problems(df, "markdown", "table_id").collect()} == {1: None, 2: None, 3: "no-rows", 4: "empty-markdown", 5: None, 6: "insufficient-headers"}
    rows = R.normalized_rows(df, "markdown", "table_id")
    assert sorted((r.table_id, r.row_index, r.group_context, r.row_text, r.cells_json) for r in rows.collect()) == [
        (1, 1, "", "Name: AB12; Price: 10 more; Date: 1/2/2024", '{"name":"AB12","price":"10 more","date":"1/2/2024"}'),
        (1, 2, "", "Name: CD34; Price: 20; Date: 3/4/2024", '{"name":"CD34","price":"20","date":"3/4/2024"}'),
        (2, 1, "Group: evening", "Class: 1; Teacher: Ann", '{"class":"1","teacher":"Ann"}'),
        (2, 2, "Group: evening", "Class: 2; Teacher: Bob", '{"class":"2","teacher":"Bob"}'),
        (5, 1, "", "a: 1; a_2: 2; col_3: 3", '{"a":"1","a_2":"2","col_3":"3"}'),
    ]
    assert sorted(tuple(r) for r in R.quality(rows, "table_id").collect()) == [(1, 2, 0, 6, 0, 0), (2, 2, 0, 4, 0, 0), (5, 1, 0, 3, 0, 1)]


def test_cell_scores(spark):
    def of(question, cells, context="", table=""):
        df = S.with_signals(spark.createDataFrame([(question, cells, context, table)], "question string, cells array<struct<key string, value string>>, g string, t string"), "question")
        return df.select(X.score(F.col("cells"), F.col("g"), F.col("t")).alias("s")).first().s

    # A code on its boundaries only: 8 and nothing for AB1234 in AB12345.
    assert of("code AB1234", [("x", "AB1234")]).codes == 8 and of("code AB1234", [("x", "AB12345")]).codes == 0
    # A label in each cell with a like name, by its value under another name, and against another number.
    assert of("class 5", [("class", "5"), ("class", "5 b")]).labels == 12
    assert of("class 5", [("room", "5")]).labels == 4
    s = of("class 5", [("class", "7")])
    assert (s.labels, s.conflicts, s.total) == (0, -8, 0) and not s.exact
    assert of("class 5", [("class", "seven")]).conflicts == 0
    # Runs of words and words are two kinds; dates count as exact.
    s = of("blue moon", [("x", "the blue moon")])
    assert (s.phrases, s.kinds, s.several, s.total) == (4, 2, 5, 9)
    s = of("on 1/2/2024", [("x", "1/2/2024")])
    assert s.dates == 3.0 and s.exact  # the full date and its day and month
    assert of("class 5", [("x", "y")], "Class 5 b").group == 0.8 + 0.3
    assert of("blue moon", [("x", "y")], "", "Blue moon table").named == 0.5
    assert of("class 5", []) is None


def test_upper_medians(spark):
    rows = [("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", 9.0), ("b", 2.0), ("c", None), ("d", 1.0), ("d", None), ("d", 5.0)]
    got = E.upper_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v")
    assert sorted(map(tuple, got.collect())) == [("a", 3.0), ("b", 2.0), ("d", 5.0)]


def test_deletes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    gone = tables.soft_delete(rows, F.col("id") == 1, F.lit("2024-01-01").cast("timestamp"))
    assert [r.id for r in tables.live(gone).collect()] == [2]
    again = tables.soft_delete(gone, F.lit(True), F.lit("2025-01-01").cast("timestamp"))
    assert again.filter("deleted_at = timestamp'2024-01-01'").count() == 1
    assert tables.without(rows, gone.filter("id = 2"), ["id"]).count() == 1


def word_file(body):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_word_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, x="": f"<w:tc><w:tcPr>{x}</w:tcPr>{p(t)}</w:tc>"
    rows = [cell("a", '<w:gridSpan w:val="2"/>') + cell("b"), cell("c", '<w:vMerge w:val="restart"/>') + cell("d") + cell("e"), cell("", "<w:vMerge/>") + cell("f") + cell("g")]
    body = p("Tiêu đề") + "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"
    (tmp_path / "a.docx").write_bytes(word_file(body))
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.docx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "d.txt").write_text("một\nhai", encoding="utf-8")
    (tmp_path / "e.xlsm").write_bytes(b"PK\x03\x04")
    found = files.read_files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.admitted for r in found.collect()} == {"a.docx": True, "b.docx": False, "c.docx": True, "d.txt": True, "e.xlsm": False}
    blocks = files.read_docx(found).cache()
    assert blocks.filter("error is not null").count() == 1
    got = [(r.row, r.col, r.span, r.text) for r in blocks.filter("kind = 'cell'").orderBy("row", "col").collect()]
    assert got == [(0, 0, 2, "a"), (0, 2, 1, "b"), (1, 0, 1, "c"), (1, 1, 1, "d"), (1, 2, 1, "e"), (2, 1, 1, "f"), (2, 2, 1, "g")]
    assert blocks.filter("kind = 'paragraph'").first().text == "Tiêu đề"
    assert files.cell_markdown(blocks.filter("kind = 'cell'"), "path", "block").first().markdown.startswith("| a | b |\n|---|---|")
    assert files.read_texts(spark, str(tmp_path / "d.txt")).first().text == "một\nhai"
