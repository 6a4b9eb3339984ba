"""Scalar functions against plain Python."""

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X

WORDS = ["Thời gian đẹp, Đà Nẵng!", "a_b-c/d.e  F", "", "  ", "ÀÉÎõü ß 𝒳", "x\ty\nz", None, "K46 (HK2): 50%"]


def plain(s, stroke=True):
    s = "".join(c for c in unicodedata.normalize("NFD", s or "") if unicodedata.category(c)[0] != "M")
    return (s.replace("đ", "d").replace("Đ", "D") if stroke else s).lower()


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    return [r[0] for r in df.select(*exprs).collect()]


def test_normalize(spark):
    punctuation = "!\"#$%&'()*+,:;<=>?@[\\]^_`{|}~"
    want = [" ".join("".join(" " if c in punctuation else c for c in plain(w)).split()) for w in WORDS]
    assert column(spark, WORDS, X.normalize("v")) == want
    assert column(spark, WORDS, X.match_form("v"))[0] == "thoi gian đep đa nang"


def test_slug(spark):
    assert column(spark, ["Đơn giá (VND)", "--", None, "a  b"], X.slug("v")) == ["don_gia_vnd", "col", "col", "a_b"]


@pytest.mark.parametrize("v", [-2.5, -0.25, 0.0, 0.05, 2.25, 2.35, 99.95])
def test_round1(spark, v):
    got = spark.range(1).select(X.round1(F.lit(v))).first()[0]
    assert got == math.floor(v * 10 + 0.5) / 10


def test_delta(spark):
    rows = spark.createDataFrame([(0, 0), (3, 0), (3, 2), (0, 4)], "a long, b long")
    assert [r[0] for r in rows.select(X.delta_percent("a", "b")).collect()] == [0.0, 100.0, 50.0, -100.0]


def test_text_hash(spark):
    def java(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return format(h, "x")

    values = ["", "a", "Câu hỏi?", "polygenelubricants"]
    assert column(spark, values, X.text_hash("v")) == [java(v) for v in values]


def test_small_ones(spark):
    one = spark.createDataFrame([("  ab cd", 2, 2, None, '{"k": " 7 ", "n": null}')], "v string, a int, b int, c int, j string")
    row = one.select(
        X.initials("v"), X.page_range("a", "b"), X.page_range("a", "c"), X.page_range("c", "c"), X.json_text("j", "$.k"), X.json_text("j", "$.n"),
        X.tokens_up("v"), X.tokens_down("v"), X.named("c", "none"), X.acronym(F.lit("ab cd e")), X.bigrams(F.lit("aab")),
        X.error_class(F.lit("Rate limit: try again in 2.5s")), X.retry_seconds(F.lit("try again in 2.5s")), X.file_kind(F.lit("A.DocX")),
    ).first()
    assert list(row) == ["AB", "2", "2", "", "7", None, 2, 1, "none", "ace", ["aa", "ab"], "MINUTE_LIMIT", 5, "DOCX"]


def test_compose(spark):
    import random
    import unicodedata

    from tessera.functions.text import compose

    rng = random.Random(8)
    marks = [chr(c) for c in (0x300, 0x301, 0x302, 0x303, 0x306, 0x307, 0x308, 0x309, 0x31B, 0x323, 0x327, 0x328)]
    texts = ["".join(rng.choice("aeiouydAEOUYêơưđ ") + "".join(rng.choice(marks) for _ in range(rng.choice([0, 0, 1, 2, 3]))) for _ in range(12)) for _ in range(300)]
    texts += [unicodedata.normalize("NFD", "Đường về nhà tệ lắm, ổn chứ? Ñandú"), "", "plain", "\u0301x", None, "a\u0301" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c for r in df.select("i", compose("t").alias("c")).orderBy("i").collect()]
    assert got == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]
