import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, good int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        kind = rng.choice(["good", "good", "junk", "toxic"])
        if kind == "toxic":
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "idiot"]))
        if kind == "junk":
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en", f"src{i % 3}", 1, None, None))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic"), kind))
        else:
            labels.append((i, None, None, kind))
    rows += [(5000, None, None, None, None, None, None), (5001, "", "en", "s", 0, None, None), (None, "x", "en", None, 1, None, None), (1, rows[1][1], "en", "s", 1, None, None)]
    rows.append((5002, "wab " * 40000, "en", "s", 1, None, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, kind string")
    return docs, truth


def test_held_out_accuracy(corpus):
    docs, truth = corpus
    known = quality.clean_labels(truth.filter("quality is not null"))
    found = quality.cotrain(docs, known).score(docs).cache()
    assert found.count() == docs.count()
    assert found.filter("score is null or keep is null").count() == 0
    unseen = found.join(truth.filter("quality is null"), F.col("id") == F.col("doc_id"))
    right = {r.kind: r.right for r in unseen.groupBy("kind").agg(F.avg((F.col("keep") == (F.col("kind") == "good")).cast("int")).alias("right")).collect()}
    assert min(right.values()) > 0.9, right


def test_without_labels(corpus):
    docs, truth = corpus
    none = quality.clean_labels(truth.filter("false"))
    assert quality.cotrain(docs, none).score(docs).filter("keep").count() == docs.count()
    bad = quality.clean_labels(truth.filter("quality = 0"))
    assert quality.cotrain(docs, bad).score(docs).filter("keep").count() == 0
    assert quality.cotrain(docs.filter("false"), none).score(docs.filter("false")).count() == 0


def test_views_together(corpus):
    docs, truth = corpus
    known = quality.clean_labels(truth.filter("quality is not null"))
    unseen = truth.filter("quality is null").select("doc_id", (F.col("kind") == "good").alias("good"))
    right = {}
    for rounds in (0, 2):
        found = quality.cotrain(docs, known, rounds=rounds).score().join(unseen, F.col("id") == F.col("doc_id"))
        right[rounds] = found.agg(*[F.avg(((F.col(c) >= 0.5) == F.col("good")).cast("int")) for c in ("p_text", "p_page", "score")]).first()
    assert right[2][2] >= max(right[2][:2]) - 0.02 and right[2][2] >= right[0][2] - 0.02


def test_good_rows_keep_all_columns(spark, corpus):
    docs, truth = corpus
    clash = docs.withColumnsRenamed({"tokens": "id", "good": "label_id"}).withColumn("tid", F.lit(1)).withColumn("keep", F.array(F.lit("x")))
    model = quality.cotrain(clash, quality.clean_labels(truth.filter("quality is not null")))
    kept = model.good_rows(clash)
    assert kept.schema == clash.schema and 0 < kept.count() < clash.count()
    assert kept.count() == model.score(clash).filter("keep").count() and kept.exceptAll(clash).count() == 0
    assert model.good_rows(clash.filter("false")).count() == 0


def test_document_frequency(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "B c"), (3, None)], "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")})
    found = {r.h: r.n for r in quality.document_frequency(quality.views(docs)).collect()}
    assert found == {quality.crc32(b"a"): 1, quality.crc32(b"b"): 2, quality.crc32(b"c"): 1}


def test_platt():
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(3, 5, (20_000, 2))
    good = (rng.random(20_000) < 1 / (1 + np.exp(-(0.7 * x[:, 0] - 0.2 * x[:, 1] + 0.5)))).astype(float)
    a, b, c = quality.platt(x, good)
    assert abs(a - 0.7) < 0.05 and abs(b + 0.2) < 0.03 and abs(c - 0.5) < 0.15
    a, c = quality.platt(np.array([[0.0], [0.0], [1.0], [1.0]]), np.array([0, 0, 1, 1.0]))  # separable
    assert np.isfinite([a, c]).all() and a > 0 > c
    assert quality.platt(np.zeros((4, 1)), np.array([1, 1, 1, 0.0]))[0] == 0


def test_highest(spark):
    df = spark.range(10_000).withColumn("v", F.col("id") % 100)
    found = [r.v for r in quality.highest(df, F.col("v"), F.col("id"), 1050).collect()]
    assert 1000 <= len(found) <= 1100 and min(found) == 89 and sum(v >= 90 for v in found) == 1000
    assert quality.highest(df, F.col("v"), F.col("id"), 20_000).count() == 10_000 and quality.highest(df.filter("false"), F.col("v"), F.col("id"), 5).count() == 0
