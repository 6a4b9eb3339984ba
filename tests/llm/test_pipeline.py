"""The pipeline on small documents, stage by stage, against plain Python."""

import random
from collections import Counter

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, pieces, simhash
from tests.llm.test_native import targets_by_hand

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        junk = i % 9 == 4
        text = " ".join(w.upper() + "!!" if junk else w for w in words)
        if i % 10 == 7:
            text = rows[i - 7][1]
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int("!!" not in text), 0))
    rows += [(2000, None, None, None, None), (2001, "", "en", None, 0)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in cp.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, tables)
        rows = [tuple(r) for r in out.collect()]
        if stage is not cp.pieces_stage:
            assert out.columns == docs.columns
        if stage is cp.quality_stage:
            assert set(rows) <= set(before)
            good = [r for r in before if "!!" not in (r[1] or "") and r[0] < 2000]
            assert len(set(good) & set(rows)) >= 0.98 * len(good)
            assert sum("!!" in (r[1] or "") for r in rows) <= 2
        elif stage is cp.exact_stage:
            last = {}
            for r in before:
                last[r[1] or ""] = max(last.get(r[1] or "", r), r, key=lambda x: x[0])
            assert sorted(rows) == sorted(last.values())
        elif stage is cp.near_stage:
            fps = [(simhash.fingerprint((r[1] or "").encode()), r) for r in sorted(before)]
            keep = [r for i, (f, r) in enumerate(fps) if not any(bin(f ^ g).count("1") <= 4 for g, _ in fps[:i])]
            assert sorted(rows) == sorted(keep)
        elif stage is cp.mixing_stage:
            sizes = Counter()
            for r in before:
                sizes[r[3]] += len((r[1] or "").split())
            want = targets_by_hand(dict(sizes), mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
            took = Counter()
            for r in rows:
                took[r[3]] += len(r[1].split())
            assert all(abs(took[s] - want[s]) <= 1 for s in want)
            whole = {r[0]: r[1] for r in before}
            assert all(whole[r[0]].startswith(r[1]) for r in rows)
        else:
            own = pieces.load()
            assert sorted(r[0] for r in rows) == sorted(r[0] for r in before)
            texts = {r[0]: {x[1] for x in before if x[0] == r[0]} for r in before}
            assert all(r[4] and own.decode(r[2]).decode() in texts[r[0]] for r in rows)
        docs = spark.createDataFrame(rows, out.schema)
    assert docs.count() > 0


def test_run(spark, tables):
    found = cp.run(spark, tables)
    assert found.filter("not lossless").count() == 0 and found.agg(F.sum("n_ids")).first()[0] > 0


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("false")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, tables).count() == 0
