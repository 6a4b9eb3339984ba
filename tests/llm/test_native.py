"""Exact dedup, mixing and personal data against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, pii
from tessera.llm.common import word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, digest int"
ODD = [
    (1, "a b", "en", "s0", 3, "x", 1),
    (2, "a b", "en", "s0", 3, "x", 1),
    (2, "a b", "en", "s0", 3, "x", 1),
    (None, "a b", None, None, None, None, None),
    (3, None, "en", "s1", 0, "x", 1),
    (4, "", "en", "s1", 0, "x", 1),
    (5, "a b ", "en", "s0", 4, "x", 1),
    (6, "w " * 30000, "en", "s2", 60000, "x", 1),
    (7, "w " * 30000, "en", "s2", 60000, "x", 1),
    (None, "null id", None, None, None, None, None),
    (None, "null id", None, None, None, None, None),
]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


def by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        spent = False
        for i in ids:
            kept = i == top and not spent
            spent |= kept
            out.append((i, top, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.length(c) % 2])
def test_exact_dedup(spark, digest):
    found = exact_dedup.dedup_decisions(docs(spark), digest=digest)
    got = [tuple(r) for r in found.select("id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=repr) == by_hand(ODD)


def test_exact_dedup_rows(spark):
    rows = exact_dedup.drop_exact_duplicates(docs(spark))
    assert rows.columns == docs(spark).columns
    assert sorted((r.doc_id, r.text) for r in rows.filter("doc_id is not null").collect()) == [
        (2, "a b"),
        (4, ""),
        (5, "a b "),
        (7, "w " * 30000),
    ]
    assert rows.filter("doc_id is null").count() == 1
    assert exact_dedup.dedup_decisions(docs(spark, [])).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs(spark, [])).count() == 0


def targets_by_hand(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / rest for s in names}
        over = {s for s in names if target[s] > most * sizes[s]} - full
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("range_rows", [2, 4096])
def test_mixing(spark, range_rows):
    rows = [(i, "x " * (i % 7 * 11 % 23), "en", f"s{i * i % 5}", 0, None, None) for i in range(60)] + ODD
    found = mixing.mix(docs(spark, rows), range_rows=range_rows).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want, took = targets_by_hand(dict(sizes), mixing.WEIGHTS, mixing.SHARE, mixing.MOST), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == sum(p.words for p in r.passes)
        assert (r.position is None) == (r.taken == 0)
        took[r.source] += r.taken
    assert all(abs(took[s] - want[s]) <= 1 for s in want)
    key = lambda r: repr((r.id, r.source, r.size, r.taken, r.position))
    again = mixing.mix(docs(spark, rows).repartition(3), range_rows=range_rows).collect()
    assert sorted(map(key, found)) == sorted(map(key, again))
    positions = [r.position for r in mixing.in_training_order(mixing.mix(docs(spark, rows))).collect() if r.position is not None]
    assert positions == sorted(positions)


def test_due_inverts_the_integral(spark):
    for schedule in mixing.SCHEDULES + ((0.0, 2.0, 0.0), (1.0, 0.0, 0.0, 3.0)):
        n = len(schedule) - 1

        def integral(t, schedule=schedule, n=n):
            total = 0.0
            for i in range(n):
                x = min(max(t * n - i, 0), 1)
                total += schedule[i] * x + (schedule[i + 1] - schedule[i]) * x * x / 2
            return total

        df = spark.range(0, 11).select((F.col("id") / 10).alias("y"), F.array(*[F.lit(float(x)) for x in schedule]).alias("s"))
        for y, t in df.select("y", mixing.due(F.col("y"), F.col("s"))).collect():
            assert integral(t) / integral(1) == pytest.approx(y, abs=1e-9)


def test_training_rows(spark):
    rows = mixing.training_rows(docs(spark))
    assert rows.columns == docs(spark).columns
    taken = mixing.mix(docs(spark)).agg(F.sum("taken")).first()[0]
    assert rows.agg(F.sum(word_count(F.col("text")))).first()[0] == taken
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.training_rows(docs(spark, [])).count() == 0


def spans_by_hand(text):
    text = text or ""
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


TEXTS = [
    None,
    "",
    "a@b.c_x@d.e.f+g@h.i",
    "é😀 jo.e+x%y@ex-a.co.uk, @b.c a@ x@y z@1.2",
    "1.2.3.4 256.1.1.1 001.02.3.0255 00.0.0.000 1.2.3.4.5.6.7.8.9 1..2.3.4",
    "card 4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559 12 34 4111  1111 1111 1111",
    "+49 (30) 123-45.67 +1 +12345678 +1 (234) 567 89 012 345 678 + 4 +4-",
    "4111111111111111@1.2.3.4",
    "9" * 20000,
    "a" * 9000 + "@" + "b" * 9000,
    "1 " * 40000,
    "+" + "1 " * 40000 + "(",
    "1." * 30000,
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not DE88370400440532013000; ssn 123-45-6789 and 123-45-6789 ",
]


def test_pii(spark):
    rows = docs(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(TEXTS)])
    found = pii.find_pii(rows).select("id", F.concat(*[pii.listed(k) for k in pii.BASE]), F.concat(pii.listed("iban"), pii.listed("ssn")))
    for i, base, more in found.collect():
        assert base == spans_by_hand(TEXTS[i]), TEXTS[i][:60]
        assert more == (["iban:5:32", "iban:37:59", "ssn:93:104"] if i == len(TEXTS) - 1 else [])
    assert pii.find_pii(docs(spark, [])).count() == 0
    marked = pii.redact(pii.find_pii(rows.filter("doc_id = 3")), "email", "<e>").first().content
    assert marked == "é😀 <e>, @b.c a@ <e> z@1.2".replace("<e> z@1.2", "x@y <e>")


def test_iban_before_capitals_and_digits(spark):
    cases = {
        "IBAN DE89370400440532013000 The": ["iban:5:27"],
        "DE89 3704 0044 0532 0130 00 Please pay": ["iban:0:27"],
        "GB82 WEST 1234 5698 7654 32 10 days": ["iban:0:27"],
        "XY12 DE89 3704 0044 0532 0130 00 AND GB82 WEST 1234 5698 7654 32 X": ["iban:5:32", "iban:37:64"],
        "DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32": ["iban:0:27", "iban:28:55"],
        "DE88 3704 0044 0532 0130 00 The, DE89 3704 0044 0532 0130 001 xDE89370400440532013000": [],
        "AB12 " * 20000: [],
    }
    rows = docs(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(cases)])
    found = {r.id: r.spans for r in pii.find_pii(rows).select("id", pii.listed("iban").alias("spans")).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())


def test_clashing_columns(spark):
    from tessera.llm import exact_dedup, mixing, simhash

    names = ["stay_id", "stay_digest", "digest", "copy", "tid", "_tid", "of", "h2", "size", "turn", "key", "_key", "id"]
    rows = [(1, "a b", "s", *range(len(names))), (2, "a b", "s", *range(len(names))), (3, None, None, *range(len(names))), (3, "c d e", "s", *range(len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for found, ids in ((exact_dedup.drop_exact_duplicates(df), [2, 3, 3]), (simhash.drop_near_duplicates(df), [1, 3, 3]), (simhash.drop_similar(df), [1, 3, 3])):
        assert found.columns == df.columns and sorted(r.doc_id for r in found.collect()) == ids
    mixed = mixing.training_rows(df)
    assert mixed.columns == df.columns and {tuple(r)[3:] for r in mixed.collect()} == {tuple(range(len(names)))}
