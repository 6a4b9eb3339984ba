import gzip
import hashlib

import pytest

from tessera.llm import warc
from tessera.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, type string, payload int"
BIG = "<p>é WARC/1.1\r\nWARC-Type: response\r\n\r\n</p>" * 40


def by_hand(rows):
    groups = {}
    for i, _, h, *_ in rows:
        if i is not None:
            groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        top = max(groups[h or ""]) if i is not None else None
        again = len(data) >= 1000 and top != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a.b/c?d\r\nX: y", BIG, "t", 1),
    (2, None, BIG, None, None),
    (3, "", BIG, None, None),
    (4, "https://x.y", None, None, None),
    (5, "u", "", None, None),
    (6, "u", "small", None, None),
    (7, "u", "small", None, None),
    (7, "u", "small", None, None),
    (3, "", BIG, None, None),
    (None, "n", BIG, None, None),
    (8, "u", "\r\n\r\n" * 3, None, None),
    (9, "long", "z" * 3_000_000, None, None),
    (10, "long", "z" * 3_000_000, None, None),
]


def round_trip(spark, rows, **options):
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.plan_captures(spark.createDataFrame(rows, SCHEMA)), path, **options)
    return path, warc.assemble(warc.read_warc(spark, path))


@pytest.mark.parametrize("options", [{}, {"records_per_file": 2}])
def test_round_trip(spark, options):
    _, captures = round_trip(spark, ROWS, **options)
    assert sorted(map(tuple, warc.page_facts(captures).collect()), key=repr) == by_hand(ROWS)
    seven = captures.filter("cast(metadata.payload as string) like '%pageId: 7\r\n'").first()
    assert (seven.requests, seven.responses, seven.metadatas) == (2, 2, 2)
    assert bytes(seven.response.payload) == b"small" and seven.request.http_head.startswith("GET u HTTP/1.1")
    one = captures.filter("request.target_uri = 'http://a.b/c?dX: y'").first()
    assert one.response.type == "revisit" and "Host: a.b\r\n" in one.request.http_head


def test_empty(spark):
    _, captures = round_trip(spark, [])
    assert captures.count() == 0 and warc.page_facts(captures).count() == 0


def test_odd_archives(spark):
    def record(kind, rid, more="", body=b"x"):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    plain = record("warcinfo", "<i>") + record("response", "<r>") + record("metadata", "<m>", "warc-concurrent-to: <r>\r\n") + record("request", "<q>", "WARC-Concurrent-To: <gone>\r\n")
    members = b"".join(gzip.compress(record("response", f"<r{i}>", body=b"y" * i)) for i in range(3))
    read = [r["record_id"] for r in warc.records_of(plain)]
    assert read == ["<i>", "<r>", "<m>", "<q>"]
    assert [len(r["payload"]) for r in warc.records_of(members)] == [0, 1, 2]
    for broken in (plain[:-30], plain[: plain.index(b"x\r\n")], members[:-3], b"not an archive\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records_of(broken))
    rows = spark.createDataFrame(
        [(r["record_id"], r["type"], None, None, r["concurrent_to"], None, None, None, r["payload"]) for r in warc.records_of(plain)], warc.RECORD
    )
    found = {c.capture_id: (c.requests, c.responses, c.metadatas) for c in warc.assemble(rows).collect()}
    assert found == {"<r>": (0, 1, 1), "<gone>": (1, 0, 0)}
