"""WARC archives: write captures as records, read records back, assemble them into captures.

Archives are written by Spark's text sink, one gzip file a task, with the blank lines that end a record as
the line separator, so any file system that Spark knows will do. They are read as binary files and parsed as a stream:
a task holds one file's compressed bytes and one record at a time; `records_per_file` bounds the first.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep

CRLF = "\r\n"
#: Payloads from this size on are written once; equal ones become revisits.
REVISIT_FROM = 1000
RECORDS_PER_FILE = 30_000
BATCH_BYTES = 4_000_000

RECORD = (
    "record_id string, type string, date string, target_uri string, concurrent_to array<string>, refers_to string, "
    "payload_digest string, http_head string, payload binary"
)


def _uuid(*parts: Column) -> Column:
    """A record id named by the parts."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4),
        F.lit("-"), F.substring(h, 21, 12), F.lit(">"),
    )


def _head(*fields: tuple[str, Column | str]) -> Column:
    """Header lines of the fields that are not null, and the blank line."""
    lines = [F.concat(F.lit(f"{name}: "), v if isinstance(v, Column) else F.lit(v), F.lit(CRLF)) for name, v in fields]
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(CRLF))


def plan_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """id, url, payload, digest, bytes and winner (the id whose capture holds this payload) of each page.

    The winner among equal payloads of at least revisit_from bytes is the largest id; smaller payloads and null
    ids are their own winners.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    # Kept, so that the planner knows its size: if it is small, the payloads stay where they are.
    shared = keep(
        pages.select(F.col(id_col).alias("id"), payload.alias("payload"))
        .filter(F.octet_length("payload") >= revisit_from)
        .select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
        .groupBy("digest", "bytes")
        .agg(F.max("id").alias("top"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n"),
        "shared-payloads",
    )
    joined = rows.join(shared, ["digest", "bytes"], "left")
    return joined.select("id", "url", "payload", "digest", "bytes", F.when(F.col("id").isNotNull(), F.col("top")).alias("top")).select(
        "id", "url", "payload", "digest", "bytes", F.coalesce("top", "id").alias("winner")
    )


def write_warc(captures: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a request, a response or revisit, and a metadata record for each row of plan_captures().

    Line breaks in urls, which a header cannot hold, are taken out. Rows alike in id and payload get the same
    record ids, so they are assembled into one capture, which counts them.
    """
    url = F.regexp_replace("url", r"[\r\n]+", "")
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    own = _uuid(F.lit("response"), F.col("id"), F.col("digest"))
    original = _uuid(F.lit("response"), F.col("winner"), F.col("digest"))
    is_revisit = ~F.col("winner").eqNullSafe(F.col("id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    body = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    size = F.octet_length(http) + F.when(is_revisit, F.lit(0).cast("long")).otherwise(F.col("bytes"))
    answer = F.concat(
        _head(
            ("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", own),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(is_revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(is_revisit, original)),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", size.cast("string")),
        ),
        body,
    )
    ask = F.concat(F.lit("GET "), F.coalesce(F.nullif(url, F.lit("")), F.lit("/")), F.lit(" HTTP/1.1" + CRLF), F.lit("Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF * 2))

    def beside(kind: str, content_type: str, block: Column) -> Column:
        return F.concat(
            _head(
                ("WARC-Type", kind),
                ("WARC-Record-ID", _uuid(F.lit(kind), own)),
                ("WARC-Date", date),
                ("WARC-Target-URI", url),
                ("WARC-Concurrent-To", own),
                ("Content-Type", content_type),
                ("Content-Length", F.octet_length(block).cast("string")),
            ),
            block,
        )

    about = F.concat(F.lit("pageId: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(CRLF))
    records = F.array(beside("request", "application/http; msgtype=request", ask), answer, beside("metadata", "application/warc-fields", about))
    (
        captures.select(F.explode(records).alias("value"))
        .write.option("lineSep", CRLF * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def _inflate(data: bytes):
    """The bytes of a file in pieces, unpacked if they are gzip members."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view = memoryview(data)
    at, step = 0, 1 << 20
    while at < len(data):
        z, rest = zlib.decompressobj(31), None
        while at < len(data) and not z.eof:
            piece = view[at : at + step]
            out = z.decompress(piece)
            at += len(piece) - len(z.unused_data)
            if out:
                yield out
        if not z.eof:
            raise ValueError("the archive ends inside a gzip member")


class _Stream:
    def __init__(self, pieces):
        self.pieces, self.held, self.at = pieces, b"", 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held, self.at = self.held[self.at :] + piece, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before the next mark, which is skipped; None at the end."""
        start = self.at
        while (found := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self.more():
                return None
        out, self.at = self.held[self.at : found], found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        have = len(self.held) - self.at
        if have >= n:
            out, self.at = self.held[self.at : self.at + n], self.at + n
            return out
        parts, need = [self.held[self.at :]], n - have
        self.held, self.at = b"", 0
        while need:
            piece = next(self.pieces, None)
            if piece is None:
                raise ValueError("the archive ends inside a record")
            parts.append(piece[:need])
            if len(piece) > need:
                self.held = piece[need:]
            need -= min(need, len(piece))
        return b"".join(parts)


def records_of(data: bytes):
    """The records of an archive, as dicts with the columns of RECORD."""
    stream = _Stream(_inflate(data))
    while True:
        head = stream.until(b"\r\n\r\n")
        if head is None:
            if stream.held[stream.at :].strip(b"\r\n"):
                raise ValueError("the archive ends inside a header")
            return
        lines = head.lstrip(b"\r\n").split(b"\r\n")
        if lines == [b""]:  # the blank lines after a record
            continue
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields: dict[str, list[str]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            fields.setdefault(name.decode("utf-8", "replace").lower(), []).append(value.strip().decode("utf-8", "replace"))
        block = stream.take(int(fields["content-length"][0]))
        one = lambda name: fields.get(name, [None])[0]
        http, payload = None, block
        if (one("content-type") or "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            cut = len(block) if cut < 0 else cut + 4
            http, payload = block[:cut].decode("utf-8", "replace"), block[cut:]
        yield {
            "record_id": one("warc-record-id"),
            "type": one("warc-type"),
            "date": one("warc-date"),
            "target_uri": one("warc-target-uri"),
            "concurrent_to": fields.get("warc-concurrent-to", []),
            "refers_to": one("warc-refers-to"),
            "payload_digest": one("warc-payload-digest"),
            "http_head": http,
            "payload": payload,
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, plain or gzip. A broken archive fails the job."""
    schema = pa.schema(
        [
            *[(n, pa.string()) for n in ("record_id", "type", "date", "target_uri")],
            ("concurrent_to", pa.list_(pa.string())),
            *[(n, pa.string()) for n in ("refers_to", "payload_digest", "http_head")],
            ("payload", pa.binary()),
        ]
    )

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for r in records_of(data.as_py()):
                    rows.append(r)
                    size += len(r["payload"]) + 500
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata, and how many of each were found.

    A response or revisit record gives the capture its id; requests and metadata join it by concurrent-to, or
    stand in a capture of the id that they name if no such record exists. Of several records of a kind the one
    with the smallest id is shown (and for one id, the smallest content). Combined before the shuffle, so that a capture
    with very many records is no large group.
    """
    answers = F.col("type").isin("response", "revisit", "resource")
    known = records.filter(answers | F.col("type").isin("request", "metadata"))
    keyed = known.withColumn("capture_id", F.when(answers, F.col("record_id")).otherwise(F.coalesce(F.get("concurrent_to", F.lit(0)), "record_id")))
    row = F.struct("record_id", "type", "date", "target_uri", "refers_to", "payload_digest", "http_head", "payload")
    is_kind = {"request": F.col("type") == "request", "response": answers, "metadata": F.col("type") == "metadata"}
    return keyed.groupBy("capture_id").agg(
        *[F.min(F.when(where, row)).alias(k) for k, where in is_kind.items()],
        *[F.count(F.when(where, 1)).alias(f"{k}s") for k, where in is_kind.items()],
    )


def page_facts(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: one row per response of the captures.

    Digest and size are those of the payload read; a revisit has those of the response that it refers to, null
    if the archives lack it. Captures without a response give no row.
    """
    page = F.regexp_extract(F.col("metadata.payload").cast("string"), "pageId: (-?[0-9]+)", 1).try_cast("long")
    facts = keep(
        captures.filter("responses > 0").select(
            "capture_id",
            page.alias("page_id"),
            F.sha1("response.payload").alias("payload_digest"),
            F.octet_length("response.payload").cast("long").alias("payload_bytes"),
            F.col("response.type").alias("record_type"),
            F.col("response.refers_to").alias("original"),
            "responses",
        ),
        "captures",
    )
    first = facts.filter("record_type != 'revisit'")
    again = facts.filter("record_type = 'revisit'").select("page_id", "record_type", "original", "responses")
    held = first.select(F.col("capture_id").alias("original"), F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    rows = first.withColumn("refers_to", F.lit(None).cast("long")).drop("capture_id").unionByName(again.join(held, "original", "left"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("responses").cast("int"))))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
