"""Documents from files: which are admitted, plain texts, word documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_kind

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "path string, block int, kind string, style string, text string, row int, col int, span int, error string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, content, admitted of each file: a known kind, no macros, and ZIP bytes where the kind is a ZIP [S1, S5]."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", file_kind("path").alias("kind"), "content", admitted(F.col("path"), F.col("content")).alias("admitted"))


def admitted(path: Column, content: Column) -> Column:
    kind = file_kind(path)
    zipped = F.hex(F.substring(content, 1, 4)) == "504B0304"
    return kind.isin("PDF", "TXT", "DOCX") & ~F.lower(path).rlike(r"\.(?:docm|dotm|xlsm|pptm)$") & F.when(kind == "DOCX", zipped).otherwise(F.lit(True))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of plain text files, whole [S2]."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def docx_blocks(content: bytes) -> Iterator[dict]:
    """Paragraphs and cells of a word document in order; a cell that continues a merged one above is left out [S4, S20]."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def words(node) -> str:
        parts = [x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "" for x in node.iter()]
        return re.sub(r"[ \t]+", " ", "".join(parts)).strip()

    for n, node in enumerate(body if body is not None else []):
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            yield {"block": n, "kind": "paragraph", "style": None if style is None else style.get(f"{_W}val"), "text": words(node), "row": None, "col": None, "span": None}
        elif node.tag == f"{_W}tbl":
            for r, row in enumerate(node.findall(f"{_W}tr")):
                at = 0
                for cell in row.findall(f"{_W}tc"):
                    span = cell.find(f"{_W}tcPr/{_W}gridSpan")
                    wide = int(span.get(f"{_W}val")) if span is not None else 1
                    merge = cell.find(f"{_W}tcPr/{_W}vMerge")
                    if merge is None or merge.get(f"{_W}val") == "restart":
                        yield {"block": n, "kind": "cell", "style": None, "text": " ".join(filter(None, map(words, cell.findall(f"{_W}p")))), "row": r, "col": at, "span": wide}
                    at += wide


def read_docx(files: DataFrame) -> DataFrame:
    """Blocks of the admitted word documents of read_files(); a file that cannot be read gives one row with the error."""

    schema = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in (c.split() for c in BLOCKS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = [{"path": path, **b} for b in docx_blocks(content.as_py())]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.filter("admitted and kind = 'DOCX'").select("path", "content").mapInArrow(run, BLOCKS)


def cell_markdown(cells: DataFrame, *keys: str) -> DataFrame:
    """keys, markdown: the cells of each table as a pipe table, its first row as header."""
    row = cells.groupBy(*keys, "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda c: F.coalesce(c["text"], F.lit(""))), " | ").alias("line"), F.count("*").alias("n"))
    lines = row.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row", "line", "n"))).alias("rows"))
    line = lambda r: F.concat(F.lit("| "), r["line"], F.lit(" |"))
    first = F.get("rows", F.lit(0))
    rule = F.concat(F.repeat(F.lit("|---"), first["n"].cast("int")), F.lit("|"))
    return lines.select(*keys, F.array_join(F.concat(F.array(line(first), rule), F.transform(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), line)), "\n").alias("markdown"))
