"""A quality classifier by co-training of two views of a document.

The text view sees the content: its words, and shares of capitals, symbols, digits and repetition. The page view sees what is known
about the page without reading it: language, source, length, and how its lines are laid out. Every document is read once for both. Which words count is
settled by their document frequencies, and the page view's scales by means and deviations, over all documents. Both views are
logistic regressions. They start from labelled rows, of which a bounded sample is used; in each round each view scores all
documents without a label, and those of which it is surest become pseudo-labels for the other view. How sure a view is, and in the
end how both are combined to score every document, is calibrated on labelled rows that neither has been fitted on.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, whole

#: Labelled rows that are fitted on, on average; pseudo-labels of each kind that a view gives the other in a round: those it
#: is surest of, among all documents of which it is at least so sure.
LABELLED, FRESH = 12_000, 1_500
ROUNDS, SURE = 2, 0.98
VOCABULARY, LEAST_DOCS = 1 << 15, 5
PSEUDO_WEIGHT = 0.3
HELD_OUT = 4  # one in so many labelled rows calibrates
LANGUAGES, SOURCES = 8, 16
SHAPE, PAGE = 5, 7 + LANGUAGES + SOURCES
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Words whose counts a task holds before it passes them on.
HELD_WORDS = 1 << 20


@cache
def _kinds() -> np.ndarray:
    """Of each character: 1 a capital, 2 a digit, 3 punctuation or a symbol, else 0."""
    of = {"Lu": 1, "Nd": 2, "P": 3, "S": 3}
    names = (unicodedata.category(chr(i)) for i in range(0x110000))
    return np.fromiter((of.get(c) or of.get(c[0], 0) for c in names), dtype=np.uint8, count=0x110000)


def _one_of(value: str | None, n: int) -> list[float]:
    out = [0.0] * n
    out[crc32((value or "").encode()) % n] = 1.0
    return out


def features(text: str, lang: str | None, source: str | None) -> tuple[bytes, list[float], list[float]]:
    """Hashes of the different words, the shape (with them the text view) and the page view of a document."""
    words = TOKEN.findall(text.lower())
    kinds = set(words)
    hashes = np.sort(np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in kinds), dtype="<u4", count=len(kinds)))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lines = text.split("\n")
    n, m = max(len(text), 1), len(lines)
    count = np.bincount(_kinds()[codes], minlength=4)
    shape = [*(count[1:] / n).tolist(), len(kinds) / (len(words) + 1), math.log1p(len(words) - len(kinds))]
    layout = [math.log1p(max(map(len, lines))), len(set(lines)) / m, sum(not x for x in lines) / m]
    page = [math.log1p(len(text)), math.log1p(m), math.log1p(len(text) / m), float(not text), *layout, *_one_of(lang, LANGUAGES), *_one_of(source, SOURCES)]
    return hashes.tobytes(), shape, page


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def views(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, tid (with id it names the row), t, shape and page of features() of each row; nulls count as empty."""

    def run(batches):
        for batch in batches:
            found = [features(*row) for row in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)])]
            t, shape, page = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(t, pa.binary()), pa.array(shape, pa.list_(pa.float64())), pa.array(page, pa.list_(pa.float64()))], names=["id", "tid", "t", "shape", "page"]
            )

    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tid"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    numbers = T.ArrayType(T.DoubleType())
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("tid", T.LongType()), T.StructField("t", T.BinaryType()), T.StructField("shape", numbers), T.StructField("page", numbers)]))


def document_frequency(rows: DataFrame) -> DataFrame:
    """h, n: the documents of views() that have each word, by hash; each task adds up its own first."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u4"))
            size += len(held[-1])
            if size > 8 * HELD_WORDS:
                yield from counted(held)
                held, size = [], 0
        yield from counted(held)

    def counted(held):
        if held:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return rows.select("t").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def highest(rows: DataFrame, bucket: Column, by: Column, n: int) -> DataFrame:
    """About n rows with the highest buckets (numbers, a bounded set of them), of the last bucket a share by hash.

    Only the counts of buckets come to the driver; a sort with a limit would send it n rows of every task.
    """
    some = rows.withColumn("_bucket", bucket.cast("long"))
    room = n
    for b, count in sorted(((r[0], r[1]) for r in some.groupBy("_bucket").count().collect()), reverse=True):
        if count >= room:
            share = F.pmod(F.xxhash64(F.lit("highest"), by), F.lit(1 << 30)) < int(room / count * (1 << 30))
            return some.filter((F.col("_bucket") > b) | ((F.col("_bucket") == b) & share)).drop("_bucket")
        room -= count
    return rows


def _share(ids: Column, rows: int, bound: int, salt: str) -> Column:
    """True for about bound of so many rows, by a hash of the id."""
    limit = min(1.0, bound / max(rows, 1))
    return F.pmod(F.xxhash64(F.lit(salt), ids), F.lit(1 << 20)) < int(limit * (1 << 20))


@dataclass
class View:
    """A fitted logistic regression."""

    weights: np.ndarray
    offset: float


@dataclass
class CoTrained:
    """The fitted views and how they combine: p = 1 / (1 + exp(-(a * text + b * page + c)))."""

    #: Hashes of the words that count, ascending; means and deviations of the page's numbers.
    vocabulary: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    text: View | None
    page: View | None
    combined: tuple[float, float, float]
    #: Platt scaling of each view alone.
    alone: dict[str, tuple[float, float]]
    #: views() of the documents that it was fitted on.
    known: DataFrame | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": None}

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the vocabulary of hashes, and which of them are in it."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), max(len(self.vocabulary) - 1, 0))
        return at, (self.vocabulary[at] == h) if len(self.vocabulary) else np.zeros(len(h), dtype=bool)

    def margins(self, t: list[bytes], shape: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and page margins of rows; 0 without a fit."""
        if self.text is None:
            return np.zeros(len(t)), np.zeros(len(t))
        row = np.repeat(np.arange(len(t)), [len(x) // 4 for x in t])
        at, known = self.places(np.frombuffer(b"".join(t), dtype="<u4"))
        w = self.text.weights
        of_words = np.bincount(row[known], weights=w[at[known]], minlength=len(t))
        return of_words + shape @ w[len(self.vocabulary) :] + self.text.offset, self.scaled(page) @ self.page.weights + self.page.offset

    def scaled(self, page: np.ndarray) -> np.ndarray:
        return (page - self.means) / self.scales

    def chances(self, t: list[bytes], shape: np.ndarray, page: np.ndarray) -> list[np.ndarray]:
        """p_text, p_page and score of rows."""
        text, page = self.margins(t, shape, page)
        (a, b, c), logistic = self.combined, lambda x: np.round(1 / (1 + np.exp(-np.clip(x, -500, 500))), 6)
        if self.text is None:
            return [logistic(np.full(len(t), c))] * 3
        return [*(logistic(self.alone[n][0] * m + self.alone[n][1]) for n, m in (("text", text), ("page", page))), logistic(a * text + b * page + c)]

    def scored(self, rows: DataFrame) -> DataFrame:
        """id, p_text, p_page, score, keep of rows of views()."""

        def run(batches):
            for batch in batches:
                p = self.chances(batch.column(1).to_pylist(), _matrix(batch.column(2), SHAPE), _matrix(batch.column(3), PAGE))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p), pa.array(p[2] >= 0.5)], names=["id", "p_text", "p_page", "score", "keep"])

        kind = [rows.schema["id"], *[T.StructField(n, T.DoubleType()) for n in ("p_text", "p_page", "score")], T.StructField("keep", T.BooleanType())]
        return rows.select("id", "t", "shape", "page").mapInArrow(run, T.StructType(kind))

    def score(self, docs: DataFrame | None = None, **columns: str) -> DataFrame:
        """id, p_text, p_page, score, keep: one row for each row of docs, or of the documents that it was fitted on. Null texts, languages
        and sources count as empty; rows that repeat are scored alike; an empty table gives an empty result; other columns are ignored."""
        return self.scored(self.known if docs is None else views(docs, **columns))

    def good_rows(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
        """The rows of docs that are kept, with all their columns, whatever their names."""
        at = [docs.columns.index(c) for c in (text_col, lang_col, source_col)]

        def run(batches):
            for batch in batches:
                rows = zip(*[[None if x is None else str(x) for x in batch.column(i).to_pylist()] for i in at])
                found = [features(t or "", lang, source) for t, lang, source in rows]
                if found:
                    t, shape, page = zip(*found)
                    yield batch.filter(pa.array(self.chances(list(t), np.array(shape), np.array(page))[2] >= 0.5))

        return docs.mapInArrow(run, docs.schema)


def _fit(rows: DataFrame, features: str, reg: float) -> View:
    model = LogisticRegression(featuresCol=features, labelCol="good", weightCol="weight", regParam=reg, maxIter=25, standardization=False).fit(rows)
    return View(model.coefficients.toArray(), float(model.intercept))


def platt(x: np.ndarray, good: np.ndarray, reg: float = 1e-4) -> tuple[float, ...]:
    """Weights of margins (columns) and the offset that fit labels, by Newton steps; for the bounded rows that are held out."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-12] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.diag([*[reg] * x.shape[1], 1e-9])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(z) + ridge, z.T @ (p - good) / len(z) + ridge @ w)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return (*(w[:-1] / scale).tolist(), float(w[-1] - (w[:-1] * mean / scale).sum()))


def _vectors(rows: DataFrame, model: CoTrained) -> DataFrame:
    """rows of views() with text_features and page_features, to be fitted on: a bounded number."""

    @F.udf(VectorUDT())
    def text(t, shape):
        at, known = model.places(np.frombuffer(bytes(t), dtype="<u4"))
        n = len(model.vocabulary)
        return Vectors.sparse(n + SHAPE, [*np.unique(at[known]).tolist(), *range(n, n + SHAPE)], [1.0] * len(np.unique(at[known])) + list(shape))

    @F.udf(VectorUDT())
    def page(x):
        return Vectors.dense(model.scaled(np.array(x)))

    return rows.withColumn("text_features", text("t", "shape")).withColumn("page_features", page("page"))


def _surest(model: CoTrained, marks: DataFrame, fresh: int) -> DataFrame:
    """view, good, id, tid: of each view, the documents without a label of which it is surest, `fresh` of each kind at most, texts once."""

    def run(batches):
        for batch in batches:
            m = model.margins(batch.column(2).to_pylist(), _matrix(batch.column(3), SHAPE), _matrix(batch.column(4), PAGE))
            m = [model.alone[n][0] * x + model.alone[n][1] for n, x in zip(("text", "page"), m)]
            far = pa.array(np.maximum(*map(np.abs, m)) >= math.log(SURE / (1 - SURE)))
            yield pa.RecordBatch.from_arrays([x.filter(far) for x in (*batch.columns[:2], *map(pa.array, m))], names=["id", "tid", "text", "page"])

    rows = model.known.select("id", "tid", "t", "shape", "page")
    schema = T.StructType([rows.schema["id"], T.StructField("tid", T.LongType()), T.StructField("text", T.DoubleType()), T.StructField("page", T.DoubleType())])
    sure = rows.mapInArrow(run, schema)
    sure = sure.join(marks.select("label_id"), sure["id"] == marks["label_id"], "left_anti")
    sure = keep(sure.groupBy("tid").agg(F.min(F.struct("text", "page", "id")).alias("r")).select("tid", "r.*"), "sure")
    picked = []
    for view in ("text", "page"):
        for good, m in ((1.0, F.col(view)), (0.0, -F.col(view))):
            best = highest(sure.filter(m >= math.log(SURE / (1 - SURE))), F.least(F.floor(m * 8), F.lit(8000)), F.col("tid"), fresh)
            picked.append(best.select(F.lit(view).alias("view"), F.lit(good).alias("good"), "id", "tid"))
    return keep(picked[0].unionByName(picked[1]).unionByName(picked[2]).unionByName(picked[3]), "surest")


def cotrain(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, fresh: int = FRESH, rounds: int = ROUNDS, id_col: str = "doc_id", **columns: str) -> CoTrained:
    """Fit on labels: doc_id and good (1 or 0), of which about `labelled` are used; everything else is of all documents.

    Without labels of both kinds among the rows that training and calibration would use, every document gets the share of good
    labels (1 without labels) as its score. Of labels that repeat an id the smallest counts; null ids have no label. Of rows that
    repeat an id one is fitted on, that with the smallest hash of its text.
    """
    marks = labels.filter("doc_id is not null and good is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("good").cast("double").alias("good"))
    known = keep(views(docs, id_col=id_col, **columns), "quality-views")
    some = marks.filter(_share(F.col("label_id"), marks.count(), labelled, "labelled"))
    sample = known.join(some, known["id"] == some["label_id"]).drop("label_id")
    sample = sample.groupBy("id").agg(F.min(F.struct("tid", "t", "shape", "page", "good")).alias("r")).select("id", "r.*")
    sample = keep(sample.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(HELD_OUT)) == 0), "quality-sample")
    counts = {(r.held, r.good): r.n for r in sample.groupBy("held", "good").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 4:
        good, every = sum(n for (_, g), n in counts.items() if g), sum(counts.values())
        p = min(max(good / every, 1e-6), 1 - 1e-6) if every else 1 - 1e-6
        return CoTrained(np.zeros(0, np.uint32), np.zeros(PAGE), np.ones(PAGE), None, None, (0.0, 0.0, math.log(p / (1 - p))), {}, known)
    counted = keep(document_frequency(known).filter(F.col("n") >= LEAST_DOCS), "frequencies")
    # At most about VOCABULARY words, however many there are.
    common = highest(counted, F.floor(F.log2("n") * 16), F.col("h"), VOCABULARY)
    words = np.sort(np.array([r.h for r in common.collect()], dtype=np.uint32))
    figures = known.agg(*[f(F.get("page", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(PAGE)]).first()
    scales = np.array(figures[PAGE:])
    model = CoTrained(words, np.array(figures[:PAGE]), np.where(scales > 1e-9, scales, 1.0), None, None, (0.0, 0.0, 0.0), {}, known)
    cols = ["good", "weight", "text_features", "page_features"]
    train = keep(_vectors(sample.filter("not held"), model).withColumn("weight", F.lit(1.0)).select(cols), "train")
    more: dict[str, DataFrame | None] = {"text": None, "page": None}
    regs = {"text": 5e-5, "page": 1e-4}

    def held_out() -> None:
        """Calibrates both views and their sum on the rows that are held out."""

        def run(batches):
            for batch in batches:
                m = model.margins(batch.column(1).to_pylist(), _matrix(batch.column(2), SHAPE), _matrix(batch.column(3), PAGE))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, m)], names=["good", "m_text", "m_page"])

        rows = sample.filter("held").select("good", "t", "shape", "page").mapInArrow(run, "good double, m_text double, m_page double").toArrow()
        good, text, page = (rows.column(i).to_numpy() for i in range(3))
        model.alone = {"text": platt(text[:, None], good), "page": platt(page[:, None], good)}
        model.combined = platt(np.column_stack([text, page]), good)

    for step in range(rounds + 1):
        for name, extra in more.items():
            every = train if extra is None else train.unionByName(extra)
            every = every.coalesce(8).cache()
            setattr(model, name, _fit(every, f"{name}_features", regs[name]))
            every.unpersist()
        held_out()
        if step == rounds:
            break
        # What one view is sure of teaches the other; the last round's pseudo-labels replace those before.
        surest = _surest(model, marks, fresh).alias("s")
        same = F.col("k.id").eqNullSafe(F.col("s.id")) & (F.col("k.tid") == F.col("s.tid"))
        # At most 4 * fresh rows.
        taught = known.alias("k").join(F.broadcast(surest), same).select("k.*", "s.view", "s.good").dropDuplicates(["id", "tid", "view"])
        taught = keep(_vectors(taught, model).withColumn("weight", F.lit(PSEUDO_WEIGHT)).select("view", *cols), "taught")
        more = {to: taught.filter(F.col("view") == name).drop("view") for name, to in (("page", "text"), ("text", "page"))}
    return model


def clean_labels(labels: DataFrame) -> DataFrame:
    """doc_id and good: 1 for labelled quality that is not toxic."""
    return labels.select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good"))
