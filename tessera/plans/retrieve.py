"""Questions to ranked contexts: the whole of hybrid retrieval as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keywords, pool, signals, vectors
from ..operators.table_rows import ROW_TYPE
from ..sources.tables import small, spread, written

DEFAULTS = {"section": "string", "order": "int", "section_order": "int", "chunk_type": "string", "section_title": "string", "heading_path": "string", "group_context": "string", "table_name": "string", "table": "string", "parent": "string"}


def prepared(chunks: DataFrame) -> DataFrame:
    """chunks with every column that retrieval looks at; missing ones are null, cells are none, the kind is text."""
    for name, kind in DEFAULTS.items():
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, F.lit(None).cast(kind))
    if "cells" not in chunks.columns:
        chunks = chunks.withColumn("cells", F.array().cast(ROW_TYPE))
    return chunks.withColumn("chunk_type", F.coalesce("chunk_type", F.lit("text")))


def retrieve(
    chunks: DataFrame, questions: DataFrame, vector_hits: DataFrame, rerank: DataFrame | None = None, most: int | None = None, keyword_only: bool = False, sections: DataFrame | None = None,
    index: keywords.Index | None = None,
) -> DataFrame:
    """question, key, document, score, rank: the contexts of each question in the order in which they are shown.

    chunks: key, tenant, document, content and what prepared() adds; questions: question, tenant, text, a bounded
    table; vector_hits: question, key; rerank: question, key, rerank, optional. Steps: signals, keyword search,
    anchors, pool, fusion, adjustments, selection within the limits of the question's kind. index: keywords.read_index() of these chunks, optional.

    sections: tenant, document, number, title, heading_path, optional. With them a question whose words name a section is locked to it and those
    below; others take sections, ranges, siblings, parents and tables around their hits; and with rerank scores a sure best hit locks the
    others to its section in a second pass [R1-R6]. Then branch and locked are given as well.
    """
    has_cells = "cells" in chunks.columns
    chunks = spread(prepared(chunks))
    asked = signals.with_signals(questions, "text").withColumn("intent", signals.intent(F.col("text"))["kind"])
    limit = signals.context_limit(F.col("intent"), F.lit(False), F.size("labels") >= 2, (F.size("words") <= 1), None if most is None else F.lit(most))
    asked = written(asked.withColumn("limit", limit), "asked")
    # Written: the few hits and candidates of the questions, which several later steps read.
    words = written(keywords.search(chunks if has_cells else chunks.drop("cells"), asked, "key", "tenant", index=index), "keyword-hits")
    vector_hits = written(vector_hits, "vector-hits")
    hits = vectors.merge_hits(vector_hits, words)
    near = chunks.select("key", "document").join(small(vector_hits), "key").select("question", "document")
    anchors = written(pool.lexical_anchors(chunks, questions, written(near, "near")), "anchors")
    if sections is None:
        expanded = asked.filter(F.col("intent").isin(*signals.EXPANDED)).select("question")
        found = pool.candidate_pool(chunks, vector_hits, words, anchors, expanded, keyword_only).withColumn("branch", F.lit(None).cast("string")).withColumn("locked", F.lit(False))
    else:
        found = _scoped(chunks, asked, questions, vector_hits, words, anchors, sections, hits, rerank, keyword_only)
    rows = written(_scored(found, chunks, asked, hits, rerank), "scored")
    rows = pool.adjusted(rows, "fused")
    rows = rows.withColumn("budget", signals.char_budget(F.col("intent"), F.col("locked"))).withColumn("chars", F.length("content"))
    kept = vectors.select_within(rows.drop("chars").withColumn("length", F.length("content")), "adjusted", "length", 25, 18000)
    kept = kept.filter((F.col("rank") <= F.col("limit")) & ((F.col("chars") <= F.col("budget")) | (F.col("rank") == 1)))
    shown = vectors.presentation_order(kept, "document", "section_order", "order")
    return shown.select("question", "key", "document", F.col("adjusted").alias("score"), "rank", *([] if sections is None else ["branch", "locked"]))


def _scored(found: DataFrame, chunks: DataFrame, asked: DataFrame, hits: DataFrame, rerank: DataFrame | None) -> DataFrame:
    """Candidates with what they are judged by, and fused scores."""
    hay = signals.squeeze(signals.fold(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("heading_path", "section_title", "content")])))
    # Candidates are few: chunks are not shuffled for them.
    rows = chunks.join(small(written(found, "found")), "key").join(small(asked.drop("tenant")), "question").withColumn("hay", hay).withColumn("terms", pool.question_words(F.col("text")))
    rows = rows.join(hits.select("question", "key", "vector", "keyword"), ["question", "key"], "left").fillna(0.0, ["vector", "keyword"])
    rows = vectors.lexical(pool.bounded(rows))
    if rerank is not None:
        rows = rows.join(rerank, ["question", "key"], "left")
    return rows.withColumn("fused", vectors.fused(F.col("rerank") if rerank is not None else None))


def _scoped(chunks, asked, questions, vector_hits, words, anchors, sections, hits, rerank, keyword_only) -> DataFrame:
    """question, key, branch, locked: locked pools where a heading or, in a second pass, the best hit names a section; semantic ones else."""
    # Written: the pools of a bounded number of questions, which the steps after them read several times.
    fixed = written(pool.locked_pool(chunks, pool.heading_scopes(questions, sections), vector_hits), "locked")
    free = written(pool.semantic_pool(chunks, vector_hits, anchors, asked).join(fixed.select("question").distinct(), "question", "left_anti"), "free")
    if rerank is not None:
        first = _scored(pool.united(free), chunks, asked, hits, rerank)
        best = written(first.select("question", "key", "document", "section", "intent", "identifiers", "labels", "dates", "numbers", F.col("fused").alias("score")), "first-pass")
        second = written(pool.locked_pool(chunks, pool.rerank_scopes(best, sections), vector_hits).filter("branch = 'locked'"), "second")
        free = free.join(second.select("question").distinct(), "question", "left_anti")
        fixed = fixed.unionByName(second)
    any_hit = vector_hits.select("question").distinct().unionByName(fixed.select("question").distinct()).distinct()
    more = words.select("question", "key", F.lit("keyword").alias("branch"))
    every = pool.united(fixed.unionByName(free).unionByName(more))
    every = every if keyword_only else every.join(any_hit, "question", "left_semi")
    every = written(every, "pool")
    return every.join(fixed.select("question").distinct().withColumn("locked", F.lit(True)), "question", "left").fillna(False, ["locked"])


def compare(chunks: DataFrame, questions: DataFrame, first: dict, second: dict) -> DataFrame:
    """The contexts of the same questions under two settings of retrieve(), marked a and b [R19]."""
    runs = [retrieve(chunks, questions, **s).withColumn("setting", F.lit(n)) for n, s in (("a", first), ("b", second))]
    return runs[0].unionByName(runs[1])
