"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, hnsw, knn, mixing, passages, pieces, pii, quality, simhash, spelling, suffixes, warc
from .common import keep, scratch_path, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.plan_captures(table(spark, sf_dir, "pages")), path)
    return warc.page_facts(warc.assemble(warc.read_warc(spark, path)))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.array_join(F.concat(*[pii.listed(k) for k in pii.BASE]), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.concat(*[pii.listed(k) for k in pii.PATTERNS]), ",").alias("spans"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.in_training_order(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup_decisions(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeated_strings(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents"), pieces.load(), round_trip=True)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_ids"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("content")).alias("lossless"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.cotrain(documents, quality.clean_labels(table(spark, sf_dir, "labels")))
    return model.score().withColumnRenamed("id", "doc_id")


def op10_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = knn.knn_join(vectors, vectors.filter("vec_id % 50 = 0"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = alignment.load()
    aligned = alignment.align(table(spark, sf_dir, "documents"), sides)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = keep(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counts = keep(alignment.pair_counts(aligned, sides), "pair-counts")
    found = alignment.link_facts(aligned, counts)
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {
    f.__name__: f
    for f in (
        op13_neighbours, op12_spelling, op11_alignment, op7_quality,
        op9_pieces, op8_suffixes, op6_passages, op10_knn,
        op1_warc, op2_pii, op3_simhash, op4_mixing,
        op5_exact_dedup,
    )
}

ORACLES = {
    "op13_neighbours": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
                     WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
     reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON r.b = p.a),
     c AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
     n AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
""",
    # The CRC-32 goes over the bytes by a table that eight shifts of each number make.
    "op12_spelling": r"""
WITH RECURSIVE c AS (SELECT list(v ORDER BY k) AS t FROM (
       SELECT k, list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, k) AS v FROM range(256) r(k))),
     r AS (SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x, count(*) AS m
           FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS x FROM documents) GROUP BY ALL),
     b AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || x)) AS s FROM r),
     y AS (SELECT x, m, list_transform(range(len(s) // 2), lambda i: CAST('0x' || substr(s, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM b),
     h AS (SELECT x, m, xor(list_reduce(bytes, lambda a, e: xor(a >> 8, t[(xor(a, e) & 255) + 1]), 4294967295), 4294967295) AS h FROM y, c),
     w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(x, 1, h % length(x)) || substr(x, h % length(x) + 2) ELSE x END AS word, sum(m)::BIGINT AS n FROM h GROUP BY ALL),
     v AS MATERIALIZED (SELECT word, n FROM w WHERE length(word) >= 5 AND n >= 3),
     g AS (SELECT word, n, i, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
     pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM g a JOIN g b USING (i, p, s) WHERE a.word <> b.word
               UNION SELECT g.word, v.word, v.n FROM g JOIN v ON v.word = p || s
               UNION SELECT v.word, g.word, g.n FROM g JOIN v ON v.word = p || s),
     f AS MATERIALIZED (SELECT v.word, v.n, count(near) AS n_near, arg_min(near, (-near_n, near)) AS near, arg_min(near_n, (-near_n, near)) AS near_n
           FROM v LEFT JOIN pairs USING (word) GROUP BY ALL),
     o AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM f),
     z AS (SELECT word, word AS root, 0 AS steps FROM o UNION ALL SELECT z.word, o.form, steps + 1 FROM z JOIN o ON o.word = z.root WHERE o.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM o JOIN (SELECT word, arg_max(root, steps) AS root FROM z GROUP BY word) USING (word)
""",
    "op6_passages": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     i AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
     x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM i JOIN d USING (doc_id)),
     m AS (SELECT h, min(doc_id) AS owner FROM x GROUP BY h),
     g AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM x JOIN m USING (h), range(50) t(j) WHERE owner < doc_id GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda e, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
""",
    "op10_knn": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
     s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
           FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op1_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     t AS (SELECT *, max(page_id) OVER (PARTITION BY n, d) AS top FROM p),
     r AS (SELECT *, n >= 1000 AND page_id < top AS again FROM t)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN top END AS refers_to
FROM r
""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
}
