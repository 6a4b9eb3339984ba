"""Listings, keyed lookups and projections of stored rows; names and figures of tables; what is told of requests and failures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import blank, compose, match_form, squeeze
from ..sources.tables import live, soft_delete
from .answers import has_pipe_table
from .table_rows import IDENTIFIER, ROW_NUMBER
from .vectors import first_by

# Kinds of chunks that hold tables; letters with marks and those that stand for them; codes and types of failures.
TABLE_KINDS = ("table_summary", "normalized_table_row", "table_row_group", "text_table_like")
MARKED = {"d": "đ", "a": "áàảãạăắằẳẵặâấầẩẫậ", "e": "éèẻẽẹêếềểễệ", "i": "íìỉĩị", "o": "óòỏõọôốồổỗộơớờởỡợ", "u": "úùủũụưứừửữự", "y": "ýỳỷỹỵ"}
RATE_CODE, RATE_TEXT = "rate_limit_exceeded", "Rate limit"
HEX_ID = r"^(?=.{1,36}$)[0-9A-Fa-f]+(?:-[0-9A-Fa-f]+){4}$"


def listed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with place, from 1: their place in the list of their document, tenant or key [K13, S18]."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def of_keys(rows: DataFrame, **keys) -> DataFrame:
    """Rows with these values, those that are not deleted; None is a value [S18]."""
    return live(reduce(lambda df, kv: df.filter(F.col(kv[0]).eqNullSafe(F.lit(kv[1]))), keys.items(), rows))


def in_tenant(rows: DataFrame, tenants: DataFrame, key: str, wanted: bool) -> DataFrame:
    """rows, joined to their tenants only if the listing asks for tenants [J2]."""
    return rows.join(tenants, key) if wanted else rows


def owned(rows: DataFrame, parents: DataFrame, key: str, deleted_too: bool) -> DataFrame:
    """Rows of parents by their key; deleted_too: also of those that are deleted, which other lookups do not see [S19]."""
    return rows.join((parents if deleted_too else live(parents)).select(key).distinct(), key, "left_semi")


def cascade(tables: dict[str, DataFrame], parents: DataFrame, key: str, where: Column, at: Column) -> dict[str, DataFrame]:
    """Every table with its rows of the parents that meet a condition deleted, and the parents themselves under "parents" [S15]."""
    gone = live(parents).filter(where).select(F.col(key), F.lit(True).alias("_gone")).distinct()
    marked = {n: soft_delete(t.join(gone, key, "left"), F.coalesce("_gone", F.lit(False)), at).drop("_gone") for n, t in tables.items()}
    return marked | {"parents": soft_delete(parents, where, at)}


def stored_config(json: Column, fields: dict[str, str]) -> Column:
    """struct of the fields ($.name: type) of a stored configuration; absent and malformed ones are null, so defaults apply later [P29]."""
    return F.struct(*[F.get_json_object(json, f"$.{n}").try_cast(t).alias(n) for n, t in fields.items()])


def hit_ids(chunk: Column, section: Column, table: Column, document: Column, text: Column) -> Column:
    """struct(chunk, section, table, document) of a vector's payload: blank ids and chunk or document ids that are no UUIDs are null;
    null as a whole if its text is blank [V4]."""
    uuid = lambda c: F.when(c.rlike(HEX_ID), c)
    some = lambda c: F.when(~blank(c), c)
    return F.when(~blank(text), F.struct(uuid(chunk).alias("chunk"), some(section).alias("section"), some(table).alias("table"), uuid(document).alias("document")))


def like_a_table(kind: Column, content: Column) -> Column:
    """A context that is of a table, by its kind or its lines; any() of it over the contexts of a request [O10]."""
    return F.coalesce(F.lower(F.trim(kind)).isin(*TABLE_KINDS), F.lit(False)) | has_pipe_table(content)


def hint(kind: Column, kinds: Column) -> Column:
    """The type that a prompt is told, by the question's and the kinds of its contexts (an array) [P22]."""
    return F.when(F.array_contains(kinds, "text_table_like"), F.when(kind == "TABLE_LOOKUP", kind).otherwise(F.lit("TABLE_LIKE"))).otherwise(kind)


def first_texts(texts: Column, n: int = 6) -> Column:
    """The first n different texts that are not blank, trimmed [O11]."""
    return F.slice(F.array_distinct(F.transform(F.filter(texts, lambda t: ~blank(t)), lambda t: F.regexp_replace(t, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))), 1, n)


def failure(messages: Column, name: Column) -> Column:
    """struct(code, type) of a failure by the messages of its chain of causes; name: of the outermost error [O13]."""
    text = F.array_join(F.filter(messages, lambda m: m.isNotNull()), " ")
    code = F.when(text.contains(RATE_CODE), F.lit(RATE_CODE))
    kind = F.when(text.contains(RATE_CODE), F.lit("tokens")).when(text.contains(RATE_TEXT), F.lit("rate_limit")).otherwise(F.coalesce(name, F.lit("error")))
    return F.struct(code.alias("code"), kind.alias("type"))


def classification(kind: Column, confidence: Column | None = None) -> Column:
    """struct(kind, confidence), the confidence held within 0..1; without one it is the fallback's 0.5 [Q18]."""
    sure = F.lit(0.5) if confidence is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return F.struct(kind.alias("kind"), sure.alias("confidence"))


def variant_key(text: Column, scope: Column, mode: Column) -> Column:
    """What two variants of a question have in common that ask the same: text in composed form without control characters, squeezed and lower, scope
    and mode [Q9]."""
    shown = F.regexp_replace(compose(F.coalesce(text, F.lit(""))), r"[\p{Cc}\p{Cf}&&[^\t\n\r ]]", "")
    return F.concat_ws("|", F.lower(squeeze(shown)), F.coalesce(scope, F.lit("")), F.coalesce(mode, F.lit("")))


def marked_variants(variants: DataFrame, question: str, order: str, text: str, key: str) -> DataFrame:
    """variants with skipped and, where it is, like: the first variant of the question with its key [Q9]."""
    first = F.first(text).over(W.partitionBy(question, key).orderBy(order))
    nth = F.row_number().over(W.partitionBy(question, key).orderBy(order))
    return variants.withColumn("skipped", nth > 1).withColumn("like", F.when(nth > 1, first))


def plain_letters(text: Column) -> Column:
    """Lower case with the letters of MARKED as their base letters; nothing else changes [X5]."""
    marks, bases = "".join(MARKED.values()), "".join(b * len(m) for b, m in MARKED.items())
    return F.translate(F.lower(text), marks, bases)


def preset(name: str, today: Column) -> Column:
    """struct(from, to): the last 7 or 30 days with today, else the month up to today [X11]."""
    first = {"7d": F.date_sub(today, 6), "30d": F.date_sub(today, 29)}.get(name, F.trunc(today, "MM").cast("date"))
    return F.struct(first.alias("from"), today.cast("date").alias("to"))


def holding(chunks: DataFrame, terms: list[str], hay: str) -> DataFrame:
    """term, df: the chunks whose text contains each of a few terms [A11]; one pass, counts only are shuffled."""
    counts = chunks.agg(*[F.count(F.when(F.col(hay).contains(t), 1)).alias(f"t{i}") for i, t in enumerate(terms)])
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms)])
    return counts.select(F.inline(pairs))


def reranked(candidates: DataFrame, question: str, key: str, order: str, score: str, top: int, most: int = 50) -> DataFrame:
    """question, key, place, max_score, min_score: the candidates with a key once each, the first `most` of them by their reranker's score, `top` of these.
    A question without scores keeps all its candidates, in their order, with 1 and 0 [R20]."""
    w = W.partitionBy(question)
    known = candidates.filter(F.col(key).isNotNull()).withColumn("_any", F.max(F.col(score).isNotNull()).over(w))
    kept = first_by(known.filter("_any"), [question, key], [order]).withColumn("_n", F.row_number().over(w.orderBy(order))).filter(F.col("_n") <= most)
    asked = kept.filter(F.col(score).isNotNull()).withColumn("place", F.row_number().over(w.orderBy(F.desc(score), order))).filter(F.col("place") <= top)
    asked = asked.withColumn("max_score", F.greatest(F.lit(0.0), F.max(score).over(w))).withColumn("min_score", F.min(score).over(w))
    rest = known.filter(~F.col("_any")).withColumn("place", F.row_number().over(w.orderBy(order))).withColumn("max_score", F.lit(1.0)).withColumn("min_score", F.lit(0.0))
    cols = [question, key, "place", "max_score", "min_score"]
    return asked.select(*cols).unionByName(rest.select(*cols))


def table_preview(rows: Column, n: int = 3, length: int = 200) -> Column:
    """The cells that are not blank of the first n rows [X23]. rows: array of arrays of cells."""
    lines = F.transform(F.slice(rows, 1, n), lambda r: F.array_join(F.filter(r, lambda c: ~blank(c)), " | "))
    return F.substring(F.array_join(F.filter(lines, lambda x: x != ""), " / "), 1, length)


def table_name(caption: Column, carried: Column, section: Column, page: Column, index: Column) -> Column:
    """The caption, else the name of the table it continues, else the section's title, else its page and number from 1 [T27]."""
    some = lambda c: F.when(~blank(c), c)
    page = F.when(page > 0, page).otherwise(1)
    return F.coalesce(F.trim(some(caption)), some(carried), F.trim(some(section)), F.concat(F.lit("Table page "), page.cast("string"), F.lit(" #"), (index + 1).cast("string")))


def context_of_headers(fragments: Column) -> Column:
    """The fragments of a header that say what a table is about: 12 characters, a colon and three words at least; '' without any [T28]."""
    some = F.filter(F.transform(fragments, squeeze), lambda f: (F.length(f) >= 12) & f.contains(":") & (F.size(F.split(f, " ")) >= 3))
    return F.array_join(F.array_distinct(some), " ")


def noisy_header(header: Column, fragments: Column | int = 1) -> Column:
    """Of several fragments, of six words or more, or with a word twice; generic names and blank ones are not [A24]."""
    words = F.split(squeeze(header), " ")
    twice = F.size(F.array_distinct(F.transform(words, match_form))) < F.size(words)
    several = (F.lit(fragments) if isinstance(fragments, int) else fragments) > 1
    return ~blank(header) & ~header.rlike(r"^col_\d+$") & (several | (F.size(words) >= 6) | twice)


def header_figures(headers: Column) -> Column:
    """struct(generic, words, noisy) of a table's column names: how many are generic or noisy, and words on average [A24]."""
    words = F.transform(headers, lambda h: F.when(blank(h), 0).otherwise(F.size(F.split(squeeze(h), " "))))
    count = lambda good: F.size(F.filter(headers, good))
    return F.struct(
        count(lambda h: h.rlike(r"^col_\d+$")).alias("generic"),
        (F.aggregate(words, F.lit(0), lambda s, x: s + x) / F.greatest(F.size(headers), F.lit(1))).alias("words"),
        count(lambda h: noisy_header(h)).alias("noisy"),
    )


def leading(cells: Column) -> Column:
    """struct(number, code, y) of a row's cells (col, text, y): a row number in the first two columns, a code in the first five, and the least y of
    those that have one, 0 without any [T26]."""
    text = lambda c: F.trim(F.coalesce(c["text"], F.lit("")))
    return F.struct(
        F.exists(cells, lambda c: (c["col"] <= 1) & text(c).rlike(ROW_NUMBER)).alias("number"), F.exists(cells, lambda c: (c["col"] <= 4) & text(c).rlike(IDENTIFIER)).alias("code"),
        F.coalesce(F.array_min(F.transform(cells, lambda c: c["y"])), F.lit(0.0)).alias("y"),
    )


def slots(cells: DataFrame, table: str, start: str) -> DataFrame:
    """table, col, s, s_end of every column up to the last one: from where to where its cells with coordinates reach, those from row `start` on, else all;
    else the column's number and the next [A13]. cells: table, row, col, x, x_end."""
    data = F.col("row") >= F.greatest(F.lit(0), F.col(start))
    reach = cells.groupBy(table, "col").agg(F.min(F.when(data, F.col("x"))).alias("a"), F.max(F.when(data, F.col("x_end"))).alias("b"), F.min("x").alias("c"), F.max("x_end").alias("d"))
    # The columns of a table: a bounded number.
    every = reach.groupBy(table).agg(F.max("col").alias("_last"), F.collect_list(F.struct("col", "a", "b", "c", "d")).alias("_cs"))
    own = lambda i: F.get(F.filter("_cs", lambda c: c["col"] == i), F.lit(0))
    reach = every.select(table, F.explode(F.transform(F.sequence(F.lit(0), F.col("_last").cast("int")), lambda i: F.struct(i.alias("col"), own(i).alias("c")))).alias("_c"))
    reach = reach.select(table, "_c.col", "_c.c.a", "_c.c.b", "_c.c.c", "_c.c.d")
    zero = F.lit(0.0)
    s_end = F.when(F.col("a").isNotNull(), F.greatest(zero, "b")).when(F.col("c").isNotNull(), F.greatest(zero, "d")).otherwise(F.col("col") + 1.0)
    return reach.select(table, "col", F.coalesce("a", "c", F.col("col").cast("double")).alias("s"), s_end.alias("s_end"))


def slot_values(cells: DataFrame, keys: list[str], slot: str, order: str, text: str, every: DataFrame | None = None) -> DataFrame:
    """keys, slot, value: the texts of a slot, squeezed and joined in order, blank ones left out; '' where nothing is left [T24].
    every: some of the keys, slot: the slots of a table, of which each row gets those without any cell as well."""
    if every is None:
        texts = F.collect_list(F.when(~blank(text), F.struct(order, squeeze(text).alias("t"))))
        return cells.groupBy(*keys, slot).agg(F.array_join(F.sort_array(texts)["t"], " ").alias("value"))
    # A row's cells and a table's slots, a bounded number of each, are gathered and joined by table alone.
    on = [k for k in keys if k in every.columns]
    held = F.collect_list(F.when(~blank(text), F.struct(F.col(order).alias("order"), squeeze(text).alias("t"), F.col(slot).alias("slot"))))
    rows = cells.groupBy(*keys).agg(F.sort_array(held).alias("_cells"))
    slots = every.groupBy(*on).agg(F.collect_set(F.struct(F.col(slot).alias("slot"))).alias("_slots"))
    of = lambda s: F.array_join(F.transform(F.filter("_cells", lambda c: c["slot"] == s["slot"]), lambda c: c["t"]), " ")
    return rows.join(slots, on).select(*keys, F.inline(F.transform("_slots", lambda s: F.struct(s["slot"].alias(slot), of(s).alias("value")))))


def row_numbers(rows: DataFrame, table: str, order: list[str]) -> DataFrame:
    """rows with row_number, counted on through the fragments of a logical table [W12]."""
    return rows.withColumn("row_number", F.row_number().over(W.partitionBy(table).orderBy(*order)))
