"""Scores of table rows by their cells: codes, labels, dates, phrases and column names of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bigrams, normalize
from ..sources.tables import small, written
from .signals import is_value, let, ngrams, sum_of, words_of

CODE, LABEL, COVERED, CONFLICT, DATE, SEVERAL = 8.0, 6.0, 4.0, -8.0, 1.5, 5.0
SAME_HEADER, SAME_INTENT = 0.72, 0.86


def on_boundary(hay: Column, needle: Column) -> Column:
    """Needle in hay with no letter or digit beside it [C4]."""
    return hay.contains(needle) & F.regexp_like(hay, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), needle, F.lit(r"\E(?![\p{L}\p{N}])")))


def forms(x: Column) -> Column:
    """struct(text, words, pairs) of a normalized name, to be compared by like()."""
    return F.struct(x.alias("text"), F.array_distinct(words_of(x)).alias("words"), bigrams(x).alias("pairs"))


def like(a: Column, b: Column, least: float = 0.0) -> Column:
    """1 for equal names, else the share of common words, else of common letter pairs [C5]. least: what the caller asks for; shares of pairs that their
    numbers alone keep below it are 0."""
    common = F.size(F.array_intersect(a["words"], b["words"]))
    pairs = F.size(F.array_intersect(a["pairs"], b["pairs"]))
    n, m = F.size(a["pairs"]), F.size(b["pairs"])
    share = let(pairs, lambda p: p / F.greatest(n + m - p, F.lit(1)))
    if least > 0:
        share = F.when(F.least(n, m) < (least - 1e-6) * F.greatest(n, m), 0.0).otherwise(share)
    some = F.when(F.arrays_overlap(a["words"], b["words"]), common / F.least(F.size(a["words"]), F.size(b["words"]))).otherwise(share)
    return F.when((a["text"] == "") | (b["text"] == ""), 0.0).when(a["text"] == b["text"], 1.0).otherwise(some)


def similarity(a: Column, b: Column) -> Column:
    """like() of two normalized names."""
    return let(F.struct(forms(a).alias("a"), forms(b).alias("b")), lambda x: like(x["a"], x["b"]))


def label_parts(label: Column) -> Column:
    """struct(raw, kind, value): a label's words before the last one, and it; null without both or if it is no value [Q17]."""
    w = words_of(normalize(label))
    parts = F.struct(normalize(label).alias("raw"), F.array_join(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), " ").alias("kind"), F.element_at(w, -1).alias("value"))
    return F.when((F.size(w) >= 2) & is_value(F.element_at(w, -1)), parts)


def other_number(text: Column, value: Column) -> Column:
    """A number of up to four digits (and a letter) in a text that is not the value, itself such a number [C6]."""
    return value.rlike(r"^\d{1,4}[a-z]?$") & _another(text, value)


def _another(text: Column, value: Column) -> Column:
    return F.exists(F.regexp_extract_all(text, F.lit(r"\d{1,4}[a-z]?"), F.lit(0)), lambda x: x != value)


def asked_terms() -> Column:
    """struct of what score() looks for, from the signals of a question: made once a question and kept beside it, not once a row."""
    parts = F.filter(F.transform("labels", label_parts), lambda p: p.isNotNull())
    parts = F.transform(parts, lambda p: F.struct(p["raw"].alias("raw"), forms(p["kind"]).alias("kind"), p["value"].alias("value"), p["value"].rlike(r"^\d{1,4}[a-z]?$").alias("number")))
    grams = F.filter("ngrams", lambda g: F.length(g) >= 4)
    return F.struct(
        F.filter(F.transform("identifiers", normalize), lambda i: i != "").alias("codes"),
        F.transform("dates", lambda d: F.lower(d)).alias("dates"),
        parts.alias("parts"),
        F.transform(grams, lambda g: F.struct(g.alias("text"), (2.0 * F.least(F.lit(3.0), F.size(words_of(g)) * 0.5)).alias("points"))).alias("grams"),
        F.forall(grams, lambda g: g.contains(" ")).alias("spaced"),
        F.filter("words", lambda w: (F.length(w) >= 3) & ~is_value(w)).alias("words"),
        F.transform(ngrams(F.col("words"), 1, 3, 1), forms).alias("intents"),
        F.filter("ngrams", lambda g: F.length(g) >= 5).alias("long_grams"),
    )


def plain_cells(cells: Column, group_context: Column, table_name: Column) -> Column:
    """struct of the normalized texts that score() looks at: made once a row where many questions read it. text and raw hold all values, a line each, so
    that what no value can hold across its end is looked for once and not in every cell."""
    values = F.transform(cells, lambda c: normalize(c["value"]))
    raw = F.array_join(F.transform(cells, lambda c: F.lower(c["value"])), "\n")
    made = lambda vs: F.struct(vs.alias("values"), F.array_join(vs, "\n").alias("text"), raw.alias("raw"), normalize(group_context).alias("context"), normalize(table_name).alias("table"))
    return let(values, made)


def names_of(cells: Column) -> Column:
    """The column names of a row's cells; none if it has no cells."""
    return F.coalesce(F.transform(cells, lambda c: c["key"]), F.array().cast("array<string>"))


def heads(names: Column, terms: Column) -> Column:
    """struct(intent, like) of a row's column names for a question with asked_terms(): points of the names, and for each label the places of the columns
    with a like name. Nothing of the row's values: made once for all rows with the same names."""
    def of(z: Column) -> Column:
        keys, asked = z["keys"], z["asked"]
        # The first of the question's runs that is like the column's name.
        liked = lambda k: F.get(F.filter(F.transform(asked["intents"], lambda g: like(k, g, SAME_INTENT)), lambda x: x >= SAME_INTENT), F.lit(0))
        intent = sum_of(keys, lambda k: 1.5 * F.coalesce(liked(k), F.lit(0.0)))
        places = lambda p: F.filter(F.transform(keys, lambda k, i: F.when(like(k, p["kind"], SAME_HEADER) >= SAME_HEADER, i).otherwise(-1)), lambda i: i >= 0)
        return F.struct(intent.alias("intent"), F.transform(asked["parts"], places).alias("like"))

    return let(F.struct(F.transform(names, lambda n: forms(normalize(n))).alias("keys"), terms.alias("asked")), of)


def with_heads(rows: DataFrame, asked: DataFrame, terms: Column, *on: str) -> DataFrame:
    """rows beside each question (with equal columns `on`), with heads() as _heads, worked out once for the rows of the same column names. rows: cells,
    read twice; asked: question (its key with `on`), a bounded table; terms: its asked_terms()."""
    rows = rows.withColumn("_names", names_of(F.col("cells")))
    named = rows.select(*on, "_names").distinct()
    each = asked.select(*on, "question", terms.alias("_terms"))
    facts = named.join(small(each), list(on)) if on else named.crossJoin(small(each))
    facts = written(facts.select(*on, "_names", "question", heads(F.col("_names"), F.col("_terms")).alias("_heads")), "heads")
    return rows.join(small(facts), [*on, "_names"]).drop("_names").join(small(asked), [*on, "question"])


def score(cells: Column, group_context: Column, table_name: Column, terms: Column | None = None, plain: Column | None = None, of_names: Column | None = None) -> Column:
    """struct(total, codes, labels, conflicts, dates, phrases, several, intent, group, named, kinds, exact) of a row for a question with
    signals beside it.

    cells: array of struct(key, value) [C1-C3, C6-C8]. Rows without cells score 0. A code counts once, a label in each cell that has it
    under a like name; a label that no cell has so counts less if a cell has its value, and against the row if a cell
    with a like name has another number. Codes, labels, runs of words, words and dates are the kinds of signals of which several add up.
    terms: asked_terms(), for many rows a column made before they are joined; worked out from the signals without it. plain: plain_cells() and of_names:
    heads(), likewise.
    """
    def of(z: Column) -> Column:
        plain, asked, named = z["plain"], z["asked"], z["heads"]
        text, context, table = plain["text"], plain["context"], plain["table"]
        codes = sum_of(asked["codes"], lambda i: F.when(on_boundary(text, i), CODE).otherwise(0.0))
        dates = sum_of(asked["dates"], lambda d: F.when(plain["raw"].contains(d), DATE).otherwise(0.0))

        def label(p: Column, like_at: Column) -> Column:
            """Points of a label and points against the row."""
            value_at = lambda i: F.get(plain["values"], i)
            has = F.filter(F.transform(plain["values"], lambda v, i: F.when(on_boundary(v, p["value"]), i).otherwise(-1)), lambda i: i >= 0)
            points = lambda at: let(F.size(F.array_intersect(at, like_at)), lambda n: F.when(n > 0, LABEL * n).otherwise(COVERED))
            held = on_boundary(text, p["value"])
            against = p["number"] & F.exists(like_at, lambda i: _another(value_at(i), p["value"]))
            return F.when(held, F.struct(let(has, points).alias("points"), F.lit(0.0).alias("against"))).otherwise(F.struct(F.lit(0.0).alias("points"), F.when(against, CONFLICT).otherwise(0.0).alias("against")))

        stand = F.transform(asked["parts"], lambda p, i: label(p, F.get(named["like"], i)))
        both = let(stand, lambda st: F.struct(sum_of(st, lambda x: x["points"]).alias("points"), sum_of(st, lambda x: x["against"]).alias("against")))
        # Runs of several words are in no value without blanks.
        grams = F.when(~asked["spaced"] | text.contains(" "), sum_of(asked["grams"], lambda g: F.when(text.contains(g["text"]), g["points"]).otherwise(0.0))).otherwise(0.0)
        words = sum_of(asked["words"], lambda w: F.when(on_boundary(text, w), 1.0).otherwise(0.0))
        in_group = lambda: sum_of(asked["parts"], lambda p: F.when(context.contains(p["raw"]) | on_boundary(context, p["value"]), 0.8).otherwise(0.0)) + sum_of(asked["grams"], lambda g: F.when(context.contains(g["text"]), 0.3).otherwise(0.0))
        group = F.when(context != "", in_group()).otherwise(0.0)
        by_name = F.when((table != "") & F.exists(asked["long_grams"], lambda g: table.contains(g)), 0.5).otherwise(0.0)
        parts_of = F.struct(*[x.alias(n) for x, n in ((codes, "codes"), (both, "both"), (dates, "dates"), (grams, "grams"), (words, "words"), (named["intent"], "intent"), (group, "group"), (by_name, "named"))])
        flat = lambda p: F.struct(p["both"]["points"].alias("labels"), p["both"]["against"].alias("conflicts"), *[p[n].alias(n) for n in ("codes", "dates", "grams", "words", "intent", "group", "named")])
        return let(let(parts_of, flat), summed)

    def summed(p: Column) -> Column:
        kinds = sum((p[k] > 0).cast("int") for k in ("codes", "labels", "grams", "words", "dates"))
        several = F.when(kinds >= 2, SEVERAL * (kinds - 1)).otherwise(0.0)
        total = p["codes"] + p["dates"] + p["labels"] + p["grams"] + p["words"] + several + p["intent"] + p["group"] + p["named"] + p["conflicts"]
        return F.struct(
            F.greatest(total, F.lit(0.0)).alias("total"), *[p[k].alias(k) for k in ("codes", "labels", "conflicts", "dates")], (p["grams"] + p["words"]).alias("phrases"),
            several.alias("several"), *[p[k].alias(k) for k in ("intent", "group", "named")], kinds.alias("kinds"), ((p["codes"] + p["dates"] > 0) | (p["labels"] > 0)).alias("exact"),
        )

    beside = lambda terms: F.struct(
        (plain_cells(cells, group_context, table_name) if plain is None else plain).alias("plain"), terms.alias("asked"), (heads(names_of(cells), terms) if of_names is None else of_names).alias("heads")
    )
    seen = let(asked_terms(), beside) if terms is None else beside(terms)
    return F.when(F.size(cells) > 0, let(seen, of))


def is_compare() -> Column:
    """Two labels or more that have a name and a value [Q17]."""
    return F.size(F.filter(F.transform("labels", label_parts), lambda p: p.isNotNull())) >= 2
