"""What a question asks for: identifiers, dates, numbers, labels, n-grams, words, variants, intent and limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, fold, normalize, squeeze, strip

# What identifiers, dates, numbers and values look like.
IDENTIFIER = r"\b([A-Za-z]{1,8}[0-9][A-Za-z0-9\-]{1,20}|[0-9]{2,}[A-Za-z][A-Za-z0-9\-]{0,20}|[A-Z]{2,}[0-9]{2,}[A-Za-z0-9\-]*)\b"
DATES = (r"\b(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4})\b", r"\b(\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2})\b", r"\b(\d{1,2}[/.\-]\d{1,2})\b")
NUMBER = r"\b\d{1,4}(?:[.,]\d+)?%?\b"
VALUE = r"^(?:\d{1,4}[a-z]?|[a-z]\d{1,4}[a-z0-9]{0,6}|[a-z]{1,8}\d[a-z0-9\-]{1,12})$"
NUMBERED = r"\b\d{1,3}\.\d{1,3}(?:\.\d{1,3})*\b"
SHORT_CODE = r"\b[A-Z]{1,6}\d[A-Za-z0-9]{0,10}\b"
EXPANDED = ("LIST_ALL", "TABLE_LOOKUP", "SECTION_SUMMARY", "COUNT_QUERY")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def identifiers(text: Column) -> Column:
    """Different codes of at least 4 characters, from the text as it is [Q2]."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(1)), lambda x: F.length(x) >= 4))


def dates(text: Column) -> Column:
    """Day-month-year, then year-month-day, then day-month; a full date gives its day and month as well [Q3]."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in DATES]))


def numbers(plain: Column) -> Column:
    """Numbers of a normalized text [Q4]."""
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(0)))


def bare(token: Column) -> Column:
    """A token without separators at its ends [X25]."""
    return F.regexp_replace(token, r"^[#:/\-.]+|[#:/\-.]+$", "")


def is_value(token: Column) -> Column:
    """Digits with a letter, a letter with digits, or letters with digits [X19]."""
    return bare(token).rlike(VALUE)


def labels(plain: Column) -> Column:
    """For each value the one to three words before it, with it, as long as none of them is a value [Q5]."""

    def of(tokens: Column) -> Column:
        def at(i: Column) -> Column:
            widths = F.sequence(F.lit(1), F.least(F.lit(3), i))
            some = F.transform(widths, lambda w: F.slice(tokens, i - w + 1, w))
            good = F.filter(some, lambda p: ~F.exists(p, lambda t: (t == "") | is_value(t)))
            return F.transform(good, lambda p: F.concat_ws(" ", F.array_join(p, " "), F.get(tokens, i)))

        places = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: (i > 0) & is_value(F.get(tokens, i)))
        return F.when(F.size(tokens) > 1, F.array_distinct(F.flatten(F.transform(places, at)))).otherwise(F.array().cast("array<string>"))

    return let(F.transform(words_of(plain), bare), of)


def runs_of(t: Column, n: int) -> Column:
    """Runs of n tokens, joined, one for each place."""
    places = F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1)))
    # By place: a slice would copy the whole list for every run.
    runs = F.transform(places, lambda i: F.concat_ws(" ", *[F.get(t, i + (k - 1)) for k in range(n)]))
    return F.when(F.size(t) >= n, runs).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, low: int, high: int, least: int = 4) -> Column:
    """Runs of low to high tokens, joined, of at least `least` characters, different ones, short runs first [Q6]."""

    def of(t: Column) -> Column:
        runs = [runs_of(t, n) for n in range(low, high + 1)]
        return F.array_distinct(F.filter(F.concat(*runs), lambda g: F.length(g) >= least))

    return let(tokens, of)


def question_ngrams(plain: Column) -> Column:
    """N-grams of 2 to 5 words; of a single word the text itself."""
    return F.when(plain == "", F.array().cast("array<string>")).when(F.size(words_of(plain)) < 2, F.array(plain)).otherwise(ngrams(words_of(plain), 2, 5))


def content_words(plain: Column) -> Column:
    """Different words of at least two characters [Q7]."""
    return F.array_distinct(F.filter(words_of(plain), lambda w: F.length(w) >= 2))


def with_signals(rows: DataFrame, text: str) -> DataFrame:
    """rows with identifiers, dates, numbers, labels, ngrams and words of a text; blank texts have none [Q1]."""
    raw = strip(F.coalesce(text, F.lit("")))
    plain = normalize(text)
    return rows.select(
        "*",
        identifiers(raw).alias("identifiers"),
        dates(raw).alias("dates"),
        numbers(plain).alias("numbers"),
        labels(plain).alias("labels"),
        question_ngrams(plain).alias("ngrams"),
        content_words(plain).alias("words"),
    )


def variants(text: Column) -> Column:
    """The question trimmed, without marks at its end, without accents: different ones ignoring case [Q8]."""
    a = strip(text)
    b = strip(F.regexp_replace(a, r"[?？.]+$", ""))
    every = F.filter(F.array(a, b, squeeze(fold(b))), lambda v: v != "")
    return F.filter(every, lambda v, i: F.array_position(F.transform(every, lambda x: F.lower(x)), F.lower(v)) == i + 1)


def intent(text: Column) -> Column:
    """Kind and confidence by the look of the question alone [Q10]."""
    kind = F.when(blank(text), F.lit("NORMAL_FACT")).when(text.rlike(NUMBERED), F.lit("SECTION_SUMMARY")).when(text.rlike(SHORT_CODE), F.lit("TABLE_LOOKUP")).otherwise(F.lit("NORMAL_FACT"))
    sure = F.when(blank(text), F.lit(1.0)).when(text.rlike(NUMBERED), F.lit(0.8)).when(text.rlike(SHORT_CODE), F.lit(0.55)).otherwise(F.lit(0.3))
    return F.struct(kind.alias("kind"), sure.alias("confidence"))


def intent_with_headings(text: Column, headings: Column, classified: Column | None = None) -> Column:
    """intent(), unless a heading shares two words of at least 4 letters, or an outside classification is
    sure enough [Q11, Q12]. classified: struct(kind, confidence)."""
    own = intent(text)
    terms = F.filter(words_of(normalize(text)), lambda w: F.length(w) >= 4)
    shared = F.exists(headings, lambda h: F.size(F.array_intersect(terms, words_of(normalize(h)))) >= 2)
    last = own if classified is None else F.when(classified["confidence"] >= 0.65, F.struct(classified["kind"].alias("kind"), classified["confidence"].alias("confidence"))).otherwise(own)
    found = F.struct(F.lit("SECTION_SUMMARY").alias("kind"), F.lit(0.85).alias("confidence"))
    return F.when(own["confidence"] >= 0.7, own).when(shared, found).otherwise(last)


def sum_of(array: Column, of) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + of(x))


def is_table_like(s: str = "") -> Column:
    """A code, label or date, or two numbers [Q16]."""
    c = lambda n: F.size(F.col(s + n))
    return (c("identifiers") > 0) | (c("labels") > 0) | (c("dates") > 0) | (c("numbers") >= 2)


def heading_scores(terms: Column, question: Column, title: Column, path: Column) -> Column:
    """struct(score, title_hits, path_hits, qualifies) of a heading for the terms of a question [Q13]."""
    title, path = normalize(title), normalize(path)
    n = F.size(terms)
    hits = F.size(F.filter(terms, lambda t: title.contains(t)))
    other = F.size(F.filter(terms, lambda t: ~title.contains(t) & path.contains(t)))
    score = 3 * hits + other - 2 * (n - hits - other)
    score = score + F.when((question != "") & title.contains(question), 2 * n).otherwise(0) + F.when((n >= 2) & (hits == n), n).otherwise(0)
    good = ((hits >= 2) | ((hits >= 1) & (other >= 1) & (n >= 2))) & (score > 0)
    return F.struct(score.alias("score"), hits.alias("title_hits"), other.alias("path_hits"), good.alias("qualifies"))


def context_limit(kind: Column, multi: Column, compare: Column, weak: Column, override: Column | None = None) -> Column:
    """How many contexts a question gets, at most what its kind asks for [Q15]."""
    asked = F.when(kind.isin("LIST_ALL", "COUNT_QUERY", "SECTION_SUMMARY"), 20).otherwise(10)
    wanted = F.when(kind == "LIST_ALL", 25).when(multi, asked).when(compare, 10).when(weak, 5).otherwise(7)
    out = F.least(F.greatest(wanted, F.lit(1)), asked)
    return out if override is None else F.coalesce(override, out)


def char_budget(kind: Column, locked: Column) -> Column:
    """Characters of context [R14]."""
    base = F.when(locked, 18000).when(kind.isin("TABLE_LOOKUP", "COUNT_QUERY"), 14000).when(kind.isin("LIST_ALL", "SECTION_SUMMARY"), 16000).otherwise(10000)
    return F.least(base, F.lit(18000))
