
from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@cache
def accent_table() -> tuple[str, str]:
    """The letters of the basic plane that are a base character with marks, and those base characters."""
    source, target = [], []
    for i in range(0x80, 0x10000):
        if 0xD800 <= i < 0xE000:
            continue
        base = [c for c in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(c)[0] != "M"]
        if len(base) == 1 and base[0] != chr(i):
            source.append(chr(i))
            target.append(base[0])
    return "".join(source), "".join(target)


def fold(x, stroke: bool = True) -> Column:
    """Accents off, lower case; stroke: đ becomes d as well [X3; without stroke X4]."""
    source, target = accent_table()
    if stroke:
        source, target = source + "đĐ", target + "dD"
    plain = F.regexp_replace(F.translate(_c(x), source, target), r"\p{M}", "")
    return F.lower(F.when(_c(x).rlike(r"[^\x00-\x7F]"), plain).otherwise(_c(x)))


@cache
def composed_pairs() -> tuple[tuple[str, str, str], ...]:
    """mark, letters and what they become together with it: every pair of the basic plane that has a composed form."""
    found: dict[str, dict[str, str]] = {}
    for i in range(0x80, 0x10000):
        parts = unicodedata.decomposition(chr(i)).split() if not 0xD800 <= i < 0xE000 else []
        if len(parts) == 2 and parts[0][0] != "<":
            base, mark = (chr(int(p, 16)) for p in parts)
            if unicodedata.combining(mark) and unicodedata.normalize("NFC", chr(i)) == chr(i):
                found.setdefault(mark, {})[base] = chr(i)
    return tuple((mark, "".join(d), "".join(d.values())) for mark, d in sorted(found.items()))


def _ordered_marks(run: Column) -> Column:
    """Marks in canonical order: by combining class, equal classes as they stand."""
    classes = _combining_classes()
    of = lambda c: F.coalesce(F.element_at(F.from_json(F.lit(classes), "map<string,int>"), c), F.lit(0))
    keyed = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c, i: F.struct(of(c).alias("k"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: s["c"]), "")


@cache
def _combining_classes() -> str:
    return json.dumps({chr(i): unicodedata.combining(chr(i)) for i in range(0x300, 0x370)})


def compose(x) -> Column:
    """Letters and marks that follow them as one letter where there is one [Q9]: canonical composition of text whose marks are those of the block 0300 to 036F.

    Letters are taken apart first, their marks put in canonical order and joined with them one after the other; a mark that has no composed form with its letter stays, and marks of a
    higher class behind it are still joined. Text without such marks is left as it is.
    """
    text = _c(x)
    cluster = r"(?s).[\x{300}-\x{36F}]+"

    def joined(c: Column) -> Column:
        first = F.substring(c, 1, 1)
        apart = F.coalesce(F.element_at(F.from_json(F.lit(_apart()), "map<string,string>"), first), first)
        base, marks = F.substring(apart, 1, 1), _ordered_marks(F.concat(F.substring(apart, F.lit(2), F.length(apart)), F.substring(c, F.lit(2), F.length(c))))
        classes = F.from_json(F.lit(_combining_classes()), "map<string,int>")
        start = F.struct(base.alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))
        table = F.from_json(F.lit(_pair_map()), "map<string,string>")

        def step(acc: Column, m: Column) -> Column:
            k = F.coalesce(F.element_at(classes, m), F.lit(0))
            one = F.when((acc["last"] == 0) | (acc["last"] < k), F.element_at(table, F.concat(acc["base"], m)))
            return F.struct(F.coalesce(one, acc["base"]).alias("base"), F.when(one.isNull(), F.concat(acc["rest"], m)).otherwise(acc["rest"]).alias("rest"), F.when(one.isNull(), k).otherwise(acc["last"]).alias("last"))

        each = F.filter(F.split(marks, ""), lambda m: m != "")
        return F.aggregate(each, start, step, lambda a: F.concat(a["base"], a["rest"]))

    parts, clusters = F.split(text, cluster), F.regexp_extract_all(text, F.lit(cluster), F.lit(0))
    whole = F.array_join(F.zip_with(parts, clusters, lambda p, c: F.concat(p, F.when(c.isNull(), F.lit("")).otherwise(joined(c)))), "")
    return F.when(text.rlike(r"[\x{300}-\x{36F}]"), whole).otherwise(text)


@cache
def _apart() -> str:
    """Letters that are a base and marks of the block, taken apart."""
    forms = {chr(i): unicodedata.normalize("NFD", chr(i)) for i in range(0xC0, 0x2000)}
    return json.dumps({c: d for c, d in forms.items() if len(d) > 1 and all(0x300 <= ord(m) < 0x370 for m in d[1:])})


@cache
def _pair_map() -> str:
    return json.dumps({b + mark: one for mark, bases, ones in composed_pairs() for b, one in zip(bases, ones) if 0x300 <= ord(mark) < 0x370})


def blank(x) -> Column:
    """Null, empty or nothing but blanks."""
    return F.coalesce(_c(x).rlike(r"^\s*$"), F.lit(True))


def strip(x) -> Column:
    """Without characters up to the space at either end, as Java's trim does."""
    return F.regexp_replace(_c(x), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def squeeze(x) -> Column:
    """Runs of blanks as one space, none at the ends."""
    # Single spaces stay where they are, so most texts have nothing to replace.
    return F.trim(F.regexp_replace(_c(x), r"\s{2,}|[\s&&[^ ]]", " "))


def normalize(x) -> Column:
    """Folded, punctuation other than / . - as blanks, squeezed; null and blank are empty [X2]."""
    plain = F.regexp_replace(fold(F.coalesce(_c(x), F.lit(""))), r"[!-,:-@\[-`{-~]+", " ")
    return squeeze(plain)


def match_form(x) -> Column:
    """Folded and squeezed, đ kept [X4]."""
    return squeeze(F.regexp_replace(fold(F.coalesce(_c(x), F.lit("")), stroke=False), r"[^\p{L}\p{N}]+", " "))


def slug(x) -> Column:
    """Letters and digits joined by _; nothing left: col [X6]."""
    s = F.regexp_replace(F.regexp_replace(fold(F.coalesce(_c(x), F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", F.lit("col")).otherwise(s)


def preview(x, length: int = 120) -> Column:
    """Squeezed, lower case, cut [X8]."""
    return F.substring(F.lower(squeeze(F.coalesce(_c(x), F.lit("")))), 1, length)


def control_free(x) -> Column:
    """Control characters off, squeezed, lower case; the text is expected in composed form [X7]."""
    return F.lower(squeeze(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[\p{Cc}&&[^\s]]", "")))


def round1(x) -> Column:
    """One decimal, halves up [X1]."""
    return F.floor(_c(x) * 10 + F.lit(0.5)) / F.lit(10.0)


def delta_percent(now, before) -> Column:
    """Change in percent: 100 from nothing to something, 0 from nothing to nothing [A2]."""
    now, before = _c(now), _c(before)
    return F.when(before <= 0, F.when(now > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(
        round1((now - before) * F.lit(100.0) / F.when(before > 0, before))
    )


def text_hash(x) -> Column:
    """Java's string hash, as hex [X9]."""
    chars = F.filter(F.split(_c(x), ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.hex(h))


def tokens_up(x) -> Column:
    """Token estimate of chat texts: a quarter of the characters rounded up, 0 if blank, else at least 1 [O5]."""
    return F.when(blank(x), F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.length(_c(x)) / 4))).cast("int")


def tokens_down(x) -> Column:
    """Token estimate of chunks: rounded down, at least 1 [O5]."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(_c(x), F.lit(""))) / 4)).cast("int")


def initials(x) -> Column:
    """The first two characters in capitals; blank: CB [P12]."""
    return F.when(blank(x), F.lit("CB")).otherwise(F.substring(F.upper(strip(x)), 1, 2))


def named(x, otherwise: str) -> Column:
    """The trimmed text, or another if it is blank [P9]."""
    return F.when(blank(x), F.lit(otherwise)).otherwise(strip(x))


def page_range(first, last) -> Column:
    """'', 'n' or 'a-b' [P13]."""
    a, b = _c(first), _c(last)
    return (
        F.when(a.isNull() & b.isNull(), F.lit(""))
        .when(a.isNull() | b.isNull() | (a == b), F.coalesce(a, b).cast("string"))
        .otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string")))
    )


def json_text(json, path: str) -> Column:
    """A field of a JSON text, trimmed; blank or missing: null [P24]."""
    value = strip(F.get_json_object(_c(json), path))
    return F.when(value != "", value)


def json_map(json) -> Column:
    """A JSON object as a map of texts; what cannot be read is empty [X14]."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(_c(json), "map<string,string>"), empty)


def number_or(x, kind: str, otherwise, low=None, high=None) -> Column:
    """A number that may come as text, else a default, held between bounds [P14, P15]."""
    value = F.coalesce(_c(x).try_cast(kind), F.lit(otherwise).cast(kind))
    if low is not None:
        value = F.greatest(value, F.lit(low).cast(kind))
    return F.least(value, F.lit(high).cast(kind)) if high is not None else value


def overlap_length(a_start, a_end, b_start, b_end) -> Column:
    """Length that two ranges share [X16]."""
    return F.greatest(F.lit(0.0), F.least(_c(a_end), _c(b_end)) - F.greatest(_c(a_start), _c(b_start)))


def bigrams(x) -> Column:
    """The different pairs of neighbouring characters, blanks left out [X21]."""
    s = F.regexp_replace(_c(x), " ", "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
    return F.array_distinct(F.filter(pairs, lambda p: F.length(p) == 2))


def acronym(x) -> Column:
    """The first letters of the words [X21]."""
    return F.array_join(F.transform(F.filter(F.split(_c(x), r"\s+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")


def retry_seconds(x) -> Column:
    """Seconds to wait by an error text, two added; null if it has none [X17]."""
    return (F.ceil(F.nullif(F.regexp_extract(_c(x), r"try again in ([0-9]+(?:\.[0-9]+)?)s", 1), F.lit("")).cast("double")) + 2).cast("int")


def error_class(x) -> Column:
    """What kind of refusal an error text is [X18]."""
    t = F.lower(F.coalesce(_c(x), F.lit("")))
    return (
        F.when(t.contains("decommissioned"), F.lit("DECOMMISSIONED"))
        .when(t.contains("request too large") | t.contains("too large"), F.lit("TOO_LARGE"))
        .when(t.contains("tokens per day") | t.contains("tpd"), F.lit("DAILY_LIMIT"))
        .when(t.contains("tokens per minute") | t.contains("tpm") | t.contains("rate limit"), F.lit("MINUTE_LIMIT"))
        .otherwise(F.lit("OTHER"))
    )


def file_kind(name) -> Column:
    """PDF, TXT, DOCX, DOC or UNKNOWN by a file's name [S6]."""
    n = F.lower(F.coalesce(_c(name), F.lit("")))
    out = F.lit("UNKNOWN")
    for end in ("doc", "docx", "txt", "pdf"):
        out = F.when(n.endswith("." + end), F.lit(end.upper())).otherwise(out)
    return out


def safe_file_name(name) -> Column:
    """A file name without characters that paths give a meaning [X20]."""
    return F.regexp_replace(F.coalesce(_c(name), F.lit("file")), r"[^A-Za-z0-9._-]", "_")
