"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame operations only. Per kind, the matches and the text between them come from the same pattern, so
their lengths add up to the positions of the matches, in code points. All patterns have one way to match
(possessive repetition), which keeps very long texts linear and off the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

#: Lengths of the account numbers by country. Codes that are not here may have any length, up to where letters and digits end.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(x.replace(" ", "|") for x in IBAN_LENGTHS.values())
_IBAN = "|".join(rf"(?:{x.replace(' ', '|')})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}+" for n, x in IBAN_LENGTHS.items())
_IBAN += rf"|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?+[A-Z0-9]){{11,30}}+"

#: A match may begin where the last one ended or where no character of its first class stands before it;
#: everywhere else a match would have begun further left.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Only its first four characters are used up, so that one that fails hides none that begins in it; group 1 is all of it.
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_IBAN})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without these characters has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a confirmed match, and what a context word close by adds.
SCORES = {"email": 0.9, "ip": 0.8, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
NEAR, NEAR_ADDS, LEAST = 40, 0.3, 0.5
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|address|host|server)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|bank|account)\b",
    "ssn": r"(?i)\b(?:ssn|social\s+security)\b",
}
#: These count without regard to the score.
BASE = ("email", "ip", "card", "phone")
SPAN = "struct<start:int,end:int,score:double>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def mod97(code: Column) -> Column:
    """The remainder by 97 of a code with letters as 10..35, its first four characters moved to the end."""
    plain = F.upper(F.replace(code, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.ascii(c) - F.when(c >= "A", F.lit(55)).otherwise(F.lit(48))
        return (rest * F.when(c >= "A", F.lit(100)).otherwise(F.lit(10)) + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        # Leading zeros may use up a lone 0, so an empty rest is 0 as well.
        part = r"(?:0++(?![0-9])|" + small + ")"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m) == 1
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def spans_of(kind: str, text: Column) -> Column:
    """The spans of a kind in a text: array of struct(start, end, score), in code points, end exclusive."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    if kind == "iban":
        none = F.expr("array()").cast(f"array<{SPAN}>")
        return F.when(text.rlike("[A-Z]{2}[0-9]{2}"), _iban_spans(text, found, between)).otherwise(none)
    begin = F.struct(F.lit(0).alias("at"), F.expr("array()").cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        near = F.substring(x["gap"], -NEAR, NEAR).rlike(CONTEXT[kind])
        score = F.when(near, F.lit(round(min(1.0, SCORES[kind] + NEAR_ADDS), 3))).otherwise(F.lit(SCORES[kind]))
        good = _confirmed(kind, x["m"])
        if kind not in BASE:
            good = good & (score >= LEAST)
        span = F.struct(start.alias("start"), end.alias("end"), score.alias("score"))
        return F.struct(end.alias("at"), F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    # Zipped, so that both arrays are made once and not for each element; the last gap has no match after it.
    pairs = F.arrays_zip(found.alias("m"), between.alias("gap"))
    spans = F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), begin, step)["out"]
    none = F.expr("array()").cast(f"array<{SPAN}>")
    return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(none) if kind in NEEDS else spans


def _iban_spans(text: Column, heads: Column, between: Column) -> Column:
    """spans_of() for matches that are only the heads of what group 1 has; none begins inside a confirmed one."""
    codes = F.regexp_extract_all(text, F.lit(PATTERNS["iban"]), F.lit(1))
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.lit("").alias("tail"), F.expr("array()").cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["code"])
        before = F.concat(acc["tail"], F.substring(x["gap"], -NEAR, NEAR))
        near = F.substring(before, -NEAR, NEAR).rlike(CONTEXT["iban"])
        score = F.when(near, F.lit(round(min(1.0, SCORES["iban"] + NEAR_ADDS), 3))).otherwise(F.lit(SCORES["iban"]))
        good = (start >= acc["free"]) & _confirmed("iban", x["code"])
        span = F.struct(start.alias("start"), end.alias("end"), score.alias("score"))
        return F.struct(
            (start + F.length(x["m"])).alias("at"),
            F.when(good, end).otherwise(acc["free"]).alias("free"),
            F.substring(F.concat(before, x["m"]), -NEAR, NEAR).alias("tail"),
            F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    matches = F.arrays_zip(heads.alias("m"), codes.alias("code"), between.alias("gap"))
    return F.aggregate(F.filter(matches, lambda x: x["m"].isNotNull()), begin, step)["out"]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds=tuple(PATTERNS)) -> DataFrame:
    """One row per document: id, text and for each kind a column spans_<kind>.

    Base kinds (email, ip, card, phone): leftmost non-overlapping matches of the pattern that their check
    confirms. iban needs its country's length and its mod-97 checksum; ssn has no checksum and counts only with a context word close
    before it, after the last match of its kind. Null texts are empty and have no spans; other columns of docs are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("content"))
    return rows.select("id", "content", *[spans_of(k, F.col("content")).alias(f"spans_{k}") for k in kinds])


def listed(kind: str) -> Column:
    """kind:start:end of each span."""
    return F.transform(f"spans_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def redact(found: DataFrame, kind: str, mark: str) -> DataFrame:
    """The texts with the spans of a kind replaced by a mark."""
    last = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = lambda acc, s: F.struct(
        s["end"].alias("at"), F.concat(acc["out"], F.substring("content", acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out")
    )
    done = F.aggregate(f"spans_{kind}", last, cut)
    return found.withColumn("content", F.concat(done["out"], F.substring("content", done["at"] + 1, F.length("content"))))
