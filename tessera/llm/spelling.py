"""Spelling variants: words that differ by one inserted, deleted or replaced letter, and the form each of them should have.

No pairs of a group are made. For replacements every word stands once for each of its places in the group of its (place, prefix, suffix); a
group keeps its size and its two best words, from which each member gets how many others there are and the best of them. A group has no
more words than the alphabet has letters, since only the letter at its place differs. For insertions and deletions the words that a deletion leaves are joined
to the vocabulary, and both ends of such a join get each other. What a word gets from all of these is added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keep, whole

#: Letters of a word, and those that are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shorter and rarer words are left out; a form must be so many times as frequent.
SHORTEST, RAREST, RATIO = 5, 3, 2
#: Of so many occurrences one has a letter taken out.
DAMAGED = 97


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are; few words need it."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, UPPER, UPPER.lower())).otherwise(text)


def without_letter(word: Column, at: Column) -> Column:
    """The word without its letter at a place, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def damaged(id_text: Column, word: Column, every: int = DAMAGED) -> Column:
    """The word, without one of its letters where `every` divides the CRC-32 of `<id>:<word>`; which one follows from the hash too."""
    h = F.crc32(F.concat(id_text, F.lit(":"), word).cast("binary"))
    return F.when(h % every == 0, without_letter(word, (h % F.length(word)).cast("int"))).otherwise(word)


def vocabulary(docs: DataFrame, every: int | None = DAMAGED, shortest: int = SHORTEST, rarest: int = RAREST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of all texts that have at least `shortest` letters and occur at least `rarest` times.

    every: damages one word occurrence of so many (see damaged()); None leaves words as they are. Null texts have no words; null
    ids count as empty ones. Occurrences are added up in each task before they move, so frequent words are no hot keys.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(whole(F.col(text_col)), F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    if every:
        words = words.select(damaged(F.col("id"), F.col("run"), every).alias("run"))
    counts = words.filter(F.length("run") >= shortest).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= rarest)


def _order(word: str = "word", n: str = "n") -> Column:
    """Smaller for better words: more occurrences first, then code-point order."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def replacements(words: DataFrame) -> DataFrame:
    """word, near, best: how many words differ from it in one replaced letter, and the best of them (as _order()); a row for each
    group of two or more words that a word is in."""
    at = F.explode(F.sequence(F.lit(0), F.length("word") - 1))
    members = words.select("word", _order().alias("rank"), at.alias("at"))
    group = ["at", "prefix", "suffix"]
    members = members.select("word", "rank", "at", F.expr("substring(word, 1, at)").alias("prefix"), F.expr("substring(word, at + 2)").alias("suffix"))
    # No more rows than letters in a group, so it fits in any task.
    of_group = W.partitionBy(*group)
    top = of_group.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    held = members.select("word", F.count("*").over(of_group).alias("size"), F.nth_value("rank", 1).over(top).alias("first"), F.nth_value("rank", 2).over(top).alias("second"))
    best = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    return held.filter("size > 1").select("word", (F.col("size") - 1).alias("near"), best.alias("best"))


def indels(words: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """word, near, best as replacements(), for words that one deletion makes of each other: a row for each end of a match."""
    at = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: without_letter(F.col("word"), i))
    # The same word is left wherever in a run of equal letters one goes.
    left = words.filter(F.length("word") > shortest).select(F.col("word").alias("long"), _order().alias("long_rank"), F.explode(F.array_distinct(at)).alias("word"))
    both = left.join(words.select("word", _order().alias("rank")), "word")
    ends = F.explode(F.array(F.struct(F.col("word"), F.col("long_rank").alias("best")), F.struct(F.col("long").alias("word"), F.col("rank").alias("best"))))
    return both.select(ends.alias("e")).select("e.word", F.lit(1).cast("long").alias("near"), "e.best")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that a chain of forms leads to. Forms are more frequent by a factor, so chains end and are short; each
    round doubles the part of a chain that is done."""
    now = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        now = keep(now, "roots")
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next")).filter("root != next")
        if not now.join(further, "root", "left_semi").limit(1).count():
            return now
        now = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, ratio: int = RATIO, shortest: int = SHORTEST) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of words (word, n; each word once, shortest letters at least).

    Words are near if they differ by exactly one inserted, deleted or replaced code point. form: the near word of largest n (ties: the first in
    code-point order), if its n, form_n, is at least `ratio` times the word's; else null. root: where forms lead to from the word, itself if it has none. n_near: number of near
    words, 0 if none. An empty table gives an empty result.
    """
    words = keep(words.select("word", "n"), "vocabulary")
    got = replacements(words).unionByName(indels(words, shortest)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.less") >= F.col("n") * ratio
    found = words.join(got, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    found = keep(found, "forms")
    return found.join(roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")
