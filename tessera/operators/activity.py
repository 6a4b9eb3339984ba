"""Conversation analytics: counts, calendar-filled series, shares, top lists, unanswered questions, feeds, pages."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import delta_percent, fold, round1, strip

#: A folded answer that holds one of these did not answer.
NO_ANSWER = ("khong biet", "khong tim thay", "khong co thong tin", "i don't know", "not found", "no relevant")


def window_of(first: date, last: date) -> tuple[date, date]:
    """From the first day's midnight to the midnight after the last."""
    if first > last:
        raise ValueError("the range ends before it begins")
    return first, last + timedelta(days=1)


def between_days(ts: str | Column, start: date, end: date) -> Column:
    """Half-open: start <= ts < end [P1]."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (ts >= F.lit(str(start)).cast("timestamp")) & (ts < F.lit(str(end)).cast("timestamp"))


def between_closed(ts: str | Column, start: date, end: date) -> Column:
    """Both ends included [P2]."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts.between(F.lit(str(start)).cast("timestamp"), F.lit(str(end)).cast("timestamp"))


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are set [P3, P7]."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def checked(name: str, value: int, low: int, high: int | None = None) -> int:
    """A parameter in its range, else ValueError [P16]."""
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high is not None else ""))
    return value


def summary(messages: DataFrame, first: date, last: date, ts: str, session: str) -> DataFrame:
    """Messages and different sessions of a range, of the equally long range before it, and the changes [A1, A2]."""
    start, end = window_of(first, last)
    earlier = start - (end - start)
    now, before = between_days(ts, start, end), between_days(ts, earlier, start)
    one = messages.filter(between_days(ts, earlier, end)).agg(
        F.count(F.when(now, 1)).alias("messages"),
        F.countDistinct(F.when(now, F.col(session))).alias("sessions"),
        F.count(F.when(before, 1)).alias("messages_before"),
        F.countDistinct(F.when(before, F.col(session))).alias("sessions_before"),
    )
    return one.select(
        "*",
        delta_percent("messages", "messages_before").alias("messages_delta"),
        delta_percent("sessions", "sessions_before").alias("sessions_delta"),
        F.lit(0.0).alias("fallback_rate"),
    )


def calendar(spark, first: date, last: date) -> DataFrame:
    """One row for each day of a range."""
    days = F.sequence(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date"))
    return spark.range(1).select(F.explode(days).alias("day"))


def daily(messages: DataFrame, first: date, last: date, ts: str, session: str) -> DataFrame:
    """Messages and different sessions of every day, days without any included [A3, A7]."""
    start, end = window_of(first, last)
    per_day = (
        messages.filter(between_days(ts, start, end))
        .groupBy(F.to_date(ts).alias("day"))
        .agg(F.count("*").alias("messages"), F.countDistinct(session).alias("sessions"))
    )
    filled = calendar(messages.sparkSession, first, last).join(per_day, "day", "left")
    return filled.select("day", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("messages", "sessions")])


def shares(messages: DataFrame, bot: str, ts: str, name: Column | None = None) -> DataFrame:
    """Messages of each bot and their share in percent, largest first, ties by first appearance [A4]."""
    per = messages.groupBy(F.col(bot).alias("bot")).agg(F.count("*").alias("messages"), F.min(ts).alias("first_seen"))
    total = F.sum("messages").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))  # a row for each bot
    out = per.withColumn("share", round1(F.col("messages") * F.lit(100.0) / total))
    return out.orderBy(F.desc("messages"), "first_seen", "bot").select("bot", "messages", "share")


def top(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n most frequent keys [A5]."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(n)


def latest(rows: DataFrame, ts: str, n: int, *ties: str) -> DataFrame:
    """The n latest rows [K1]."""
    return rows.orderBy(F.col(ts).desc(), *[F.col(t).desc() for t in ties]).limit(n)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows, each with the number of all rows and of pages [K2]."""
    checked("page", number, 0)
    checked("size", size, 1, 100)
    total = rows.count()
    out = rows.orderBy(*order).offset(number * size).limit(size)
    return out.withColumns({"total": F.lit(total), "pages": F.lit(-(-total // size))})


def answered_pairs(turns: DataFrame, order: list[str], session: str, role: str, text: str, newest: int | None = 500, per_session: bool = False) -> DataFrame:
    """User turns that an assistant turn of the same session directly follows: session, question, answer [W1].

    The order is that of all turns together, so a turn of another session in between breaks a pair;
    per_session looks at each session alone. Only the newest turns are considered, which bounds the
    window without partitions; None, with per_session, takes all.
    """
    if newest is not None:
        turns = turns.orderBy(*[F.col(c).desc() for c in order]).limit(newest)
    elif not per_session:
        raise ValueError("without a limit the pairs are looked for in each session alone")
    w = (W.partitionBy(session) if per_session else W.partitionBy()).orderBy(*order)
    follows = turns.select(
        F.col(session).alias("session"),
        F.lower(role).alias("role"),
        F.col(text).alias("question"),
        *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)],
        F.lead(session).over(w).alias("next_session"),
        F.lower(F.lead(role).over(w)).alias("next_role"),
        F.lead(text).over(w).alias("answer"),
    )
    return follows.filter((F.col("role") == "user") & (F.col("next_role") == "assistant") & (F.col("session") == F.col("next_session"))).select(
        "session", "question", "answer", *[F.col(f"_{i}").alias(c) for i, c in enumerate(order) if c not in ("session", "question", "answer")]
    )


def unanswered(pairs: DataFrame, first_by: list[str], n: int, hints=NO_ANSWER) -> DataFrame:
    """Questions whose answers hold a hint, by how often they were asked, with the session of the first [A8, P23]."""
    answer = fold(F.coalesce("answer", F.lit("")))
    hit = reduce(lambda a, b: a | b, [answer.contains(h) for h in hints])
    asked = pairs.filter(hit).withColumn("question", strip("question")).filter("question != ''")
    out = asked.groupBy("question").agg(F.count("*").alias("times"), F.min(F.struct(*first_by, "session")).alias("first"))
    return out.orderBy(F.desc("times"), F.col("first")).limit(n).select("question", "times", F.col("first.session").alias("first_session"))


def last_turns(turns: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """Turns and the last text of each session [W2]."""
    return turns.groupBy(F.col(session).alias("session")).agg(F.count("*").alias("turns"), F.max_by(text, order).alias("last_text"))


def first_turns(turns: DataFrame, session: str, order: str, n: int = 10) -> DataFrame:
    """The first n turns of each session [W3]."""
    w = W.partitionBy(session).orderBy(order)
    return turns.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def counts_beside(rows: DataFrame, key: str, **counted: tuple[DataFrame, str]) -> DataFrame:
    """rows with a count of each other table's rows by key, 0 where there are none [J4]."""
    for name, (other, column) in counted.items():
        per = other.groupBy(F.col(column).alias(key)).agg(F.count("*").alias(name))
        rows = rows.join(per, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


def feed(n: int, **sources: tuple[DataFrame, str, str]) -> DataFrame:
    """The n latest events of several tables, each given by rows, time and title column [U1, K11]."""
    parts = [
        rows.select(F.lit(kind).alias("kind"), F.col(ts).cast("timestamp").alias("at"), F.col(title).cast("string").alias("title"))
        .orderBy(F.desc("at"), "title")
        .limit(n)
        for kind, (rows, ts, title) in sources.items()
    ]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("at"), "kind", "title").limit(n)


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of two tables by key, and whether they are as many [A18]."""
    a = left.groupBy(key).agg(F.count("*").alias("left_rows"))
    b = right.groupBy(key).agg(F.count("*").alias("right_rows"))
    both = a.join(b, key, "full_outer").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("left_rows", "right_rows")])
    return both.withColumn("equal", F.col("left_rows") == F.col("right_rows"))
