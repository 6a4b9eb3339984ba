"""What is shown of answers and contexts: refusals, preambles, prompts, caps, request figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, page_range, squeeze, tokens_up

# What answers that refuse say; how answers begin that name their source; codes and numbered items.
REFUSALS = ("không tìm thấy thông tin này trong tài liệu", "không có trong tài liệu", "không tìm thấy thông tin", "không có thông tin")
PREAMBLE = r"(?is)^(?:theo\s+(?:source|nguồn)\s*\d*|dựa\s+(?:trên|vào)\s+(?:source|nguồn)\s*\d*)\s*[,:.\-–—]\s*"
CODE = r"\b[A-Z][A-Z0-9]*-\d+\b"
ITEM = r"(?m)^\s*\d+\.\s+\S"


def without_preamble(answer: Column) -> Column:
    """The answer without "by source n," in front; answers without it and blank ones as they are [O3]."""
    begin = F.regexp_replace(answer, r"^\s+", "")
    return F.when(begin.rlike(PREAMBLE), F.regexp_replace(F.regexp_replace(begin, PREAMBLE, ""), r"^\s+", "")).otherwise(answer)


def refusal(answer: Column) -> Column:
    """struct(refuses, leads): whether an answer refuses, and does so before any code or list item [O1]."""
    plain = F.lower(F.coalesce(answer, F.lit("")))
    places = [F.when(F.instr(plain, m) > 0, F.instr(plain, m)) for m in REFUSALS]
    first = F.least(*places)
    fact = F.least(*[F.when(F.regexp_instr(answer, F.lit(p)) > 0, F.regexp_instr(answer, F.lit(p))) for p in (CODE, ITEM)])
    refuses = first.isNotNull()
    return F.struct(refuses.alias("refuses"), (refuses & (fact.isNull() | (first <= fact))).alias("leads"))


def substantive(answer: Column) -> Column:
    """A code, a numbered item or three lines with a colon [O2]."""
    answer = F.coalesce(answer, F.lit(""))
    lines = F.filter(F.split(answer, r"\r\n|\r|\n"), lambda x: x.contains(":"))
    return answer.rlike(CODE) | answer.rlike(ITEM) | (F.size(lines) >= 3)


def answer_tokens(kind: Column, multi: Column, compare: Column) -> Column:
    """Token cap of an answer [O4]."""
    return F.greatest(F.when(kind == "LIST_ALL", 768).when(multi | compare, 512).when(kind == "NORMAL_FACT", 384).otherwise(512), F.lit(64))


def has_pipe_table(text: Column) -> Column:
    """Any line with two pipes [O7]."""
    return F.exists(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_count(x, F.lit(r"\|")) >= 2)


def context_block(title: Column, first: Column, last: Column, content: Column, cells: Column | None = None) -> Column:
    """One context of a prompt: title and pages, the content, a row's cells one a line [O6]."""
    pages = page_range(first, last)
    head = F.concat(F.coalesce(title, F.lit("")), F.when(pages != "", F.concat(F.lit(" (p. "), pages, F.lit(")"))).otherwise(F.lit("")))
    body = squeeze(F.coalesce(content, F.lit("")))
    if cells is not None:
        listed = F.array_join(F.transform(F.filter(cells, lambda c: c["value"] != ""), lambda c: F.concat_ws(": ", c["key"], c["value"])), "\n")
        body = F.when(F.size(cells) > 0, listed).otherwise(body)
    return F.concat_ws("\n", head, body)


def prompts(contexts: DataFrame, question: str, order: str, block: str, instruction: str = "Answer from the passages.") -> DataFrame:
    """question, prompt: the selected contexts of each question in order, a bounded number each [O6, O8]."""
    row = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(block).alias("block"))))
    text = F.array_join(F.transform(row, lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r["block"])), "\n\n")
    return contexts.groupBy(question).agg(text.alias("passages")).select(question, F.concat_ws("\n\n", F.lit(instruction), "passages", F.col(question)).alias("prompt"))


# The headings of a prompt's parts and the names of its speakers.
SCOPE, KIND, SOURCES, HISTORY, ASKED = "PHẠM VI TÌM KIẾM ĐÃ XÁC ĐỊNH: ", "LOẠI CÂU HỎI: ", "TÀI LIỆU THAM KHẢO", "LỊCH SỬ HỘI THOẠI", "CÂU HỎI HIỆN TẠI"
USER, ASSISTANT = "Người dùng", "Trợ lý"


def shown_content(kind: Column, content: Column, cells: Column, table: Column, row: Column, group: Column) -> Column:
    """The content of a context; of a row with filled cells its table, number, group and cells, a line each [O6]."""
    some = lambda c: ~blank(c)
    line = lambda name, c: F.when(some(c), F.array(F.concat(F.lit(name), F.trim(c)))).otherwise(F.array().cast("array<string>"))
    full = F.filter(cells, lambda c: some(c["value"]) & c["key"].isNotNull())
    lines = F.concat(line("Table: ", table), line("Row: ", row.cast("string")), line("Group: ", group), F.array(F.lit("Cells:")), F.transform(full, lambda c: F.concat(F.lit("- "), F.trim(c["key"]), F.lit(": "), F.trim(c["value"]))))
    is_row = F.lower(F.trim(F.coalesce(kind, F.lit("")))) == "normalized_table_row"
    return F.when(is_row & (F.size(full) > 0), F.array_join(lines, "\n")).otherwise(F.coalesce(content, F.lit("")))


def full_prompts(asked: DataFrame, contexts: DataFrame, history: DataFrame, scope_note: str = "", kind_notes: dict[str, str] | None = None, row_note: str = "") -> DataFrame:
    """question, prompt: scope, kind, sources, earlier turns and the question of each question, also of those without contexts or turns [O6, O8].

    asked: question, text, kind, scope (null or blank: none); contexts: question, rank, file, heading, page_start, page_end, chunk_type, content, cells,
    table_name, row_index, group_context, as many as a question may have; history: question, at, role, text, the turns that are to be
    shown. Notes are what is said about a locked scope, a kind of question, and contexts that are rows. Nulls are shown as blank, null pages as null.
    """
    blankless = lambda c: F.coalesce(F.col(c), F.lit(""))
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    body = shown_content(F.col("chunk_type"), F.col("content"), F.col("cells"), F.col("table_name"), F.col("row_index"), F.col("group_context"))
    block = F.concat(
        F.lit("Document: "), blankless("file"), F.lit("\nSection: "), blankless("heading"), F.lit("\nPages: "), page("page_start"), F.lit("-"), page("page_end"),
        F.lit("\nType: "), blankless("chunk_type"), F.lit("\n\nContent:\n"), body, F.lit("\n\n"),
    )
    is_row = F.coalesce(F.lower(F.trim("chunk_type")) == "normalized_table_row", F.lit(False))
    sources = contexts.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b"))))["b"].alias("_blocks"), F.max(is_row).alias("_rows"))
    said = F.concat(F.when(F.upper("role") == "USER", USER).otherwise(ASSISTANT), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n"))
    turns = history.groupBy("question").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", said.alias("s"))))["s"], "").alias("_turns"))
    rows = asked.join(sources, "question", "left").join(turns, "question", "left")
    heading = lambda x: F.concat(F.lit("["), x, F.lit("]\n"))
    notes = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in (kind_notes or {}).items()], F.lit(""))
    numbered = F.array_join(F.transform(F.coalesce("_blocks", F.array().cast("array<string>")), lambda b, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("]\n"), b)), "")
    parts = [
        F.when(~blank(F.col("scope")), F.concat(heading(F.concat(F.lit(SCOPE), F.col("scope"))), F.lit(f"{scope_note}\n\n"))),
        F.when(~blank(F.col("kind")), F.concat(heading(F.concat(F.lit(KIND), F.col("kind"))), notes, F.lit("\n\n"))),
        F.when(F.col("_rows") & F.lit(row_note != ""), F.lit(f"{row_note}\n\n")),
        F.concat(heading(F.lit(SOURCES)), numbered),
        F.when(F.col("_turns").isNotNull(), F.concat(heading(F.lit(HISTORY)), F.col("_turns"), F.lit("\n"))),
        F.concat(heading(F.lit(ASKED)), F.coalesce("text", F.lit(""))),
    ]
    return rows.select("question", F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("prompt"))


def request_figures(requests: DataFrame, stages: list[str], texts: list[str]) -> DataFrame:
    """requests with the sum of stage times (negative ones as 0) and token estimates of texts [A19, A20, A25, O12]."""
    total = reduce(lambda a, b: a + b, [F.greatest(F.coalesce(F.col(s), F.lit(0)), F.lit(0)) for s in stages])
    chars = reduce(lambda a, b: a + b, [F.length(F.coalesce(F.col(t), F.lit(""))) for t in texts])
    return requests.withColumns({"total_ms": total, "chars": chars, "tokens": F.ceil(chars / F.lit(4)), **{f"{t}_tokens": tokens_up(F.col(t)) for t in texts}})
