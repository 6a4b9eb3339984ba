"""Projections of records to what listings show, and checks of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import initials, named, strip

SOURCE_FIELDS = ("fileName", "documentName", "title", "snippet", "chunk", "content", "pages")


def source_rows(sources: Column) -> Column:
    """Maps of an answer's sources as structs: trimmed texts, empty ones null, the score as a number or null [P10]."""
    text = lambda m, f: F.nullif(strip(F.try_element_at(m, F.lit(f))), F.lit("")).alias(f)
    one = lambda m: F.struct(*[text(m, f) for f in SOURCE_FIELDS], F.try_element_at(m, F.lit("score")).try_cast("double").alias("score"))
    return F.transform(F.filter(F.coalesce(sources, F.array().cast("array<map<string,string>>")), lambda m: m.isNotNull() & (F.size(m) > 0)), one)


def messages(rows: DataFrame) -> DataFrame:
    """Messages with the role in lower case, user if missing, and no sources as an empty list [P11, P26]."""
    return rows.withColumns({"role": F.coalesce(F.lower("role"), F.lit("user")), "sources": source_rows(F.col("sources"))})


def documents(rows: DataFrame) -> DataFrame:
    """Documents with defaults for what is missing and times in ISO form [P27, S6]."""
    return rows.withColumns(
        {
            "file_name": named("file_name", "document"),
            "file_size": F.coalesce("file_size", F.lit(0).cast("long")),
            "chunk_count": F.coalesce("chunk_count", F.lit(0)),
            "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX"),
        }
    )


def bots(rows: DataFrame) -> DataFrame:
    """Bots with name, initials and status [P28, P12, P9]."""
    return rows.withColumns({"name": named("name", "Unknown chatbot"), "initials": initials("name"), "status": F.when(F.col("is_active"), "ACTIVE").otherwise("INACTIVE")})


def status_is(wanted: str, active: str = "is_active") -> Column:
    """'' for all, else ACTIVE or INACTIVE [P6]."""
    if wanted not in ("", "ACTIVE", "INACTIVE"):
        raise ValueError(f"no such status: {wanted}")
    return F.lit(True) if not wanted else F.col(active) == (wanted == "ACTIVE")


def json_contains(json: str, term: str, *paths: str) -> Column:
    """A term in any of the fields of a JSON text, ignoring case; missing ones are empty [P5, P25]."""
    found = F.lit(False)
    for p in paths:
        found = found | F.contains(F.lower(F.coalesce(F.get_json_object(json, p), F.lit(""))), F.lit(term.lower()))
    return found if term.strip() else F.lit(False)


def tenant_rows(rows: DataFrame, widgets: DataFrame, key: Column) -> DataFrame:
    """rows of the active widget that has an API key [P19]."""
    mine = widgets.filter((F.col("api_key") == key) & F.col("is_active")).select("widget_config_id")
    return rows.join(mine, "widget_config_id", "left_semi")


def with_defaults(given: Column, defaults: dict[str, str]) -> Column:
    """A map on top of defaults [P20]."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(given, k))
    return F.coalesce(F.map_concat(kept, given), base)


def clean_origins(origins: Column) -> Column:
    """Origins trimmed, blank ones dropped [P21]."""
    return F.filter(F.transform(origins, strip), lambda x: x != "")


def is_colour(x: Column) -> Column:
    return F.coalesce(x.rlike("^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"), F.lit(False))


def key_hash(key: Column) -> Column:
    """What is stored of a key [X15]."""
    return F.sha2(key, 256)


def masked(key: Column) -> Column:
    """A key with all but its ends hidden [X15]."""
    return F.when(F.length(key) <= 8, F.lit("****")).otherwise(F.concat(F.substring(key, 1, 4), F.lit("****"), F.substring(key, -4, 4)))


def in_sections(hits: DataFrame, sections: list[str]) -> DataFrame:
    """Hits of given sections; hits without one pass [P17]."""
    return hits.filter(F.col("section_id").isNull() | F.col("section_id").isin(*sections))


def embed_text(heading: Column, title: Column, kind: Column, content: Column) -> Column:
    """What a chunk's vector is made from: its path or title, its kind, its content [V2]."""
    head = F.coalesce(F.nullif(strip(heading), F.lit("")), F.nullif(strip(title), F.lit("")))
    return F.concat_ws("\n", head, F.concat(F.lit("Type: "), kind), content)


def chunk_counts(chunks: DataFrame, document: str) -> DataFrame:
    """Chunks of each document by kind, both kinds of section summaries as text [A17]."""
    kind = F.when(F.col("chunk_type").isin("section_summary", "parent_section_summary"), "text").otherwise(F.coalesce("chunk_type", F.lit("text")))
    return chunks.groupBy(document, kind.alias("kind")).agg(F.count("*").alias("chunks"))


def coordinate_coverage(cells: DataFrame) -> DataFrame:
    """Cells with and without a size, by extractor [A26]."""
    sized = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    return cells.groupBy("extractor").agg(F.countDistinct("table_id").alias("tables"), F.count_if(sized).alias("sized"), F.count_if(~sized).alias("unsized"))


def broken_links(chunks: DataFrame) -> DataFrame:
    """Summaries that name children which do not exist, and chunks without content [H8]."""
    children = chunks.filter("child_section_ids is not null").select("document_id", "id", F.explode(F.split("child_section_ids", r"\s*,\s*")).alias("child"))
    known = chunks.select("document_id", F.col("section_id").alias("child")).distinct()
    lost = children.join(known, ["document_id", "child"], "left_anti").select("document_id", "id", F.concat(F.lit("no section "), F.col("child")).alias("problem"))
    blank = chunks.filter(F.trim(F.coalesce("content", F.lit(""))) == "").select("document_id", "id", F.lit("blank content").alias("problem"))
    return lost.unionByName(blank)
