"""Content on its way in: which parser takes a file, what is stored of it, what its lines are worth keeping for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.text import extension, memory_of

#: Bytes up to which a file is parsed, and up to which its text is stored.
PARSE_BYTES, STORE_BYTES = 4 << 20, 512 << 10
#: Extension -> parser for what is no programming language.
PARSERS = {"md": "markdown", "mdx": "markdown", "csv": "sheet", "tsv": "sheet", "txt": "text", "json": "text", "yaml": "text", "yml": "text", "toml": "text", "sql": "text"}


def dispatch(files: DataFrame) -> DataFrame:
    """Adds ``parser``, and ``reason`` where none takes a file: binary, too-large, parser-failed, empty or no-parser.

    Needs path, text_content, byte_size, omitted_reason and ``language_parser`` (what takes the language, null if none).
    """
    table = F.create_map(*[x for k, v in PARSERS.items() for x in (F.lit(k), F.lit(v))])
    parser = F.coalesce("language_parser", F.try_element_at(table, extension(F.col("path"))))
    reason = (
        F.when(F.col("omitted_reason") == "binary", "binary").when((F.col("omitted_reason") == "over-size-bound") | (F.col("byte_size") > PARSE_BYTES), "too-large")
        .when(F.col("text_content").isNull(), "parser-failed").when(F.col("text_content") == "", "empty").when(parser.isNull(), "no-parser")
    )
    return files.withColumn("reason", reason).withColumn("parser", F.when(F.col("reason").isNull(), parser))


def content_store(files: DataFrame) -> DataFrame:
    """(content_hash, omitted_reason, bytes, sightings): each content once; without text there is a reason, never both.

    The first row of a content decides; contents without a text are known by their object id.
    """
    size = F.octet_length("text_content")
    reason = F.when(F.col("text_content").isNull(), F.coalesce("omitted_reason", F.lit("undecodable"))).when(size > STORE_BYTES, "over-size-bound")
    rows = files.select(F.sha2(F.coalesce("text_content", "oid", F.lit("")), 256).alias("content_hash"), F.struct(reason.alias("omitted_reason"), F.when(reason.isNull(), size).cast("long").alias("bytes")).alias("row"), "file_id")
    return rows.groupBy("content_hash").agg(F.min_by("row", "file_id").alias("row"), F.count(F.lit(1)).alias("sightings")).select("content_hash", "row.omitted_reason", "row.bytes", "sightings")


def memories(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, kind, origin, confidence, statement): statements worth keeping, outside fenced code."""
    parts = docs.select(key, F.posexplode(F.split(text, r"(?m)^ {0,3}(?:```|~~~).*$")).alias("k", "part")).where(F.col("k") % 2 == 0)
    lines = parts.select(key, F.explode(F.split("part", r"\r\n|\n|\r")).alias("line"))
    return lines.select(key, memory_of(F.col("line")).alias("m")).where(F.col("m").isNotNull()).select(key, "m.*")
