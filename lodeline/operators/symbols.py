"""Declarations in source texts, read with patterns inside Catalyst; outlines, overloads and references between files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DECLARATION = r"(?m)^[ \t]*((?:export[ \t]+)?(?:async[ \t]+)?(?:function|class|interface|enum|type|const|def)[ \t]+[A-Za-z_$][A-Za-z0-9_$]*)"


def declarations(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, path, nth, kind, name, exported): every declaration in its order in the file."""
    found = files.where(F.col("text_content").isNotNull()).select("file_id", "repo_id", "path", F.posexplode(F.regexp_extract_all("text_content", F.lit(DECLARATION), F.lit(1))).alias("nth", "head"))
    words = F.split(F.regexp_replace("head", F.lit(r"[ \t]+"), F.lit(" ")), " ")
    return found.select("file_id", "repo_id", "path", "nth", F.element_at(words, -2).alias("kind"), F.element_at(words, -1).alias("name"), F.col("head").startswith("export").alias("exported"))


SIGNATURE = r"(?m)^[ \t]*((?:(?:export|default|declare|abstract|async)[ \t]+)*(?:function|class|interface|enum|def)[ \t]+[A-Za-z_$][A-Za-z0-9_$]*[^\n{]*)"
_KEYWORDS = ("function", "class", "interface", "enum", "def")


def signatures(files: DataFrame) -> DataFrame:
    """(file_id, name, signature, modifiers array<string>) of every declaration, from the line that opens it."""
    heads = files.where(F.col("text_content").isNotNull()).select("file_id", F.explode(F.regexp_extract_all("text_content", F.lit(SIGNATURE), F.lit(1))).alias("head"))
    flat = F.trim(F.regexp_replace("head", F.lit(r"\s+"), F.lit(" ")))
    words = F.split(flat, " ")
    at = F.array_min(F.array_compact(F.array(*[F.nullif(F.array_position(words, k), F.lit(0)) for k in _KEYWORDS])))
    name = F.regexp_extract(F.element_at(words, (at + 1).cast("int")), r"^([A-Za-z_$][A-Za-z0-9_$]*)", 1)
    return heads.select("file_id", name.alias("name"), F.regexp_replace(flat, F.lit(r"[:;\s]+$"), F.lit("")).alias("signature"), F.slice(words, F.lit(1), (at - 1).cast("int")).alias("modifiers"))


def overloads(symbols: DataFrame) -> DataFrame:
    """Adds ``overload``: how many declarations of the same name stand before it in the file."""
    w = W.partitionBy("file_id", "name").orderBy("nth")
    return symbols.withColumn("overload", F.row_number().over(w) - 1)


def resolve(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, name, target_file, how): a name declared in the same file, else the only one of its repository."""
    local = symbols.select("file_id", "name").distinct().withColumn("local", F.lit(True))
    unique = symbols.groupBy("repo_id", "name").agg(F.count_distinct("file_id").alias("n"), F.min("file_id").alias("only")).where(F.col("n") == 1).select("repo_id", "name", "only")
    rows = references.join(local, ["file_id", "name"], "left").join(unique, ["repo_id", "name"], "left")
    how = F.when(F.col("local"), "local").when(F.col("only").isNotNull(), "unique").otherwise("unresolved")
    return rows.select("file_id", "name", F.when(F.col("local"), F.col("file_id")).otherwise(F.col("only")).alias("target_file"), how.alias("how"))


def parents_by_level(rows: DataFrame, keys: list[str], order: str, level: str, name: str, deepest: int = 6) -> DataFrame:
    """Adds ``parent``: the last row before it of a smaller level (headings of an outline)."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col(level) == k, F.struct(F.col(order), F.col(name))), ignorenulls=True).over(w) for k in range(1, deepest)}
    found = rows.select("*", *[c.alias(f"_l{k}") for k, c in last.items()])
    best = F.array_max(F.array_compact(F.array(*[F.when(F.col(level) > k, F.col(f"_l{k}")) for k in last])))
    return found.withColumn("parent", best[name]).drop(*[f"_l{k}" for k in last])
