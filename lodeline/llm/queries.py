"""Registered queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import langid, mixing, packing, parsing, secrets
from lodeline.session import cut, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each distinct credential in a statement or commit subject."""
    statements = secrets.found_secrets(table(spark, d, "evidence_record"), "statement", True, "evidence_record")
    subjects = secrets.found_secrets(table(spark, d, "commit_record"), "subject", False, "commit_record")
    return statements.unionByName(subjects)


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every statement and subject as it may be passed on, with the number of distinct credentials cut out."""
    parts = []
    for name, column, as_json in (("evidence_record", "statement", True), ("commit_record", "subject", False)):
        rows = secrets.scan(table(spark, d, name), column, as_json)
        parts.append(rows.select(F.lit(name).alias("table_name"), "row_id", F.coalesce(F.size("secrets"), F.lit(0)).alias("n_secrets"), "redacted"))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Files with a syntax error in the language of their extension."""
    judged = parsing.judge_files(table(spark, d, "source_file"), table(spark, d, "language_spec"))
    return judged.where(F.col("error_at").isNotNull()).select("file_id")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of broken files for each repository and language."""
    return parsing.broken_rates(parsing.judge_files(table(spark, d, "source_file"), table(spark, d, "language_spec")))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of every kind."""
    return packing.pack_documents(packing.measured(table(spark, d, "documents")), table(spark, d, "container_spec"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each kind are."""
    kinds = table(spark, d, "container_spec")
    return packing.fill_report(packing.pack_documents(packing.measured(table(spark, d, "documents")), kinds), kinds)


def p7_locality(spark: SparkSession, d: str) -> DataFrame:
    """How near the documents that share a container lie on the curve, against containers filled without regard to it."""
    sizes = cut(packing.measured(table(spark, d, "documents")))
    return packing.locality_report(packing.pack_documents(sizes, table(spark, d, "container_spec")), sizes)


def p7_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: every document once and whole, no container over its room, no needless cut."""
    sizes, kinds = cut(packing.measured(table(spark, d, "documents"))), table(spark, d, "container_spec")
    packed = cut(packing.pack_documents(sizes, kinds))
    rooms = kinds.select("container_name", (F.col("capacity_tokens") - F.coalesce("reserved_tokens", F.lit(0))).alias("room"))
    docs = packed.groupBy("container_name", "doc_id").agg(F.sum("tokens").alias("got"), F.count(F.lit(1)).alias("pieces")).join(sizes, "doc_id").join(F.broadcast(rooms), "container_name")  # five rows
    whole = docs.groupBy("container_name").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("got") != F.col("tokens")).alias("torn"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("room"))).alias("needless"))
    full = packed.groupBy("container_name", "container_no").agg(F.sum("tokens").alias("used")).join(F.broadcast(rooms), "container_name").groupBy("container_name").agg(F.count_if(F.col("used") > F.col("room")).alias("over"))
    return whole.join(full, "container_name")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document in the largest mix that meets all target shares."""
    targets = table(spark, d, "mix_target")
    return mixing.mix(mixing.sized(table(spark, d, "documents"), targets), targets)


def p8_shards(spark: SparkSession, d: str) -> DataFrame:
    """What each shard of the mix got of each source against its quota."""
    targets = table(spark, d, "mix_target")
    return mixing.shard_report(mixing.mix(mixing.sized(table(spark, d, "documents"), targets), targets))


def p8_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any mix: no document more often than its source allows, none twice in a pass, shares as asked for."""
    targets = table(spark, d, "mix_target")
    mixed = cut(mixing.mix(mixing.sized(table(spark, d, "documents"), targets), targets))
    uses = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pass_no").alias("passes"))
    bad = uses.join(F.broadcast(targets), "source").groupBy("source").agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("n") != F.col("passes")).alias("twice"))
    report = mixing.share_report(mixed, targets)
    return report.join(bad, "source", "left").select("source", F.coalesce("too_often", F.lit(0)).alias("too_often"), F.coalesce("twice", F.lit(0)).alias("twice"), (F.abs(F.col("actual_share") - F.col("target_share")) < 0.01).alias("on_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    targets = table(spark, d, "mix_target")
    return mixing.share_report(mixing.mix(mixing.sized(table(spark, d, "documents"), targets), targets), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Segments of documents that mix languages or whose label is missing or wrong."""
    found = langid.segments(table(spark, d, "documents"))
    return found.where(~F.col("label_right")).select("doc_id", "segment_no", "lang")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every segment of every document."""
    return langid.segments(table(spark, d, "documents"))


QUERIES = {
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p7_locality": p7_locality,
    "p7_sound": p7_sound,
    "p8_mix": p8_mix,
    "p8_shards": p8_shards,
    "p8_sound": p8_sound,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_languages": p9_languages,
}
#: SQL cannot pack or mix; it can tell what must come out of the checks of any packing and mix.
ORACLE: dict[str, str] = {
    "p7_sound": "SELECT container_name, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documents, 0 AS torn, 0 AS needless, 0 AS over FROM container_spec",
    "p8_sound": "SELECT source, 0 AS too_often, 0 AS twice, true AS on_target FROM mix_target",
}
