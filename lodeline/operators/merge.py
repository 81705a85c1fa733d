"""Batch rewrites: upserts, import checks, retention. Each is one full outer or anti join and yields a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, outcome, digest): created, updated, unchanged or kept for every key of either side."""
    a = stored.select(*keys, F.col(digest).alias("_old"))
    b = incoming.select(*keys, F.col(digest).alias("_new"))
    outcome = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    return a.join(b, keys, "full_outer").select(*keys, outcome.alias("outcome"), F.coalesce("_new", "_old").alias(digest))


def classify_import(stored: DataFrame, incoming: DataFrame, key: str, digest: str, parents: DataFrame, parent: str) -> DataFrame:
    """(key, verdict): orphaned without a parent row, written if new, unchanged or conflicting if known."""
    known = stored.select(key, F.col(digest).alias("_old"))
    homes = parents.select(F.col(parent)).distinct().withColumn("_home", F.lit(True))
    rows = incoming.select(key, F.col(digest).alias("_new"), parent).join(known, key, "left").join(homes, parent, "left")
    verdict = F.when(F.col("_home").isNull(), "orphaned").when(F.col("_old").isNull(), "written").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("conflicting")
    return rows.select(key, verdict.alias("verdict"))


def unreferenced(rows: DataFrame, key: str, references: DataFrame, older: Column | None = None) -> DataFrame:
    """Rows that nothing refers to, and that are old enough."""
    kept = rows if older is None else rows.where(older)
    return kept.join(references.select(key).distinct(), key, "left_anti")


def prunable(target: str, rows: DataFrame, before: Column, condition: Column | None = None, keep_if: tuple[DataFrame, str] | None = None) -> DataFrame:
    """(target, held, doomed): how many rows there are, and how many retention would remove.

    Doomed is what is older than ``before`` (column ``at``; without an age nothing is), meets the condition, and is
    referred to by no row of ``keep_if`` (references, key).
    """
    doomed = (F.col("at") < before) & (F.lit(True) if condition is None else condition)
    if keep_if is not None:
        references, key = keep_if
        rows = rows.join(references.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_kept", F.lit(True)), key, "left")
        doomed = doomed & F.col("_kept").isNull()
    return rows.agg(F.lit(target).alias("target"), F.count(F.lit(1)).alias("held"), F.count_if(doomed).alias("doomed"))
