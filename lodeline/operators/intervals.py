"""Edges with half-open validity: as-of reads, repair of exclusive edges, coalescing, retirement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def holds_at(at: Column) -> Column:
    """Whether an edge holds at an instant: its start belongs to it, its end does not."""
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def exclusive(assertions: DataFrame, keys: list[str]) -> DataFrame:
    """Closes each edge where the next of the same key begins. Recomputed from all assertions, so late ones just fall
    into place and the order of arrival does not matter."""
    w = W.partitionBy(*keys).orderBy("valid_from", "to_id")
    nexts = F.lead("valid_from").over(w)
    end = F.when(nexts.isNull(), F.col("valid_to")).otherwise(F.least(F.coalesce("valid_to", nexts), nexts))
    return assertions.withColumn("valid_to", end)


def coalesce_runs(states: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Joins neighbouring rows of one key that say the same: gaps and islands, the earliest start stays."""
    w = W.partitionBy(*keys).orderBy(*order)
    fresh = F.coalesce((F.col("to_id") != F.lag("to_id").over(w)).cast("int"), F.lit(1))
    return states.withColumn("fresh", fresh).where(F.col("fresh") == 1).drop("fresh")


def retire(edges: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """Closes open edges that ``gone`` (from_id, type, to_id) names; an edge that begins later is left alone."""
    marked = edges.join(gone.select("from_id", "type", "to_id").distinct().withColumn("gone", F.lit(True)), ["from_id", "type", "to_id"], "left")
    close = F.col("gone") & F.col("valid_to").isNull() & (F.col("valid_from") <= at)
    return marked.withColumn("valid_to", F.when(close, at).otherwise(F.col("valid_to"))).drop("gone")
