"""Which strategy answers a line: exact look-up if it finds anything, else ranked lists fused; set-wise over many lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators.search import RRF_K


def plan_search(lines: DataFrame, exact: DataFrame, lists: list[DataFrame]) -> DataFrame:
    """(line, id, strategy, fused): exact hits end a line's plan; others get the fusion of the ranked lists; a line without
    any hit is a row that says so.

    ``lines`` is (line), ``exact`` is (line, id) over all that can be named, each of ``lists`` is (line, id, rank). One plan:
    nothing is collected to decide, an anti join on the lines answered exactly does.
    """
    hits = exact.join(lines, "line", "left_semi").distinct()
    answered = hits.select("line").distinct()
    open_ = lines.join(answered, "line", "left_anti")
    every = None
    for one in lists:
        every = one if every is None else every.unionByName(one)
    fused = every.join(open_, "line", "left_semi").groupBy("line", "id").agg(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))).alias("fused"))
    silent = open_.join(fused.select("line").distinct(), "line", "left_anti")
    return (
        hits.select("line", "id", F.lit("exact").alias("strategy"), F.lit(1.0).alias("fused")).unionByName(fused.select("line", "id", F.lit("fused").alias("strategy"), "fused"))
        .unionByName(silent.select("line", F.lit(None).cast("string").alias("id"), F.lit("note:nothing-found").alias("strategy"), F.lit(None).cast("double").alias("fused")))
    )
