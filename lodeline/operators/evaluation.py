"""Retrieval metrics over judged rankings (query_id, item, rank, relevant), and budgets over ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def precision(judged: DataFrame, k: int) -> DataFrame:
    """Share of relevant items among those returned in the first k (not among k)."""
    rows = judged.where(F.col("rank") <= k).groupBy("query_id")
    return rows.agg((F.count_if("relevant") / F.count(F.lit(1))).alias("value"))


def recall(judged: DataFrame, k: int) -> DataFrame:
    """Share of the relevant items that are in the first k; queries without any are left out."""
    sums = judged.groupBy("query_id").agg(F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias("got"), F.count_if("relevant").alias("all"))
    return sums.where(F.col("all") > 0).select("query_id", (F.col("got") / F.col("all")).alias("value"))


def reciprocal_rank(judged: DataFrame) -> DataFrame:
    return judged.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("relevant"), 1 / F.col("rank"))), F.lit(0.0)).alias("value"))


def ndcg(judged: DataFrame, k: int) -> DataFrame:
    """Discounted gain of the first k against the best possible order."""
    gain = F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)))
    sums = judged.groupBy("query_id").agg(F.coalesce(gain, F.lit(0.0)).alias("dcg"), F.least(F.lit(k), F.count_if("relevant")).cast("int").alias("n")).where(F.col("n") > 0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return sums.select("query_id", (F.col("dcg") / ideal).alias("value"))


def within_budget(rows: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """The best rows whose running cost stays within a budget; the first always stays."""
    w = W.partitionBy(*keys).orderBy(*order)
    upto = F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("upto", upto).withColumn("nth", F.row_number().over(w)).where((F.col("upto") <= budget) | (F.col("nth") == 1))


def admit(rows: DataFrame, keys: list[str], order: str, cost: str, budget: int) -> DataFrame:
    """Greedy admission in order that passes over what does not fit and goes on, over all rows of each key.

    Room only shrinks, so of equal costs c the first so many in order are admitted and none behind them, at most
    budget/c. All that can be admitted is therefore among the first budget/c rows of each cost: about budget * ln(budget)
    rows a key, whatever its size, and only they are folded. Rows that cost nothing always fit. Null costs never do;
    negative ones are an error.
    """
    price = F.col(cost).cast("long")
    priced = rows.select(*keys, order, F.when(price < 0, F.raise_error(F.lit("negative cost"))).otherwise(price).alias("cost")).where(F.col("cost") <= budget)
    free = priced.where(F.col("cost") == 0).select(*keys, F.col(order).cast("long").alias(order))
    nth = F.row_number().over(W.partitionBy(*keys, "cost").orderBy(order))
    able = priced.where(F.col("cost") > 0).withColumn("nth", nth).where(F.col("nth") * F.col("cost") <= budget)
    lists = able.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("item"), "cost"))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))

    def step(acc, x):
        fits = acc["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["item"].cast("long")))).otherwise(acc["kept"]).alias("kept"))

    return free.unionByName(lists.select(*keys, F.explode(F.aggregate("items", start, step)["kept"]).alias(order)))


def bench_scores(ranked: DataFrame, k: int) -> DataFrame:
    """(task, sourced, rr_primary, stale_above_current, irrelevant5, recall, tokens) from (task, artefact, rank, expected,
    primary, superseded, cost). ``stale_above_current`` is null for a task without superseded artefacts."""
    inside = F.col("rank") <= k
    first = lambda flag: F.min(F.when(F.col(flag) & inside, F.col("rank")))
    stale = F.coalesce(first("superseded") < F.coalesce(first("primary"), F.lit(1 << 30)), F.lit(False))
    return ranked.groupBy("task").agg(
        (F.count_if("primary") == F.count_if(F.col("primary") & inside)).alias("sourced"), F.round(F.coalesce(1 / first("primary"), F.lit(0.0)), 6).alias("rr_primary"),
        F.when(F.count_if("superseded") > 0, stale).alias("stale_above_current"), F.count_if((F.col("rank") <= 5) & ~F.col("expected") & ~F.col("superseded")).alias("irrelevant5"),
        F.round(F.try_divide(F.count_if(F.col("expected") & inside), F.count_if("expected")), 6).alias("recall"), F.coalesce(F.sum(F.when(inside, F.col("cost"))), F.lit(0)).cast("long").alias("tokens"),
    )


def parse_quality(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(matched, found, expected, precision, recall) of (file_id, name) symbols against labelled ones, each once a file."""
    marked = found.distinct().withColumn("f", F.lit(1)).join(labels.distinct().withColumn("l", F.lit(1)), ["file_id", "name"], "full_outer")
    sums = marked.agg(F.count_if(F.col("f").isNotNull() & F.col("l").isNotNull()).alias("matched"), F.count("f").alias("found"), F.count("l").alias("expected"))
    return sums.select("*", F.round(F.try_divide("matched", "found"), 6).alias("precision"), F.round(F.try_divide("matched", "expected"), 6).alias("recall"))
