"""Canonical frames over the driver's tables, and the same as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.session import table

ENTITY_COLUMNS = ("kind", "canonical_key", "schema_version", "source_system", "source_id", "source_scope", "lifecycle", "attributes", "content_hash")


def registrar():
    """(queries, SQL, decorator): the decorator keeps a query under its name, with the SQL that checks it."""
    queries, oracle = {}, {}

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql is not None:
                oracle[f.__name__] = sql
            return f

        return keep

    return queries, oracle, query


def newest(df: DataFrame, keys: list[str], order: list, keep: list[str]) -> DataFrame:
    """The last row of each key: one hash aggregate with a map-side part, no sort of whole groups."""
    row = F.max_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("row")).select(*keys, "row.*")


def entity(spark: SparkSession, d: str) -> DataFrame:
    """The state of each entity by its newest report."""
    rows = table(spark, d, "entity_update").withColumn("observed_at", F.coalesce("source_observed_at", "recorded_at"))
    return newest(rows, ["id"], [F.col("observed_at"), F.col("recorded_at"), F.col("delivery_id")], [*ENTITY_COLUMNS, "observed_at", "recorded_at"])


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """One row for each piece of evidence, the one recorded last."""
    rows = table(spark, d, "evidence_record")
    keep = [c for c in rows.columns if c not in ("evidence_id", "row_id")]
    return newest(rows, ["evidence_id"], [F.col("recorded_at"), F.col("row_id")], keep)


ENTITY = """entity AS (SELECT *, coalesce(source_observed_at, recorded_at) AS observed_at FROM entity_update
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(source_observed_at, recorded_at) DESC, recorded_at DESC, delivery_id DESC) = 1)"""
EVIDENCE = """evidence AS (SELECT * FROM evidence_record QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY recorded_at DESC, row_id DESC) = 1)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Typed edges with half-open validity: (from_id, type, to_id, valid_from, valid_to)."""
    start = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    never = F.lit(None).cast("timestamp_ntz")

    def named(kind: str, col: str):
        return F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))

    def plain(name: str, a, type_: str, b, at=start):
        return table(spark, d, name).select(a.alias("from_id"), F.lit(type_).alias("type"), b.alias("to_id"), at.alias("valid_from"), never.alias("valid_to"))

    nation = plain("nation", named("nation", "n_nationkey"), "nation_in_region", named("region", "n_regionkey"))
    customer = plain("customer", named("customer", "c_custkey"), "customer_in_nation", named("nation", "c_nationkey"))
    supplier = plain("supplier", named("supplier", "s_suppkey"), "supplier_in_nation", named("nation", "s_nationkey"))
    order = plain("orders", named("customer", "o_custkey"), "customer_placed_order", named("order", "o_orderkey"), F.col("o_orderdate"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    lines = lines.join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.groupBy("l_orderkey", "l_partkey", "o_orderdate").agg(F.max("l_shipdate").alias("shipped"))
    parts = lines.select(
        named("order", "l_orderkey").alias("from_id"), F.lit("order_contains_part").alias("type"), named("part", "l_partkey").alias("to_id"),
        F.col("o_orderdate").alias("valid_from"), F.when(F.col("shipped") > F.col("o_orderdate"), F.col("shipped")).alias("valid_to"),
    )
    return nation.unionByName(customer).unionByName(supplier).unionByName(order).unionByName(parts)


EDGES = """edges AS (
SELECT 'nation:' || n_nationkey AS from_id, 'nation_in_region' AS type, 'region:' || n_regionkey AS to_id, TIMESTAMP '1995-01-01' AS valid_from, NULL::TIMESTAMP AS valid_to FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'customer_in_nation', 'nation:' || c_nationkey, TIMESTAMP '1995-01-01', NULL FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier_in_nation', 'nation:' || s_nationkey, TIMESTAMP '1995-01-01', NULL FROM supplier
UNION ALL SELECT 'customer:' || o_custkey, 'customer_placed_order', 'order:' || o_orderkey, o_orderdate, NULL FROM orders
UNION ALL SELECT 'order:' || l_orderkey, 'order_contains_part', 'part:' || l_partkey, o_orderdate, CASE WHEN max(l_shipdate) > o_orderdate THEN max(l_shipdate) END
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_partkey, o_orderdate)"""
