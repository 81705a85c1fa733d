"""What changed between full snapshots.

Method: the items of each complete snapshot meet those of the complete snapshot before in a full outer join on the
primary key, and canonical row hashes are compared; a missing side is an addition or a removal, unequal hashes are a
change. The key of the join holds the item, so a source with a third of all rows spreads like any other.

Defined cases: rows with a null key or item, and snapshots that are not complete, take no part; several rows for one
item in one snapshot count by the latest ``acquired_at``, then the greatest entry key; an unknown value equals every
value; empty tables and sources with one snapshot give nothing; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_hash(*values: Column) -> Column:
    """Canonical hash of a row's values: 128 bits; null if all are unknown."""
    known = F.coalesce(*[v.isNotNull() for v in values]) if len(values) == 1 else None
    text = values[0] if len(values) == 1 else F.to_json(F.array(*[F.struct(v.cast("string").alias("v")) for v in values]))
    digest = F.unhex(F.substring(F.sha2(text.cast("string"), 256), 1, 32))
    return F.when(known, digest) if known is not None else digest


def snapshot_items(listing: DataFrame, item: Column, value: Column) -> DataFrame:
    """(repo_id, snapshot_no, item_name, row_hash) of complete snapshots, one row for each item."""
    rows = listing.where(F.col("is_complete")).select(
        "repo_id", F.col("snapshot_no").cast("long").alias("snapshot_no"), item.alias("item_name"), row_hash(value).alias("row_hash"), "acquired_at", "entry_id"
    )
    rows = rows.where(F.col("repo_id").isNotNull() & F.col("snapshot_no").isNotNull() & F.col("item_name").isNotNull())
    last = F.max_by(F.struct("row_hash"), F.struct("acquired_at", "entry_id"))
    return rows.groupBy("repo_id", "snapshot_no", "item_name").agg(last.alias("row")).select("repo_id", "snapshot_no", "item_name", "row.row_hash")


def snapshot_pairs(listing: DataFrame) -> DataFrame:
    """(repo_id, prev_no, snapshot_no): each complete snapshot with the complete one before; one row a snapshot."""
    seen = listing.where(F.col("is_complete") & F.col("repo_id").isNotNull() & F.col("snapshot_no").isNotNull())
    seen = seen.select("repo_id", F.col("snapshot_no").cast("long").alias("snapshot_no")).distinct()
    w = W.partitionBy("repo_id").orderBy("snapshot_no")
    return seen.withColumn("prev_no", F.lag("snapshot_no").over(w)).where(F.col("prev_no").isNotNull())


def snapshot_changes(listing: DataFrame, item: Column, value: Column, item_type: str) -> DataFrame:
    """(repo_id, snapshot_no, item_type, item_name, change_type) between consecutive complete snapshots."""
    items = snapshot_items(listing, item, value)
    pairs = snapshot_pairs(listing)
    keys = ["repo_id", "snapshot_no", "item_name"]
    now = items.join(pairs.select("repo_id", "snapshot_no"), ["repo_id", "snapshot_no"], "left_semi")
    before = (
        items.withColumnRenamed("snapshot_no", "prev_no")
        .join(pairs, ["repo_id", "prev_no"])
        .select("repo_id", "snapshot_no", "item_name", F.col("row_hash").alias("old_hash"), F.lit(True).alias("was"))
    )
    both = now.withColumn("is", F.lit(True)).join(before, keys, "full_outer")
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("is").isNull(), "removed")
        .when(F.col("row_hash") != F.col("old_hash"), "changed")
    )
    return both.select("repo_id", "snapshot_no", F.lit(item_type).alias("item_type"), "item_name", change.alias("change_type")).where(F.col("change_type").isNotNull())
