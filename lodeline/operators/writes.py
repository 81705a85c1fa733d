"""Batch forms of the writes of a knowledge store: edges asserted, artifacts gated, cursors and marks advanced.

Each function sees the stored rows and one batch and returns outcomes or the new rows, so a job can write them as a new
snapshot; nothing depends on the order in which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def assert_edges(stored: DataFrame, incoming: DataFrame, exclusive: tuple[str, ...] = ()) -> DataFrame:
    """(from_id, type, to_id, valid_from, valid_to, outcome) for every asserted edge.

    Rows are (from_id, type, to_id, valid_from, valid_to, source_system, content_hash), one for each (from_id, type,
    to_id, valid_from). ``unchanged``: the same content is stored, or the stored interval is closed and the new row would
    reopen it, or the same open edge of the same source began earlier. ``updated``: stored with other content.
    ``opened``: everything else. In an exclusive type an opened edge ends where the next of its origin begins.
    """
    key = ["from_id", "type", "to_id", "valid_from"]
    old = stored.select(*key, F.col("valid_to").alias("old_to"), F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    open_ = stored.where(F.col("valid_to").isNull()).groupBy("from_id", "type", "to_id", "source_system").agg(F.min("valid_from").alias("open_from"))
    rows = incoming.join(old, key, "left").join(open_, ["from_id", "type", "to_id", "source_system"], "left")
    same = F.col("known") & (F.col("old_hash") == F.col("content_hash"))
    reopens = F.col("known") & F.col("old_to").isNotNull() & F.col("valid_to").isNull()
    held = F.col("known").isNull() & F.col("valid_to").isNull() & (F.col("open_from") <= F.col("valid_from"))
    outcome = F.when(F.coalesce(same | reopens | held, F.lit(False)), "unchanged").when(F.col("known"), "updated").otherwise("opened")
    marked = rows.withColumn("outcome", outcome)
    if not exclusive:
        return marked.select(*key, "valid_to", "outcome")
    starts = stored.select("from_id", "type", "valid_from").unionByName(incoming.select("from_id", "type", "valid_from")).where(F.col("type").isin(*exclusive)).distinct()
    nexts = starts.withColumn("next_from", F.lead("valid_from").over(W.partitionBy("from_id", "type").orderBy("valid_from")))
    bounded = marked.join(nexts, ["from_id", "type", "valid_from"], "left")
    end = F.when((F.col("outcome") != "unchanged") & F.col("next_from").isNotNull(), F.least(F.coalesce("valid_to", "next_from"), "next_from")).otherwise(F.col("valid_to"))
    return bounded.select(*key, end.alias("valid_to"), "outcome")


def artifact_gate(wanted: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(scope_id, valid, reason): whether what was made from a source still stands for it.

    ``wanted`` and ``artifacts`` are (scope_id, producer, producer_version, source_hash).
    """
    made = artifacts.select("scope_id", *[F.col(c).alias(f"made_{c}") for c in ("producer", "producer_version", "source_hash")], F.lit(True).alias("made"))
    rows = wanted.join(made, "scope_id", "left")
    reason = (
        F.when(F.col("made").isNull(), "missing").when(~F.col("made_producer").eqNullSafe(F.col("producer")), "producer")
        .when(~F.col("made_producer_version").eqNullSafe(F.col("producer_version")), "version").when(~F.col("made_source_hash").eqNullSafe(F.col("source_hash")), "source")
    )
    return rows.select("scope_id", reason.isNull().alias("valid"), F.coalesce(reason, F.lit("valid")).alias("reason"))


def upsert_entities(stored: DataFrame, incoming: DataFrame, if_absent: bool = False) -> DataFrame:
    """(id, outcome, lifecycle, content_hash): rows are (id, lifecycle, content_hash).

    Equal content is only touched; with ``if_absent`` known rows stay as they are; the lifecycle of a known row is not
    overwritten by a report, since only lifecycle changes move it.
    """
    old = stored.select("id", F.col("lifecycle").alias("old_lifecycle"), F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    rows = incoming.join(old, "id", "full_outer")
    new = F.col("content_hash").isNotNull() | F.col("lifecycle").isNotNull()
    outcome = (
        F.when(~new, "kept").when(F.col("known").isNull(), "created").when(F.lit(if_absent), "unchanged")
        .when(F.col("old_hash").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("updated")
    )
    changed = F.col("outcome").isin("created", "updated")
    return rows.withColumn("outcome", outcome).select("id", "outcome", F.coalesce("old_lifecycle", "lifecycle").alias("lifecycle"), F.when(changed, F.col("content_hash")).otherwise(F.col("old_hash")).alias("content_hash"))


def advance_marks(previous: DataFrame, commits: DataFrame, now: Column, tips: int = 64) -> DataFrame:
    """(repo_id, last_commit, tips, advanced): how far each repository has been read.

    ``previous`` is (repo_id, last_commit, tips array<string>), ``commits`` is (repo_id, sha, committed, complete). A read
    that was not complete advances nothing; a commit from the future counts as now; the newest tips come first, at most
    ``tips`` are remembered.
    """
    read = commits.groupBy("repo_id").agg(F.max("committed").alias("newest"), F.max_by("sha", F.struct("committed", "sha")).alias("tip"), F.bool_and("complete").alias("complete"))
    rows = read.join(previous, "repo_id", "full_outer")
    go = F.coalesce(F.col("complete"), F.lit(False))
    best = F.least(F.greatest(F.coalesce("last_commit", "newest"), F.coalesce("newest", "last_commit")), now)
    old = F.coalesce("tips", F.array().cast("array<string>"))
    remembered = F.slice(F.concat(F.array("tip"), F.array_remove(old, F.col("tip"))), 1, tips)
    return rows.select("repo_id", F.when(go, best).otherwise(F.col("last_commit")).alias("last_commit"), F.when(go & F.col("tip").isNotNull(), remembered).otherwise(old).alias("tips"), go.alias("advanced"))


def usable_cursors(cursors: DataFrame, version: str) -> DataFrame:
    """Positions to go on from; those another version of the producer left behind are not taken up."""
    return cursors.where(F.col("producer_version") == version)


def capture_faults(captures: DataFrame) -> DataFrame:
    """(session_id, sequence, fault): captures whose number is not positive, comes twice or leaves a gap before it."""
    w = W.partitionBy("session_id").orderBy("sequence")
    rows = captures.withColumn("before", F.lag("sequence").over(w))
    fault = (
        F.when(F.col("sequence").isNull() | (F.col("sequence") < 1), "not-positive").when(F.col("sequence") == F.col("before"), "repeated")
        .when(F.col("sequence") > F.coalesce("before", F.lit(0)) + 1, "gap")
    )
    return rows.select("session_id", "sequence", fault.alias("fault")).where(F.col("fault").isNotNull())


def reconcile_conflicts(rows: DataFrame) -> DataFrame:
    """(evidence_id, evidence_state, changed): believed records of a field in which systems disagree are marked, and marks
    without a disagreement are cleared; other states stay."""
    believed = F.col("evidence_state").isin("current", "conflicting")
    key = [F.col("subject_id"), F.coalesce("field_name", F.lit("\u0000")).alias("k")]
    clash = (
        rows.where(believed).groupBy(*key).agg(F.count_distinct("statement").alias("statements"), F.count_distinct("source_system").alias("systems"))
        .where((F.col("statements") > 1) & (F.col("systems") > 1)).select("subject_id", "k", F.lit(True).alias("clash"))
    )
    marked = rows.withColumn("k", key[1]).join(clash, ["subject_id", "k"], "left")
    state = F.when(~believed, F.col("evidence_state")).when(F.col("clash"), "conflicting").otherwise("current")
    return marked.select("evidence_id", state.alias("evidence_state"), (state != F.col("evidence_state")).alias("changed"))
