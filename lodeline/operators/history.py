"""History of changing attributes: every version of an entity with its half-open period of validity.

Method: affected-chain rebuild. Late or corrected rows never patch intervals in place; the entities they touch are
looked up, all raw rows of those entities are read again, their whole chains of intervals are rebuilt, and the old
chains are replaced in one step. Rebuilding is one shuffle by entity and a handful of windows over the same sort.

An entity with more than ``hot_rows`` rows is never put into one task: its rows are cut into ranges of time, every
range is resolved on its own, and the state at the seams comes from a summary with one row for each range.

Defined cases: rows with a null id or no instant at all take no part; null attributes and a null lifecycle are states
like any other; text that is no JSON stands for itself; several rows for one instant count in the order of
``recorded_at``, then of their row key; changes before an entity's first report open no version; changes about
unknown entities are ignored; empty tables give an empty history; further columns of the inputs are ignored.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.functions.canonical import json_digest
from lodeline.session import cut

#: Rows of one entity from which its chain is cut into ranges of time, rows of a range, and ranges of one entity.
HOT_ROWS, RANGE_ROWS, MOST_RANGES = 200_000, 50_000, 1_024
#: Hot entities up to which their list is broadcast; beyond, the join shuffles.
BROADCAST_HOT = 20_000


def change_events(updates: DataFrame, changes: DataFrame, with_attributes: bool = True) -> DataFrame:
    """One stream of what set an entity's state: (id, at, recorded_at, ord, is_report, digest, attributes?, lifecycle)."""
    reports = updates.select(
        F.col("id"),
        F.coalesce("source_observed_at", "recorded_at").alias("at"),
        F.col("recorded_at"),
        F.col("delivery_id").alias("ord"),
        F.lit(True).alias("is_report"),
        json_digest(F.col("attributes")).alias("digest"),
        *([F.col("attributes")] if with_attributes else []),
        F.col("lifecycle"),
    )
    retirements = changes.where(F.col("change_action").isin("retire", "reinstate")).select(
        F.col("entity_id").alias("id"),
        F.col("changed_at").alias("at"),
        F.col("recorded_at"),
        F.col("change_id").alias("ord"),
        F.lit(False).alias("is_report"),
        F.lit(None).cast("binary").alias("digest"),
        *([F.lit(None).cast("string").alias("attributes")] if with_attributes else []),
        F.when(F.col("change_action") == "retire", "deleted").otherwise("active").alias("lifecycle"),
    )
    return reports.unionByName(retirements).where(F.col("id").isNotNull() & F.col("at").isNotNull())


def _state(df: DataFrame) -> list[str]:
    return ["digest", "lifecycle"] + (["attributes"] if "attributes" in df.columns else [])


def _carried(events: DataFrame, keys: list[str]) -> DataFrame:
    """The state after each instant: rows of one instant folded, attributes carried over lifecycle changes."""
    order = [F.col("at"), F.col("recorded_at").asc_nulls_first(), F.col("is_report"), F.col("ord")]
    w = W.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    report = F.struct(*[F.col(c) for c in ("digest", "attributes") if c in events.columns])
    seen = events.withColumn("report", F.last(F.when(F.col("is_report"), report), ignorenulls=True).over(upto))
    return seen.withColumn("next_at", F.lead("at").over(w)).where(F.col("next_at").isNull() | (F.col("next_at") != F.col("at")))


def _opened(df: DataFrame, report: F.Column, previous: F.Column) -> DataFrame:
    """Rows where the state differs from the one before; ``previous`` is null where there is none."""
    same = previous.isNotNull() & previous["digest"].eqNullSafe(report["digest"]) & previous["lifecycle"].eqNullSafe(F.col("lifecycle"))
    return df.where(report.isNotNull() & ~same)


def _shape(df: DataFrame, report: F.Column, valid_to: F.Column) -> DataFrame:
    attributes = [report["attributes"].alias("attributes")] if "attributes" in df.columns else []
    return df.select("id", F.col("at").alias("valid_from"), valid_to.alias("valid_to"), F.col("lifecycle"), *attributes)


def _plain_chains(events: DataFrame) -> DataFrame:
    w = W.partitionBy("id").orderBy("at")
    report = F.col("report")
    folded = _carried(events, ["id"]).where(report.isNotNull())
    lagged = folded.withColumn("previous", F.lag(F.struct(report["digest"].alias("digest"), F.col("lifecycle").alias("lifecycle"))).over(w))
    opened = _opened(lagged, report, F.col("previous"))
    return _shape(opened, report, F.lead("at").over(w))


def _ranges(events: DataFrame, hot: DataFrame) -> DataFrame:
    """(id, cuts): instants that cut a hot entity's rows into ranges of about ``RANGE_ROWS``, at most ``MOST_RANGES``."""
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    shares = F.array(*[F.lit(k / MOST_RANGES) for k in range(1, MOST_RANGES)])
    cuts = events.join(hot, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(micros, shares, 4 * MOST_RANGES).alias("q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(MOST_RANGES) / F.ceil(F.col("n") / RANGE_ROWS))).cast("int")
    return cuts.select("id", F.filter("q", lambda _, i: (i + 1) % step == 0).alias("cuts"))


def _hot_chains(events: DataFrame, hot: DataFrame, n_hot: int) -> DataFrame:
    """Chains of hot entities, cut into ranges of time; ``hot`` has ``n_hot`` ids.

    Only the ranges' limits are ever broadcast, and only while there are few hot ids; everything else that meets by
    (id, range) is shuffled on both, so no entity is in one task and nothing grows with a broadcast.
    """
    cuts = cut(_ranges(events, hot))
    few = n_hot <= BROADCAST_HOT
    at = F.unix_micros(F.col("at").cast("timestamp"))
    ranged = events.join(F.broadcast(cuts) if few else cuts, "id").withColumn("range_no", F.size(F.filter("cuts", lambda c: c < at))).drop("cuts")
    folded = cut(_carried(ranged, ["id", "range_no"]))
    by_range = W.partitionBy("id").orderBy("range_no")  # at most MOST_RANGES rows an id
    before = by_range.rowsBetween(W.unboundedPreceding, -1)
    ends = folded.groupBy("id", "range_no").agg(
        F.max_by(F.struct("report"), F.when(F.col("report").isNotNull(), F.col("at"))).alias("last_report"), F.max_by("lifecycle", "at").alias("last_lifecycle")
    )
    seams = ends.select(
        "id", "range_no",
        F.last("last_report", ignorenulls=True).over(before).alias("in_report"),
        F.lag(F.struct("last_lifecycle")).over(by_range).alias("in_lifecycle"),
    )
    w = W.partitionBy("id", "range_no").orderBy("at")
    known = (
        folded.join(seams, ["id", "range_no"])
        .withColumn("report", F.coalesce(F.col("report"), F.col("in_report.report")))
        .withColumn("nth", F.row_number().over(w))
        .withColumn("lagged", F.lag(F.struct(F.col("report"), F.col("lifecycle"))).over(w))
    )
    inside = F.when(F.col("lagged.report").isNotNull(), F.struct(F.col("lagged.report.digest").alias("digest"), F.col("lagged.lifecycle").alias("lifecycle")))
    outside = F.when(F.col("in_report").isNotNull(), F.struct(F.col("in_report.report.digest").alias("digest"), F.col("in_lifecycle.last_lifecycle").alias("lifecycle")))
    opened = _opened(known.withColumn("previous", F.when(F.col("nth") > 1, inside).otherwise(outside)), F.col("report"), F.col("previous"))
    opened = cut(opened.drop("lagged", "in_report", "in_lifecycle", "nth"))
    after = by_range.rowsBetween(1, W.unboundedFollowing)
    nexts = opened.groupBy("id", "range_no").agg(F.min("at").alias("first_at"))
    nexts = nexts.select("id", "range_no", F.min("first_at").over(after).alias("later_at"))
    closed = opened.withColumn("valid_to", F.lead("at").over(w)).join(nexts, ["id", "range_no"])
    return _shape(closed, F.col("report"), F.coalesce("valid_to", "later_at"))


def chains_of(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All intervals of all entities that ``events`` tells of (see change_events)."""
    sizes = events.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    hot = cut(sizes.where(F.col("n") > hot_rows).select("id"))  # at most rows / hot_rows ids
    n_hot = hot.count()
    if not n_hot:
        return _plain_chains(events)
    few = F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot
    return _plain_chains(events.join(few, "id", "left_anti")).unionByName(_hot_chains(events, few, n_hot))


def build_chains(updates: DataFrame, changes: DataFrame, with_attributes: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All intervals of all entities in ``updates``: (id, valid_from, valid_to, lifecycle[, attributes]).

    ``valid_to`` is null for the version in force.
    """
    # only the two id columns are read to find hot entities, before any attribute is
    sizes = updates.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    late = changes.where(F.col("entity_id").isNotNull()).groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    hot = cut(sizes.unionByName(late).where(F.col("n") > hot_rows).select("id").distinct())  # at most rows / hot_rows ids
    events, n_hot = change_events(updates, changes, with_attributes), hot.count()
    if not n_hot:
        return _plain_chains(events)
    few = F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot
    return _plain_chains(events.join(few, "id", "left_anti")).unionByName(_hot_chains(events, few, n_hot))


def apply_batch(history: DataFrame | None, updates: DataFrame, changes: DataFrame, touched: DataFrame | None = None, with_attributes: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The history after a batch of late, corrected or new rows.

    ``updates`` and ``changes`` hold all raw rows known by now, the batch included; ``touched`` has the ids (column
    ``id``) that the batch mentions. Chains of touched entities are rebuilt from all their raw rows and take the place
    of the old ones; all others are kept as they are. Without a history every entity counts as touched.
    """
    if history is None or touched is None:
        return build_chains(updates, changes, with_attributes, hot_rows)
    touched = touched.select("id").where(F.col("id").isNotNull()).distinct()
    rebuilt = build_chains(
        updates.join(touched, "id", "left_semi"),
        changes.join(touched.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi"),
        with_attributes, hot_rows,
    )
    return history.join(touched, "id", "left_anti").select(rebuilt.columns).unionByName(rebuilt)


class StaleWrite(RuntimeError):
    """Another writer committed first; the batch has to be applied again to what that one left."""


class HistoryStore:
    """Raw changes and chains laid out by a hash of the entity, so that a batch reads and rewrites only the buckets it touches.

    Every write goes to a folder of its own. A manifest names, for each bucket, the folder with its chains, and all
    folders with raw changes; it is put in place by one rename that fails if its number is taken. A reader sees one
    manifest, so the old or the new chains and never a mixture; of two writers that began from the same manifest the
    second gets StaleWrite and has touched nothing the first one's manifest names. ``vacuum`` removes what no kept
    manifest names.

    Within a touched bucket the chains of touched entities are rebuilt from all their raw changes; the others are copied.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256, hot_rows: int = HOT_ROWS):
        self.spark, self.root, self.buckets, self.hot_rows = spark, root.rstrip("/"), buckets, hot_rows

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str = "") -> list[str]:
        fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(self._path(folder))] if fs.exists(self._path(folder)) else []

    def _buckets(self, folder: str) -> set[int]:
        return {int(n[7:]) for n in self._names(folder) if n.startswith("bucket=")}

    def versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self._names() if n.startswith("manifest-") and n.endswith(".json"))

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def _manifest(self, version: int | None) -> dict:
        if version is None:
            return {"raw": [], "chains": {}}
        stream = self._fs().open(self._path(f"manifest-{version}.json"))
        try:
            text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, version: int, manifest: dict) -> None:
        fs, draft = self._fs(), self._path(f"_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri() if self._path().toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, self._path(f"manifest-{version}.json"), how)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise StaleWrite(f"version {version} is taken") from None
            raise

    def _chains(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame | None:
        by_folder: dict[str, list[int]] = {}
        for bucket, folder in manifest["chains"].items():
            if buckets is None or int(bucket) in buckets:
                by_folder.setdefault(folder, []).append(int(bucket))
        out = None
        for folder, own in sorted(by_folder.items()):  # at most one folder a batch still in force
            part = self.spark.read.parquet(f"{self.root}/chains/{folder}").where(F.col("bucket").isin(own))
            out = part if out is None else out.unionByName(part)
        return out

    def read(self, version: int | None = None) -> DataFrame | None:
        """The history of a version, by default the newest; None if there is none."""
        version = self.version() if version is None else version
        found = self._chains(self._manifest(version))
        return None if found is None else found.drop("bucket")

    def apply(self, updates: DataFrame, changes: DataFrame) -> DataFrame:
        """Takes in a batch of raw rows (only the new ones) and returns the history after it."""
        version = self.version()
        manifest = self._manifest(version)
        raw = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        change_events(updates, changes).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/raw/{raw}")
        hit = self._buckets(f"raw/{raw}")
        if not hit:  # an empty batch
            return self.read()
        arrived = self.spark.read.parquet(f"{self.root}/raw/{raw}")
        touched = arrived.select("id").distinct()
        events = arrived
        for folder in manifest["raw"]:
            events = events.unionByName(self.spark.read.parquet(f"{self.root}/raw/{folder}").where(F.col("bucket").isin(sorted(hit))))
        rebuilt = chains_of(events.drop("bucket").join(touched, "id", "left_semi"), self.hot_rows)
        old = self._chains(manifest, hit)
        after = rebuilt if old is None else old.drop("bucket").join(touched, "id", "left_anti").select(rebuilt.columns).unionByName(rebuilt)
        folder = uuid.uuid4().hex
        after.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/chains/{folder}")
        chains = {k: v for k, v in manifest["chains"].items() if int(k) not in hit} | {str(k): folder for k in sorted(self._buckets(f"chains/{folder}"))}
        self._commit(0 if version is None else version + 1, {"raw": [*manifest["raw"], raw], "chains": chains})
        return self.read()

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the newest ``keep`` versions, and data folders none of them names. Not while a batch is applied."""
        fs, versions = self._fs(), self.versions()
        kept = [self._manifest(v) for v in versions[-keep:]]
        for v in versions[:-keep]:
            fs.delete(self._path(f"manifest-{v}.json"), False)
        for kind, used in (("raw", {f for m in kept for f in m["raw"]}), ("chains", {f for m in kept for f in m["chains"].values()})):
            for name in self._names(kind):
                if name not in used:
                    fs.delete(self._path(f"{kind}/{name}"), True)


def as_of(history: DataFrame, at: F.Column) -> DataFrame:
    """The versions in force at an instant: the start belongs to the period, the end does not."""
    return history.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
