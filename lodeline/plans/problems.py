"""The registered queries of the general problems 1, 2, 3 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.canonical import full_ref, repository_path
from lodeline.operators.hierarchy import ancestors, descendants, hierarchy
from lodeline.operators.history import HistoryStore, apply_batch
from lodeline.operators.instants import _parts, candidate_zones, estimate_zones, normalise_instants, read_fields
from lodeline.operators.snapshots import snapshot_changes
from lodeline.session import cut, scratch, table


def _micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


def _versions(history: DataFrame, *more: str) -> DataFrame:
    return history.select(
        F.col("id").alias("entity_id"), _micros("valid_from").alias("valid_from_us"), F.coalesce(_micros("valid_to"), F.lit(-1)).cast("long").alias("valid_to_us"), "lifecycle", *more
    )


def _in_two_steps(spark: SparkSession, d: str, with_attributes: bool) -> DataFrame:
    """A history of what was recorded in the first nine tenths of the time, and all later rows as one late batch."""
    updates, changes = table(spark, d, "entity_update"), table(spark, d, "lifecycle_change")
    ends = updates.agg(F.min("recorded_at").alias("a"), F.max("recorded_at").alias("b")).first()
    if ends["a"] is None:
        return apply_batch(None, updates, changes, with_attributes=with_attributes)
    from_ = F.lit(ends["b"] - (ends["b"] - ends["a"]) / 10).cast("timestamp_ntz")
    late = F.coalesce(F.col("recorded_at") >= from_, F.lit(True))
    before = apply_batch(None, updates.where(~late), changes.where(~late), with_attributes=with_attributes)
    touched = updates.where(late).select("id").unionByName(changes.where(late).select(F.col("entity_id").alias("id"))).distinct()
    return apply_batch(before, updates, changes, touched, with_attributes=with_attributes)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every entity, reached by a late batch that rebuilds the chains it touches."""
    return _versions(_in_two_steps(spark, d, with_attributes=False))


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    """The same with the attributes of each version, as the report spelt them that opened it."""
    return _versions(_in_two_steps(spark, d, with_attributes=True), "attributes")


def p1_late_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The history through the store: rows recorded before 2022, then all later ones; the chains of touched buckets are replaced."""
    updates, changes = table(spark, d, "entity_update"), table(spark, d, "lifecycle_change")
    early = F.coalesce(F.col("recorded_at") < F.lit("2022-01-01 00:00:00").cast("timestamp_ntz"), F.lit(False))
    store = HistoryStore(spark, scratch(spark, "history"), buckets=32)
    store.apply(updates.where(early), changes.where(early))
    return _versions(store.apply(updates.where(~early), changes.where(~early)), "attributes")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Paths and refs added, removed or changed between consecutive complete listings."""
    paths = snapshot_changes(table(spark, d, "tree_snapshot"), repository_path(F.col("path")), F.lower("oid"), "path")
    refs = snapshot_changes(table(spark, d, "branch_snapshot"), full_ref(F.col("ref_name")), F.lower("head_sha"), "ref")
    return paths.unionByName(refs)


def _instants(spark: SparkSession, d: str) -> DataFrame:
    jira = read_fields(table(spark, d, "jira_issue"), {c: c for c in ("created", "updated", "resolutiondate")}, ["row_id"])
    committed = F.coalesce(F.try_to_timestamp("committed_at"), F.col("acquired_at").cast("timestamp"))  # a change is written before it is committed
    commit = read_fields(table(spark, d, "commit_record"), {"authored_at": "authored_at"}, ["row_id"], committed)
    return jira.withColumn("table_name", F.lit("jira_issue")).unionByName(commit.withColumn("table_name", F.lit("commit_record")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each of the four time fields that names an instant."""
    return normalise_instants(_instants(spark, d), table(spark, d, "source_site"), ["table_name", "row_id"]).drop("zone_source")


def p3_zone_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The zones each site's zone-less texts speak for, beside the one the register declares."""
    sites = table(spark, d, "source_site")
    latest = F.col("field_name").isin("updated", "authored_at")  # the fields that lie close to their bound
    parts = _parts(_instants(spark, d).where(F.col("fields").isNotNull() & latest).join(sites.select("site_id", "date_order"), "site_id", "left"))
    found = estimate_zones(parts, candidate_zones(spark))
    return found.join(sites.select("site_id", "time_zone"), "site_id").select("site_id", "time_zone", "estimated_zone", "from_quarter", "to_quarter", "rows", "violations", "lead")


def p3_withheld(spark: SparkSession, d: str) -> DataFrame:
    """p3_found once more with all declared zones withheld: how many instants of each site come out the same."""
    blind = table(spark, d, "source_site").withColumn("time_zone", F.lit(None).cast("string"))
    keys = ["table_name", "row_id"]
    told = normalise_instants(_instants(spark, d), table(spark, d, "source_site"), [*keys, "site_id"])
    guessed = normalise_instants(_instants(spark, d), blind, keys).select(*keys, "field_name", F.col("utc_us").alias("guess"))
    both = told.where(F.col("zone_source") == "site").join(guessed, [*keys, "field_name"], "left")
    same = F.count_if(F.col("guess") == F.col("utc_us"))
    return both.groupBy("site_id").agg(F.count(F.lit(1)).alias("instants"), same.alias("same"), (same / F.count(F.lit(1))).alias("share"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of each commit in the first-parent forest of its repository."""
    return hierarchy(table(spark, d, "commit_record"), places=False).select("repo_id", "sha", "root_sha", "depth")


def p6_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """Number of descendants of each commit in a tree, handed up by the peeling."""
    tree = hierarchy(table(spark, d, "commit_record")).where(F.col("size").isNotNull())
    return tree.select("repo_id", "sha", "root_sha", "depth", (F.col("size") - 1).alias("n_descendants"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "commit_record")
    return rows.where(F.col("row_id") % 50 == 0).select("repo_id", "sha").distinct()


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """The whole path from the root of each commit that a row with an id divisible by 50 reports."""
    tree = cut(hierarchy(table(spark, d, "commit_record")))
    return ancestors(tree, _asked(spark, d))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of each commit that a row with an id divisible by 50 reports."""
    tree = cut(hierarchy(table(spark, d, "commit_record")))
    return descendants(tree, _asked(spark, d))


def p6_all_paths(spark: SparkSession, d: str) -> DataFrame:
    """The whole path from the root of every commit in a tree."""
    tree = cut(hierarchy(table(spark, d, "commit_record")))
    return ancestors(tree, tree)


def p6_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every commit in a tree."""
    tree = cut(hierarchy(table(spark, d, "commit_record")))
    return descendants(tree, tree)


QUERIES = {
    "p1_found": p1_found,
    "p1_versions": p1_versions,
    "p1_late_rebuild": p1_late_rebuild,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_zone_estimates": p3_zone_estimates,
    "p3_withheld": p3_withheld,
    "p6_found": p6_found,
    "p6_subtrees": p6_subtrees,
    "p6_paths": p6_paths,
    "p6_descendants": p6_descendants,
    "p6_all_paths": p6_all_paths,
    "p6_all_descendants": p6_all_descendants,
}

_HISTORY_SQL = """
WITH leaf AS (SELECT e.delivery_id, list_sort(list(t.fullkey || ' ' || t.type || ' ' || coalesce(t.atom::VARCHAR, ''))) AS state
              FROM entity_update e, json_tree(e.attributes) t GROUP BY 1),
ev AS (SELECT id, coalesce(source_observed_at, recorded_at) AS t_at, recorded_at, true AS rep, delivery_id AS ord, md5(state::VARCHAR) AS dg, lifecycle
       FROM entity_update JOIN leaf USING (delivery_id)
       UNION ALL
       SELECT entity_id, changed_at, recorded_at, false, change_id, NULL, CASE change_action WHEN 'retire' THEN 'deleted' ELSE 'active' END
       FROM lifecycle_change WHERE change_action IN ('retire', 'reinstate')),
st AS (SELECT id, t_at, lifecycle, last_value(dg IGNORE NULLS) OVER w AS dg, lead(t_at) OVER w2 AS nx FROM ev
       WINDOW w AS (PARTITION BY id ORDER BY t_at, recorded_at, rep, ord ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY id ORDER BY t_at, recorded_at, rep, ord)),
folded AS (SELECT * FROM st WHERE (nx IS NULL OR nx <> t_at) AND dg IS NOT NULL),
lagged AS (SELECT *, lag(dg || lifecycle) OVER (PARTITION BY id ORDER BY t_at) AS before FROM folded),
opened AS (SELECT * FROM lagged WHERE before IS DISTINCT FROM dg || lifecycle)
SELECT id AS entity_id, epoch_us(t_at) AS valid_from_us, coalesce(epoch_us(lead(t_at) OVER (PARTITION BY id ORDER BY t_at)), -1) AS valid_to_us, lifecycle FROM opened
"""
_ATTRIBUTES_SQL = (
    _HISTORY_SQL.replace("md5(state::VARCHAR) AS dg,", "md5(state::VARCHAR) AS dg, attributes,")
    .replace("change_id, NULL, CASE", "change_id, NULL, NULL, CASE")
    .replace("last_value(dg IGNORE NULLS) OVER w AS dg,", "last_value(dg IGNORE NULLS) OVER w AS dg, last_value(attributes IGNORE NULLS) OVER w AS attributes,")
    .replace("-1) AS valid_to_us, lifecycle FROM", "-1) AS valid_to_us, lifecycle, attributes FROM")
)


def _diff_sql(table_name: str, item: str, value: str, kind: str) -> str:
    return f"""
SELECT coalesce(n.repo_id, o.repo_id) AS repo_id, coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, '{kind}' AS item_type, coalesce(n.item, o.item) AS item_name,
       CASE WHEN o.item IS NULL THEN 'added' WHEN n.item IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM (SELECT i.* FROM {kind}_items i JOIN {kind}_pairs USING (repo_id, snapshot_no)) n
FULL JOIN (SELECT i.repo_id, p.snapshot_no, i.item, i.v FROM {kind}_items i JOIN {kind}_pairs p ON i.repo_id = p.repo_id AND i.snapshot_no = p.prev_no) o
  ON n.repo_id = o.repo_id AND n.snapshot_no = o.snapshot_no AND n.item = o.item
WHERE n.item IS NULL OR o.item IS NULL OR n.v <> o.v"""


def _items_sql(table_name: str, item: str, value: str, kind: str) -> str:
    return f"""{kind}_items AS (SELECT repo_id, snapshot_no::BIGINT AS snapshot_no, {item} AS item, lower({value}) AS v FROM {table_name} WHERE is_complete
  QUALIFY row_number() OVER (PARTITION BY repo_id, snapshot_no, {item} ORDER BY acquired_at DESC, entry_id DESC) = 1),
{kind}_pairs AS (SELECT repo_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo_id ORDER BY snapshot_no) AS prev_no
  FROM (SELECT DISTINCT repo_id, snapshot_no::BIGINT AS snapshot_no FROM {table_name} WHERE is_complete) QUALIFY prev_no IS NOT NULL)"""


_PATH = ("tree_snapshot", r"nfc_normalize(regexp_replace(replace(path, '\', '/'), '^(\./+)+', ''))", "oid", "path")
_REF = ("branch_snapshot", "CASE WHEN ref_name LIKE 'refs/%' THEN ref_name ELSE 'refs/heads/' || ref_name END", "head_sha", "ref")
_FOREST_SQL = """
WITH RECURSIVE one AS (SELECT repo_id, sha, parents[1] AS p FROM commit_record QUALIFY row_number() OVER (PARTITION BY repo_id, sha ORDER BY acquired_at DESC, row_id DESC) = 1),
node AS (SELECT o.repo_id, o.sha, p.sha AS parent FROM one o LEFT JOIN one p ON o.repo_id = p.repo_id AND o.p = p.sha),
tree AS (SELECT repo_id, sha, sha AS root_sha, 0::BIGINT AS depth FROM node WHERE parent IS NULL
         UNION ALL SELECT n.repo_id, n.sha, t.root_sha, t.depth + 1 FROM tree t JOIN node n ON n.repo_id = t.repo_id AND n.parent = t.sha),
rest AS (SELECT n.* FROM node n ANTI JOIN tree t ON n.repo_id = t.repo_id AND n.sha = t.sha),
walk AS (SELECT repo_id, sha, parent AS at FROM rest UNION SELECT w.repo_id, w.sha, r.parent FROM walk w JOIN rest r ON r.repo_id = w.repo_id AND r.sha = w.at)
SELECT repo_id, sha, root_sha, depth FROM tree
UNION ALL SELECT repo_id, sha, '', CASE WHEN EXISTS (SELECT 1 FROM walk w WHERE w.repo_id = r.repo_id AND w.sha = r.sha AND w.at = r.sha) THEN -1 ELSE -2 END FROM rest r
"""
_TREE_SQL = _FOREST_SQL[: _FOREST_SQL.index("rest AS")].rstrip().rstrip(",")
_ASKED_SQL = "a AS (SELECT DISTINCT repo_id, sha FROM commit_record WHERE row_id % 50 = 0)"
_ALL_SQL = "a AS (SELECT DISTINCT repo_id, sha FROM commit_record)"
_PATHS_SQL = f"""{_TREE_SQL}, {_ASKED_SQL}, up AS (SELECT t.repo_id, t.sha, t.sha AS at FROM tree t JOIN a USING (repo_id, sha)
  UNION ALL SELECT u.repo_id, u.sha, n.parent FROM up u JOIN node n ON n.repo_id = u.repo_id AND n.sha = u.at WHERE n.parent IS NOT NULL)
SELECT u.repo_id, u.sha, u.at AS ancestor_sha, t.depth AS ancestor_depth FROM up u JOIN tree t ON t.repo_id = u.repo_id AND t.sha = u.at"""
_BELOW_SQL = f"""{_TREE_SQL}, {_ASKED_SQL}, down AS (SELECT t.repo_id, t.sha, t.sha AS at FROM tree t JOIN a USING (repo_id, sha)
  UNION ALL SELECT x.repo_id, x.sha, n.sha FROM down x JOIN node n ON n.repo_id = x.repo_id AND n.parent = x.at)
SELECT x.repo_id, x.sha, x.at AS descendant_sha, t.depth AS descendant_depth FROM down x JOIN tree t ON t.repo_id = x.repo_id AND t.sha = x.at WHERE x.at <> x.sha"""
_SUBTREES_SQL = f"""{_TREE_SQL}, sub AS (SELECT repo_id, sha, sha AS at FROM tree UNION ALL SELECT s.repo_id, s.sha, n.sha FROM sub s JOIN node n ON n.repo_id = s.repo_id AND n.parent = s.at)
SELECT repo_id, sha, root_sha, depth, count(*) - 1 AS n_descendants FROM tree JOIN sub USING (repo_id, sha) GROUP BY ALL"""

ORACLE = {
    "p1_found": _HISTORY_SQL,
    "p1_versions": _ATTRIBUTES_SQL,
    "p1_late_rebuild": _ATTRIBUTES_SQL,
    "p2_found": f"WITH {_items_sql(*_PATH)}, {_items_sql(*_REF)} {_diff_sql(*_PATH)} UNION ALL {_diff_sql(*_REF)}",
    "p6_found": _FOREST_SQL,
    "p6_paths": _PATHS_SQL,
    "p6_descendants": _BELOW_SQL,
    "p6_subtrees": _SUBTREES_SQL,
    "p6_all_paths": _PATHS_SQL.replace(_ASKED_SQL, _ALL_SQL),
    "p6_all_descendants": _BELOW_SQL.replace(_ASKED_SQL, _ALL_SQL),
}
