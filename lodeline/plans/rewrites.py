"""Registered queries: merges, retention, symbols, outlines, sessions, streams, sources."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.functions import text as X
from lodeline.functions.canonical import full_ref
from lodeline.operators import evaluation as M
from lodeline.operators import graph as G
from lodeline.operators import ledger as L
from lodeline.operators import merge as U
from lodeline.operators import symbols as Y
from lodeline.plans.frames import ENTITY, EVIDENCE, entity, evidence, newest, registrar
from lodeline.session import table
from lodeline.streaming import events as E

QUERIES, ORACLE, query = registrar()


CUT = "2022-01-01 00:00:00"
_STATE = "(SELECT id, kind, content_hash FROM entity_update WHERE recorded_at {} TIMESTAMP '2022-01-01' QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC, delivery_id DESC) = 1)"


def _halves(spark, d, name, key):
    rows = table(spark, d, name)
    early = F.col("recorded_at") < F.lit(CUT).cast("timestamp_ntz")
    order = [F.col("recorded_at"), F.col("delivery_id" if name == "entity_update" else "row_id")]
    keep = ["kind", "content_hash"] if name == "entity_update" else ["subject_id", "statement"]
    return newest(rows.where(early), [key], order, keep), newest(rows.where(~early), [key], order, keep)


@query(f"""SELECT CASE WHEN a.id IS NULL THEN 'created' WHEN b.id IS NULL THEN 'kept' WHEN a.content_hash = b.content_hash THEN 'unchanged' ELSE 'updated' END AS outcome, count(*) AS n
FROM {_STATE.format('<')} a FULL JOIN {_STATE.format('>=')} b ON a.id = b.id GROUP BY 1""")
def upsert_outcomes(spark, d):
    before, after = _halves(spark, d, "entity_update", "id")
    return U.upsert(before, after, ["id"], "content_hash").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_EV = "(SELECT evidence_id, subject_id, statement FROM evidence_record WHERE recorded_at {} TIMESTAMP '2022-01-01' QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY recorded_at DESC, row_id DESC) = 1)"


@query(f"""SELECT b.evidence_id, CASE WHEN NOT EXISTS (SELECT 1 FROM lifecycle_change c WHERE c.entity_id = b.subject_id) THEN 'orphaned' WHEN a.evidence_id IS NULL THEN 'written' WHEN a.statement = b.statement THEN 'unchanged' ELSE 'conflicting' END AS verdict
FROM {_EV.format('>=')} b LEFT JOIN {_EV.format('<')} a ON a.evidence_id = b.evidence_id""")
def import_classify(spark, d):
    stored, incoming = _halves(spark, d, "evidence_record", "evidence_id")
    homes = table(spark, d, "lifecycle_change").select(F.col("entity_id").alias("subject_id"))
    return U.classify_import(stored, incoming, "evidence_id", "statement", homes, "subject_id")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, min({k})::BIGINT AS first_key, max({k})::BIGINT AS last_key FROM {t}" for t, k in (("entity_update", "delivery_id"), ("evidence_record", "row_id"), ("commit_record", "row_id"), ("documents", "doc_id"))))
def export_counts(spark, d):
    out = None
    for name, key in (("entity_update", "delivery_id"), ("evidence_record", "row_id"), ("commit_record", "row_id"), ("documents", "doc_id")):
        part = table(spark, d, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.min(key).cast("long").alias("first_key"), F.max(key).cast("long").alias("last_key"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT DISTINCT oid FROM source_file f WHERE oid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tree_snapshot t WHERE lower(t.oid) = lower(f.oid))")
def prune_blobs(spark, d):
    blobs = table(spark, d, "source_file").where(F.col("oid").isNotNull()).select("oid", F.lower("oid").alias("k")).distinct()
    return U.unreferenced(blobs, "k", table(spark, d, "tree_snapshot").select(F.lower("oid").alias("k"))).select("oid")


@query(f"""WITH {EVIDENCE} SELECT evidence_id FROM evidence e WHERE evidence_state = 'superseded' AND recorded_at < TIMESTAMP '2023-01-01'
AND NOT EXISTS (SELECT 1 FROM evidence x WHERE x.evidence_state = 'current' AND x.subject_id = e.subject_id)""")
def prune_evidence(spark, d):
    rows = evidence(spark, d)
    old = (F.col("evidence_state") == "superseded") & (F.col("recorded_at") < F.lit("2023-01-01 00:00:00").cast("timestamp_ntz"))
    return U.unreferenced(rows, "subject_id", rows.where(F.col("evidence_state") == "current"), old).select("evidence_id")


@query("SELECT user_id, event_id, epoch_us(ts) AS at_us FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_checkpoint(spark, d):
    last = newest(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], ["event_id", "ts"])
    return last.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


@query("SELECT site_id, issue_id, status FROM jira_issue QUALIFY row_number() OVER (PARTITION BY site_id, issue_id ORDER BY acquired_at DESC, row_id DESC) = 1")
def latest_status(spark, d):
    return newest(table(spark, d, "jira_issue"), ["site_id", "issue_id"], [F.col("acquired_at"), F.col("row_id")], ["status"])


_DECL = r"""decl AS (SELECT file_id, repo_id, path, g.i - 1 AS nth, string_split(regexp_replace(heads[g.i], '[ \t]+', ' ', 'g'), ' ') AS w, heads[g.i] AS head FROM
(SELECT file_id, repo_id, path, regexp_extract_all(text_content, '(?m)^[ \t]*((?:export[ \t]+)?(?:async[ \t]+)?(?:function|class|interface|enum|type|const|def)[ \t]+[A-Za-z_$][A-Za-z0-9_$]*)', 1) AS heads FROM source_file WHERE text_content IS NOT NULL) f, unnest(generate_series(1, len(heads))) AS g(i)),
sym AS (SELECT file_id, repo_id, path, nth, w[-2] AS kind, w[-1] AS name, starts_with(head, 'export') AS exported FROM decl)"""


@query(f"WITH {_DECL} SELECT file_id, nth::INT AS nth, kind, name, exported FROM sym WHERE starts_with(name, 'load')")
def find_symbols(spark, d):
    return Y.declarations(table(spark, d, "source_file")).where(F.col("name").startswith("load")).select("file_id", "nth", "kind", "name", "exported")


@query(f"WITH {_DECL} SELECT file_id, name, nth::INT AS nth, (row_number() OVER (PARTITION BY file_id, name ORDER BY nth) - 1)::INT AS overload FROM sym")
def symbol_overload(spark, d):
    return Y.overloads(Y.declarations(table(spark, d, "source_file"))).select("file_id", "name", "nth", F.col("overload").cast("int").alias("overload"))


@query(rf"""WITH {_DECL}, r AS (SELECT DISTINCT file_id, repo_id, unnest(regexp_extract_all(text_content, '(?m)^import \{{ ([A-Za-z0-9_$]+) \}}', 1)) AS name FROM source_file WHERE text_content IS NOT NULL),
u AS (SELECT repo_id, name, min(file_id) AS only_file FROM sym GROUP BY 1, 2 HAVING count(DISTINCT file_id) = 1), l AS (SELECT DISTINCT file_id, name FROM sym)
SELECT r.file_id, r.name, CASE WHEN l.file_id IS NOT NULL THEN r.file_id ELSE only_file END AS target_file, CASE WHEN l.file_id IS NOT NULL THEN 'local' WHEN only_file IS NOT NULL THEN 'unique' ELSE 'unresolved' END AS how
FROM r LEFT JOIN l ON l.file_id = r.file_id AND l.name = r.name LEFT JOIN u ON u.repo_id = r.repo_id AND u.name = r.name""")
def resolve_references(spark, d):
    files = table(spark, d, "source_file").where(F.col("text_content").isNotNull())
    refs = files.select("file_id", "repo_id", F.explode(F.regexp_extract_all("text_content", F.lit(r"(?m)^import \{ ([A-Za-z0-9_$]+) \}"), F.lit(1))).alias("name")).distinct()
    return Y.resolve(refs, Y.declarations(files))


@query("""WITH RECURSIVE c AS (SELECT source, doc_id, coalesce(n_chars, 0) AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL),
f AS (SELECT source, 0::BIGINT AS k, 0::BIGINT AS used, NULL::BIGINT AS doc_id FROM (SELECT DISTINCT source FROM c) UNION ALL
 SELECT f.source, c.k, CASE WHEN f.used + c.cost <= 4000 THEN f.used + c.cost ELSE f.used END, CASE WHEN f.used + c.cost <= 4000 THEN c.doc_id END FROM f JOIN c ON c.source = f.source AND c.k = f.k + 1)
SELECT source, doc_id FROM f WHERE doc_id IS NOT NULL""")
def budget_admit(spark, d):
    rows = table(spark, d, "documents").where(F.col("source").isNotNull()).select("source", "doc_id", F.coalesce("n_chars", F.lit(0)).alias("cost"))
    return M.admit(rows, ["source"], "doc_id", "cost", 4000)


@query("""WITH i AS (SELECT site_id || ' ' || issue_key AS id, 'issue' AS kind, true AS known FROM jira_issue), p AS (SELECT site_id || ' ' || project_key AS id, 'project' AS kind, false AS known FROM jira_issue), r AS (SELECT reporter AS id, 'actor' AS kind, false AS known FROM jira_issue WHERE reporter IS NOT NULL)
SELECT id, kind, bool_or(known) AS known, count(*) AS mentions FROM (SELECT * FROM i UNION ALL SELECT * FROM p UNION ALL SELECT * FROM r) GROUP BY 1, 2""")
def model_project(spark, d):
    j = table(spark, d, "jira_issue")
    parts = j.select(F.concat_ws(" ", "site_id", "issue_key").alias("id"), F.lit("issue").alias("kind"), F.lit(True).alias("known"))
    parts = parts.unionByName(j.select(F.concat_ws(" ", "site_id", "project_key").alias("id"), F.lit("project").alias("kind"), F.lit(False).alias("known")))
    parts = parts.unionByName(j.where(F.col("reporter").isNotNull()).select(F.col("reporter").alias("id"), F.lit("actor").alias("kind"), F.lit(False).alias("known")))
    return parts.groupBy("id", "kind").agg(F.bool_or("known").alias("known"), F.count(F.lit(1)).alias("mentions"))


_RELEASE_SQL = """WITH RECURSIVE l AS (SELECT DISTINCT repo_id, sha AS id, unnest(parents) AS other FROM commit_record),
h AS (SELECT repo_id, arg_max(sha, (acquired_at, row_id)) AS head FROM commit_record GROUP BY 1),
b AS (SELECT *, CASE WHEN ref_name LIKE 'refs/%' THEN ref_name ELSE 'refs/heads/' || ref_name END AS tag FROM branch_snapshot WHERE head_sha IS NOT NULL),
t AS (SELECT repo_id, tag, min(taken_at) AS since, arg_max(lower(head_sha), (acquired_at, entry_id)) AS previous FROM b WHERE tag LIKE 'refs/tags/%' GROUP BY 1, 2),
p AS (SELECT t.repo_id, t.previous FROM t JOIN h USING (repo_id) WHERE previous <> head
 QUALIFY row_number() OVER (PARTITION BY t.repo_id ORDER BY since DESC, list_transform(regexp_extract_all(tag, '\\d+'), lambda n: TRY_CAST(n AS BIGINT)) DESC, tag DESC) = 1),
w AS (SELECT repo_id, 'h' AS side, head AS id FROM h UNION SELECT repo_id, 'p', previous FROM p UNION SELECT w.repo_id, w.side, l.other FROM w JOIN l ON l.repo_id = w.repo_id AND l.id = w.id)
SELECT w.repo_id || ' ' || h.head AS origin, w.repo_id || ' ' || w.id AS id, EXISTS (SELECT 1 FROM commit_record c WHERE c.repo_id = w.repo_id AND c.sha = w.id) AS resolved
FROM w JOIN h USING (repo_id) WHERE side = 'h' AND NOT EXISTS (SELECT 1 FROM w x WHERE x.side = 'p' AND x.repo_id = w.repo_id AND x.id = w.id)"""


@query(_RELEASE_SQL)
def release_commits(spark, d):
    """What each repository's newest commit reaches and its newest release before does not."""
    rows = table(spark, d, "commit_record").where(F.col("repo_id").isNotNull() & F.col("sha").isNotNull())
    parents = rows.groupBy("repo_id", F.col("sha").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list("parents"))).alias("parents"))
    heads = rows.groupBy("repo_id").agg(F.max_by("sha", F.struct("acquired_at", "row_id")).alias("head"))
    tags = table(spark, d, "branch_snapshot").where(full_ref(F.col("ref_name")).startswith("refs/tags/") & F.col("head_sha").isNotNull())
    tags = tags.groupBy("repo_id", full_ref(F.col("ref_name")).alias("tag")).agg(F.min("taken_at").alias("since"), F.max_by(F.lower("head_sha"), F.struct("acquired_at", "entry_id")).alias("previous"))
    number = F.transform(F.regexp_extract_all("tag", F.lit(r"(\d+)"), F.lit(1)), lambda n: n.try_cast("long"))
    before = tags.join(heads, "repo_id").where(F.col("previous") != F.col("head")).groupBy("repo_id").agg(F.max_by("previous", F.struct("since", number, "tag")).alias("previous"))
    found = G.ancestor_difference(parents, heads.join(before, "repo_id", "left"))
    return found.select(F.concat_ws(" ", "repo_id", "head").alias("origin"), F.concat_ws(" ", "repo_id", "id").alias("id"), "resolved")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY 1, 2")
def event_dedup(spark, d):
    return E.dedup_deliveries(table(spark, d, "events"), ["user_id", "event_type", "ts"]).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT user_id, ts, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 3600000000)::INT, 1) AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS started_us, count(*) AS n FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, d):
    return E.debounce(table(spark, d, "events"), "user_id", "1 hour").select("user_id", F.unix_micros("started").alias("started_us"), "n")
