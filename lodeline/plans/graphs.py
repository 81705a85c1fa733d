"""Registered queries: evidence ledger, edges in time, graph walks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.operators import graph as G
from lodeline.operators import intervals as V
from lodeline.operators import ledger as L
from lodeline.operators import retrieval as R
from lodeline.plans.frames import EDGES, ENTITY, EVIDENCE, edges, entity, evidence, newest, registrar
from lodeline.session import table

QUERIES, ORACLE, query = registrar()


def us(col):
    return F.unix_micros(F.col(col).cast("timestamp"))


# ------------------------------------------------------------------ the ledger
_AUTH = "CASE WHEN authority = 0 THEN 30 ELSE authority END"
_SUP = f"sup AS (SELECT *, coalesce(observed_at < max(observed_at) OVER (PARTITION BY subject_id, field_name, source_system), false) AS superseded, {_AUTH} AS auth, coalesce(confidence, -1) AS conf FROM evidence)"
_CONFLICTS = "SELECT subject_id, field_name, count(DISTINCT statement) AS statements, count(DISTINCT source_system) AS systems FROM {} GROUP BY 1, 2 HAVING statements > 1 AND systems > 1"


@query(f"WITH {EVIDENCE}, {_SUP} SELECT evidence_id, superseded FROM sup")
def superseded_evidence(spark, d):
    return L.superseded(evidence(spark, d)).select("evidence_id", "superseded")


@query(f"""WITH {EVIDENCE}, {_SUP}, r AS (SELECT *, row_number() OVER w AS nth, lead(statement) OVER w AS s2, lead((superseded, auth, conf, coalesce(observed_at::VARCHAR, ''))) OVER w AS k2
FROM sup WINDOW w AS (PARTITION BY subject_id, field_name ORDER BY superseded, auth DESC, conf DESC, observed_at DESC NULLS LAST, evidence_id))
SELECT subject_id, field_name, evidence_id FROM r WHERE nth = 1 AND NOT coalesce(k2 = (superseded, auth, conf, coalesce(observed_at::VARCHAR, '')) AND s2 <> statement, false)""")
def preferred_evidence(spark, d):
    return L.preferred(evidence(spark, d)).select("subject_id", "field_name", "evidence_id")


@query(f"WITH {EVIDENCE} " + _CONFLICTS.format("evidence"))
def detect_conflicts(spark, d):
    return L.conflicts(evidence(spark, d))


@query(f"""WITH {EVIDENCE}, c AS (SELECT *, lead(evidence_id) OVER (PARTITION BY subject_id, field_name, source_system ORDER BY recorded_at, evidence_id) AS superseded_by FROM evidence),
k AS ({_CONFLICTS.format("c WHERE superseded_by IS NULL")})
SELECT evidence_id, CASE WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN EXISTS (SELECT 1 FROM k WHERE k.subject_id = c.subject_id AND k.field_name IS NOT DISTINCT FROM c.field_name) THEN 'conflicting' ELSE 'current' END AS state, superseded_by FROM c""")
def evidence_state(spark, d):
    return L.write_states(evidence(spark, d))


@query(f"""WITH {EVIDENCE}, b AS (SELECT *, {_AUTH} AS auth, CASE evidence_state WHEN 'current' THEN 0 WHEN 'conflicting' THEN 10 WHEN 'stale' THEN 20 WHEN 'superseded' THEN 30 WHEN 'unavailable' THEN 40 ELSE 50 END AS bel, coalesce(confidence, -1) AS conf,
max((evidence_state = 'current')::INT) OVER (PARTITION BY subject_id, field_name) = 1 AS has_current FROM evidence),
f AS (SELECT *, row_number() OVER (PARTITION BY subject_id, field_name ORDER BY bel, auth DESC, conf DESC, observed_at DESC NULLS LAST, evidence_id) AS in_field FROM b WHERE NOT has_current OR evidence_state = 'current')
SELECT subject_id, evidence_id, row_number() OVER (PARTITION BY subject_id ORDER BY in_field > 2, bel, auth DESC, conf DESC, observed_at DESC NULLS LAST, evidence_id) AS rank FROM f QUALIFY rank <= 6""")
def select_evidence(spark, d):
    return L.select(evidence(spark, d), 6).select("subject_id", "evidence_id", "rank")


@query(f"WITH {EVIDENCE} SELECT subject_id, field_name FROM ({_CONFLICTS.format('evidence WHERE evidence_state IN (' + chr(39) + 'current' + chr(39) + ', ' + chr(39) + 'conflicting' + chr(39) + ')')}) UNION SELECT subject_id, field_name FROM evidence WHERE evidence_state = 'conflicting'")
def disputed_fields(spark, d):
    rows = evidence(spark, d)
    believed = L.conflicts(rows.where(F.col("evidence_state").isin("current", "conflicting"))).select("subject_id", "field_name")
    return believed.unionByName(rows.where(F.col("evidence_state") == "conflicting").select("subject_id", "field_name")).distinct()


@query(f"WITH {EVIDENCE} SELECT subject_id, CASE WHEN count(*) = count(confidence) THEN min(confidence) END AS confidence FROM evidence GROUP BY 1")
def derived_confidence(spark, d):
    return L.weakest(evidence(spark, d), ["subject_id"])


@query(f"WITH {EVIDENCE} SELECT subject_id, round(CASE WHEN max(confidence) >= 1 THEN 1.0 ELSE 1 - exp(coalesce(sum(ln(1 - confidence)) FILTER (confidence < 1), 0)) END, 6) AS score FROM evidence WHERE confidence IS NOT NULL GROUP BY 1")
def noisy_or(spark, d):
    return L.noisy_or(evidence(spark, d).where(F.col("confidence").isNotNull()), ["subject_id"], "confidence").select("subject_id", F.round("score", 6).alias("score"))


@query(f"WITH {EVIDENCE} SELECT evidence_id, {_AUTH}::INT AS effective FROM evidence")
def effective_authority(spark, d):
    return evidence(spark, d).select("evidence_id", L.effective_authority(F.col("authority")).cast("int").alias("effective"))


@query(f"WITH {EVIDENCE} SELECT locator->>'$.path' AS path, permission_scope AS scope, count(*) AS statements FROM evidence WHERE locator->>'$.path' IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2")
def anchor_groups(spark, d):
    rows = evidence(spark, d).select(F.get_json_object("locator", "$.path").alias("path"), F.col("permission_scope").alias("scope")).where(F.col("path").isNotNull())
    return rows.groupBy("path", "scope").agg(F.count(F.lit(1)).alias("statements")).where(F.col("statements") >= 2)


@query(f"WITH {EVIDENCE} SELECT subject_id, count(*) AS statements, count(DISTINCT source_system) AS systems FROM evidence GROUP BY 1 HAVING count(*) >= 2")
def subject_groups(spark, d):
    rows = evidence(spark, d).groupBy("subject_id").agg(F.count(F.lit(1)).alias("statements"), F.count_distinct("source_system").alias("systems"))
    return rows.where(F.col("statements") >= 2)


@query(f"WITH {EVIDENCE} SELECT e.id, ev.evidence_id, e.kind FROM evidence ev JOIN (WITH {ENTITY} SELECT * FROM entity) e ON e.id = ev.subject_id WHERE contains(lower(ev.statement), 'webhook')")
def search_evidence(spark, d):
    hits = evidence(spark, d).where(F.lower("statement").contains("webhook")).select(F.col("subject_id").alias("id"), "evidence_id")
    return hits.join(entity(spark, d).select("id", "kind"), "id").select("id", "evidence_id", "kind")


# ------------------------------------------------------------------ edges in time
_STATE = "st AS (SELECT user_id::VARCHAR AS from_id, event_type AS to_id, ts AS valid_from, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)"


def _states(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("from_id"), F.col("event_type").alias("to_id"), F.col("ts").alias("valid_from"), "event_id")
    last = newest(rows, ["from_id", "valid_from"], [F.col("event_id")], ["to_id"])
    return last.withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))


@query(f"WITH {_STATE} SELECT from_id, to_id, epoch_us(valid_from) AS from_us, epoch_us(lead(valid_from) OVER (PARTITION BY from_id ORDER BY valid_from)) AS to_us FROM st")
def exclusive_intervals(spark, d):
    return V.exclusive(_states(spark, d), ["from_id"]).select("from_id", "to_id", us("valid_from").alias("from_us"), us("valid_to").alias("to_us"))


@query(f"""WITH {_STATE}, c AS (SELECT *, lag(to_id) OVER (PARTITION BY from_id ORDER BY valid_from) AS p FROM st), k AS (SELECT * FROM c WHERE p IS NULL OR p <> to_id)
SELECT from_id, to_id, epoch_us(valid_from) AS from_us, epoch_us(lead(valid_from) OVER (PARTITION BY from_id ORDER BY valid_from)) AS to_us FROM k""")
def coalesce_edges(spark, d):
    runs = V.coalesce_runs(_states(spark, d), ["from_id"], ["valid_from"])
    return V.exclusive(runs, ["from_id"]).select("from_id", "to_id", us("valid_from").alias("from_us"), us("valid_to").alias("to_us"))


@query("""SELECT entity_id, change_action, epoch_us(changed_at) AS at_us FROM lifecycle_change QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY changed_at DESC, change_action = 'reinstate', change_id DESC) = 1""")
def newest_change(spark, d):
    rows = table(spark, d, "lifecycle_change")
    order = [F.col("changed_at").desc(), (F.col("change_action") == "reinstate"), F.col("change_id").desc()]
    return G.first_of(rows, ["entity_id"], order).select("entity_id", "change_action", us("changed_at").alias("at_us"))


@query(f"""WITH {ENTITY}, n AS (SELECT * FROM lifecycle_change QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY changed_at DESC, change_action = 'reinstate', change_id DESC) = 1)
SELECT e.id, n.change_action FROM entity e JOIN n ON n.entity_id = e.id WHERE n.changed_at > e.observed_at AND e.lifecycle <> CASE n.change_action WHEN 'retire' THEN 'deleted' ELSE 'active' END""")
def pending_lifecycle(spark, d):
    rows = table(spark, d, "lifecycle_change")
    order = [F.col("changed_at").desc(), (F.col("change_action") == "reinstate"), F.col("change_id").desc()]
    change = G.first_of(rows, ["entity_id"], order).select(F.col("entity_id").alias("id"), "change_action", "changed_at")
    want = F.when(F.col("change_action") == "retire", "deleted").otherwise("active")
    both = entity(spark, d).select("id", "lifecycle", "observed_at").join(change, "id")
    return both.where((F.col("changed_at") > F.col("observed_at")) & (F.col("lifecycle") != want)).select("id", "change_action")


_AT = "1998-06-01 00:00:00"


@query(f"WITH {EDGES} SELECT type, count(*) AS n, count(DISTINCT from_id) AS sources FROM edges WHERE valid_from <= TIMESTAMP '{_AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_AT}') GROUP BY 1")
def neighbours_as_of(spark, d):
    rows = edges(spark, d).where(V.holds_at(F.lit(_AT).cast("timestamp_ntz")))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("from_id").alias("sources"))


@query(f"WITH {EDGES} SELECT n_nationkey AS nation, other_id, type, direction FROM (SELECT from_id AS id, to_id AS other_id, type, 'out' AS direction, valid_to FROM edges UNION ALL SELECT to_id, from_id, type, 'in', valid_to FROM edges) x JOIN nation ON x.id = 'nation:' || n_nationkey WHERE valid_to IS NULL")
def neighbours(spark, d):
    wanted = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    found = G.neighbours(edges(spark, d), wanted)
    return found.join(F.broadcast(wanted), "id").select(F.col("n_nationkey").alias("nation"), "other_id", "type", "direction")


@query(f"WITH {EDGES}, o AS (SELECT 'customer:' || min(c_custkey) AS id FROM customer GROUP BY c_nationkey) SELECT o.id, e.to_id AS other_id, e.type FROM o JOIN edges e ON e.from_id = o.id")
def neighbours_out(spark, d):
    wanted = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("k")).select(F.concat(F.lit("customer:"), F.col("k").cast("string")).alias("id"))
    return edges(spark, d).withColumnRenamed("from_id", "id").join(wanted, "id").select("id", F.col("to_id").alias("other_id"), "type")


@query(f"WITH {EDGES} SELECT to_id AS id, type, count(*) AS n FROM edges WHERE valid_to IS NULL GROUP BY 1, 2")
def neighbours_in(spark, d):
    return edges(spark, d).where(F.col("valid_to").isNull()).groupBy(F.col("to_id").alias("id"), "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EDGES}, s AS (SELECT DISTINCT from_id AS id, to_id AS other FROM edges WHERE type IN ('nation_in_region', 'customer_in_nation') UNION SELECT to_id, from_id FROM edges WHERE type IN ('nation_in_region', 'customer_in_nation')),
o AS (SELECT 'region:' || r_regionkey AS id FROM region),
h1 AS (SELECT DISTINCT o.id AS origin, s.other AS id FROM o JOIN s USING (id)), h2 AS (SELECT DISTINCT origin, s.other AS id FROM h1 JOIN s USING (id) EXCEPT (SELECT origin, id FROM h1 UNION SELECT id, id FROM o))
SELECT origin, id, 1 AS depth FROM h1 UNION ALL SELECT origin, id, 2 FROM h2""")
def traverse(spark, d):
    kept = edges(spark, d).where(F.col("type").isin("nation_in_region", "customer_in_nation"))
    origins = table(spark, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"))
    return G.traverse(G.both_ways(kept), origins, 2)


_SITE_LINKS = "l AS (SELECT DISTINCT repo_id || ' ' || sha AS id, repo_id || ' ' || unnest(parents) AS other FROM commit_record)"
_HOPS = "w AS (SELECT id AS origin, id, 0 AS depth FROM o UNION SELECT w.origin, {to}, w.depth + 1 FROM w JOIN l ON {at} = w.id WHERE w.depth < 10) SELECT origin, id, min(depth)::INT AS depth FROM w WHERE id <> origin GROUP BY 1, 2"


def _commit_links(spark, d):
    rows = table(spark, d, "commit_record")
    links = rows.select("repo_id", "sha", F.explode("parents").alias("p"))
    return links.select(F.concat_ws(" ", "repo_id", "sha").alias("id"), F.concat_ws(" ", "repo_id", "p").alias("other_id")).distinct()


def _commit_ends(spark, d, pick):
    ends = table(spark, d, "commit_record").groupBy("repo_id").agg(pick("sha").alias("sha"))
    return ends.select(F.concat_ws(" ", "repo_id", "sha").alias("id"))


@query(f"WITH RECURSIVE {_SITE_LINKS}, o AS (SELECT repo_id || ' ' || max(sha) AS id FROM commit_record GROUP BY repo_id), {_HOPS.format(to='l.other', at='l.id')}")
def provenance(spark, d):
    """Everything the last commit of each repository derives from, within ten hops."""
    return G.closure(_commit_links(spark, d), _commit_ends(spark, d, F.max))


@query(f"WITH RECURSIVE {_SITE_LINKS}, o AS (SELECT repo_id || ' ' || min(sha) AS id FROM commit_record GROUP BY repo_id), {_HOPS.format(to='l.id', at='l.other')}")
def dependents(spark, d):
    """Everything that derives from the first commit of each repository, within ten hops."""
    links = _commit_links(spark, d).select(F.col("other_id").alias("id"), F.col("id").alias("other_id"))
    return G.closure(links, _commit_ends(spark, d, F.min))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT author_email AS a, repo_id AS b FROM commit_record WHERE author_email IS NOT NULL), n AS (SELECT a AS id FROM e UNION SELECT b FROM e),
s AS (SELECT a AS id, b AS o FROM e UNION SELECT b, a FROM e), w AS (SELECT id, id AS r FROM n UNION SELECT w.id, s.o FROM w JOIN s ON s.id = w.r) SELECT id, min(r) AS component FROM w GROUP BY id""")
def equivalence_clusters(spark, d):
    rows = table(spark, d, "commit_record").where(F.col("author_email").isNotNull()).select(F.col("author_email").alias("id"), F.col("repo_id").alias("other_id")).distinct()
    return G.components(rows)


@query("""WITH b AS (SELECT *, dense_rank() OVER (PARTITION BY repo_id ORDER BY snapshot_no DESC) AS k FROM branch_snapshot WHERE is_complete)
SELECT o.repo_id, o.ref_name FROM (SELECT DISTINCT repo_id, ref_name FROM b WHERE k = 2) o ANTI JOIN (SELECT DISTINCT repo_id, ref_name FROM b WHERE k = 1) n ON o.repo_id = n.repo_id AND o.ref_name = n.ref_name""")
def retire_vanished(spark, d):
    rows = table(spark, d, "branch_snapshot").where(F.col("is_complete"))
    numbers = rows.select("repo_id", "snapshot_no").distinct().withColumn("k", F.row_number().over(W.partitionBy("repo_id").orderBy(F.col("snapshot_no").desc())))
    placed = rows.join(numbers.where(F.col("k") <= 2), ["repo_id", "snapshot_no"]).select("repo_id", "ref_name", "k").distinct()
    return placed.where("k = 2").drop("k").join(placed.where("k = 1").drop("k"), ["repo_id", "ref_name"], "left_anti")


@query("""SELECT repo_id, path, CASE count(DISTINCT taken) WHEN 1 THEN min(state) ELSE 'kept' END AS outcome FROM (
SELECT repo_id, path, taken, CASE taken WHEN 'a' THEN 'tombstone' ELSE 'new' END AS state FROM (SELECT DISTINCT repo_id, path, CASE WHEN snapshot_no = mx THEN 'b' ELSE 'a' END AS taken
 FROM (SELECT *, max(snapshot_no) OVER (PARTITION BY repo_id) AS mx FROM tree_snapshot WHERE is_complete))) GROUP BY 1, 2""")
def symbol_reconcile(spark, d):
    rows = table(spark, d, "tree_snapshot").where(F.col("is_complete")).select("repo_id", "path", "snapshot_no").where(F.col("path").isNotNull())
    last = rows.groupBy("repo_id").agg(F.max("snapshot_no").alias("mx"))
    flags = rows.join(last, "repo_id").groupBy("repo_id", "path").agg(F.max(F.col("snapshot_no") == F.col("mx")).alias("now"), F.max(F.col("snapshot_no") < F.col("mx")).alias("before"))
    outcome = F.when(F.col("now") & F.col("before"), "kept").when(F.col("now"), "new").otherwise("tombstone")
    return flags.select("repo_id", "path", outcome.alias("outcome"))


