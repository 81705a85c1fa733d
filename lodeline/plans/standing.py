"""Registered queries: durable contexts, packs and answers, symbols, releases, benchmarks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.functions import text as X
from lodeline.operators import contexts as C
from lodeline.operators import evaluation as M
from lodeline.operators import ledger as L
from lodeline.operators import retrieval as R
from lodeline.operators import search as S
from lodeline.operators import symbols as Y
from lodeline.plans.frames import ENTITY, EVIDENCE, entity, evidence, newest, registrar
from lodeline.plans.texts import _ENTITY_TEXT, _R, _WORDS_SQL, LINE, _entity_text, _post, _rounded
from lodeline.session import table

QUERIES, ORACLE, query = registrar()

# ------------------------------------------------------------------ durable contexts: decisions stated in issues
_NORMAL = r"regexp_replace(trim(regexp_replace(regexp_replace(lower(summary), '[,;:](\s|$)', '\1', 'g'), '\s+', ' ', 'g')), '[.!?;:,]+$', '')"
_STATED = rf"""said AS (SELECT 'decision' AS kind, project_key AS subject_id, site_id AS scope, {_NORMAL} AS normal, CASE WHEN status IN ('Done', 'Closed') THEN 'archived' WHEN status = 'To Do' THEN 'candidate' ELSE 'active' END AS lifecycle, acquired_at AS recorded_at, row_id AS row_key, priority FROM jira_issue WHERE starts_with(lower(summary), 'we decided')),
keyed AS (SELECT sha256('{{"contextKind":"' || kind || '","normalized":' || to_json(normal) || ',"subjectId":"' || subject_id || '"}}') AS id, * FROM said),
ctx AS (SELECT id, arg_max(kind, (recorded_at, row_key)) AS kind, arg_max(subject_id, (recorded_at, row_key)) AS subject_id, arg_max(scope, (recorded_at, row_key)) AS scope, arg_max(normal, (recorded_at, row_key)) AS normal, arg_max(lifecycle, (recorded_at, row_key)) AS lifecycle, count(*) AS reports, max(recorded_at) AS last_at FROM keyed GROUP BY id),
bag AS (SELECT *, list_sort(list_distinct(regexp_extract_all(normal, '[\p{{L}}\p{{N}}]+'))) AS w FROM ctx)"""


def _said(spark, d):
    rows = table(spark, d, "jira_issue").where(F.lower("summary").startswith("we decided"))
    state = F.when(F.col("status").isin("Done", "Closed"), "archived").when(F.col("status") == "To Do", "candidate").otherwise("active")
    return rows.select(
        F.lit("decision").alias("kind"), F.col("project_key").alias("subject_id"), F.col("site_id").alias("scope"), X.normalise_statement(F.col("summary")).alias("normal"), state.alias("lifecycle"), F.col("acquired_at").alias("recorded_at"), F.col("row_id").alias("row_key"), "priority"
    )


def _contexts(spark, d):
    return C.merged(_said(spark, d))


@query(f"WITH {_STATED} SELECT id, subject_id, lifecycle, reports FROM ctx")
def context_merge(spark, d):
    return _contexts(spark, d).select("id", "subject_id", "lifecycle", "reports")


@query(f"WITH {_STATED} SELECT id, scope, kind, row_number() OVER (ORDER BY last_at DESC, id) AS rank FROM ctx WHERE lifecycle = 'active' ORDER BY rank LIMIT 200")
def context_current(spark, d):
    """Active contexts of any scope, kind and subject, the latest first, a page of two hundred."""
    page = _contexts(spark, d).where(F.col("lifecycle") == "active").orderBy(F.desc("last_at"), "id").limit(200)
    return page.select("id", "scope", "kind", F.row_number().over(W.orderBy(F.desc("last_at"), "id")).alias("rank"))


_NEAR = """cls AS (SELECT kind, subject_id, w, min(id) AS rep FROM bag GROUP BY ALL), np AS (SELECT x.rep AS a, y.rep AS b, len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)) AS similarity FROM cls x JOIN cls y ON x.kind = y.kind AND x.subject_id = y.subject_id AND x.rep < y.rep
 UNION ALL SELECT rep, id, 1.0 FROM bag JOIN cls USING (kind, subject_id, w) WHERE id <> rep), con AS (SELECT * FROM np WHERE similarity >= 0.8)"""


@query(f"WITH {_STATED}, {_NEAR} SELECT a, b, round(similarity, 6) AS similarity FROM con")
def contradictions(spark, d):
    """Different statements of one kind on one subject that share at least four fifths of their words."""
    return C.near_pairs(_contexts(spark, d), ["kind", "subject_id"]).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_STATED}, g AS (SELECT id, scope, kind, unnest(w) AS g FROM bag WHERE lifecycle = 'active'), ask AS (SELECT DISTINCT id FROM keyed WHERE row_key % 50 = 0)
SELECT x.id, y.id AS candidate, count(*) AS shared, row_number() OVER (PARTITION BY x.id ORDER BY count(*) DESC, y.id) AS rank FROM g x JOIN ask ON ask.id = x.id JOIN g y ON x.scope = y.scope AND x.kind = y.kind AND x.g = y.g AND x.id <> y.id GROUP BY 1, 2 QUALIFY rank <= 25""")
def near_dup_candidates(spark, d):
    """Candidates for every context that a row with an id divisible by 50 states."""
    asked = _said(spark, d).where(F.col("row_key") % 50 == 0).select(C.context_id(F.col("kind"), F.col("subject_id"), F.col("normal")).alias("id"))
    return C.candidates(_contexts(spark, d), asked)


_TRUST = """sup AS (SELECT id AS subject_id, row_key::VARCHAR AS evidence_id, coalesce(priority, '') AS statement, scope AS source_system, CASE priority WHEN 'High' THEN 80 WHEN 'Low' THEN 20 ELSE 0 END AS authority, recorded_at AS observed_at FROM keyed),
s1 AS (SELECT *, observed_at < max(observed_at) OVER (PARTITION BY subject_id, source_system) AS old, CASE WHEN authority = 0 THEN 30 ELSE authority END AS auth FROM sup),
s2 AS (SELECT *, row_number() OVER w AS nth, lead((old, auth, observed_at::VARCHAR)) OVER w AS k2, lead(statement) OVER w AS st2 FROM s1 WINDOW w AS (PARTITION BY subject_id ORDER BY old, auth DESC, observed_at DESC, evidence_id)),
pref AS (SELECT subject_id AS id, evidence_id AS preferred, authority FROM s2 WHERE nth = 1 AND NOT coalesce(k2 = (old, auth, observed_at::VARCHAR) AND st2 <> statement, false)), cnt AS (SELECT id, count(*) AS support FROM keyed GROUP BY 1),
ends AS (SELECT id, count(*) AS contradicted FROM (SELECT a AS id FROM con UNION ALL SELECT b FROM con) GROUP BY 1), nxt AS (SELECT id, lead(id) OVER (PARTITION BY subject_id ORDER BY last_at, id) AS superseded_by, lifecycle FROM ctx),
tr AS (SELECT c.id, c.kind, c.subject_id, c.lifecycle, c.lifecycle = 'active' AS current, coalesce(support, 0) AS support, preferred, authority, coalesce(support, 0) > 1 AND preferred IS NULL AS undecided, coalesce(contradicted, 0) AS contradicted, CASE WHEN c.lifecycle = 'archived' THEN n.superseded_by END AS superseded_by
 FROM ctx c LEFT JOIN cnt USING (id) LEFT JOIN pref USING (id) LEFT JOIN ends USING (id) LEFT JOIN nxt n USING (id))"""


def _trust(spark, d):
    contexts = _contexts(spark, d)
    key = C.context_id(F.col("kind"), F.col("subject_id"), F.col("normal"))
    rank = F.when(F.col("priority") == "High", 80).when(F.col("priority") == "Low", 20).otherwise(0)
    support = _said(spark, d).select(
        key.alias("subject_id"), F.col("row_key").cast("string").alias("evidence_id"), F.coalesce("priority", F.lit("")).alias("statement"), F.col("scope").alias("source_system"), rank.alias("authority"), F.lit(None).cast("double").alias("confidence"), F.col("recorded_at").alias("observed_at")
    )
    after = F.lead("id").over(W.partitionBy("subject_id").orderBy("last_at", "id"))
    superseding = contexts.select("id", "lifecycle", after.alias("superseded_by")).where(F.col("lifecycle") == "archived").select("id", "superseded_by")
    found = C.trust(contexts, support, C.near_pairs(contexts, ["kind", "subject_id"]), superseding)
    return found.join(contexts.select("id", "kind", "subject_id"), "id")


@query(f"""WITH {_STATED}, {_NEAR}, {_TRUST} SELECT id, current, support, preferred, authority, undecided, contradicted, superseded_by, CASE lifecycle WHEN 'candidate' THEN 'proposed' WHEN 'archived' THEN 'retired' ELSE
 CASE WHEN support = 0 THEN 'unsupported' WHEN preferred IS NULL THEN CASE WHEN contradicted > 0 THEN 'contradicted-undecided' ELSE 'undecided' END WHEN contradicted > 0 THEN 'contradicted' ELSE 'supported' END END AS reason FROM tr""")
def context_trust(spark, d):
    return _trust(spark, d).drop("kind", "subject_id")


@query(f"WITH {_STATED}, {_NEAR}, {_TRUST} SELECT id, row_number() OVER (PARTITION BY subject_id ORDER BY NOT current, CASE WHEN coalesce(authority, 0) = 0 THEN 30 ELSE authority END DESC, support DESC, id) AS rank FROM tr QUALIFY rank <= 10")
def standing_order(spark, d):
    """The ten first contexts of each subject: current ones, by kind, authority and support."""
    w = W.partitionBy("subject_id").orderBy(*C.standing_order())
    return _trust(spark, d).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 10).select("id", "rank")


_MOVE_SQL = "CASE event_type WHEN 'view' THEN 'accept' WHEN 'error' THEN 'archive' WHEN 'signup' THEN 'reinstate' WHEN 'purchase' THEN 'supersede' ELSE 'unknown' END"


@query(f"""WITH RECURSIVE m AS (SELECT user_id AS id, event_id AS seq, {_MOVE_SQL} AS move, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS move, NULL::VARCHAR AS outcome, 'candidate' AS state FROM (SELECT DISTINCT id FROM m)
 UNION ALL SELECT m.id, m.k, m.seq, m.move, CASE WHEN t IS NULL THEN 'refused' ELSE 'applied' END, coalesce(t, x.state) FROM (SELECT f.*, m.k AS nk, m.move AS nm, CASE WHEN m.move = 'accept' AND f.state = 'candidate' THEN 'active' WHEN m.move = 'archive' AND f.state IN ('active', 'candidate') THEN 'archived' WHEN m.move = 'reinstate' AND f.state = 'archived' THEN 'active'
  WHEN m.move = 'supersede' AND f.state IN ('active', 'candidate', 'archived') THEN 'superseded' END AS t FROM f JOIN m ON m.id = f.id AND m.k = f.k + 1) x JOIN m ON m.id = x.id AND m.k = x.nk)
SELECT id, seq, move, outcome, state FROM f WHERE k > 0""")
def context_lifecycle(spark, d):
    """Moves of one context a user, in order of arrival."""
    move = F.when(F.col("event_type") == "view", "accept").when(F.col("event_type") == "error", "archive").when(F.col("event_type") == "signup", "reinstate").when(F.col("event_type") == "purchase", "supersede").otherwise("unknown")
    return C.lifecycle_fold(table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), move.alias("move")))


@query(f"""WITH {EVIDENCE}, m AS (SELECT evidence_id AS memory_id, CASE WHEN evidence_state = 'superseded' THEN 'later' END AS superseded_by, CASE field_name WHEN 'configuration' THEN 'constraint' WHEN 'signature' THEN 'fact' ELSE field_name END AS kind, CASE method WHEN 'asserted' THEN 'explicit' ELSE 'extracted' END AS origin, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence FROM evidence),
r AS (SELECT *, CASE WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN kind IS NULL OR kind NOT IN ('constraint', 'decision', 'gotcha', 'preference', 'fact', 'next-step') THEN 'unknown-kind' END AS refusal FROM m)
SELECT memory_id, refusal, CASE WHEN refusal IS NULL THEN CASE origin WHEN 'explicit' THEN 'active' ELSE 'candidate' END END AS state, CASE WHEN refusal IS NULL THEN confidence END AS confidence FROM r""")
def promotion_plan(spark, d):
    kind = F.when(F.col("field_name") == "configuration", "constraint").when(F.col("field_name") == "signature", "fact").otherwise(F.col("field_name"))
    rows = evidence(spark, d).select(
        F.col("evidence_id").alias("memory_id"), F.when(F.col("evidence_state") == "superseded", "later").alias("superseded_by"), kind.alias("kind"), F.when(F.col("method") == "asserted", "explicit").otherwise("extracted").alias("origin"), F.nanvl("confidence", F.lit(None).cast("double")).alias("confidence")
    )
    return C.promotion(rows)


@query(f"""WITH {ENTITY}, {EVIDENCE}, f AS (SELECT repo_id || ':' || path AS path, arg_max(sha256(text_content), file_id) AS now_hash FROM source_file WHERE text_content IS NOT NULL GROUP BY 1),
o AS (SELECT e.id, e.lifecycle, bool_or(evidence_state = 'superseded') OVER (PARTITION BY e.id) AND false AS sup, v.evidence_id, e.source_scope || ':' || (locator->>'$.path') AS path, sha256(statement) AS h FROM entity e JOIN evidence v ON v.subject_id = e.id),
i AS (SELECT 'repo ' || path AS id, 'active' AS lifecycle, CASE WHEN hash_no % 3 = 0 THEN 'x' ELSE now_hash END AS h, path, now_hash FROM (SELECT f.*, length(path) AS hash_no FROM f))
SELECT id, CASE WHEN lifecycle = 'superseded' THEN 'superseded' WHEN lifecycle IN ('archived', 'deleted') OR sum((path IS NOT NULL)::INT) = 0 THEN 'unanchored' WHEN bool_or(path IS NOT NULL AND coalesce(h = now_hash, false)) THEN 'verified' WHEN arg_max(path IS NOT NULL AND now_hash IS NULL, evidence_id) THEN 'unknown' ELSE 'stale' END AS verdict
FROM (SELECT o.id, o.lifecycle, o.evidence_id, o.path, o.h, f.now_hash FROM o LEFT JOIN f ON f.path = o.path UNION ALL SELECT id, lifecycle, '', path, h, now_hash FROM i) GROUP BY id, lifecycle""")
def anchor_verdict(spark, d):
    """Anchors of all evidence against the files as they are, and one anchor for each file, a third of them changed."""
    files = table(spark, d, "source_file").where(F.col("text_content").isNotNull()).groupBy(F.concat_ws(":", "repo_id", "path").alias("path")).agg(F.max_by(F.sha2("text_content", 256), "file_id").alias("now_hash"))
    path = F.when(F.col("source_scope").isNotNull() & F.get_json_object("locator", "$.path").isNotNull(), F.concat_ws(":", "source_scope", F.get_json_object("locator", "$.path")))
    told = evidence(spark, d).select(F.col("subject_id").alias("id"), "evidence_id", "locator", "statement").join(entity(spark, d).select("id", "lifecycle", "source_scope"), "id")
    seen = told.select("id", "lifecycle", F.lit(False).alias("superseded"), F.col("evidence_id").alias("observation_no"), path.alias("path"), F.sha2("statement", 256).alias("content_hash"))
    own = files.select(F.concat(F.lit("repo "), "path").alias("id"), F.lit("active").alias("lifecycle"), F.lit(False).alias("superseded"), F.lit("").alias("observation_no"), "path", F.when(F.length("path") % 3 == 0, "x").otherwise(F.col("now_hash")).alias("content_hash"))
    return C.verify_anchors(seen.unionByName(own), files)


def _pack_rows(spark, d):
    standing = _trust(spark, d).where("current").join(_contexts(spark, d).select("id", "normal"), "id")
    standing = standing.select("id", F.row_number().over(W.orderBy(*C.standing_order())).alias("rank"), X.estimate_tokens(F.col("normal")).alias("tokens"))  # current contexts of the subjects asked about
    rows = entity(spark, d).where(F.col("lifecycle") == "active")
    hits = _rounded(S.search(rows, "id", _entity_text(), S.relaxed(S.parse(LINE)))).join(rows.select("id", "attributes"), "id").orderBy(F.desc("score"), "id").limit(500)
    items = hits.select("id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"), X.estimate_tokens(F.col("attributes")).alias("tokens"))
    return standing, items


@query()
def context_pack(spark, d):
    """One pack of 1,200 estimated tokens: standing contexts, then hits; what did not fit is counted by reason."""
    entries, omitted = C.pack(*_pack_rows(spark, d), budget=1_200)
    kept = entries.select("part", "id", "rank", "tokens", F.lit("kept").alias("fate"))
    return kept.unionByName(omitted.select("part", F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("rank"), F.col("n").alias("tokens"), F.col("reason").alias("fate")))


@query(f"""WITH {EVIDENCE}, {ENTITY}, b AS (SELECT *, CASE WHEN authority = 0 THEN 30 ELSE authority END AS auth, coalesce(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END, -1) AS conf, coalesce(field_name, '') AS f FROM evidence WHERE evidence_state IN ('current', 'conflicting')),
c AS (SELECT subject_id, f, count(*) AS cites, count(DISTINCT statement) > 1 AND count(DISTINCT source_system) > 1 AS disputed, dense_rank() OVER (PARTITION BY subject_id ORDER BY f) AS claim FROM b GROUP BY 1, 2 QUALIFY claim <= 20),
z AS (SELECT b.*, c.claim, c.disputed, row_number() OVER (PARTITION BY b.subject_id, b.f ORDER BY auth DESC, conf DESC, evidence_id) AS citation FROM b JOIN c ON c.subject_id = b.subject_id AND c.f = b.f)
SELECT e.id, z.f AS field_name, z.claim, z.citation, z.evidence_id, z.disputed, CASE WHEN e.lifecycle <> 'active' THEN 'not-current' WHEN z.evidence_id IS NULL THEN 'not-answerable' WHEN z.disputed THEN 'ambiguous' ELSE 'answered' END AS verdict FROM entity e LEFT JOIN z ON z.subject_id = e.id AND citation <= 3""")
def answer_claims(spark, d):
    """Claims about every entity: up to twenty fields with three citations each, and whether they answer."""
    return L.answers(entity(spark, d), evidence(spark, d).withColumn("confidence", F.nanvl("confidence", F.lit(None).cast("double"))))


@query(f"""WITH {EVIDENCE}, m AS (SELECT evidence_id, subject_id, permission_scope, locator->>'$.path' AS path FROM evidence WHERE evidence_state = 'current'), s AS (SELECT 'subject' AS relation, subject_id AS anchor, count(*) AS members FROM m GROUP BY 2 HAVING count(*) > 1),
p AS (SELECT 'path', coalesce(permission_scope, '') || ':' || path, count(*) FROM m WHERE path IS NOT NULL GROUP BY 2 HAVING count(*) > 1), l AS (SELECT 'link', r.left_id, count(DISTINCT r.right_id) FROM (SELECT DISTINCT a.subject_id AS left_id, b.subject_id AS right_id FROM m a JOIN m b ON a.path = b.path AND a.permission_scope IS NOT DISTINCT FROM b.permission_scope AND a.subject_id < b.subject_id) r GROUP BY 2),
n AS (SELECT 'absent', signal, n FROM (SELECT 'no-path' AS signal, count(*) FILTER (path IS NULL) AS n FROM m UNION ALL SELECT 'alone', (SELECT count(*) FROM (SELECT subject_id FROM m GROUP BY 1 HAVING count(*) = 1))) WHERE n > 0)
SELECT * FROM s UNION ALL SELECT * FROM p UNION ALL SELECT * FROM l UNION ALL SELECT * FROM n""")
def relation_index(spark, d):
    return L.relation_index(evidence(spark, d).where(F.col("evidence_state") == "current"))


@query("""WITH g AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS generation FROM events), lin AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY generation) AS later FROM g WHERE generation <= 11),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY generation, CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, ts, event_id) AS rank FROM lin WHERE later IS NULL OR event_type IN ('view', 'click'))
SELECT user_id, event_id, rank, (SELECT count(*) FROM lin x WHERE x.user_id = k.user_id) - (SELECT count(*) FROM k y WHERE y.user_id = k.user_id AND y.rank <= 60) AS omitted FROM k WHERE rank <= 60""")
def session_recover(spark, d):
    """What a user's last session takes over from the ten before it: the nearest first, superseded statements left out."""
    recent = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, d, "events").withColumn("generation", F.row_number().over(recent)).where(F.col("generation") <= 11)
    later = F.lag("event_id").over(W.partitionBy("user_id", "event_type").orderBy("generation"))
    lineage = rows.withColumn("later", later).withColumn("all", F.count(F.lit(1)).over(W.partitionBy("user_id")))
    kind = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).otherwise(2)
    kept = lineage.where(F.col("later").isNull() | F.col("event_type").isin("view", "click"))
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy("generation", kind, "ts", "event_id"))).where(F.col("rank") <= 60)
    return ranked.select("user_id", "event_id", "rank", (F.col("all") - F.count(F.lit(1)).over(W.partitionBy("user_id"))).alias("omitted"))


# ------------------------------------------------------------------ planning

@query(f"""WITH {ENTITY}, {_post('epost', 'id', _ENTITY_TEXT, 'entity')}, lines AS (SELECT (SELECT min(id) FROM entity) AS line UNION ALL SELECT '{LINE}' UNION ALL SELECT 'no/such/path'),
x AS (SELECT line, id, 1 AS rank FROM lines JOIN entity ON id = line OR attributes->>'$.path' = line OR source_id = line), t AS (SELECT '{LINE}' AS line, id, row_number() OVER (ORDER BY matched DESC, score DESC, id) AS rank FROM (SELECT id, count(*) AS matched, round({_R} / ({_R} + 1), 6) AS score FROM epost WHERE lexeme IN ({_WORDS_SQL}) GROUP BY 1) ORDER BY rank LIMIT 20),
sem AS (SELECT '{LINE}' AS line, id, rank FROM (SELECT id, row_number() OVER (ORDER BY md5(id)) AS rank FROM entity WHERE kind = 'issue') WHERE rank <= 5)
SELECT line, id, 'exact' AS strategy, 1.0::DOUBLE AS fused FROM x UNION ALL SELECT line, id, 'fused', round(sum(1.0::DOUBLE / (60 + rank)), 6) FROM (SELECT * FROM t UNION ALL SELECT * FROM sem) WHERE line NOT IN (SELECT line FROM x) GROUP BY 1, 2
UNION ALL SELECT line, NULL, 'note:nothing-found', NULL FROM lines WHERE line NOT IN (SELECT line FROM x) AND line <> '{LINE}'""")
def planned_search(spark, d):
    """Three lines planned: an id is answered exactly, prose by text and vectors fused, a path without a match says so.

    The vectors' list is a fixed order of issues, since no model is at hand.
    """
    from lodeline.operators.planner import plan_search

    rows = entity(spark, d)
    first = rows.agg(F.min("id").alias("line"))
    lines = first.unionByName(spark.createDataFrame([(LINE,), ("no/such/path",)], "line string"))
    order = W.orderBy(F.md5("id"))
    semantic = rows.where(F.col("kind") == "issue").orderBy(F.md5("id")).limit(5).select(F.lit(LINE).alias("line"), "id", F.row_number().over(order).alias("rank"))
    text = _rounded(S.search(rows, "id", _entity_text(), S.relaxed(S.parse(LINE)))).orderBy(F.desc("matched"), F.desc("score"), "id").limit(20)
    text = text.select(F.lit(LINE).alias("line"), "id", F.row_number().over(W.orderBy(F.desc("matched"), F.desc("score"), "id")).alias("rank"))
    exact = rows.select("id", F.explode(F.array_distinct(F.array_compact(F.array("id", R.attribute("path"), "source_id")))).alias("line"))
    return plan_search(lines, exact, [text, semantic]).withColumn("fused", F.round("fused", 6))


# ------------------------------------------------------------------ versions, symbols, releases, benchmarks
@query("""WITH v AS (SELECT repo_id, path, lower(oid) AS version, snapshot_no, entry_id FROM tree_snapshot WHERE is_complete AND path IS NOT NULL), l AS (SELECT repo_id, max(snapshot_no) AS last FROM v GROUP BY 1)
SELECT repo_id, path, arg_max(version, (snapshot_no, entry_id)) AS version FROM v JOIN l USING (repo_id) WHERE snapshot_no = last GROUP BY 1, 2""")
def current_versions(spark, d):
    """The newest version of every file that the last complete listing of its repository still holds open."""
    rows = table(spark, d, "tree_snapshot").where(F.col("is_complete") & F.col("path").isNotNull()).select("repo_id", "path", F.lower("oid").alias("version"), "snapshot_no", "entry_id")
    last = rows.groupBy("repo_id").agg(F.max("snapshot_no").alias("snapshot_no"))
    return rows.join(last, ["repo_id", "snapshot_no"]).groupBy("repo_id", "path").agg(F.max_by("version", F.struct("snapshot_no", "entry_id")).alias("version"))


_OLD = "TIMESTAMP '2022-01-01'"


@query(f"""WITH {EVIDENCE}, {ENTITY}, t AS (SELECT 'blobs' AS target, count(*) AS held, count(*) FILTER (NOT EXISTS (SELECT 1 FROM tree_snapshot s WHERE lower(s.oid) = f.oid) AND seen < {_OLD}) AS doomed FROM (SELECT lower(oid) AS oid, max(observed_at) AS seen FROM source_file WHERE oid IS NOT NULL GROUP BY 1) f
UNION ALL SELECT 'evidence', count(*), count(*) FILTER (evidence_state = 'superseded' AND recorded_at < {_OLD} AND NOT EXISTS (SELECT 1 FROM evidence x WHERE x.subject_id = e.subject_id AND x.evidence_state = 'current')) FROM evidence e
UNION ALL SELECT 'contexts', count(*), count(*) FILTER (lifecycle = 'archived' AND observed_at < {_OLD}) FROM entity UNION ALL SELECT 'journals', count(*), count(*) FILTER (ts < TIMESTAMP '2024-01-10') FROM events
UNION ALL SELECT 'sessions', count(*), count(*) FILTER (last < TIMESTAMP '2024-01-20') FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)) SELECT * FROM t""")
def prune_plan(spark, d):
    """What retention would remove of each target, by age; nothing is removed by a plan."""
    from lodeline.operators.merge import prunable

    old = F.lit("2022-01-01 00:00:00").cast("timestamp_ntz")
    blobs = table(spark, d, "source_file").where(F.col("oid").isNotNull()).groupBy(F.lower("oid").alias("k")).agg(F.max("observed_at").alias("at"))
    told = evidence(spark, d)
    rows = table(spark, d, "events")
    parts = [
        prunable("blobs", blobs, old, keep_if=(table(spark, d, "tree_snapshot").select(F.lower("oid").alias("k")), "k")),
        prunable("evidence", told.withColumn("at", F.col("recorded_at")), old, F.col("evidence_state") == "superseded", (told.where(F.col("evidence_state") == "current").select("subject_id"), "subject_id")),
        prunable("contexts", entity(spark, d).withColumn("at", F.col("observed_at")), old, F.col("lifecycle") == "archived"),
        prunable("journals", rows.select(F.col("ts").alias("at")), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")),
        prunable("sessions", rows.groupBy("user_id").agg(F.max("ts").alias("at")), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(r"""WITH l AS (SELECT file_id, path, unnest(regexp_extract_all(text_content, '(?m)^[ \t]*((?:(?:export|default|declare|abstract|async)[ \t]+)*(?:function|class|interface|enum|def)[ \t]+[A-Za-z_$][A-Za-z0-9_$]*[^\n{]*)', 1)) AS head FROM source_file WHERE text_content IS NOT NULL)
SELECT file_id, head_name AS name, signature, modifiers, count(*) AS n FROM (SELECT file_id, regexp_extract(head, '(?:function|class|interface|enum|def)[ \t]+([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS head_name, trim(regexp_replace(regexp_replace(head, '\s+', ' ', 'g'), '[:;\s]+$', '')) AS signature,
 list_filter(string_split(trim(regexp_replace(regexp_extract(head, '^((?:(?:export|default|declare|abstract|async)[ \t]+)*)', 1), '[ \t]+', ' ', 'g')), ' '), lambda m: m <> '') AS modifiers FROM l) GROUP BY ALL""")
def symbol_signature(spark, d):
    """Signature and modifiers of every declaration as its first line states them."""
    return Y.signatures(table(spark, d, "source_file")).groupBy("file_id", "name", "signature", "modifiers").agg(F.count(F.lit(1)).alias("n"))


_TAG_SQL = """r AS (SELECT repo_id, tag, since, row_number() OVER (PARTITION BY repo_id ORDER BY since, tag) AS nth, length(tag) % 4 = 0 AS draft FROM (SELECT repo_id, CASE WHEN ref_name LIKE 'refs/%' THEN ref_name ELSE 'refs/heads/' || ref_name END AS tag, min(taken_at) AS since FROM branch_snapshot GROUP BY 1, 2) WHERE tag LIKE 'refs/%')"""


def _releases(spark, d):
    from lodeline.functions.canonical import full_ref

    return table(spark, d, "branch_snapshot").groupBy("repo_id", full_ref(F.col("ref_name")).alias("tag")).agg(F.min("taken_at").alias("since")).withColumn("draft", F.length("tag") % 4 == 0)


@query(f"WITH {_TAG_SQL} SELECT repo_id, tag, last_value(CASE WHEN NOT draft THEN tag END IGNORE NULLS) OVER (PARTITION BY repo_id ORDER BY since, tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM r")
def previous_release(spark, d):
    """The last release before each that is no draft; refs stand in for releases in order of first sight."""
    w = W.partitionBy("repo_id").orderBy("since", "tag").rowsBetween(W.unboundedPreceding, -1)
    return _releases(spark, d).select("repo_id", "tag", F.last(F.when(~F.col("draft"), F.col("tag")), ignorenulls=True).over(w).alias("previous"))


@query(f"WITH {_TAG_SQL}, dep AS (SELECT entry_id AS deployment_id, repo_id, CASE WHEN entry_id % 5 = 0 THEN head_sha ELSE CASE WHEN ref_name LIKE 'refs/%' THEN ref_name ELSE 'refs/heads/' || ref_name END END AS ref FROM branch_snapshot) SELECT deployment_id, arg_min(r.tag, (r.since, r.tag)) AS release_tag FROM dep LEFT JOIN r ON r.repo_id = dep.repo_id AND r.tag = dep.ref GROUP BY 1")
def deploys_release(spark, d):
    """The release that each deployment's ref names; every fifth deployment names a commit and so none."""
    from lodeline.functions.canonical import full_ref

    deployments = table(spark, d, "branch_snapshot").select(F.col("entry_id").alias("deployment_id"), "repo_id", F.when(F.col("entry_id") % 5 == 0, F.col("head_sha")).otherwise(full_ref(F.col("ref_name"))).alias("tag"))
    found = deployments.join(_releases(spark, d).select("repo_id", "tag", "since"), ["repo_id", "tag"], "left")
    return found.groupBy("deployment_id").agg(F.min_by(F.when(F.col("since").isNotNull(), F.col("tag")), F.struct("since", "tag")).alias("release_tag"))


_SCORED = """j AS (SELECT source AS task, doc_id::VARCHAR AS artefact, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank, doc_id % 7 = 0 AS expected, doc_id % 35 = 0 AS prim, doc_id % 11 = 0 AS superseded, coalesce(n_chars, 0) AS cost FROM documents WHERE source IS NOT NULL)"""


@query(f"""WITH {_SCORED} SELECT task, count(*) FILTER (prim) = count(*) FILTER (prim AND rank <= 10) AS sourced, round(coalesce(max(1.0::DOUBLE / rank) FILTER (prim AND rank <= 10), 0), 6) AS rr_primary,
CASE WHEN count(*) FILTER (superseded) > 0 THEN coalesce(min(rank) FILTER (superseded AND rank <= 10) < coalesce(min(rank) FILTER (prim AND rank <= 10), 1000), false) END AS stale_above_current,
count(*) FILTER (rank <= 5 AND NOT expected AND NOT superseded) AS irrelevant5, round(count(*) FILTER (expected AND rank <= 10) / nullif(count(*) FILTER (expected), 0), 6) AS recall, coalesce(sum(cost) FILTER (rank <= 10), 0)::BIGINT AS tokens FROM j GROUP BY 1""")
def bench_score(spark, d):
    """Scores of one ranking a source against labels by id: what the answer rests on, what is out of date, what is beside the point."""
    rows = table(spark, d, "documents").where(F.col("source").isNotNull())
    w = W.partitionBy("source").orderBy(F.col("n_chars").desc_nulls_last(), "doc_id")
    k = F.col("doc_id")
    ranked = rows.select(F.col("source").alias("task"), k.cast("string").alias("artefact"), F.row_number().over(w).alias("rank"), (k % 7 == 0).alias("expected"), (k % 35 == 0).alias("primary"), (k % 11 == 0).alias("superseded"), F.coalesce("n_chars", F.lit(0)).alias("cost"))
    return M.bench_scores(ranked, 10)


@query(f"""WITH s AS (SELECT file_id, unnest(regexp_extract_all(text_content, '(?m)^(?:def|class)[ \\t]+([A-Za-z_]\\w*)', 1)) AS name FROM source_file WHERE text_content IS NOT NULL AND regexp_matches(lower(path), '\\.pyi?$')),
l AS (SELECT file_id, unnest(regexp_extract_all(text_content, '(?m)^[ \\t]*(?:async[ \\t]+)?(?:def|class)[ \\t]+([A-Za-z_]\\w*)', 1)) AS name FROM source_file WHERE text_content IS NOT NULL AND regexp_matches(lower(path), '\\.pyi?$')),
a AS (SELECT DISTINCT * FROM s), b AS (SELECT DISTINCT * FROM l), c AS (SELECT count(*) AS matched FROM a JOIN b USING (file_id, name)) SELECT matched, (SELECT count(*) FROM a) AS found, (SELECT count(*) FROM b) AS expected, round(matched / (SELECT count(*) FROM a), 6) AS "precision", round(matched / (SELECT count(*) FROM b), 6) AS recall FROM c""")
def parse_quality(spark, d):
    """What the outline of top-level Python declarations finds of all declarations in the files."""
    files = table(spark, d, "source_file").where(F.col("text_content").isNotNull() & F.lower("path").rlike(r"\.pyi?$"))
    found = files.select("file_id", F.explode(F.regexp_extract_all("text_content", F.lit(r"(?m)^(?:def|class)[ \t]+([A-Za-z_]\w*)"), F.lit(1))).alias("name"))
    labels = files.select("file_id", F.explode(F.regexp_extract_all("text_content", F.lit(r"(?m)^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+([A-Za-z_]\w*)"), F.lit(1))).alias("name"))
    return M.parse_quality(found, labels)
