"""Registered queries: exact retrieval, access, aggregates, identity, paging, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.functions import identity as I
from lodeline.operators import access as A
from lodeline.operators import retrieval as R
from lodeline.plans.frames import ENTITY, EVIDENCE, entity, evidence, registrar
from lodeline.session import table

GRANTS = ("repo-00000", "repo-00003")
ACCESS = A.Access(grants=GRANTS)
RULES = (A.Exclusion("docs/**"), A.Exclusion("*.md", "2021-06-01 00:00:00"), A.Exclusion("tests"))
_GRANT_SQL = "(source_scope IS NULL OR source_scope IN ('repo-00000', 'repo-00003') OR source_scope LIKE 'repo-00000:%' OR source_scope LIKE 'repo-00003:%')"
QUERIES, ORACLE, query = registrar()


@query(f"WITH {ENTITY} SELECT id, kind, source_id, lifecycle FROM entity WHERE kind IN ('file', 'issue') AND lifecycle = 'active' AND {_GRANT_SQL}")
def find_entities(spark, d):
    return R.find_entities(entity(spark, d), kinds=("file", "issue"), lifecycle="active", access=ACCESS).select("id", "kind", "source_id", "lifecycle")


@query(f"WITH {ENTITY} SELECT id, source_id, attributes->>'$.extension' AS extension FROM entity WHERE attributes->>'$.language' = 'typescript' AND attributes->>'$.classification' = 'test'")
def find_by_attribute(spark, d):
    found = R.find_entities(entity(spark, d), attributes={"language": "typescript", "classification": "test"})
    return found.select("id", "source_id", R.attribute("extension").alias("extension"))


@query(f"WITH {ENTITY} SELECT id, kind FROM entity e WHERE EXISTS (SELECT 1 FROM lifecycle_change c WHERE e.source_system = 'git' AND c.path = e.source_id)")
def find_by_external_id(spark, d):
    keys = table(spark, d, "lifecycle_change").select(F.lit("git").alias("system"), F.col("path").alias("external_id"))
    return R.with_external_id(entity(spark, d), keys).select("id", "kind")


@query(f"""WITH {ENTITY}, t AS (SELECT path AS term FROM lifecycle_change UNION SELECT subject_id FROM evidence_record UNION SELECT substring(attributes->>'$.head', 1, 10) FROM entity_update WHERE kind = 'branch')
SELECT DISTINCT term, id, 1.0::DOUBLE AS score FROM t JOIN entity ON id = term OR attributes->>'$.path' = term
UNION SELECT DISTINCT term, id, 1.0::DOUBLE FROM t JOIN entity ON regexp_matches(term, '^[0-9a-f]{{7,40}}$') AND (starts_with(source_id, term) OR starts_with(attributes->>'$.head', term))""")
def by_identifier(spark, d):
    paths = table(spark, d, "lifecycle_change").select(F.col("path").alias("term"))
    ids = table(spark, d, "evidence_record").select(F.col("subject_id").alias("term"))
    heads = table(spark, d, "entity_update").where(F.col("kind") == "branch").select(F.substring(R.attribute("head"), 1, 10).alias("term"))
    terms = paths.unionByName(ids).unionByName(heads).where(F.col("term").isNotNull()).distinct()
    return R.by_identifier(entity(spark, d), terms).select("term", "id", "score")


@query(f"WITH {ENTITY} SELECT id, kind, canonical_key, lifecycle FROM entity WHERE id = (SELECT min(id) FROM entity WHERE source_scope IS NULL)")
def get_entity(spark, d):
    rows = entity(spark, d)
    wanted = rows.where(F.col("source_scope").isNull()).agg(F.min("id").alias("id"))
    return A.visible(rows.join(F.broadcast(wanted), "id"), A.withheld_reason(F.col("source_scope"), R.attribute("path"), F.col("observed_at"), A.Access())).select("id", "kind", "canonical_key", "lifecycle")


@query(f"WITH {EVIDENCE} SELECT evidence_id, permission_scope FROM evidence WHERE permission_scope IS NULL OR permission_scope IN ('repo-00000', 'repo-00003') OR permission_scope LIKE 'repo-00000:%' OR permission_scope LIKE 'repo-00003:%'")
def permission_filter(spark, d):
    return evidence(spark, d).where(A.permitted(F.col("permission_scope"), GRANTS)).select("evidence_id", "permission_scope")


@query(f"WITH {ENTITY} SELECT id, source_scope FROM entity WHERE source_scope IS NULL OR source_scope IN ('repo-00001', 'repo-00002')")
def scope_filter(spark, d):
    return entity(spark, d).where(A.in_scope(F.col("source_scope"), ("repo-00001", "repo-00002"))).select("id", "source_scope")


@query(f"WITH {ENTITY} SELECT id, (source_scope IS NULL OR (source_scope IN ('repo-00000', 'repo-00001', 'repo-00002') AND source_scope <> 'repo-00001')) AS allowed FROM entity")
def scope_evaluate(spark, d):
    return entity(spark, d).select("id", A.in_scope(F.col("source_scope"), ("repo-00000", "repo-00001", "repo-00002"), ("repo-00001",)).alias("allowed"))


_REASON_SQL = f"""CASE WHEN NOT ({_GRANT_SQL}) THEN 'permission'
 WHEN regexp_full_match(p, 'docs/.*') OR (regexp_full_match(p, '(.*/)?[^/]*\\.md(/.*)?') AND observed_at >= TIMESTAMP '2021-06-01') OR regexp_full_match(p, '(.*/)?tests(/.*)?') THEN 'exclusion' END"""


@query(f"WITH {ENTITY}, e AS (SELECT *, attributes->>'$.path' AS p FROM entity) SELECT id, p AS path FROM e WHERE ({_REASON_SQL}) IS NULL AND p IS NOT NULL")
def exclusion_filter(spark, d):
    access = A.Access(grants=GRANTS, exclusions=RULES)
    rows = entity(spark, d).withColumn("path", R.attribute("path"))
    return A.visible(rows, A.withheld_reason(F.col("source_scope"), F.col("path"), F.col("observed_at"), access)).where(F.col("path").isNotNull()).select("id", "path")


@query(f"WITH {ENTITY}, e AS (SELECT *, attributes->>'$.path' AS p FROM entity) SELECT {_REASON_SQL} AS reason, count(*) AS n FROM e WHERE ({_REASON_SQL}) IS NOT NULL GROUP BY 1")
def withheld_counts(spark, d):
    access = A.Access(grants=GRANTS, exclusions=RULES)
    return A.withheld_tally(entity(spark, d), A.withheld_reason(F.col("source_scope"), R.attribute("path"), F.col("observed_at"), access))


@query(f"WITH {EVIDENCE} SELECT count(*) AS n FROM evidence WHERE contains(lower(statement), 'token') AND permission_scope IS NOT NULL AND permission_scope NOT IN ('repo-00000', 'repo-00003') AND permission_scope NOT LIKE 'repo-00000:%' AND permission_scope NOT LIKE 'repo-00003:%'")
def count_protected(spark, d):
    hit = F.lower("statement").contains("token") & ~A.permitted(F.col("permission_scope"), GRANTS)
    return evidence(spark, d).where(hit).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVIDENCE} SELECT subject_id, evidence_id, coalesce(field_name, '') AS field_name, row_number() OVER (PARTITION BY subject_id ORDER BY coalesce(observed_at, recorded_at) DESC, evidence_id) AS rank FROM evidence WHERE evidence_state = 'current' QUALIFY rank <= 200")
def evidence_for_subject(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("subject_id").orderBy(F.coalesce("observed_at", "recorded_at").desc(), "evidence_id")
    rows = evidence(spark, d).where(F.col("evidence_state") == "current").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 200)
    return rows.select("subject_id", "evidence_id", F.coalesce("field_name", F.lit("")).alias("field_name"), "rank")


@query(f"WITH {ENTITY}, m AS (SELECT max(observed_at) AS now FROM entity) SELECT id, row_number() OVER (ORDER BY observed_at, id) AS staleness_rank FROM entity, m WHERE epoch_us(now) - epoch_us(observed_at) > 30 * 86400 * 1000000::BIGINT AND lifecycle = 'active' ORDER BY observed_at, id LIMIT 100")
def stale_candidates(spark, d):
    from pyspark.sql import Window as W

    rows = entity(spark, d)
    now = rows.agg(F.max("observed_at").alias("now"))
    old = R.stale(rows.where(F.col("lifecycle") == "active").join(F.broadcast(now)), F.col("now"), 30 * 86400).orderBy("observed_at", "id").limit(100)
    return old.select("id", F.row_number().over(W.orderBy("observed_at", "id")).alias("staleness_rank"))


@query(f"WITH {ENTITY} SELECT kind, count(*) AS n FROM entity GROUP BY 1")
def inventory(spark, d):
    return entity(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(DISTINCT id) FROM entity_update) AS entities, (SELECT count(DISTINCT evidence_id) FROM evidence_record) AS evidence, (SELECT count(DISTINCT (repo_id, sha)) FROM commit_record) AS commits")
def counts(spark, d):
    def one(name, cols, alias):
        return table(spark, d, name).select(*cols).distinct().agg(F.count(F.lit(1)).alias(alias))

    parts = [one("entity_update", ["id"], "entities"), one("evidence_record", ["evidence_id"], "evidence"), one("commit_record", ["repo_id", "sha"], "commits")]
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))  # three single rows


@query("SELECT repo_id, count(*) AS files, count(text_content) AS with_text, coalesce(sum(octet_length(encode(text_content))), 0)::BIGINT AS bytes FROM source_file GROUP BY 1")
def content_stats(spark, d):
    rows = table(spark, d, "source_file").groupBy("repo_id")
    return rows.agg(F.count(F.lit(1)).alias("files"), F.count("text_content").alias("with_text"), F.coalesce(F.sum(F.octet_length("text_content")), F.lit(0)).cast("long").alias("bytes"))


@query(f"""WITH {EVIDENCE} SELECT producer, count(*) FILTER (evidence_state = 'stale') AS stale, list_sort(list(DISTINCT producer_version) FILTER (evidence_state = 'current')) AS versions,
epoch_us(max(recorded_at)) AS last_us FROM evidence GROUP BY 1""")
def artifact_status(spark, d):
    return evidence(spark, d).groupBy("producer").agg(
        F.count_if(F.col("evidence_state") == "stale").alias("stale"),
        F.array_sort(F.collect_set(F.when(F.col("evidence_state") == "current", F.col("producer_version")))).alias("versions"),
        F.unix_micros(F.max("recorded_at").cast("timestamp")).alias("last_us"),
    )


@query(f"""WITH {ENTITY}, r AS (SELECT coalesce(source_scope, '') AS scope, (attributes->>'$.referenceResolution.extracted')::BIGINT AS x, (attributes->>'$.referenceResolution.resolved')::BIGINT AS s, attributes->'$.referenceResolution.unresolved' AS u FROM entity WHERE kind = 'file' AND attributes->>'$.referenceResolution' IS NOT NULL),
k AS (SELECT scope, key, (u->>key)::BIGINT AS n FROM (SELECT scope, u, unnest(json_keys(u)) AS key FROM r)),
a AS (SELECT scope, sum(x)::BIGINT AS extracted, sum(s)::BIGINT AS resolved FROM r GROUP BY 1), b AS (SELECT scope, sum(n)::BIGINT AS unresolved, count(DISTINCT key) AS reasons FROM k GROUP BY 1)
SELECT scope, extracted, resolved, coalesce(unresolved, 0) AS unresolved, coalesce(reasons, 0) AS reasons, CASE WHEN extracted IS NULL THEN 'unknown' WHEN extracted > resolved THEN 'incomplete' ELSE 'complete' END AS verdict FROM a LEFT JOIN b USING (scope)""")
def reference_completeness(spark, d):
    part = F.get_json_object("attributes", "$.referenceResolution")
    files = entity(spark, d).where((F.col("kind") == "file") & part.isNotNull()).select(
        F.coalesce("source_scope", F.lit("")).alias("scope"),
        F.from_json(part, "extracted long, resolved long, unresolved map<string,long>").alias("r"),
    )
    sums = files.groupBy("scope").agg(F.sum("r.extracted").alias("extracted"), F.sum("r.resolved").alias("resolved"))
    reasons = files.select("scope", F.explode("r.unresolved").alias("reason", "n")).groupBy("scope").agg(F.sum("n").alias("unresolved"), F.count_distinct("reason").alias("reasons"))
    verdict = F.when(F.col("extracted").isNull(), "unknown").when(F.col("extracted") > F.col("resolved"), "incomplete").otherwise("complete")
    return sums.join(reasons, "scope", "left").na.fill(0, ["unresolved", "reasons"]).withColumn("verdict", verdict)


@query("SELECT max(schema_version)::BIGINT AS version, count(DISTINCT schema_version) AS versions FROM entity_update")
def schema_version(spark, d):
    return table(spark, d, "entity_update").agg(F.max("schema_version").cast("long").alias("version"), F.count_distinct("schema_version").alias("versions"))


@query("SELECT event_type, count(*) AS n, sum(value) AS total, min(value) AS least, max(value) AS most, CASE WHEN value <= 10 THEN 10 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 END AS bucket FROM events GROUP BY event_type, bucket".replace("sum(value)", "round(sum(value), 6)"))
def histogram(spark, d):
    bucket = F.when(F.col("value") <= 10, 10).when(F.col("value") <= 50, 50).when(F.col("value") <= 100, 100)
    rows = table(spark, d, "events").groupBy("event_type", bucket.alias("bucket"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(f"WITH {ENTITY} SELECT id, kind, source_id, row_number() OVER (ORDER BY kind, source_id, id) AS rank, true AS more FROM entity ORDER BY kind, source_id, id LIMIT 50")
def paged(spark, d):
    return R.page(entity(spark, d).select("id", "kind", "source_id"), ["kind", "source_id", "id"], 50)


@query("SELECT repo_id, sha, row_id FROM commit_record WHERE (repo_id, sha, row_id) > ('repo-00003', '8', 0) ORDER BY 1, 2, 3 LIMIT 200")
def keyset_page(spark, d):
    rows = table(spark, d, "commit_record").select("repo_id", "sha", "row_id")
    return R.keyset_page(rows, ["repo_id", "sha", "row_id"], ("repo-00003", "8", 0), 200)


_HEX = "sha256(k)"


@query(f"""WITH k AS (SELECT DISTINCT id, canonical_key, strlen(kind) || ':' || kind || strlen(source_system) || ':' || source_system || strlen(coalesce(source_scope, '')) || ':' || coalesce(source_scope, '') || strlen(source_id) || ':' || source_id AS k FROM entity_update),
h AS (SELECT *, {_HEX} AS h FROM k)
SELECT id, k = canonical_key AS key_ok, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-8' || substring(h, 14, 3) || '-' || translate(substring(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substring(h, 18, 3) || '-' || substring(h, 21, 12) = id AS id_ok FROM h""")
def integrity_sweep(spark, d):
    rows = table(spark, d, "entity_update").select("id", "canonical_key", "kind", "source_system", "source_scope", "source_id").distinct()
    key = I.canonical_key(F.col("kind"), F.col("source_system"), F.col("source_scope"), F.col("source_id"))
    return rows.select("id", (key == F.col("canonical_key")).alias("key_ok"), (I.canonical_id(key) == F.col("id")).alias("id_ok"))


@query("""SELECT repo_id, sha, 'relationship' IS NOT NULL AS made, sha256(length('relationship') || ':relationship' || length(repo_id) || ':' || repo_id || '17:commit_has_parent' || length(p) || ':' || p || length(sha) || ':' || sha) AS key_hash
FROM (SELECT DISTINCT repo_id, sha, parents[1] AS p FROM commit_record) WHERE p IS NOT NULL""")
def relationship_keys(spark, d):
    rows = table(spark, d, "commit_record").select("repo_id", "sha", F.get("parents", F.lit(0)).alias("p")).distinct().where(F.col("p").isNotNull())
    key = I.relationship_key(F.col("repo_id"), F.lit("commit_has_parent"), F.col("p"), F.col("sha"))
    return rows.select("repo_id", "sha", F.lit(True).alias("made"), I.content_hash(key).alias("key_hash"))
