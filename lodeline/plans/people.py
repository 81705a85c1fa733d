"""Registered queries: who is who, edges and artifacts written, marks advanced, conflicts reconciled."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.operators import resolution as P
from lodeline.operators import retrieval as R
from lodeline.operators import writes as U
from lodeline.operators.ledger import completeness_of, declared_authority
from lodeline.plans.frames import ENTITY, EVIDENCE, entity, evidence, newest, registrar
from lodeline.plans.texts import _ADDRESS_SQL, _mails
from lodeline.session import table

QUERIES, ORACLE, query = registrar()

_ODD = (("n1", "forge", "77+danna@users.noreply.github.com", None, "Dan"), ("n2", "forge", None, "Twin", "TWIN "), ("n3", "chat", None, "Twin", "Other"), ("n4", "chat", "PADO+x@dev.example", None, None))
_ODD_SQL = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in _ODD)
_ACTORS_SQL = f"""rec AS (SELECT id AS record_id, 'directory' AS system, attributes->>'$.emails[0]' AS address, attributes->>'$.usernames[0]' AS login, attributes->>'$.displayName' AS display_name FROM entity WHERE kind = 'actor'
 UNION ALL SELECT DISTINCT 'm:' || author_email, 'history', author_email, NULL, regexp_extract(author_email, '^([^@]*)@', 1) FROM commit_record WHERE author_email IS NOT NULL UNION ALL SELECT * FROM (VALUES {_ODD_SQL})),
addr AS (SELECT rec.*, lower(trim(translate(address, '<>', ''))) AS low FROM rec), x AS (SELECT *, CASE WHEN NOT regexp_matches(low, '^.+@[^@]+$') OR low LIKE '%@users.noreply.github.com' OR position('+' IN low) <= 1 THEN low ELSE regexp_replace(low, '\\+[^@]*@', '@') END AS address_key,
 CASE WHEN lower(trim(address)) LIKE '%@users.noreply.github.com' THEN nullif(string_split(split_part(lower(trim(address)), '@', 1), '+')[-1], '') END AS told FROM addr),
keys AS (SELECT record_id, system, 'same-address' AS rule, 0.95 AS sure, address_key AS k FROM x UNION SELECT record_id, system, 'same-username', 0.6, login FROM x UNION SELECT record_id, system, 'same-display-name', 0.5, lower(trim(display_name)) FROM x
 UNION SELECT record_id, system, 'noreply-login', 0.8, n FROM (SELECT record_id, system, told AS n FROM x UNION SELECT record_id, system, login FROM x) WHERE n IN (SELECT told FROM x WHERE told IS NOT NULL)),
links AS (SELECT DISTINCT a.record_id AS a, a.rule, a.sure, first_value(b.record_id) OVER (PARTITION BY a.record_id, a.rule, a.k ORDER BY b.record_id) AS b FROM keys a JOIN keys b ON a.rule = b.rule AND a.k = b.k AND a.system <> b.system WHERE trim(a.k) <> '')"""


@query(f"WITH {ENTITY}, {_ACTORS_SQL} SELECT least(a, b) AS left, greatest(a, b) AS right, arg_max(rule, (sure, rule)) AS rule, max(sure)::DOUBLE AS confidence FROM links GROUP BY 1, 2")
def resolve_actors(spark, d):
    """People of the directory, authors of commits and a few accounts elsewhere that may be the same."""
    known = entity(spark, d).where(F.col("kind") == "actor")
    known = known.select(F.col("id").alias("record_id"), F.lit("directory").alias("system"), F.get_json_object("attributes", "$.emails[0]").alias("address"), F.get_json_object("attributes", "$.usernames[0]").alias("login"), R.attribute("displayName").alias("display_name"))
    mails = table(spark, d, "commit_record").where(F.col("author_email").isNotNull()).select(F.col("author_email").alias("address")).distinct()
    local = F.when(F.col("address").contains("@"), F.substring_index("address", "@", 1)).otherwise("")
    mails = mails.select(F.concat(F.lit("m:"), "address").alias("record_id"), F.lit("history").alias("system"), "address", F.lit(None).cast("string").alias("login"), local.alias("display_name"))
    odd = spark.createDataFrame(_ODD, "record_id string, system string, address string, login string, display_name string")
    return P.resolve_actors(known.unionByName(mails).unionByName(odd))


_EXTRA = (("Ada B", "ada@x.example"), ("Ada B", "Ada+t@x.example"), ("ada b", "ada@y.example"), ("Octo", "5+octo@users.noreply.github.com"), (None, "octo@x.example"), ("Root", "root@a.example"), ("Root", "root@b.example"))
_EXTRA_SQL = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in _EXTRA)


@query(f"""WITH {ENTITY}, i AS (SELECT lower(trim(name)) AS name, lower(trim(email)) AS email FROM (SELECT attributes->>'$.displayName' AS name, unnest(from_json(attributes->'$.emails', '["VARCHAR"]')) AS email FROM entity WHERE kind = 'actor' UNION SELECT NULL, author_email FROM commit_record WHERE author_email IS NOT NULL UNION SELECT * FROM (VALUES {_EXTRA_SQL})) WHERE trim(email) <> ''),
e AS (SELECT DISTINCT email FROM i), {_ADDRESS_SQL}, j AS (SELECT DISTINCT i.name, i.email, address, regexp_extract(address, '^([^@]*)', 1) AS local, CASE WHEN i.email LIKE '%@users.noreply.github.com' THEN nullif(string_split(split_part(i.email, '@', 1), '+')[-1], '') END AS login FROM i JOIN k USING (email)),
g AS (SELECT unnest([{", ".join(f"'{x}'" for x in P.GENERIC)}]) AS local),
l AS (SELECT email AS a, min(email) OVER (PARTITION BY address) AS b, 'same-address' AS rule, 0.95 AS sure FROM j UNION SELECT address, min(address) OVER (PARTITION BY name, local), 'same-name-and-local-part', 0.5 FROM j WHERE name <> '' AND local NOT IN (FROM g)
 UNION SELECT o.address, min(n.address), 'noreply-login', 0.8 FROM j o JOIN j n ON n.login = o.local WHERE o.login IS NULL AND o.local NOT IN (FROM g) GROUP BY o.address)
SELECT least(a, b) AS left, greatest(a, b) AS right, arg_max(rule, (sure, rule)) AS rule, max(sure)::DOUBLE AS confidence FROM l WHERE a <> b GROUP BY 1, 2""")
def identity_links(spark, d):
    known = entity(spark, d).where(F.col("kind") == "actor").select(R.attribute("displayName").alias("name"), F.explode(F.from_json(F.get_json_object("attributes", "$.emails"), "array<string>")).alias("email"))
    mails = table(spark, d, "commit_record").select(F.lit(None).cast("string").alias("name"), F.col("author_email").alias("email"))
    return P.identity_links(known.unionByName(mails).unionByName(spark.createDataFrame(_EXTRA, "name string, email string")))


@query(f"""WITH {ENTITY}, n AS (SELECT DISTINCT id AS record_id, source_system AS system, attributes->>'$.number' AS key FROM entity WHERE kind = 'issue'), k AS (SELECT min(key) AS key FROM n),
t AS (SELECT 'i:' || row_id AS record_id, 'tracker' AS system, summary || ' ' || coalesce(description, '') AS text FROM jira_issue UNION ALL SELECT 'd:' || doc_id, 'wiki', text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'q', 'mail', 'see ' || key || ', and x' || key || ' not' FROM k),
r AS (SELECT DISTINCT record_id, system, unnest(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9_-])', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z][A-Z0-9_]+-[0-9]+)(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) AS key FROM t)
SELECT least(r.record_id, n.record_id) AS left, greatest(r.record_id, n.record_id) AS right, 'quoted-key' AS rule, 0.8::DOUBLE AS confidence FROM r JOIN n USING (key) WHERE r.system <> n.system GROUP BY 1, 2""")
def resolve_issues(spark, d):
    """Issues of the directory whose keys other systems' texts quote."""
    rows = entity(spark, d).where(F.col("kind") == "issue")
    keys = rows.select(F.col("id").alias("record_id"), F.col("source_system").alias("system"), R.attribute("number").alias("key"))
    j = table(spark, d, "jira_issue").select(F.concat(F.lit("i:"), F.col("row_id").cast("string")).alias("record_id"), F.lit("tracker").alias("system"), F.concat_ws(" ", "summary", F.coalesce("description", F.lit(""))).alias("text"))
    docs = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("record_id"), F.lit("wiki").alias("system"), "text")
    quoting = keys.agg(F.min("key").alias("key")).select(F.lit("q").alias("record_id"), F.lit("mail").alias("system"), F.concat(F.lit("see "), "key", F.lit(", and x"), "key", F.lit(" not")).alias("text"))
    return P.quoted_issues(j.unionByName(docs).unionByName(quoting), keys)


_MAILMAP = (("Dana", "dana@corp.example", None, "danna@dev.example", 1), ("Pado P", None, None, None, 2), ("P. Ado", "pado@corp.example", "twin", "pado@dev.example", 3), ("Pado", "pado@dev.example", None, None, 4), ("Last", "last@corp.example", None, "danna@dev.example", 5))
_MAILMAP_SQL = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in _MAILMAP)


@query(rf"""WITH m AS (SELECT * FROM (VALUES {_MAILMAP_SQL}) v(proper_name, proper_email, commit_name, commit_email, line_no)), i AS (SELECT DISTINCT author_email AS email, n AS name FROM commit_record, (SELECT unnest(['Twin', 'Someone']) AS n) WHERE author_email IS NOT NULL),
r AS (SELECT i.*, m.proper_name AS pn, m.proper_email AS pe, CASE WHEN commit_name IS NOT NULL THEN 0 WHEN commit_email IS NOT NULL THEN 1 ELSE 2 END AS kind, line_no FROM i LEFT JOIN m ON lower(trim(coalesce(commit_email, proper_email))) = lower(trim(i.email)) AND (commit_name IS NULL OR lower(commit_name) = lower(i.name)))
SELECT name, email, coalesce(pn, name) AS proper_name, coalesce(pe, email) AS proper_email FROM r QUALIFY row_number() OVER (PARTITION BY name, email ORDER BY kind, line_no DESC) = 1""")
def mailmap(spark, d):
    rows = table(spark, d, "commit_record").where(F.col("author_email").isNotNull()).select(F.col("author_email").alias("email")).distinct()
    people = rows.select(F.explode(F.array(F.lit("Twin"), F.lit("Someone"))).alias("name"), "email")
    rules = spark.createDataFrame(_MAILMAP, "proper_name string, proper_email string, commit_name string, commit_email string, line_no int")
    return P.apply_mailmap(people, rules)


_ALIAS_SQL = """al AS (SELECT 'git' AS system, author_email AS external_id, min(repo_id) AS actor_id, CASE WHEN author_email LIKE '%@%' THEN 'developer' ELSE 'agent' END AS actor_class, min(acquired_at) AS valid_from, NULL::TIMESTAMP AS valid_to FROM commit_record WHERE author_email IS NOT NULL AND acquired_at < TIMESTAMP '2021-01-01' GROUP BY 2)"""


def _aliases(spark, d):
    rows = table(spark, d, "commit_record").where(F.col("author_email").isNotNull())
    kind = F.when(F.col("author_email").contains("@"), "developer").otherwise("agent")
    return rows.select(F.lit("git").alias("system"), F.col("author_email").alias("external_id"), F.col("repo_id").alias("actor_id"), kind.alias("actor_class"), "acquired_at")


_EARLY = "2021-01-01 00:00:00"


def _held(spark, d):
    first = _aliases(spark, d).where(F.col("acquired_at") < F.lit(_EARLY).cast("timestamp_ntz")).groupBy("system", "external_id", "actor_class")
    return first.agg(F.min("actor_id").alias("actor_id"), F.min("acquired_at").alias("valid_from")).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))


@query(f"""WITH {_ALIAS_SQL}, p AS (SELECT DISTINCT 'git' AS system, author_email AS external_id, repo_id AS actor_id, CASE WHEN author_email LIKE '%@%' THEN 'developer' ELSE 'agent' END AS actor_class FROM commit_record WHERE author_email IS NOT NULL AND acquired_at >= TIMESTAMP '2021-01-01')
SELECT p.system, p.external_id, p.actor_id, CASE WHEN al.actor_id IS NULL THEN 'linked' WHEN al.actor_id = p.actor_id THEN 'unchanged' ELSE 'collision' END AS outcome, al.actor_id AS existing_actor, CASE WHEN al.actor_id <> p.actor_id THEN al.actor_class <> p.actor_class END AS crosses_class FROM p LEFT JOIN al ON al.external_id = p.external_id""")
def identity_collisions(spark, d):
    """Later addresses claimed for repositories against the aliases in force before 2021."""
    late = _aliases(spark, d).where(F.col("acquired_at") >= F.lit(_EARLY).cast("timestamp_ntz")).drop("acquired_at").distinct()
    return P.link_aliases(_held(spark, d), late)


@query(f"""WITH {_ALIAS_SQL}, mg AS (SELECT 'repo-00000' AS s, 'repo-00001' AS m UNION ALL SELECT 'repo-00002', 'repo-00003'), hit AS (SELECT al.*, s FROM al LEFT JOIN mg ON al.actor_id = m),
rows_ AS (SELECT system, external_id, actor_id, valid_from, CASE WHEN s IS NOT NULL THEN TIMESTAMP '2021-01-01' ELSE valid_to END AS valid_to FROM hit UNION ALL SELECT system, external_id, s, TIMESTAMP '2021-01-01', NULL FROM hit WHERE s IS NOT NULL)
SELECT actor_id, external_id, epoch_us(valid_from) AS from_us, epoch_us(valid_to) AS to_us FROM rows_""")
def identity_merge(spark, d):
    """The alias table after two merges; merged people keep their past."""
    merges = spark.createDataFrame([("repo-00000", "repo-00001"), ("repo-00002", "repo-00003")], "survivor_id string, merged_id string")
    # one class of actors: repositories stand in for people here
    aliases = _held(spark, d).withColumn("actor_class", F.lit("developer"))
    after = P.merge_actors(aliases, merges, F.lit(_EARLY).cast("timestamp_ntz"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return after.select("actor_id", "external_id", us("valid_from").alias("from_us"), us("valid_to").alias("to_us"))


@query(f"WITH {_ALIAS_SQL} SELECT system, external_id, actor_id FROM al WHERE valid_from <= TIMESTAMP '2020-06-01'")
def alias_as_of(spark, d):
    return P.strongest_alias(_held(spark, d), F.lit("2020-06-01 00:00:00").cast("timestamp_ntz")).select("system", "external_id", "actor_id")


# ------------------------------------------------------------------ edges, artifacts, marks
_ASSERTED = """ev AS (SELECT user_id::VARCHAR AS from_id, event_type AS to_id, ts AS valid_from, CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 1 HOUR END AS valid_to, 'log' AS source_system, md5(event_type || value::VARCHAR) AS content_hash, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id DESC) = 1),
st AS (SELECT * FROM ev WHERE event_id % 3 <> 0), inc AS (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN 'x' ELSE content_hash END AS content_hash) FROM ev WHERE event_id % 3 <> 1)"""


def _asserted(spark, d):
    rows = table(spark, d, "events")
    edge = rows.select(
        F.col("user_id").cast("string").alias("from_id"), F.lit("user_did").alias("type"), F.col("event_type").alias("to_id"), F.col("ts").alias("valid_from"), F.when(F.col("event_id") % 7 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("valid_to"),
        F.lit("log").alias("source_system"), F.md5(F.concat("event_type", F.col("value").cast("string"))).alias("content_hash"), "event_id",
    )
    return newest(edge, ["from_id", "type", "to_id", "valid_from"], [F.col("event_id")], ["valid_to", "source_system", "content_hash", "event_id"])


@query(f"""WITH {_ASSERTED}, o AS (SELECT from_id, to_id, min(valid_from) AS open_from FROM st WHERE valid_to IS NULL GROUP BY 1, 2),
m AS (SELECT i.from_id, i.to_id, i.valid_from, i.valid_to, CASE WHEN s.from_id IS NOT NULL AND s.content_hash = i.content_hash THEN 'unchanged' WHEN s.from_id IS NOT NULL AND s.valid_to IS NOT NULL AND i.valid_to IS NULL THEN 'unchanged'
 WHEN s.from_id IS NULL AND i.valid_to IS NULL AND o.open_from <= i.valid_from THEN 'unchanged' WHEN s.from_id IS NOT NULL THEN 'updated' ELSE 'opened' END AS outcome
 FROM inc i LEFT JOIN st s ON s.from_id = i.from_id AND s.to_id = i.to_id AND s.valid_from = i.valid_from LEFT JOIN o ON o.from_id = i.from_id AND o.to_id = i.to_id),
n AS (SELECT from_id, valid_from, lead(valid_from) OVER (PARTITION BY from_id ORDER BY valid_from) AS nx FROM (SELECT from_id, valid_from FROM st UNION SELECT from_id, valid_from FROM inc))
SELECT m.from_id, m.to_id, epoch_us(m.valid_from) AS from_us, epoch_us(CASE WHEN outcome <> 'unchanged' AND nx IS NOT NULL THEN least(coalesce(m.valid_to, nx), nx) ELSE m.valid_to END) AS to_us, outcome FROM m JOIN n ON n.from_id = m.from_id AND n.valid_from = m.valid_from""")
def assert_edges(spark, d):
    """What each asserted edge comes to against the stored ones; a user does one thing at a time."""
    rows = _asserted(spark, d)
    stored = rows.where(F.col("event_id") % 3 != 0).drop("event_id")
    incoming = rows.where(F.col("event_id") % 3 != 1).withColumn("content_hash", F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("content_hash"))).drop("event_id")
    done = U.assert_edges(stored, incoming, ("user_did",))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return done.select("from_id", "to_id", us("valid_from").alias("from_us"), us("valid_to").alias("to_us"), "outcome")


@query(f"""WITH {EVIDENCE}, a AS (SELECT subject_id AS scope_id, arg_max((producer, producer_version, source_id), (recorded_at, evidence_id)) AS m FROM evidence WHERE recorded_at < TIMESTAMP '2022-01-01' GROUP BY 1),
w AS (SELECT subject_id AS scope_id, arg_max((producer, producer_version, source_id), (recorded_at, evidence_id)) AS m FROM evidence GROUP BY 1),
v AS (SELECT w.scope_id, CASE WHEN a.scope_id IS NULL THEN 'missing' WHEN a.m[1] IS DISTINCT FROM w.m[1] THEN 'producer' WHEN a.m[2] IS DISTINCT FROM w.m[2] THEN 'version' WHEN a.m[3] IS DISTINCT FROM w.m[3] THEN 'source' ELSE 'valid' END AS reason FROM w LEFT JOIN a ON a.scope_id = w.scope_id)
SELECT scope_id, reason = 'valid' AS valid, reason FROM v""")
def artifact_gate(spark, d):
    """Whether what was last made about a subject before 2022 still stands."""
    rows = evidence(spark, d).withColumnsRenamed({"subject_id": "scope_id", "source_id": "source_hash"})
    last = lambda df: newest(df, ["scope_id"], [F.col("recorded_at"), F.col("evidence_id")], ["producer", "producer_version", "source_hash"])
    return U.artifact_gate(last(rows), last(rows.where(F.col("recorded_at") < F.lit("2022-01-01 00:00:00").cast("timestamp_ntz"))))


_BELIEVED = "evidence WHERE evidence_state IN ('current', 'conflicting')"


@query(f"""WITH {EVIDENCE}, k AS (SELECT subject_id, field_name FROM {_BELIEVED} GROUP BY ALL HAVING count(DISTINCT statement) > 1 AND count(DISTINCT source_system) > 1),
n AS (SELECT e.*, CASE WHEN evidence_state NOT IN ('current', 'conflicting') THEN evidence_state WHEN EXISTS (SELECT 1 FROM k WHERE k.subject_id = e.subject_id AND k.field_name IS NOT DISTINCT FROM e.field_name) THEN 'conflicting' ELSE 'current' END AS new_state FROM evidence e)
SELECT evidence_id, new_state AS evidence_state, new_state <> evidence_state AS changed FROM n""")
def conflict_states(spark, d):
    return U.reconcile_conflicts(evidence(spark, d))


_HALF = "(SELECT * FROM entity_update WHERE recorded_at {} TIMESTAMP '2022-01-01' QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC, delivery_id DESC) = 1)"


@query(f"""SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'kept' WHEN a.id IS NULL THEN 'created' WHEN a.content_hash = b.content_hash THEN 'unchanged' ELSE 'updated' END AS outcome, coalesce(a.lifecycle, b.lifecycle) AS lifecycle, coalesce(b.content_hash, a.content_hash) AS content_hash
FROM {_HALF.format('<')} a FULL JOIN {_HALF.format('>=')} b ON a.id = b.id""")
def upsert_entities(spark, d):
    rows, cut = table(spark, d, "entity_update"), F.lit("2022-01-01 00:00:00").cast("timestamp_ntz")
    last = lambda df: newest(df, ["id"], [F.col("recorded_at"), F.col("delivery_id")], ["lifecycle", "content_hash"])
    return U.upsert_entities(last(rows.where(F.col("recorded_at") < cut)), last(rows.where(F.col("recorded_at") >= cut)))


_NOW = "2023-01-01 00:00:00"


@query(f"""WITH c AS (SELECT repo_id, sha, TRY_CAST(replace(committed_at, 'Z', '') AS TIMESTAMP) AS moment, sha IS NOT NULL AND coalesce(parents, ['']) <> [NULL] AND committed_at IS NOT NULL AS ok, acquired_at FROM commit_record),
p AS (SELECT repo_id, max(moment) AS last_commit, arg_max(sha, (moment, sha)) AS tip FROM c WHERE acquired_at < TIMESTAMP '2021-06-01' GROUP BY 1), n AS (SELECT repo_id, max(moment) AS newest, arg_max(sha, (moment, sha)) AS tip, repo_id < 'repo-00010' AS complete FROM c WHERE acquired_at >= TIMESTAMP '2021-06-01' GROUP BY 1)
SELECT coalesce(n.repo_id, p.repo_id) AS repo_id, epoch_us(CASE WHEN coalesce(complete, false) THEN least(greatest(coalesce(last_commit, newest), newest), TIMESTAMP '{_NOW}') ELSE last_commit END) AS last_us,
CASE WHEN coalesce(complete, false) THEN list_concat([n.tip], CASE WHEN p.tip IS NOT NULL AND p.tip <> n.tip THEN [p.tip] ELSE [] END) WHEN p.tip IS NULL THEN []::VARCHAR[] ELSE [p.tip] END AS tips, coalesce(complete, false) AS advanced FROM n FULL JOIN p ON n.repo_id = p.repo_id""")
def watermark(spark, d):
    """How far each repository is read after two reads; those from the tenth repository on were cut short."""
    at = F.try_to_timestamp(F.replace("committed_at", F.lit("Z"), F.lit(""))).cast("timestamp_ntz")
    rows = table(spark, d, "commit_record").select("repo_id", "sha", at.alias("committed"), "acquired_at", (F.col("repo_id") < "repo-00010").alias("complete"))
    cut = F.lit("2021-06-01 00:00:00").cast("timestamp_ntz")
    none = rows.limit(0).select("repo_id", F.col("committed").alias("last_commit"), F.array("sha").alias("tips"))
    now = F.lit(_NOW).cast("timestamp_ntz")
    first = U.advance_marks(none, rows.where(F.col("acquired_at") < cut).withColumn("complete", F.lit(True)), F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")).drop("advanced")
    done = U.advance_marks(first, rows.where(F.col("acquired_at") >= cut), now)
    return done.select("repo_id", F.unix_micros(F.col("last_commit").cast("timestamp")).alias("last_us"), "tips", "advanced")


@query("""WITH c AS (SELECT user_id AS session_id, (event_id % 5 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS seq FROM events), l AS (SELECT *, lag(seq) OVER (PARTITION BY session_id ORDER BY seq) AS b FROM c)
SELECT session_id, seq AS sequence, CASE WHEN seq < 1 THEN 'not-positive' WHEN seq = b THEN 'repeated' WHEN seq > coalesce(b, 0) + 1 THEN 'gap' END AS fault FROM l WHERE seq < 1 OR seq = b OR seq > coalesce(b, 0) + 1""")
def capture_sequence(spark, d):
    """Faults in the numbering of captures of each session."""
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 5 + nth - 1).alias("sequence"))
    return U.capture_faults(rows)


_LADDER = "CASE method WHEN 'observed' THEN 80 WHEN 'parsed' THEN 60 WHEN 'inferred' THEN 40 WHEN 'aggregated' THEN 40 WHEN 'generated' THEN 20 WHEN 'asserted' THEN 20 ELSE 0 END"


@query(f"WITH {EVIDENCE}, o AS (SELECT *, CASE source_system WHEN 'git' THEN field_name IN ('path', 'signature', 'configuration') ELSE field_name IN ('title', 'status') END AS own FROM evidence) SELECT evidence_id, CASE WHEN coalesce(own, false) AND method IN ('observed', 'parsed') THEN 100 ELSE {_LADDER} END::INT AS declared FROM o")
def authority_for(spark, d):
    """Authority by method; the system a field belongs to is its system of record."""
    git, other = F.col("field_name").isin("path", "signature", "configuration"), F.col("field_name").isin("title", "status")
    own = F.coalesce(F.when(F.col("source_system") == "git", git).otherwise(other), F.lit(False))
    return evidence(spark, d).select("evidence_id", declared_authority(F.col("method"), own).alias("declared"))


@query("""SELECT file_id, CASE WHEN omitted_reason IS NOT NULL OR (kind = 'executable' AND text_content IS NULL) THEN 'partial' WHEN text_content IS NOT NULL OR kind = 'file' THEN 'complete' ELSE 'unknown' END AS completeness FROM source_file""")
def completeness(spark, d):
    """Whether what was read of a file is all of it: read tells of an omission, enumerated of a listing that ended."""
    read = F.col("omitted_reason").isNotNull() | F.col("text_content").isNotNull() | (F.col("kind") == "file")
    listed = F.when((F.col("kind") == "executable") & F.col("text_content").isNull(), F.lit(False))
    return table(spark, d, "source_file").select("file_id", completeness_of(read, F.col("omitted_reason"), listed.isNotNull(), listed).alias("completeness"))
