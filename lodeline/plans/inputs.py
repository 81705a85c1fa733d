"""Registered queries: readers over texts held in tables, outlines, ingestion that resumes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.functions import text as X
from lodeline.operators import symbols as Y
from lodeline.plans.frames import registrar
from lodeline.session import table
from lodeline.sources import repositories as G
from lodeline.sources.files import markdown_segments as segments
from lodeline.sources.files import parse_csv as csv_shape

QUERIES, ORACLE, query = registrar()

_HEADS = r"""ln AS (SELECT doc_id, g.i - 1 AS line_no, lines[g.i] AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS lines FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '(?m)^#{1,6}\s')), unnest(generate_series(1, len(lines))) AS g(i)),
fe AS (SELECT *, count(*) FILTER (regexp_matches(line, '^\s{0,3}(?:```|~~~)')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS fences FROM ln),
hd AS (SELECT doc_id, line_no::INT AS line_no, length(regexp_extract(line, '^(#{1,6})\s+(.*?)\s*#*\s*$', 1))::INT AS level, regexp_extract(line, '^(#{1,6})\s+(.*?)\s*#*\s*$', 2) AS title FROM fe WHERE fences % 2 = 0 AND regexp_matches(line, '^(#{1,6})\s+(.*?)\s*#*\s*$'))"""


@query(f"WITH {_HEADS} SELECT * FROM hd")
def markdown_segments(spark, d):
    return segments(table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {_HEADS} SELECT doc_id, line_no, title, (SELECT arg_max(p.title, p.line_no) FROM hd p WHERE p.doc_id = hd.doc_id AND p.line_no < hd.line_no AND p.level < hd.level) AS parent FROM hd")
def outline_parent(spark, d):
    """The heading each heading of a document stands under."""
    rows = segments(table(spark, d, "documents"), "doc_id", "text")
    return Y.parents_by_level(rows, ["doc_id"], "line_no", "level", "title", deepest=7).select("doc_id", "line_no", "title", "parent")


@query(r"""WITH h AS (SELECT row_id, [trim(regexp_replace(summary, '\s+', ' ', 'g')), trim(regexp_replace(coalesce(description, ''), '\s+', ' ', 'g')), 'a < b & c', 'last'] AS b FROM jira_issue)
SELECT row_id, g.i AS nth, b[g.i] AS block FROM (SELECT row_id, list_filter(b, lambda x: x <> '') AS b FROM h), unnest(generate_series(1, len(b))) AS g(i)""")
def html_blocks(spark, d):
    """Blocks of a page made of each issue; its text is escaped as a page would."""
    def safe(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    page = F.concat(F.lit("<html><h1 class='t'>"), safe(F.col("summary")), F.lit("</h1><p>"), safe(F.coalesce("description", F.lit(""))), F.lit("</p><ul><li>a &lt; <b>b</b> &amp; c</li><li></li></ul><table><tr><td>last</td></tr></table></html>"))
    rows = table(spark, d, "jira_issue").select("row_id", F.posexplode(X.html_blocks(page)).alias("k", "block"))
    return rows.select("row_id", (F.col("k") + 1).cast("long").alias("nth"), "block")


@query("SELECT row_id, 3 + (row_id % 2 = 0)::INT AS rows, 3 AS columns, (row_id % 2 = 0)::INT AS ragged, 1 AS blank FROM jira_issue")
def parse_csv(spark, d):
    """Shape of a small table with a quoted cell for each issue; every second one has a ragged row."""
    cell = F.concat(F.lit('"'), F.replace(F.concat_ws("\n", "summary", F.coalesce("description", F.lit(""))), F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.concat(F.lit("\ufeffid,text,state\n1,"), cell, F.lit(",open\r\n\n2,plain,closed"), F.when(F.col("row_id") % 2 == 0, "\n3,short").otherwise(""))
    return csv_shape(table(spark, d, "jira_issue").select("row_id", text.alias("text")), "row_id", "text")


_PAGES = """pg AS (SELECT user_id AS scope, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page_no, event_id, event_type, ts FROM events)"""


@query(f"""WITH {_PAGES}, b AS (SELECT scope, min(page_no) AS stop FROM pg WHERE event_id % 17 = 0 GROUP BY 1), g AS (SELECT pg.* FROM pg LEFT JOIN b USING (scope) WHERE (stop IS NULL OR page_no < stop) AND page_no <= 20),
l AS (SELECT scope, count(*) AS pages, max_by([CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END], page_no) AS n, min(ts) AS started, arg_min(event_type = 'view', page_no) AS same FROM g GROUP BY 1),
p AS (SELECT DISTINCT user_id AS scope, user_id * 10 AS old, TIMESTAMP '2023-12-01' AS w FROM events WHERE user_id % 2 = 0)
SELECT s.scope, CASE WHEN l.pages IS NULL OR same THEN old ELSE l.n[1] END AS cursor, epoch_us(CASE WHEN old IS NOT NULL THEN w ELSE started END) AS window_us, coalesce(pages, 0) AS pages, CASE WHEN stop IS NOT NULL THEN 'failed' WHEN same THEN 'unchanged' WHEN l.n[1] IS NOT NULL THEN 'partial' ELSE 'complete' END AS outcome
FROM (SELECT DISTINCT scope FROM pg) s LEFT JOIN l USING (scope) LEFT JOIN b USING (scope) LEFT JOIN p USING (scope)""")
def ingest_resume(spark, d):
    """Where each of many scopes goes on after a batch of pages; every other one had a cursor, some pages fail."""
    w = W.partitionBy("user_id").orderBy("event_id")
    k = F.col("event_id")
    pages = table(spark, d, "events").select(
        F.col("user_id").alias("scope"), F.row_number().over(w).alias("page_no"), F.when(k % 3 != 0, k).alias("next_cursor"), F.col("ts").alias("started"), (k % 17 == 0).alias("failed"), F.col("event_type").alias("digest"), F.lit("view").alias("last_digest")
    )
    even = table(spark, d, "events").where(F.col("user_id") % 2 == 0).select(F.col("user_id").alias("scope"), (F.col("user_id") * 10).alias("cursor"), F.lit("2023-12-01 00:00:00").cast("timestamp_ntz").alias("window_start")).distinct()
    done = G.ingest_pages(even, pages)
    return done.select("scope", "cursor", F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_us"), F.col("pages").cast("long").alias("pages"), "outcome")


@query("SELECT row_id, issue_id AS id, issue_key AS key, summary AS title, status AS state, NULL AS problem FROM jira_issue UNION ALL SELECT -1, NULL, NULL, NULL, NULL, 'unparseable' UNION ALL SELECT -2, NULL, NULL, NULL, NULL, 'no-list'")
def recorded_issues(spark, d):
    """Issues read back from listing bodies as the tracker's interface would have given them."""
    issue = F.struct(F.col("issue_id").alias("id"), F.col("issue_key").alias("key"), F.struct(F.col("summary").alias("summary"), F.struct(F.col("status").alias("name")).alias("status")).alias("fields"))
    bodies = table(spark, d, "jira_issue").select("row_id", F.to_json(F.struct(F.array(issue).alias("issues"))).alias("body"))
    odd = spark.createDataFrame([(-1, "{"), (-2, '{"issues": 3}')], "row_id long, body string")
    return G.recorded(bodies.unionByName(odd), "tracker_issue", "$.issues", keep=("row_id",)).select("row_id", "id", "key", "title", "state", "problem")


@query("""SELECT repo_id, sha, coalesce(parents, []) AS parents, coalesce(author_email, '') AS author_email, subject FROM commit_record WHERE regexp_full_match(sha, '[0-9a-f]{40}') AND len(list_filter(coalesce(parents, []), lambda p: p IS NULL)) = 0""")
def git_history(spark, d):
    """Commits read back from the text a log would have printed for each."""
    rows = table(spark, d, "commit_record").where(~F.exists(F.coalesce("parents", F.array().cast("array<string>")), lambda p: p.isNull()))
    line = F.concat_ws("\x1f", "sha", F.concat_ws(" ", F.coalesce("parents", F.array().cast("array<string>"))), F.lit("n"), F.coalesce("author_email", F.lit("")), F.lit("2020-01-01T00:00:00Z"), "committed_at", "subject")
    texts = rows.select("repo_id", F.concat(line, F.lit("\x00")).alias("text"))
    return G.history(texts).select("repo_id", "sha", "parents", "author_email", "subject")
