"""Registered queries: sessions, durable contexts, planning, gaps, edge retirement."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.functions import identity as I
from lodeline.functions import text as X
from lodeline.operators import graph as G
from lodeline.operators import intervals as V
from lodeline.operators import retrieval as R
from lodeline.operators import search as S
from lodeline.plans.frames import EDGES, ENTITY, edges, entity, newest, registrar
from lodeline.plans.texts import LINE
from lodeline.session import table

QUERIES, ORACLE, query = registrar()


@query("""WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), t AS (SELECT user_id, event_id AS origin FROM c WHERE k = 1)
SELECT origin, event_id AS id, (k - 1)::INT AS depth FROM c JOIN t USING (user_id) WHERE k BETWEEN 2 AND 11""")
def session_lineage(spark, d):
    rows = table(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    links = rows.select(F.col("event_id").alias("id"), F.lag("event_id").over(w).alias("other_id")).where(F.col("other_id").isNotNull())
    tips = newest(rows, ["user_id"], [F.col("ts"), F.col("event_id")], ["event_id"]).select(F.col("event_id").alias("id"))
    return G.closure(links, tips).select("origin", "id", F.col("depth").cast("int").alias("depth"))


@query("SELECT repo_id, count(*) AS absent FROM (SELECT DISTINCT repo_id, unnest(parents) AS sha FROM commit_record) p WHERE NOT EXISTS (SELECT 1 FROM commit_record c WHERE c.repo_id = p.repo_id AND c.sha = p.sha) GROUP BY 1")
def memory_evidence_gaps(spark, d):
    rows = table(spark, d, "commit_record")
    cited = rows.select("repo_id", F.explode("parents").alias("sha")).distinct()
    return cited.join(rows.select("repo_id", "sha"), ["repo_id", "sha"], "left_anti").groupBy("repo_id").agg(F.count(F.lit(1)).alias("absent"))


@query(f"""WITH {EDGES}, n AS (SELECT to_id AS origin, from_id AS id FROM edges WHERE type = 'nation_in_region') SELECT origin, id, 1 AS depth FROM n
UNION ALL SELECT n.origin, e.from_id, 2 FROM n JOIN edges e ON e.to_id = n.id AND e.type = 'customer_in_nation'""")
def scope_closure(spark, d):
    kept = edges(spark, d).where(F.col("type").isin("nation_in_region", "customer_in_nation")).select(F.col("to_id").alias("id"), F.col("from_id").alias("other_id"))
    origins = table(spark, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"))
    return G.closure(kept, origins, 6)


@query("""WITH s AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY 1), p AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT count(*) AS open_runs, epoch_us(min(s.t)) AS oldest_us FROM s LEFT JOIN p USING (user_id) WHERE p.t IS NULL OR p.t < s.t""")
def unfinished_runs(spark, d):
    rows = table(spark, d, "events")
    begun = rows.where(F.col("event_type") == "signup").groupBy("user_id").agg(F.min("ts").alias("s"))
    done = rows.where(F.col("event_type") == "purchase").groupBy("user_id").agg(F.max("ts").alias("p"))
    left = begun.join(done, "user_id", "left").where(F.col("p").isNull() | (F.col("p") < F.col("s")))
    return left.agg(F.count(F.lit(1)).alias("open_runs"), F.unix_micros(F.min("s").cast("timestamp")).alias("oldest_us"))


# ------------------------------------------------------------------ planning, vectors, edges
@query("""WITH n AS (SELECT vec_id, label + 1 AS label FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE label = 9)
SELECT coalesce(o.vec_id, n.vec_id) AS vec_id, coalesce(n.label, o.label)::INT AS label, n.vec_id IS NOT NULL AS written FROM embeddings o FULL JOIN n ON o.vec_id = n.vec_id""")
def embedding_upsert(spark, d):
    old = table(spark, d, "embeddings").select("vec_id", "label")
    new = old.where(F.col("label") < 3).select("vec_id", (F.col("label") + 1).alias("new")).unionByName(old.where(F.col("label") == 9).select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.col("label").alias("new")))
    return old.join(new, "vec_id", "full_outer").select("vec_id", F.coalesce("new", "label").cast("int").alias("label"), F.col("new").isNotNull().alias("written"))


@query(f"""WITH {EDGES}, g AS (SELECT DISTINCT 'customer:' || o_custkey AS f, 'order:' || o_orderkey AS t FROM orders WHERE o_orderstatus = 'F')
SELECT from_id, to_id, epoch_us(CASE WHEN g.f IS NOT NULL AND valid_to IS NULL AND valid_from <= TIMESTAMP '1998-01-01' THEN TIMESTAMP '1998-01-01' ELSE valid_to END) AS to_us FROM edges LEFT JOIN g ON from_id = g.f AND to_id = g.t WHERE type = 'customer_placed_order'""")
def retire_edges(spark, d):
    kept = edges(spark, d).where(F.col("type") == "customer_placed_order")
    gone = table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("from_id"), F.lit("customer_placed_order").alias("type"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("to_id"))
    done = V.retire(kept, gone, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    return done.select("from_id", "to_id", F.unix_micros(F.col("valid_to").cast("timestamp")).alias("to_us"))
