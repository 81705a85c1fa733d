"""One object with the read operations over a set of canonical tables; every method returns a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators import access as A
from lodeline.operators import graph as G
from lodeline.operators import ledger as L
from lodeline.operators import retrieval as R
from lodeline.operators import search as S

PAGE = R.DEFAULT_LIMIT


@dataclass(frozen=True)
class Tables:
    """entities(id, kind, source_system, source_id, source_scope, lifecycle, attributes, observed_at), evidence(evidence_id,
    subject_id, field_name, statement, source_system, authority, confidence, observed_at, evidence_state, permission_scope),
    edges(from_id, type, to_id, valid_from, valid_to)."""

    entities: DataFrame
    evidence: DataFrame
    edges: DataFrame


class Engine:
    """Reads with a caller's access applied before anything is ranked, counted or walked through."""

    def __init__(self, tables: Tables, access: A.Access | None = None):
        access = access or A.Access()
        reason = A.withheld_reason(F.col("source_scope"), R.attribute("path"), F.col("observed_at"), access)
        self.all_entities, self.reason, self.access = tables.entities, reason, access
        self.entities = A.visible(tables.entities, reason)
        # evidence is seen by those who may see both it and what it is about
        told = tables.evidence.where(A.permitted(F.col("permission_scope"), access.grants))
        self.evidence = told.join(self.entities.select(F.col("id").alias("subject_id")), "subject_id", "left_semi")
        self.edges = tables.edges

    def get_entity(self, entity_id: str) -> DataFrame:
        """The entity, or nothing; what is withheld cannot be told from what does not exist."""
        return self.entities.where(F.col("id") == entity_id)

    def find(self, limit: int = PAGE, offset: int = 0, **filters) -> DataFrame:
        """A page of entities that meet all filters (see operators.retrieval.find_entities)."""
        return R.page(R.find_entities(self.entities, **filters), ["kind", "source_id", "id"], limit, offset)

    def withheld(self) -> DataFrame:
        return A.withheld_tally(self.all_entities, self.reason)

    def _ranked(self, hits: DataFrame) -> DataFrame:
        believed = self.evidence.where(F.col("evidence_state") == "current").groupBy(F.col("subject_id").alias("id"))
        auth = believed.agg(F.max(L.effective_authority(F.col("authority"))).alias("auth"))
        ranked = hits.join(self.entities, "id").join(auth, "id", "left").withColumn("auth", F.coalesce("auth", F.lit(L.UNDECLARED_AUTHORITY)))
        return ranked.withColumn("standing", S.standing(F.col("lifecycle")))

    def _hits(self, q: S.Query) -> DataFrame:
        text = F.concat_ws(" ", *[R.attribute(f) for f in ("name", "description", "path", "title", "statement")], F.translate(R.attribute("path"), "/-_.", "    "), F.col("source_id"))
        own = S.search(self.entities, "id", text, q).select("id", "score")
        told = S.search(self.evidence.withColumn("pair", F.struct("subject_id", "evidence_id")), "pair", F.col("statement"), q)
        told = told.groupBy(F.col("pair.subject_id").alias("id")).agg(F.max("score").alias("score"))
        hits = own.unionByName(told).groupBy("id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("sources"))
        return self._ranked(hits)

    def search(self, line: str, limit: int = PAGE) -> DataFrame:
        """Ranked hits. What a line names exactly (an id, a path, a source id) is the answer; a line that names nothing is
        searched strictly, and relaxed hits fill up behind."""
        line, limit = line.strip()[:1024], R.clamp_limit(limit)
        exact = self.entities.where((F.col("id") == line) | (R.attribute("path") == line) | (F.col("source_id") == line))
        exact = self._ranked(exact.select("id", F.lit(1.0).alias("score"), F.lit(1).cast("long").alias("sources"))).withColumn("tier", F.lit(0))
        q = S.parse(line)
        hits = exact
        if q.terms:
            loose = self._hits(q).withColumn("tier", F.lit(1))
            if S.relaxed(q) != q:
                loose = loose.unionByName(self._hits(S.relaxed(q)).withColumn("tier", F.lit(2)))
            unnamed = exact.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)  # one row or none
            hits = exact.unionByName(loose.join(F.broadcast(unnamed), how="left_semi"))
        best = G.first_of(hits, ["id"], [F.col("tier"), F.col("score").desc()])
        return best.orderBy("tier", *S.rank_order()).limit(limit)

    def explain(self, line: str, limit: int = PAGE) -> DataFrame:
        """The hits of a search, each with the first sort key in which it stays behind the one above it."""
        return S.why_below(self.search(line, limit), [("tier", False), ("standing", False), ("score", True), ("auth", True), ("observed_at", True), ("kind", False), ("source_id", False), ("id", False)])

    def neighbours(self, entity_id: str, depth: int = 1, types: tuple[str, ...] = (), at: str | None = None) -> DataFrame:
        """One hop: edges; more: nodes with their distance. Nodes the caller may not see end the walk."""
        spark = self.entities.sparkSession
        origin = spark.createDataFrame([(entity_id,)], "id string").join(self.entities.select("id"), "id", "left_semi")  # a hidden origin has no neighbours
        when = None if at is None else F.lit(at).cast("timestamp_ntz")
        visible = self.entities.select("id")
        if not 1 <= depth <= G.MAX_DEPTH:
            raise ValueError(f"depth must be between 1 and {G.MAX_DEPTH}")
        if depth <= 1:
            return G.neighbours(self.edges, origin, when, types).join(visible.withColumnRenamed("id", "other_id"), "other_id", "left_semi")
        from lodeline.operators.intervals import holds_at

        kept = self.edges.where(F.col("type").isin(list(types))) if types else self.edges
        kept = kept.where(F.col("valid_to").isNull() if when is None else holds_at(when))
        return G.traverse(G.both_ways(kept), origin, depth, visible)

    def why(self, entity_id: str) -> DataFrame:
        """The evidence about an entity, best first, with what it conflicts with."""
        rows = self.evidence.where(F.col("subject_id") == entity_id)
        disputed = L.conflicts(rows).select("field_name", F.lit(True).alias("disputed"))
        ranked = L.select(rows, R.MAX_LIMIT)
        key = F.coalesce("field_name", F.lit("\u0000"))
        return ranked.withColumn("k", key).join(disputed.withColumn("k", key).drop("field_name"), "k", "left").drop("k").withColumn("disputed", F.coalesce("disputed", F.lit(False)))

    def answer(self, entity_id: str) -> DataFrame:
        """One preferred statement for each field of an entity, where the evidence allows one."""
        return L.preferred(self.evidence.where(F.col("subject_id") == entity_id)).select("field_name", "statement", "evidence_id", "confidence")

    def contexts(self, kind: str = "context") -> DataFrame:
        """Durable contexts in force, the latest observed first."""
        return self.entities.where((F.col("kind") == kind) & (F.col("lifecycle") == "active")).orderBy(F.col("observed_at").desc(), "id")

    def context_pack(self, line: str, budget: int = 4_000, limit: int = 20) -> tuple[DataFrame, DataFrame]:
        """(entries, omissions) for a question: contexts in force first, then hits, within a budget of estimated tokens."""
        from pyspark.sql import Window as W

        from lodeline.functions.text import estimate_tokens
        from lodeline.operators.contexts import pack

        cost = estimate_tokens(F.coalesce("attributes", F.lit("")))
        standing = self.contexts().limit(500).select("id", F.row_number().over(W.orderBy(F.col("observed_at").desc(), "id")).alias("rank"), cost.alias("tokens"))
        hits = self.search(line, min(5 * limit, R.MAX_LIMIT))
        items = hits.select("id", F.row_number().over(W.orderBy("tier", *S.rank_order())).alias("rank"), cost.alias("tokens"))  # a page
        return pack(standing, items, budget, most_items=limit)
