"""Durable contexts: statements that stay in force across sessions, merged, compared, promoted, judged and packed.

A context is (id, kind, subject_id, scope, normal, lifecycle, recorded_at): ``normal`` is its normalised statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.functions.identity import content_hash
from lodeline.operators import ledger as L
from lodeline.session import cut

NEAR = 0.8  # fixed value: shared words of two statements from which they are near
CANDIDATES = 25  # fixed value
# fixed values: what acting against a statement costs, dearest first
KIND_ORDER = ("constraint", "decision", "gotcha", "preference", "fact", "next-step")
# fixed values: move -> (states it may start from, state it leads to)
MOVES = {"accept": (("candidate",), "active"), "archive": (("active", "candidate"), "archived"), "reinstate": (("archived",), "active"), "supersede": (("active", "candidate", "archived"), "superseded")}


def context_id(kind: Column, subject: Column, normal: Column) -> Column:
    return content_hash(F.to_json(F.struct(kind.alias("contextKind"), normal.alias("normalized"), subject.alias("subjectId"))))


def words_of(normal: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normal, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def merged(statements: DataFrame) -> DataFrame:
    """One context for each (kind, subject, normal): (id, ..., reports, first_at, last_at). Equal ids are one statement."""
    key = context_id(F.col("kind"), F.col("subject_id"), F.col("normal"))
    rows = statements.withColumn("id", key).groupBy("id")
    newest = F.max_by(F.struct("kind", "subject_id", "scope", "normal", "lifecycle"), F.struct("recorded_at", "row_key"))
    return rows.agg(newest.alias("c"), F.count(F.lit(1)).alias("reports"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at")).select("id", "c.*", "reports", "first_at", "last_at")


def near_pairs(contexts: DataFrame, same: list[str], threshold: float = NEAR) -> DataFrame:
    """(a, b, similarity): contexts that agree in ``same`` and share at least ``threshold`` of their words; a < b.

    Exact: contexts with the same set of words meet as one class first; classes then meet under the rarest words of each
    set, as many as two similar sets must share one of. Members of a class are linked to its least, and two near classes
    by their least members, so copies are not expanded into all pairs and no link between different texts is lost.
    """
    rows = contexts.select("id", *same, F.array_sort(words_of(F.col("normal"))).alias("w")).where(F.size("w") > 0)
    for c in same:
        rows = rows.where(F.col(c).isNotNull())
    keyed = cut(rows.withColumn("sig", F.xxhash64("w")))
    classes = cut(keyed.groupBy(*same, "w").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    copies = keyed.join(classes.where(F.col("n") > 1), [*same, "w"]).where(F.col("id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    words = classes.select(*same, "rep", F.size("w").alias("size"), F.explode("w").alias("g"))
    ranked = words.join(words.groupBy(*same, "g").agg(F.count(F.lit(1)).alias("df")), [*same, "g"])
    nth = F.row_number().over(W.partitionBy(*same, "rep").orderBy("df", "g"))
    prefix = ranked.withColumn("nth", nth).where(F.col("nth") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).select(*same, "rep", "size", "g")
    other = prefix.select(*same, F.col("rep").alias("b"), F.col("size").alias("size_b"), "g")
    fits = (F.col("rep") < F.col("b")) & (F.col("size") >= F.col("size_b") * threshold) & (F.col("size_b") >= F.col("size") * threshold)
    pairs = prefix.join(other, [*same, "g"]).where(fits).select(F.col("rep").alias("a"), "b").distinct()
    sets = classes.select(F.col("rep"), "w")
    both = pairs.join(sets.withColumnsRenamed({"rep": "a", "w": "wa"}), "a").join(sets.withColumnsRenamed({"rep": "b", "w": "wb"}), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    scored = both.select("a", "b", (common / (F.size("wa") + F.size("wb") - common)).alias("similarity")).where(F.col("similarity") >= threshold)
    return scored.unionByName(copies)


def candidates(contexts: DataFrame, asked: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(id, candidate, shared, rank): for each asked active context the others of its scope and kind with the most words in
    common, at most ``most`` (the feature); counted by an equi-join on words, words no other has drop out."""
    live = contexts.where(F.col("lifecycle") == "active").select("id", "scope", "kind", F.explode(words_of(F.col("normal"))).alias("g"))
    of = live.join(asked.select("id").distinct(), "id", "left_semi").withColumnRenamed("id", "asked")
    met = of.join(live, ["scope", "kind", "g"]).where(F.col("asked") != F.col("id")).groupBy("asked", "id").agg(F.count(F.lit(1)).alias("shared"))
    w = W.partitionBy("asked").orderBy(F.desc("shared"), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(F.col("asked").alias("id"), F.col("id").alias("candidate"), "shared", "rank")


def lifecycle_fold(moves: DataFrame, start: str = "candidate") -> DataFrame:
    """(id, seq, move, outcome, state): moves of each context in order, each applied only from a state it may start from.

    The state machine has a handful of states, so a history is folded as a composition of small maps: one array a context
    is folded in place; contexts have few moves.
    """
    ordered = moves.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "move"))).alias("m"))
    init = F.struct(F.lit(start).alias("state"), F.array().cast("array<struct<seq:bigint,move:string,outcome:string,state:string>>").alias("log"))

    def step(acc, x):
        state = acc["state"]
        to = F.lit(None).cast("string")
        for name, (sources, target) in MOVES.items():
            to = F.when((x["move"] == name) & state.isin(*sources), target).otherwise(to)
        after = F.coalesce(to, state)
        row = F.struct(x["seq"].cast("bigint").alias("seq"), x["move"].alias("move"), F.when(to.isNotNull(), "applied").otherwise("refused").alias("outcome"), after.alias("state"))
        return F.struct(after.alias("state"), F.concat(acc["log"], F.array(row)).alias("log"))

    return ordered.select("id", F.explode(F.aggregate("m", init, step)["log"]).alias("r")).select("id", "r.*")


def promotion(memories: DataFrame) -> DataFrame:
    """(memory_id, refusal, state, confidence): superseded memories and unknown kinds are refused; what was said outright
    becomes active, what was only extracted a candidate."""
    refusal = F.when(F.col("superseded_by").isNotNull(), "superseded").when(~F.coalesce(F.col("kind").isin(*KIND_ORDER), F.lit(False)), "unknown-kind")
    state = F.when(refusal.isNull(), F.when(F.col("origin") == "explicit", "active").otherwise("candidate"))
    return memories.select("memory_id", refusal.alias("refusal"), state.alias("state"), F.when(refusal.isNull(), F.col("confidence")).alias("confidence"))


def trust(contexts: DataFrame, support: DataFrame, contradictions: DataFrame, superseding: DataFrame) -> DataFrame:
    """(id, current, support, preferred, authority, undecided, contradicted, superseded_by, reason).

    ``support`` is current evidence (evidence_id, subject_id, field_name, statement, source_system, authority, confidence,
    observed_at), ``contradictions`` (a, b), ``superseding`` (id, superseded_by).
    """
    one = support.withColumn("field_name", F.lit("support"))
    counts = one.groupBy(F.col("subject_id").alias("id")).agg(F.count(F.lit(1)).alias("support"))
    best = L.preferred(one).select(F.col("subject_id").alias("id"), F.col("evidence_id").alias("preferred"), "authority")
    ends = contradictions.select(F.col("a").alias("id")).unionByName(contradictions.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("contradicted"))
    rows = contexts.select("id", "lifecycle").join(counts, "id", "left").join(best, "id", "left").join(ends, "id", "left").join(superseding, "id", "left").na.fill(0, ["support", "contradicted"])
    undecided = (F.col("support") > 1) & F.col("preferred").isNull()
    reason = (
        F.when(F.col("lifecycle") == "candidate", "proposed").when(F.col("lifecycle") == "archived", "retired").when(F.col("lifecycle") == "superseded", "replaced").when(F.col("lifecycle") == "deleted", "removed")
        .when(F.col("lifecycle") != "active", "unrecognised").when(F.col("support") == 0, "unsupported").when(F.col("preferred").isNull(), F.when(F.col("contradicted") > 0, "contradicted-undecided").otherwise("undecided"))
        .when(F.col("contradicted") > 0, "contradicted").otherwise("supported")
    )
    return rows.select("id", (F.col("lifecycle") == "active").alias("current"), "support", "preferred", "authority", undecided.alias("undecided"), "contradicted", "superseded_by", reason.alias("reason"))


def standing_order() -> list[Column]:
    """Current first, then by kind, authority, support and id (needs current, kind, authority, support, id)."""
    rank = F.lit(len(KIND_ORDER))
    for i, kind in reversed(list(enumerate(KIND_ORDER))):
        rank = F.when(F.col("kind") == kind, i).otherwise(rank)
    return [(~F.col("current")).cast("int"), rank, L.effective_authority(F.coalesce("authority", F.lit(0))).desc(), F.col("support").desc(), F.col("id")]


def verify_anchors(observations: DataFrame, current: DataFrame) -> DataFrame:
    """(id, verdict): verified if every anchored file of some observation is as it was, unknown if a file has no known
    state now, else stale; contexts that are superseded or not in force are not looked at.

    ``observations`` is (id, lifecycle, superseded, observation_no, path, content_hash), path null without an anchor;
    ``current`` is (path, now_hash).
    """
    rows = observations.join(current, "path", "left")
    each = rows.groupBy("id", "lifecycle", "superseded", "observation_no").agg(
        F.count("path").alias("anchors"), F.bool_and(F.col("path").isNull() | F.coalesce(F.col("now_hash") == F.col("content_hash"), F.lit(False))).alias("same"), F.bool_or(F.col("path").isNotNull() & F.col("now_hash").isNull()).alias("lost")
    )
    sums = each.groupBy("id", "lifecycle", "superseded").agg(F.sum("anchors").alias("anchors"), F.bool_or(F.col("same") & (F.col("anchors") > 0)).alias("held"), F.max_by("lost", "observation_no").alias("lost"))
    verdict = (
        F.when(F.col("superseded") | (F.col("lifecycle") == "superseded"), "superseded").when(F.col("lifecycle").isin("archived", "deleted") | (F.col("anchors") == 0), "unanchored")
        .when(F.col("held"), "verified").when(F.col("lost"), "unknown").otherwise("stale")
    )
    return sums.select("id", verdict.alias("verdict"))


def pack(standing: DataFrame, items: DataFrame, budget: int, most_standing: int = 10, most_items: int = 20) -> tuple[DataFrame, DataFrame]:
    """(entries, omissions) of one answer: standing contexts first, then items, in rank order, each admitted if it fits
    into what is left of the budget, later ones tried when an earlier one does not fit.

    ``standing`` and ``items`` are ranked rows (id, rank, tokens); at most 500 of each are looked at, so the sequence is
    folded as one array. ``entries`` is (part, id, rank, tokens); ``omissions`` is (reason, part, n).
    """
    def listed(rows: DataFrame, part: str, most: int) -> DataFrame:
        return rows.orderBy("rank").limit(500).select(F.lit(part).alias("part"), "id", F.col("rank").cast("int").alias("rank"), F.col("tokens").cast("long").alias("tokens"), F.lit(most).alias("most"))

    both = listed(standing, "0-standing", most_standing).unionByName(listed(items.join(standing.select("id"), "id", "left_anti"), "1-items", most_items))
    bag = both.groupBy().agg(F.array_sort(F.collect_list(F.struct("part", "rank", "id", "tokens", "most"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.map_from_arrays(F.array(F.lit("0-standing"), F.lit("1-items")), F.array(F.lit(0), F.lit(0))).alias("n"), F.array().cast("array<struct<part:string,rank:int,id:string,tokens:bigint,fate:string>>").alias("log"))

    def step(acc, x):
        full = acc["n"][x["part"]] >= x["most"]
        fits = ~full & (acc["used"] + x["tokens"] <= budget)
        fate = F.when(full, "limit").when(fits, "kept").otherwise("budget")
        count = lambda p: acc["n"][p] + F.when(fits & (x["part"] == p), 1).otherwise(0)
        n = F.map_from_arrays(F.array(F.lit("0-standing"), F.lit("1-items")), F.array(count("0-standing"), count("1-items")))
        row = F.struct(x["part"].alias("part"), x["rank"].alias("rank"), x["id"].alias("id"), x["tokens"].alias("tokens"), fate.alias("fate"))
        return F.struct((acc["used"] + F.when(fits, x["tokens"]).otherwise(0)).alias("used"), n.alias("n"), F.concat(acc["log"], F.array(row)).alias("log"))

    log = bag.select(F.explode(F.aggregate("rows", start, step)["log"]).alias("r")).select("r.*").withColumn("part", F.substring("part", 3, 20))
    entries = log.where(F.col("fate") == "kept").select("part", "id", "rank", "tokens")
    return entries, log.where(F.col("fate") != "kept").groupBy(F.col("fate").alias("reason"), "part").agg(F.count(F.lit(1)).alias("n"))
