"""The evidence ledger: preference, supersession, conflicts, selection. Window functions over (subject, field)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How believable a state is, lower is better; other states come last.
BELIEVABILITY = {"current": 0, "conflicting": 10, "stale": 20, "superseded": 30, "unavailable": 40}
#: Fixed value: undeclared authority ranks between the two lowest declared steps.
UNDECLARED_AUTHORITY = 30
FIELD_RESERVE = 2


def effective_authority(authority: Column) -> Column:
    return F.when(authority == 0, UNDECLARED_AUTHORITY).otherwise(authority)


def believability(state: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in BELIEVABILITY.items():
        out = out.when(state == name, rank)
    return out.otherwise(50)


def superseded(rows: DataFrame) -> DataFrame:
    """Adds ``superseded``: the same system has observed the same field of the subject later."""
    newest = F.max("observed_at").over(W.partitionBy("subject_id", "field_name", "source_system"))
    return rows.withColumn("superseded", F.coalesce(F.col("observed_at") < newest, F.lit(False)))


def preferred(rows: DataFrame) -> DataFrame:
    """One row for each (subject, field) that has an answer: the best evidence, unless the two best tie and disagree.

    Superseded rows count only where there are no others.
    """
    ranked = superseded(rows).withColumn("auth", effective_authority(F.col("authority"))).withColumn("conf", F.coalesce("confidence", F.lit(-1.0)))
    key = ["subject_id", "field_name"]
    order = [F.col("superseded"), F.col("auth").desc(), F.col("conf").desc(), F.col("observed_at").desc_nulls_last(), F.col("evidence_id")]
    w = W.partitionBy(*key).orderBy(*order)
    rank = F.struct("superseded", "auth", "conf", F.coalesce(F.col("observed_at").cast("string"), F.lit("")).alias("o"))
    best = ranked.withColumn("nth", F.row_number().over(w)).withColumn("me", rank)
    best = best.withColumn("next", F.lead(F.struct("me", "statement")).over(w)).where(F.col("nth") == 1)
    tie = F.coalesce((F.col("next.me") == F.col("me")) & (F.col("next.statement") != F.col("statement")), F.lit(False))
    return best.where(~tie)


def conflicts(rows: DataFrame) -> DataFrame:
    """(subject_id, field_name, statements, systems) where more than one system makes more than one statement."""
    sums = rows.groupBy("subject_id", "field_name").agg(F.count_distinct("statement").alias("statements"), F.count_distinct("source_system").alias("systems"))
    return sums.where((F.col("statements") > 1) & (F.col("systems") > 1))


def write_states(rows: DataFrame) -> DataFrame:
    """State after all writes: a later record of the same system on the same field supersedes, conflicts are marked.

    (evidence_id, state, superseded_by): derived from the whole ledger, so the order of arrival does not matter.
    """
    w = W.partitionBy("subject_id", "field_name", "source_system").orderBy("recorded_at", "evidence_id")
    chained = rows.withColumn("superseded_by", F.lead("evidence_id").over(w))
    live = chained.where(F.col("superseded_by").isNull())
    clash = conflicts(live).select("subject_id", "field_name", F.lit(True).alias("clash"))
    key = F.coalesce("field_name", F.lit("\u0000"))
    marked = chained.withColumn("k", key).join(clash.withColumn("k", key).drop("field_name"), ["subject_id", "k"], "left")
    state = F.when(F.col("superseded_by").isNotNull(), "superseded").when(F.col("clash"), "conflicting").otherwise("current")
    return marked.select("evidence_id", state.alias("state"), "superseded_by")


def select(rows: DataFrame, limit: int) -> DataFrame:
    """The best evidence of each subject: two of each field first, then the rest in order of rank."""
    order = [believability(F.col("evidence_state")), effective_authority(F.col("authority")).desc(), F.coalesce("confidence", F.lit(-1.0)).desc(), F.col("observed_at").desc_nulls_last(), F.col("evidence_id")]
    has_current = F.max((F.col("evidence_state") == "current").cast("int")).over(W.partitionBy("subject_id", "field_name")) == 1
    kept = rows.withColumn("has_current", has_current).where(~F.col("has_current") | (F.col("evidence_state") == "current"))
    in_field = kept.withColumn("in_field", F.row_number().over(W.partitionBy("subject_id", "field_name").orderBy(*order)))
    final = W.partitionBy("subject_id").orderBy((F.col("in_field") > FIELD_RESERVE), *order)
    return in_field.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= limit)


def weakest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The least confidence of each group, null as soon as one is unknown."""
    return rows.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == F.count("confidence"), F.min("confidence")).alias("confidence"))


def noisy_or(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1 - product(1 - x) of each group, x clamped to [0, 1]; sums of logarithms, so groups of any size combine map-side."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value)))
    logs = F.sum(F.when(x < 1, F.log1p(-x)))
    return rows.groupBy(*keys).agg(F.when(F.max(x) >= 1, 1.0).otherwise(1 - F.exp(F.coalesce(logs, F.lit(0.0)))).alias("score"))


# fixed values: authority by method, and of the system of record
AUTHORITY = {"observed": 80, "parsed": 60, "inferred": 40, "aggregated": 40, "generated": 20, "asserted": 20}
SYSTEM_OF_RECORD = 100


def declared_authority(method: Column, system_of_record: Column) -> Column:
    """Authority of a statement by how it was come by; what the system of record itself shows ranks above all, what was
    concluded or said does not gain by where it was said; unknown methods have none."""
    table = F.create_map(*[x for k, v in AUTHORITY.items() for x in (F.lit(k), F.lit(v))])
    return F.when(system_of_record & method.isin("observed", "parsed"), SYSTEM_OF_RECORD).otherwise(F.coalesce(F.try_element_at(table, method), F.lit(0))).cast("int")


def completeness_of(read: Column, omitted: Column, listed: Column, ended: Column) -> Column:
    """complete, partial or unknown from two signals. ``read`` and ``listed`` say whether a signal was given at all:
    ``omitted`` is why content was left out (null: it was not), ``ended`` whether a listing came to its end (null: not known)."""
    return (
        F.when(~read & ~listed, "unknown").when(read & omitted.isNotNull(), "partial").when(listed & F.coalesce(~ended, F.lit(False)), "partial")
        .when(listed & ended.isNull() & ~read, "unknown").otherwise("complete")
    )


def answers(entities: DataFrame, rows: DataFrame, claims: int = 20, citations: int = 3) -> DataFrame:
    """(id, field_name, claim, citation, evidence_id, disputed, verdict): believed fields of each entity with their best evidence.

    An entity that is not active is ``not-current``, one without believed evidence ``not-answerable``, a field in which
    systems disagree ``ambiguous``. Nulls of ``field_name`` are a field of their own, named ''.
    """
    told = rows.where(F.col("evidence_state").isin("current", "conflicting")).select("subject_id", F.coalesce("field_name", F.lit("")).alias("field_name"), "evidence_id", "statement", "source_system", effective_authority(F.col("authority")).alias("auth"), F.coalesce("confidence", F.lit(-1.0)).alias("conf"))
    fields = told.groupBy("subject_id", "field_name").agg(((F.count_distinct("statement") > 1) & (F.count_distinct("source_system") > 1)).alias("disputed"))
    fields = fields.withColumn("claim", F.row_number().over(W.partitionBy("subject_id").orderBy("field_name"))).where(F.col("claim") <= claims)
    best = F.row_number().over(W.partitionBy("subject_id", "field_name").orderBy(F.desc("auth"), F.desc("conf"), "evidence_id"))
    cited = told.withColumn("citation", best).where(F.col("citation") <= citations).join(fields, ["subject_id", "field_name"])
    out = entities.select("id", "lifecycle").join(cited.withColumnRenamed("subject_id", "id"), "id", "left")
    verdict = F.when(F.col("lifecycle") != "active", "not-current").when(F.col("evidence_id").isNull(), "not-answerable").when(F.col("disputed"), "ambiguous").otherwise("answered")
    return out.select("id", "field_name", "claim", "citation", "evidence_id", "disputed", verdict.alias("verdict"))


def relation_index(rows: DataFrame) -> DataFrame:
    """(relation, anchor, members): what a set of statements has to do with each other.

    ``subject`` and ``path`` are groups of at least two; ``link`` counts, for each subject, the later ones it shares an
    anchored path with (from an equi-join on distinct (path, subject) pairs); ``absent`` counts what says nothing.
    """
    path = F.get_json_object("locator", "$.path")
    told = rows.select("subject_id", F.coalesce("permission_scope", F.lit("")).alias("scope"), path.alias("path"))
    n = F.count(F.lit(1)).alias("members")
    subjects = told.groupBy(F.col("subject_id").alias("anchor")).agg(n)
    paths = told.where(F.col("path").isNotNull()).groupBy(F.concat_ws(":", "scope", "path").alias("anchor")).agg(n).where(F.col("members") > 1)
    anchored = told.where(F.col("path").isNotNull()).distinct()
    later = anchored.select("scope", "path", F.col("subject_id").alias("other"))
    links = anchored.join(later, ["scope", "path"]).where(F.col("subject_id") < F.col("other")).groupBy(F.col("subject_id").alias("anchor")).agg(F.count_distinct("other").alias("members"))
    silent = told.agg(F.count_if(F.col("path").isNull()).alias("members")).select(F.lit("no-path").alias("anchor"), "members")
    alone = subjects.agg(F.count_if(F.col("members") == 1).alias("members")).select(F.lit("alone").alias("anchor"), "members")
    parts = (("subject", subjects.where(F.col("members") > 1)), ("path", paths), ("link", links), ("absent", silent.unionByName(alone).where(F.col("members") > 0)))
    out = None
    for name, part in parts:
        one = part.select(F.lit(name).alias("relation"), "anchor", "members")
        out = one if out is None else out.unionByName(one)
    return out
