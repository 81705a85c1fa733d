"""Exact retrieval: conjunctive filters, identifiers, paging. Filters stay Catalyst predicates and reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.operators.access import Access, permitted

DEFAULT_LIMIT, MAX_LIMIT = 50, 500  # fixed values


def clamp_limit(limit) -> int:
    """A usable page size: the default for anything that is no positive integer."""
    return min(limit, MAX_LIMIT) if isinstance(limit, int) and not isinstance(limit, bool) and limit > 0 else DEFAULT_LIMIT


def clamp_offset(offset) -> int:
    return offset if isinstance(offset, int) and not isinstance(offset, bool) and offset > 0 else 0


def attribute(name: str) -> Column:
    """A member of the attributes as text."""
    return F.get_json_object("attributes", f"$.{name}")


def find_entities(
    entities: DataFrame, kinds: tuple[str, ...] = (), system: str | None = None, scope: str | None = None, lifecycle: str | None = None,
    attributes: dict[str, str] | None = None, access: Access | None = None,
) -> DataFrame:
    """Entities that meet all filters and that the caller may see."""
    out = entities
    if kinds:
        out = out.where(F.col("kind").isin(list(kinds)))
    for column, value in (("source_system", system), ("source_scope", scope), ("lifecycle", lifecycle)):
        if value is not None:
            out = out.where(F.col(column) == value)
    for name, value in (attributes or {}).items():
        out = out.where(attribute(name) == value)
    return out.where(permitted(F.col("source_scope"), access.grants)) if access else out


def page(df: DataFrame, keys: list[str], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order, with ``more`` telling whether rows follow: limit+1 rows decide, nothing is counted."""
    limit, offset = clamp_limit(limit), clamp_offset(offset)
    got = df.orderBy(*keys).offset(offset).limit(limit + 1)
    w = W.orderBy(*keys)  # at most MAX_LIMIT + 1 rows
    numbered = got.withColumn("rank", F.row_number().over(w))
    return numbered.withColumn("more", F.max("rank").over(W.partitionBy(F.lit(1))) > limit).where(F.col("rank") <= limit)


def keyset_page(df: DataFrame, keys: list[str], after: tuple, limit: int) -> DataFrame:
    """The rows after a key in a total order; the predicate prunes, no offset is walked."""
    row = F.struct(*[F.col(k) for k in keys])
    return df.where(row > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, after, strict=True)])).orderBy(*keys).limit(clamp_limit(limit))


def by_identifier(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, id, score): an entity whose id or path a term is, or whose source id starts with a hexadecimal term.

    Ids and paths meet in equi-joins; prefixes in an equi-join on their first seven characters.
    """
    base = entities.select("id", "source_id", attribute("path").alias("path"), attribute("head").alias("head"))
    exact = base.select("id", F.col("id").alias("term")).unionByName(base.select("id", F.col("path").alias("term"))).join(terms, "term")
    hexes = terms.where(F.col("term").rlike("^[0-9a-f]{7,40}$")).withColumn("k", F.substring("term", 1, 7))
    named = base.select("id", F.col("source_id").alias("name")).unionByName(base.select("id", F.col("head").alias("name"))).withColumn("k", F.substring("name", 1, 7))
    prefixed = named.join(hexes, "k").where(F.col("name").startswith(F.col("term"))).select("id", "term")
    return exact.select("id", "term").unionByName(prefixed).distinct().withColumn("score", F.lit(1.0))


def with_external_id(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entities that an external id stands for: (system, external_id) in ``wanted``; a semi join, so none comes twice."""
    keys = wanted.select(F.col("system").alias("source_system"), F.col("external_id").alias("source_id")).distinct()
    return entities.join(keys, ["source_system", "source_id"], "left_semi")


def duration_seconds(text: Column) -> Column:
    """Seconds of a duration such as 500ms, 30s, 15m, 12h, 7d; null for other texts."""
    n = F.regexp_extract(text, r"^(\d+)(ms|s|m|h|d)$", 1)
    unit = F.regexp_extract(text, r"^(\d+)(ms|s|m|h|d)$", 2)
    factor = F.when(unit == "ms", 0.001).when(unit == "s", 1.0).when(unit == "m", 60.0).when(unit == "h", 3600.0).when(unit == "d", 86400.0)
    return F.when(n != "", n).try_cast("double") * factor


def stale(entities: DataFrame, now: Column, after_seconds: float) -> DataFrame:
    """Entities not observed for so long, the stalest first by ``staleness_rank``."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp"))) / F.lit(1_000_000)
    return entities.withColumn("age_seconds", age).where(F.col("age_seconds") > after_seconds)
