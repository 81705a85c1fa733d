"""Who is who: identities normalised, linked within and across systems, merged; issues quoted by other systems.

No rule compares all pairs. Each is an equi-join on the value that two records share, and within a group of records with
one value every record is linked to the group's least one (across systems: to the least of another system), so a value
that many share costs one row a record and the connected groups are the same.

Defined cases: null or blank values match nothing; repeated records count once; local parts that many people have are no
evidence; of several rules for a pair the surest stays; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.functions.text import login_of, normalise_address

# fixed values: how sure each rule is
CONFIDENCE = {"mailmap": 1.0, "same-address": 0.95, "noreply-login": 0.8, "quoted-key": 0.8, "same-username": 0.6, "same-display-name": 0.5, "same-name-and-local-part": 0.5}
# fixed values: local parts that say nothing about a person
GENERIC = ("admin", "root", "user", "git", "dev", "developer", "info", "me", "test", "build", "ci", "jenkins", "noreply", "no-reply", "support", "mail", "hello", "contact")


def _surest(links: DataFrame) -> DataFrame:
    """One row for each pair, by its surest rule; the pair stands in order."""
    table = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    rows = links.select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), "rule").where(F.col("left") != F.col("right")).withColumn("confidence", table[F.col("rule")])
    best = F.max_by("rule", F.struct("confidence", "rule"))
    return rows.groupBy("left", "right").agg(best.alias("rule"), F.max("confidence").alias("confidence"))


def _across(records: DataFrame, key: Column, rule: str) -> DataFrame:
    """(a, b, rule): every record with the least record of another system that has the same key."""
    keyed = records.select("record_id", "system", key.alias("k")).where(F.col("k").isNotNull() & (F.trim("k") != ""))
    least = keyed.groupBy("k", "system").agg(F.min("record_id").alias("least"))
    ends = least.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("least", "system"))).alias("ends"))  # one entry a system
    other = F.get(F.filter("ends", lambda e: e["system"] != F.col("system")), F.lit(0))["least"]
    return keyed.join(ends.where(F.size("ends") > 1), "k").select(F.col("record_id").alias("a"), other.alias("b"), F.lit(rule).alias("rule"))


def resolve_actors(records: DataFrame) -> DataFrame:
    """(left, right, rule, confidence): records of different systems that may be one person.

    ``records`` is (record_id, system, address, login, display_name).
    """
    address = normalise_address(F.col("address"))
    told = login_of(F.col("address"))
    names = records.select("record_id", "system", F.explode(F.array_distinct(F.array_compact(F.array(told, F.col("login"))))).alias("name"), told.isNotNull().alias("noreply"))
    has = names.groupBy("name").agg(F.bool_or("noreply").alias("noreply"))
    by_login = _across(names.join(has.where("noreply").select("name"), "name", "left_semi"), F.col("name"), "noreply-login")
    links = (
        _across(records, address, "same-address").unionByName(by_login).unionByName(_across(records, F.col("login"), "same-username"))
        .unionByName(_across(records, F.lower(F.trim("display_name")), "same-display-name"))
    )
    return _surest(links)


def _star(rows: DataFrame, key: Column, rule: str) -> DataFrame:
    keyed = rows.select(F.col("name_of").alias("a"), key.alias("k")).where(F.col("k").isNotNull()).distinct()
    least = keyed.groupBy("k").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return keyed.join(least, "k").select("a", "b", F.lit(rule).alias("rule"))


def identity_links(identities: DataFrame) -> DataFrame:
    """(left, right, rule, confidence): addresses that may be one person; ``identities`` is (name, email)."""
    rows = identities.where(F.col("email").isNotNull() & (F.trim("email") != "")).select(F.lower(F.trim("name")).alias("name"), F.lower(F.trim("email")).alias("email")).distinct()
    rows = rows.withColumn("address", normalise_address(F.col("email"))).withColumn("local", F.substring_index("address", "@", 1)).withColumn("login", login_of(F.col("email")))
    same = _star(rows.withColumn("name_of", F.col("email")), F.col("address"), "same-address")
    plain = rows.withColumn("name_of", F.col("address")).where(~F.col("local").isin(*GENERIC))
    named = _star(plain.where(F.col("name") != ""), F.concat_ws(":", F.octet_length("name").cast("string"), "name", "local"), "same-name-and-local-part")
    has_login = rows.where(F.col("login").isNotNull()).groupBy(F.col("login").alias("k")).agg(F.min("address").alias("b"))
    spoken = plain.where(F.col("login").isNull()).select(F.col("local").alias("k"), F.col("address").alias("a")).distinct()
    by_login = spoken.join(has_login, "k").select("a", "b", F.lit("noreply-login").alias("rule"))
    return _surest(same.unionByName(named).unionByName(by_login))


def quoted_issues(issues: DataFrame, keys: DataFrame) -> DataFrame:
    """(left, right, rule, confidence): records whose text quotes the key of an issue of another system.

    ``issues`` is (record_id, system, text), ``keys`` is (record_id, system, key).
    """
    quoted = issues.select(F.col("record_id").alias("a"), F.col("system").alias("own"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])[A-Z][A-Z0-9_]+-[0-9]+(?![\p{L}\p{N}_])"), F.lit(0)))).alias("key"))
    met = quoted.join(keys.select(F.col("record_id").alias("b"), "system", "key").distinct(), "key").where(F.col("own") != F.col("system"))
    return _surest(met.select("a", "b", F.lit("quoted-key").alias("rule")))


def apply_mailmap(identities: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds proper_name and proper_email. A rule for a name and an address beats one for the address alone, which beats one
    that only gives an address its proper name.

    ``rules`` is (proper_name, proper_email, commit_name, commit_email), nulls where a rule has no such part; the last
    rule of a kind counts, by ``line_no``.
    """
    mail = F.lower(F.trim(F.coalesce("commit_email", "proper_email")))
    kind = F.when(F.col("commit_name").isNotNull(), 0).when(F.col("commit_email").isNotNull(), 1).otherwise(2)
    keyed = rules.select(mail.alias("mail"), kind.alias("kind"), F.lower(F.trim("commit_name")).alias("who"), F.struct("proper_name", "proper_email").alias("to"), "line_no")
    out = identities.withColumn("mail", F.lower(F.trim("email"))).withColumn("who", F.lower(F.trim("name")))
    for k, on in ((0, ["mail", "who"]), (1, ["mail"]), (2, ["mail"])):
        last = keyed.where(F.col("kind") == k).groupBy(*on).agg(F.max_by("to", "line_no").alias(f"to{k}"))
        out = out.join(last, on, "left")
    to = F.coalesce("to0", "to1", "to2")
    return out.select(*identities.columns, F.coalesce(to["proper_name"], F.col("name")).alias("proper_name"), F.coalesce(to["proper_email"], F.col("email")).alias("proper_email"))


def link_aliases(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """(system, external_id, actor_id, outcome, existing_actor, crosses_class): what each proposed alias comes to.

    ``current`` holds the aliases in force and ``proposed`` new ones, both (system, external_id, actor_id, actor_class).
    An alias in force is never taken over: another actor's claim is a collision.
    """
    held = current.select("system", "external_id", F.col("actor_id").alias("existing_actor"), F.col("actor_class").alias("existing_class"))
    rows = proposed.join(held, ["system", "external_id"], "left")
    outcome = F.when(F.col("existing_actor").isNull(), "linked").when(F.col("existing_actor") == F.col("actor_id"), "unchanged").otherwise("collision")
    crosses = F.when(outcome == "collision", F.col("existing_class") != F.col("actor_class"))
    return rows.select("system", "external_id", "actor_id", outcome.alias("outcome"), "existing_actor", crosses.alias("crosses_class"))


def merge_actors(aliases: DataFrame, merges: DataFrame, at: Column) -> DataFrame:
    """The alias table after merges (survivor_id, merged_id): open aliases of the merged are closed and open again under the survivor.

    A merge into oneself or across actor classes raises; an alias the survivor holds already is not opened twice; a
    survivor that is itself merged hands on to the last one in the chain only when merges are applied one after another.
    """
    klass = aliases.groupBy("actor_id").agg(F.max("actor_class").alias("c"))
    pairs = merges.join(klass.select(F.col("actor_id").alias("survivor_id"), F.col("c").alias("cs")), "survivor_id", "left").join(klass.select(F.col("actor_id").alias("merged_id"), F.col("c").alias("cm")), "merged_id", "left")
    bad = (F.col("survivor_id") == F.col("merged_id")) | (F.col("cs") != F.col("cm"))
    pairs = pairs.select(F.when(bad, F.raise_error(F.lit("actors that cannot be merged"))).otherwise(F.col("merged_id")).alias("actor_id"), "survivor_id")
    marked = aliases.join(pairs, "actor_id", "left")
    moves = F.col("survivor_id").isNotNull() & F.col("valid_to").isNull()
    closed = marked.withColumn("valid_to", F.when(moves, at).otherwise(F.col("valid_to"))).select(aliases.columns)
    opened = marked.where(moves).withColumns({"actor_id": F.col("survivor_id"), "valid_from": at, "valid_to": F.lit(None).cast(aliases.schema["valid_to"].dataType)})
    held = aliases.where(F.col("valid_to").isNull()).select("system", "external_id", "actor_id")
    fresh = opened.select(aliases.columns).join(held, ["system", "external_id", "actor_id"], "left_anti").select(aliases.columns)
    return closed.unionByName(fresh)


def superseding_edges(merges: DataFrame, at: Column) -> DataFrame:
    """The edges that merges leave behind: (from_id, type, to_id, valid_from)."""
    return merges.select(F.col("merged_id").alias("from_id"), F.lit("entity_supersedes_entity").alias("type"), F.col("survivor_id").alias("to_id"), at.alias("valid_from"))


def strongest_alias(aliases: DataFrame, at: Column) -> DataFrame:
    """The alias of each (system, external_id) in force at an instant; half-open, the latest start counts."""
    w = W.partitionBy("system", "external_id").orderBy(F.col("valid_from").desc(), "actor_id")
    held = aliases.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    return held.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).drop("_nth")
