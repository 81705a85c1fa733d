"""Mixed timestamp formats and time zones, brought to one UTC instant.

Method: a zone written in the text holds. Where the text has none, the zone of its site holds, and a site without a
usable zone gets one estimated. Its local times are aligned with instants known to be later in the same sequence: for a
commit the moment it was committed, else the moment the row was taken in. Each candidate zone turns the local times into
instants by its whole history of offsets; a row whose time comes out after its bound is a violation, and a time far
before the bound is unlikely, so both sides of the error count: ``log(1 + lag / 1 min)`` for each row, for a violation
twice that and ``VIOLATION`` more. Scores are summed by site and quarter in one aggregation; the cheapest history over
the quarters is found by dynamic programming, where each change of zone costs ``SWITCH``.

Zones whose offsets are the same in the middle of each winter and summer are one candidate under one name. Where the best candidate
is not ahead of the next by ``SEPARATION``, no zone is returned.

Defined cases: null and blank texts, texts of no known form, dates that do not exist, and unknown zones give no row;
rows without a site use the estimate for the null site, and UTC if nothing speaks for any candidate; repeated rows are
each read; empty tables give an empty result; very long texts match no form; further columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.instants import fields_of, is_region, known_regions, local_parts, offset_minutes, split_fields, utc_micros

#: Names preferred for candidates that share their offsets with others.
PREFERRED = (
    "Europe/London", "Europe/Berlin", "Europe/Athens", "Europe/Moscow", "Asia/Dubai", "Asia/Kolkata", "Asia/Kathmandu", "Asia/Shanghai", "Asia/Tokyo",
    "Australia/Sydney", "Pacific/Auckland", "America/Sao_Paulo", "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles",
)
#: Cost of a violation beside its size, cost of a change of zone, lead that the best candidate needs.
VIOLATION, SWITCH, SEPARATION = 6.0, 60.0, 1.0
#: Scores closer than this are taken for equal: the offsets differ in a few hours a year at most.
EQUAL = 0.05
YEARS = (2016, 2024)


def candidate_zones(spark: SparkSession, years: tuple[int, int] = YEARS) -> tuple[str, ...]:
    """One name for each history of offsets that any region has in these years, UTC first; about a hundred."""
    names = spark.createDataFrame([(n,) for n in known_regions(spark)], "zone string")
    steps = F.expr(f"sequence(timestamp'{years[0]}-01-15 00:00:00', timestamp'{years[1]}-01-15 00:00:00', interval 6 months)")
    offsets = F.transform(steps, lambda t: F.unix_seconds(F.from_utc_timestamp(t, F.col("zone"))) - F.unix_seconds(t))
    place = {n: i for i, n in enumerate(PREFERRED)}
    classes: dict[int, str] = {}
    rows = names.select("zone", F.xxhash64(offsets).alias("history"), (F.array_max(F.transform(offsets, F.abs)) == 0).alias("utc")).collect()  # one short row a region
    for r in sorted(rows, key=lambda r: (place.get(r["zone"], len(place)), r["zone"])):
        classes.setdefault(r["history"], "UTC" if r["utc"] else r["zone"])
    return tuple(sorted(classes.values(), key=lambda n: (n != "UTC", place.get(n, len(place)), n)))


def read_fields(df: DataFrame, columns: dict[str, str], keys: list[str], bound: Column | None = None) -> DataFrame:
    """(keys, site_id, bound, field_name, fields): one row for each text; ``fields`` is null if it has no known form.

    ``bound`` is an instant that the times cannot lie behind, by default when the row was taken in.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("field_name"), F.col(col).cast("string").alias("text")) for name, col in columns.items()])
    late = F.col("acquired_at").cast("timestamp") if bound is None else bound
    long = df.select(*keys, "site_id", late.alias("bound"), F.explode(F.filter(pairs, lambda p: p["text"].isNotNull())).alias("value"))
    return long.select(*keys, "site_id", "bound", "value.field_name", fields_of(F.col("value.text")).alias("fields"))


def _parts(df: DataFrame) -> DataFrame:
    local, zone, epoch = local_parts(F.col("parts"), F.col("date_order"))
    return df.withColumn("parts", split_fields(F.col("fields"))).withColumn("local", local).withColumn("zone", zone).withColumn("epoch", epoch)


def zone_scores(parts: DataFrame, candidates: tuple[str, ...]) -> DataFrame:
    """(site_id, quarter, rows, costs, violations): sums for each candidate, combined map-side."""
    bare = parts.where((F.col("zone") == "") & F.col("local").isNotNull() & F.col("bound").isNotNull())
    zones = F.posexplode(F.split(F.lit(",".join(candidates)), ",")).alias("k", "candidate")
    each = bare.select("site_id", (F.year("bound") * 4 + F.quarter("bound")).cast("long").alias("quarter"), F.timestamp_micros("local").alias("local"), F.unix_micros("bound").alias("bound"), zones)
    each = each.withColumn("lag", (F.col("bound") - F.unix_micros(F.to_utc_timestamp("local", F.col("candidate")))) / 6e7)
    cost = F.when(F.col("lag") < 0, VIOLATION + 2 * F.log1p(-F.col("lag"))).otherwise(F.log1p(F.col("lag")))
    sums = each.groupBy("site_id", "quarter", "k").agg(F.count(F.lit(1)).alias("rows"), F.sum(cost).alias("cost"), F.count_if(F.col("lag") < 0).alias("bad"))
    row = F.array_sort(F.collect_list(F.struct("k", "cost", "bad")))  # one entry a candidate
    found = sums.groupBy("site_id", "quarter").agg(F.max("rows").alias("rows"), row.alias("row"))
    return found.select("site_id", "quarter", "rows", F.col("row.cost").alias("costs"), F.col("row.bad").alias("violations"))


def _histories(candidates: tuple[str, ...]):
    def cheapest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("quarter")
        quarters, rows = pdf["quarter"].tolist(), pdf["rows"].tolist()
        total, back = [0.0] * len(candidates), []
        for costs in pdf["costs"]:
            low = min(range(len(candidates)), key=lambda k: (total[k], k))
            back.append([k if total[k] <= total[low] + SWITCH else low for k in range(len(candidates))])
            total = [min(total[k], total[low] + SWITCH) + c for k, c in enumerate(costs)]
        at = next(k for k in range(len(candidates)) if total[k] <= min(total) + EQUAL)
        chosen = []
        for from_ in reversed(back):
            chosen.append(at)
            at = from_[at]
        chosen.reverse()
        out, i = [], 0
        while i < len(chosen):
            j = i
            while j + 1 < len(chosen) and chosen[j + 1] == chosen[i]:
                j += 1
            sums = [sum(col) for col in zip(*pdf["costs"].tolist()[i : j + 1], strict=True)]
            best = sums[chosen[i]]
            lead = min((x - best for x in sums if x - best > EQUAL), default=0.0)
            bad = sum(v[chosen[i]] for v in pdf["violations"].tolist()[i : j + 1])
            zone = candidates[chosen[i]] if lead >= SEPARATION else None
            first = None if i == 0 else quarters[i]
            last = None if j + 1 == len(chosen) else quarters[j + 1]
            out.append((pdf["site_id"].iloc[0], first, last, zone, sum(rows[i : j + 1]), bad, lead))
            i = j + 1
        frame = pd.DataFrame(out, columns=["site_id", "from_quarter", "to_quarter", "estimated_zone", "rows", "violations", "lead"])
        return frame.astype({"from_quarter": "Int64", "to_quarter": "Int64"})

    return cheapest


def estimate_zones(parts: DataFrame, candidates: tuple[str, ...]) -> DataFrame:
    """(site_id, from_quarter, to_quarter, estimated_zone, rows, violations, lead): the history of zones of each site.

    Quarters count as year * 4 + quarter, half-open; null ends are open. One row a site and stretch.
    """
    # a site has one row a quarter here, so a group is a few dozen rows whatever the input
    schema = "site_id string, from_quarter long, to_quarter long, estimated_zone string, rows long, violations long, lead double"
    return zone_scores(parts, candidates).groupBy("site_id").applyInPandas(_histories(candidates), schema)


def normalise_instants(fields: DataFrame, sites: DataFrame, keys: list[str], candidates: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, field_name, utc_us, zone_source): one row for each text that names an instant.

    ``sites`` is the register of sites, (site_id, time_zone, date_order), one short row for each.
    """
    regions = known_regions(fields.sparkSession)
    register = sites.groupBy("site_id").agg(F.max_by("time_zone", F.coalesce("time_zone", F.lit(""))).alias("time_zone"), F.max("date_order").alias("date_order"))
    usable = is_region(F.col("time_zone"), regions) | offset_minutes(F.col("time_zone")).isNotNull()
    register = register.withColumn("time_zone", F.when(usable, F.col("time_zone")))
    placed = fields.where(F.col("fields").isNotNull()).join(register, "site_id", "left")
    parts = _parts(placed)
    # only the site column is read to see whether any zone has to be estimated
    lost = fields.select("site_id").distinct().join(register.where(F.col("time_zone").isNotNull()), "site_id", "left_anti")
    if lost.take(1):
        unknown = _parts(placed.where(F.col("time_zone").isNull()))
        found = estimate_zones(unknown, candidates or candidate_zones(fields.sparkSession))
        stretch = F.struct(F.coalesce("from_quarter", F.lit(0)).alias("lo"), F.coalesce("to_quarter", F.lit(1 << 40)).alias("hi"), F.col("estimated_zone").alias("zone"))
        found = found.groupBy(F.col("site_id").alias("est_site")).agg(F.collect_list(stretch).alias("stretches"))  # one row a site
        parts = parts.join(found, F.col("site_id").eqNullSafe(F.col("est_site")) & F.col("time_zone").isNull(), "left")
        quarter = F.coalesce(F.year("bound") * 4 + F.quarter("bound"), F.lit(0)).cast("long")
        held = F.get(F.filter("stretches", lambda x: (x["lo"] <= quarter) & (quarter < x["hi"])), F.lit(0))
        parts = parts.withColumn("estimated_zone", held["zone"])
    else:
        parts = parts.withColumn("estimated_zone", F.lit(None).cast("string"))
    written = F.col("zone") != ""
    zone = F.when(written, F.col("zone")).otherwise(F.coalesce("time_zone", "estimated_zone", F.lit("UTC")))
    source = F.when(F.col("epoch").isNotNull(), "number").when(written, "text").when(F.col("time_zone").isNotNull(), "site").otherwise("estimate")
    out = parts.withColumn("zone_source", source).withColumn("zone", zone).withColumn("minutes", offset_minutes(F.col("zone")))
    out = out.withColumn("utc_us", F.coalesce("epoch", utc_micros(F.col("local"), F.col("zone"), F.col("minutes"), regions)))
    return out.where(F.col("utc_us").isNotNull()).select(*keys, "field_name", "utc_us", "zone_source")
