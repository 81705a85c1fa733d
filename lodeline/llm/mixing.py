"""Records of several sources mixed to target shares of the total size.

Method: Sainte-Lague apportionment. The total is cut into blocks of equal size; blocks go to sources by the highest
quotients share/(2k+1), which gives integer quotas, and, since the rule never takes back a block when the total grows,
integer quotas for every output shard as differences of the allocation at the shards' ends. A source's documents are
laid out in a seeded order, pass after pass, and its quota takes them from the front.

The largest total at which every source can deliver its share within its repeats is the default. Sums run over
(source, hash range) and only then over ranges, so no source is ever in one task.

A partial pass is cut where the first document does not fit, and what is left is filled from a bounded choice of shorter
ones, so the number of jobs is fixed.

Defined cases: null and empty texts, null sources and sources without a target take no part; targets without any
document, with a share of 0 or with 0 repeats get 0 blocks, a null cap counts as 1, and the other shares keep their proportions; documents
are taken whole, one that does not fit into what is left of a quota is passed over for shorter ones behind it, and a
source ends less than one block below its quota unless no document is short enough; no quota is exceeded; equal hashes are ordered by ``doc_id``; empty tables give an empty mix; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.llm import tokens as T
from lodeline.llm.parsing import spread
from lodeline.session import cut

BLOCK_TOKENS, SHARDS, SEED, RANGES = 256, 16, 20_240_131, 4_096


def sainte_lague(shares: dict[str, float], seats: int) -> dict[str, int]:
    """Seats by the highest quotients share/(2k+1); ties go to the name first in the alphabet.

    The number of seats may be in the billions: a divisor is found by bisection, and only the last few seats are
    dealt one by one.
    """
    weights = {k: Fraction(v) for k, v in shares.items() if v and v > 0}
    got = dict.fromkeys(shares, 0)
    if not weights or seats <= 0:
        return got
    total = sum(weights.values())
    # a source's k-th seat has the quotient w/(2k-1): start a little below everyone's due and deal the rest
    for k, w in weights.items():
        got[k] = max(0, int(w * seats / total) - len(weights))
    rest = seats - sum(got.values())
    while rest:
        best = min(weights, key=lambda k: (-weights[k] / (2 * got[k] + 1), k))
        got[best] += 1
        rest -= 1
    return got


def quotas(shares: dict[str, float], blocks: int, shards: int = SHARDS) -> dict[str, list[int]]:
    """Blocks of each source at the end of each shard: cumulative, non-decreasing, the last is the whole quota."""
    ends = [sainte_lague(shares, blocks * (j + 1) // shards) for j in range(shards)]
    return {k: [e[k] for e in ends] for k in shares}


def _count(folder: str, vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([T.count(t, folder, vocabulary) for t in batch.column(2).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], names=["doc_id", "source", "tokens"])

    return count


def sized(documents: DataFrame, targets: DataFrame, folder: str = T.TOKENIZERS, vocabulary: str = T.VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of documents that can take part."""
    wanted = F.broadcast(targets.where(F.col("source").isNotNull()).select("source").distinct())  # one short row a source
    rows = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "source", "text").join(wanted, "source", "left_semi")
    rows = rows.select("doc_id", "source", "text")
    return spread(rows, "doc_id").mapInArrow(_count(folder, vocabulary), "doc_id long, source string, tokens long").where(F.col("tokens") > 0)


def _starts(rows: DataFrame, name: str) -> DataFrame:
    """Adds the tokens in front of each row of its source, in seeded order; sums by hash range first, so none is in one task."""
    ranges = rows.groupBy("source", "range_no").agg(F.sum("tokens").alias("in_range"))
    front = F.sum("in_range").over(W.partitionBy("source").orderBy("range_no").rowsBetween(W.unboundedPreceding, -1))
    before = ranges.select("source", "range_no", F.coalesce(front, F.lit(0)).alias("before"))  # at most RANGES rows a source
    w = W.partitionBy("source", "range_no").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    return inside.join(before, ["source", "range_no"]).withColumn(name, F.col("before") + F.col("inside")).drop("before", "inside")


#: Size classes (powers of two) and documents of each class that fill the last room of a source.
CLASSES, SMALLEST = 40, 8


def _short_ones(laid: DataFrame, behind: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """The SMALLEST documents (tokens, start, doc_id) of each size class of each source behind a place in its order.

    At most SMALLEST * CLASSES rows a source, whatever its size; a document of the class below the room left always fits,
    and two or three of a class use up what the class can, so these are all that greedy filling can ask for.
    """
    spark = laid.sparkSession
    places = spark.createDataFrame(sorted(behind.items()), "source string, behind long")  # one row a target
    rows = laid.join(F.broadcast(places), "source").where(F.col("start") > F.col("behind"))
    w = W.partitionBy("source", F.floor(F.log2("tokens")), F.pmod("h", F.lit(64))).orderBy("tokens", "start")
    part = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= SMALLEST)  # a class is never in one task
    w = W.partitionBy("source", F.floor(F.log2("tokens"))).orderBy("tokens", "start")
    out: dict[str, list[tuple[int, int, int]]] = {s: [] for s in behind}
    for r in part.withColumn("k", F.row_number().over(w)).where(F.col("k") <= SMALLEST).select("source", "tokens", "start", "doc_id").collect():
        out[r["source"]].append((r["tokens"], r["start"], r["doc_id"]))
    return out


def _fill(laid: DataFrame, gaps: dict[str, int], done: dict[str, int], passes: dict[str, int], most: dict[str, int], block: int) -> DataFrame | None:
    """Documents of partial passes: (source, doc_id, tokens, pass_no, at), in a fixed number of jobs.

    A pass takes documents in seeded order up to the first that does not fit. The room left is filled, longest first, with
    documents behind that one, then, if the cap allows, with documents of one more pass; both from a bounded choice.
    """
    spark = laid.sparkSession
    live = {s: g for s, g in gaps.items() if g > 0 and passes[s] <= most[s]}
    if not live:
        return None
    state = spark.createDataFrame([(s, g, done[s], passes[s]) for s, g in sorted(live.items())], "source string, gap long, done long, pass_no long")  # one row a target
    fits = laid.join(F.broadcast(state), "source").where(F.col("start") + F.col("tokens") <= F.col("gap"))
    used = fits.select("source", "doc_id", "tokens", "pass_no", (F.col("done") + F.col("start")).alias("at"))
    ends = {r["source"]: r["end"] for r in fits.groupBy("source").agg(F.max(F.col("start") + F.col("tokens")).alias("end")).collect()}  # one row a target
    rows: list[tuple[str, int, int, int, int]] = []
    for extra in (0, 1):
        room = {s: live[s] - ends.get(s, 0) for s in live}
        behind = {s: (ends.get(s, 0) if not extra else -1) for s, r in room.items() if r >= block and passes[s] + extra <= most[s]}
        if not behind:
            break
        for s, choice in _short_ones(laid, behind).items():
            for tokens, _, doc in sorted(choice, key=lambda c: (-c[0], c[1])):
                if tokens <= room[s]:
                    rows.append((s, doc, tokens, passes[s] + extra, done[s] + ends.get(s, 0)))
                    ends[s] = ends.get(s, 0) + tokens
                    room[s] -= tokens
    return used.unionByName(spark.createDataFrame(rows, "source string, doc_id long, tokens long, pass_no long, at long")) if rows else used


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK_TOKENS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source, doc_id, pass_no, shard, block_no, tokens, quota): one row for each use of a document.

    A document belongs to the block its first token lies in, and to the shard whose quota holds that block; ``quota`` is
    the tokens of that source in that shard, which the last document of a shard may run over by less than its own length.
    """
    spark = sizes.sparkSession
    rows = sizes.select("source", "doc_id", "tokens", F.xxhash64(F.lit(seed), "source", "doc_id").alias("h")).withColumn("range_no", F.pmod("h", F.lit(RANGES)))
    laid = cut(_starts(cut(rows), "start"))
    goal = {r["source"]: (r["target_share"] or 0.0, 1 if r["max_repeats"] is None else max(0, r["max_repeats"])) for r in targets.collect() if r["source"] is not None}
    have = {r["source"]: r["n"] for r in laid.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # one row a target
    shares = {s: w for s, (w, most) in goal.items() if w > 0 and most > 0 and have.get(s)}
    weight = sum(shares.values()) or 1.0
    reach = min((have[s] * goal[s][1] * weight / w for s, w in shares.items()), default=0)
    blocks = int((reach if total_tokens is None else total_tokens) // block)
    ends = quotas(shares, blocks, shards)
    quota = {s: min(ends[s][-1] * block, have[s] * goal[s][1]) for s in shares}
    full = {s: quota[s] // have[s] for s in shares}
    plan = spark.createDataFrame([(s, full[s], have[s], ends[s]) for s in sorted(shares)], "source string, full long, have long, ends array<long>")  # one row a target
    whole = laid.join(F.broadcast(plan), "source").where(F.col("full") > 0).withColumn("pass_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("full"))))
    used = whole.select("source", "doc_id", "tokens", "pass_no", (F.col("start") + (F.col("pass_no") - 1) * F.col("have")).alias("at"))
    part = _fill(laid, {s: quota[s] - full[s] * have[s] for s in shares}, {s: full[s] * have[s] for s in shares}, {s: full[s] + 1 for s in shares}, {s: goal[s][1] for s in shares}, block)
    if part is not None:
        used = used.unionByName(part)
    shard = F.least(F.size(F.filter("ends", lambda e: e <= F.col("block_no"))), F.lit(shards - 1))
    placed = used.join(F.broadcast(plan.select("source", "ends")), "source").withColumn("block_no", F.floor(F.col("at") / block)).withColumn("shard", shard)
    before = F.when(F.col("shard") > 0, F.get("ends", F.col("shard") - 1)).otherwise(0)
    return placed.select("source", "doc_id", "pass_no", "shard", "block_no", "tokens", ((F.get("ends", F.col("shard")) - before) * block).alias("quota"))


def shard_report(mixed: DataFrame) -> DataFrame:
    """(source, shard, quota, tokens, over): what each shard got of each source against its quota; one row a source and shard."""
    each = mixed.groupBy("source", "shard").agg(F.max("quota").alias("quota"), F.sum("tokens").alias("tokens"))
    return each.withColumn("over", F.col("tokens") - F.col("quota"))


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, uses, most_uses): one row a target."""
    each = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("pass_no").alias("most_uses"))
    whole = targets.select("source", "target_share").join(each, "source", "left").na.fill(0, ["tokens", "uses", "most_uses"])
    every = F.sum("tokens").over(W.partitionBy(F.lit(1)))  # one row a target
    return whole.select("source", "target_share", F.coalesce(F.try_divide("tokens", every), F.lit(0.0)).alias("actual_share"), "tokens", "uses", "most_uses")
