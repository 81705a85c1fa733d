"""Graph reads as set operations: neighbours, bounded breadth-first walks, closures, components.

Every hop is one join of the frontier with the edges; visited nodes leave by an anti join; lineage is cut in the shared
folder after each hop, so a lost executor costs one hop at most.
"""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.session import cut

MAX_DEPTH = 6  # fixed value
#: Commits of one repository up to which one task walks them.
WALK_ROWS = 300_000


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other_id, type, direction, valid_from, valid_to): each edge seen from either end."""
    out = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other_id"), "type", F.lit("out").alias("direction"), "valid_from", "valid_to")
    back = edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other_id"), "type", F.lit("in").alias("direction"), "valid_from", "valid_to")
    return out.unionByName(back)


def neighbours(edges: DataFrame, wanted: DataFrame, at: Column | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """Edges at the wanted ids (column ``id``), as of an instant or as they stand open."""
    from lodeline.operators.intervals import holds_at

    kept = edges.where(F.col("type").isin(list(types))) if types else edges
    kept = kept.where(F.col("valid_to").isNull() if at is None else holds_at(at))
    return both_ways(kept).join(wanted.select("id").distinct(), "id", "left_semi")


def traverse(hops: DataFrame, origins: DataFrame, depth: int, visible: DataFrame | None = None) -> DataFrame:
    """(origin, id, depth): nodes reached within ``depth`` hops of each origin, by the shortest way.

    ``hops`` is (id, other_id). A node outside ``visible`` is neither returned nor walked through. More hops than
    MAX_DEPTH raise; ``truncated`` tells of what lies behind the last hop.
    """
    if depth > MAX_DEPTH:
        raise ValueError(f"a walk goes {MAX_DEPTH} hops at most")
    frontier = origins.select(F.col("id").alias("origin"), "id").distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    steps = hops.select("id", "other_id").distinct()
    for k in range(1, depth + 1):
        found = frontier.join(steps, "id").select("origin", F.col("other_id").alias("id")).distinct()
        if visible is not None:
            found = found.join(visible.select("id"), "id", "left_semi")
        frontier = cut(found.join(seen.select("origin", "id"), ["origin", "id"], "left_anti"))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(k)))
    return seen.where(F.col("depth") > 0)


def truncated(found: DataFrame, hops: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """(origin, reason, n): what a walk of ``depth`` hops left out. ``depth``: nodes of the last hop with further
    neighbours not yet found; ``limit``: nodes beyond the ``limit`` first in order of depth and id."""
    last = found.where(F.col("depth") == depth).select("origin", "id")
    known = found.select("origin", "id").unionByName(found.select("origin", F.col("origin").alias("id"))).distinct()
    onward = last.join(hops.select("id", "other_id"), "id").select("origin", F.col("id").alias("from_"), F.col("other_id").alias("id")).join(known, ["origin", "id"], "left_anti")
    deep = onward.groupBy("origin").agg(F.count_distinct("from_").alias("n")).select("origin", F.lit("depth").alias("reason"), "n")
    if limit is None:
        return deep
    over = found.groupBy("origin").agg((F.count(F.lit(1)) - limit).alias("n")).where(F.col("n") > 0).select("origin", F.lit("limit").alias("reason"), "n")
    return deep.unionByName(over)


def closure(links: DataFrame, origins: DataFrame, hops: int | None = 10) -> DataFrame:
    """(origin, id, depth): everything that follows from the origins along (id, other_id), hidden nodes included; without ``hops`` to the last."""
    frontier, seen = origins.select(F.col("id").alias("origin"), "id").distinct(), None
    known = frontier
    for k in count(1) if hops is None else range(1, hops + 1):
        found = frontier.join(links, "id").select("origin", F.col("other_id").alias("id")).distinct()
        frontier = cut(found.join(known, ["origin", "id"], "left_anti"))
        if not frontier.take(1):
            break
        known = known.unionByName(frontier)
        step = frontier.withColumn("depth", F.lit(k))
        seen = step if seen is None else seen.unionByName(step)
        if k % 20 == 0:  # long walks keep short plans
            known, seen = cut(known), cut(seen)
    return seen if seen is not None else frontier.withColumn("depth", F.lit(0)).where(F.lit(False))


def ancestor_difference(parents: DataFrame, heads: DataFrame, walk_rows: int = WALK_ROWS) -> DataFrame:
    """(repo_id, head, id, resolved): what ``head`` reaches, itself included, and ``previous`` does not, to the last ancestor.

    ``parents`` is (repo_id, id, parents), one row a commit; ``heads`` is (repo_id, head, previous), one row a repository;
    without a previous head all that ``head`` reaches counts. A commit without a row of its own is reached but not
    ``resolved``. A repository with up to ``walk_rows`` commits is walked inside one task, since a walk by joins takes
    as many rounds as the longest chain has links; larger ones go through joins, with the same result.
    """
    sizes = parents.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > walk_rows).select("repo_id"))  # at most rows / walk_rows names
    if not large.take(1):
        return _walked(parents, heads)
    big, tips = parents.join(large, "repo_id", "left_semi"), heads.join(large, "repo_id", "left_semi")
    links = cut(big.select(F.struct("repo_id", "id").alias("id"), F.explode("parents").alias("p"), "repo_id").select("id", F.struct("repo_id", F.col("p").alias("id")).alias("other_id")).where(F.col("p").isNotNull()).distinct())
    reached = []
    for end in ("head", "previous"):
        start = tips.where(F.col(end).isNotNull()).select(F.struct("repo_id", F.col(end).alias("id")).alias("id"))
        reached.append(start.unionByName(closure(links, start, None).select("id")).distinct().select("id.repo_id", "id.id"))
    key = ["repo_id", "id"]
    rest = reached[0].join(reached[1], key, "left_anti").join(big.select(*key, F.lit(True).alias("known")), key, "left")
    far = rest.join(tips.select("repo_id", "head"), "repo_id").select("repo_id", "head", "id", F.coalesce("known", F.lit(False)).alias("resolved"))
    return _walked(parents.join(large, "repo_id", "left_anti"), heads.join(large, "repo_id", "left_anti")).unionByName(far)


def _walked(parents: DataFrame, heads: DataFrame) -> DataFrame:
    def reach(up: dict, start: str | None, known: set) -> dict:
        seen, todo = {}, [start] if start is not None else []
        while todo:
            v = todo.pop()
            if v not in seen and v not in known:
                seen[v] = v in up
                todo.extend(p for p in up.get(v, ()) if p is not None)
        return seen

    def walk(commits: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        up = {v: () if p is None else p for v, p in zip(commits["id"], commits["parents"])}
        rows = []
        for repo, head, previous in ends[["of", "head", "previous"]].itertuples(index=False):
            found = reach(up, head, set(reach(up, previous, set())))
            rows += [(repo, head, v, known) for v, known in found.items()]
        return pd.DataFrame(rows, columns=["repo_id", "head", "id", "resolved"])

    both = parents.select("repo_id", "id", "parents").groupBy("repo_id").cogroup(heads.select(F.col("repo_id").alias("of"), "head", "previous").groupBy("of"))
    return both.applyInPandas(walk, "repo_id string, head string, id string, resolved boolean")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected component, by hook and jump in a logarithmic number of rounds.

    A component may hold any share of all rows: every round joins on node ids only and reduces labels map-side.
    """
    pairs = links.select("id", "other_id").unionByName(links.select(F.col("other_id").alias("id"), F.col("id").alias("other_id"))).where(F.col("id") != F.col("other_id")).distinct()
    pairs = cut(pairs)
    label = cut(links.select("id").unionByName(links.select(F.col("other_id").alias("id"))).distinct().withColumn("component", F.col("id")))
    while True:
        near = pairs.join(label.select(F.col("id").alias("other_id"), F.col("component").alias("c")), "other_id").groupBy("id").agg(F.min("c").alias("c"))
        hooked = label.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("c", "component")).alias("low"))
        # the root of a component that touches a lower one takes the lower label, then everyone jumps to the root's
        roots = hooked.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("to"))
        moved = hooked.select("id", "component", F.col("low").alias("root")).join(roots, "root", "left")
        after = cut(moved.select("id", F.least(F.col("root"), F.coalesce("to", "root")).alias("component"), (F.least(F.col("root"), F.coalesce("to", "root")) != F.col("component")).alias("moved")))
        label = after.select("id", "component")
        if not after.where("moved").take(1):
            return label


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order (what DISTINCT ON gives elsewhere)."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") == 1).drop("_nth")
