"""Parent-child links to full hierarchies: root, depth, path, descendants and cycles.

Method: bottom-up leaf peeling. Leaves are taken off level by level and hand their subtree sizes to their parents; the
reverse of the peeling order gives every node its root, depth and place in a preorder. What cannot be peeled holds a
cycle. Peeling runs inside one task for a tree set of bounded size (one repository with up to ``peel_rows`` nodes);
larger sets go through pointer doubling over the whole cluster, with the same result in about log2(depth) rounds,
since peeling one level a round would need as many rounds as the longest chain has links.

The preorder visits the largest subtree first, so the links to largest children form runs of neighbours (heavy paths).
All descendants of a node are one range of places, and its path is at most log2(n) ranges, one for each heavy path on
the way to the root. ``ancestors`` and ``descendants`` write lists out for the nodes asked for: ranges are cut into
blocks of ``BLOCK`` places and meet the nodes by (root, block), so a giant tree spreads over as many keys as it has
blocks. For all nodes of a chain the lists would hold n*n/2 entries.

Defined cases: rows with a null repository or node are left out; of several rows for a node the latest counts; a
parent without a row of its own in the same repository, or a null one, makes the node a root; a node that is its own
parent is a cycle; nodes on a cycle have root '' and depth -1, nodes leading to one root '' and depth -2, and both have
null ``pre``, ``size``, ``head`` and ``up``; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.session import cut, cut_round

#: Nodes of one repository up to which one task peels them (about 150 bytes each in Python).
PEEL_ROWS = 300_000
#: Places of a preorder that lists are joined by.
BLOCK = 4_096
SCHEMA = "repo_id string, sha string, parent string, root_sha string, depth long, pre long, size long, head long, up long"


def links(commits: DataFrame) -> DataFrame:
    """(repo_id, sha, parent): the row that counts for each commit, with its first parent."""
    rows = commits.where(F.col("repo_id").isNotNull() & F.col("sha").isNotNull())
    rows = rows.select("repo_id", "sha", F.get("parents", F.lit(0)).alias("parent"), "acquired_at", "row_id")
    last = F.max_by(F.struct("parent"), F.struct("acquired_at", "row_id"))
    return rows.groupBy("repo_id", "sha").agg(last.alias("row")).select("repo_id", "sha", F.col("row.parent").alias("parent"))


def peel(up: np.ndarray) -> tuple[np.ndarray, ...]:
    """(root, depth, pre, size, head, above) of nodes 0..n-1 with parents ``up`` (-1: none), by leaf peeling.

    ``head`` is the place of the first node of a node's heavy path, ``above`` the place of that node's parent (-1: none).
    Nodes on a cycle get depth -1, nodes leading to one -2; all else of both is -1.
    """
    n = len(up)
    parents = up.tolist()
    waiting = np.bincount(up[up >= 0], minlength=n).tolist()
    size = [1] * n
    order = [i for i in range(n) if not waiting[i]]
    for v in order:  # grows while it is read: each node comes after all its children
        p = parents[v]
        if p >= 0:
            size[p] += size[v]
            waiting[p] -= 1
            if not waiting[p]:
                order.append(p)
    # the place of a child behind its parent: what its elder siblings take, the largest first
    sizes = np.array(size, dtype=np.int64)
    rank = np.lexsort((np.arange(n), -sizes, up))
    front = np.cumsum(sizes[rank]) - sizes[rank]
    first = np.ones(n, dtype=bool)
    first[1:] = up[rank][1:] != up[rank][:-1]
    base = np.maximum.accumulate(np.where(first, front, 0)) if n else front
    step, eldest = np.empty(n, dtype=np.int64), np.empty(n, dtype=bool)
    step[rank], eldest[rank] = front - base + 1, first
    step, eldest = step.tolist(), eldest.tolist()
    root, depth, pre, head, above = ([-1] * n for _ in range(5))  # what is never peeled lies on a cycle
    for v in reversed(order):
        p = parents[v]
        if p < 0:
            root[v], depth[v], pre[v], head[v] = v, 0, 0, 0
        elif root[p] < 0:
            depth[v] = -2
        else:
            root[v], depth[v], pre[v] = root[p], depth[p] + 1, pre[p] + step[v]
            head[v], above[v] = (head[p], above[p]) if eldest[v] else (pre[v], pre[p])
    size = np.where(np.array(root, dtype=np.int64) < 0, -1, sizes)
    return np.array(root), np.array(depth), np.array(pre), size, np.array(head), np.array(above)


def _peel_repository(rows: pd.DataFrame) -> pd.DataFrame:
    sha = rows["sha"].to_numpy()
    rows = rows.iloc[np.argsort(sha, kind="stable")].reset_index(drop=True)
    index = pd.Index(rows["sha"])
    up = index.get_indexer(rows["parent"])
    up[rows["parent"].isna().to_numpy()] = -1
    root, depth, pre, size, head, above = peel(up.astype(np.int64))
    shas = rows["sha"].to_numpy()
    rows["parent"] = np.where(up >= 0, rows["parent"].to_numpy(), None)
    rows["root_sha"] = np.where(root >= 0, shas[root], "")
    rows["depth"] = depth
    for name, values in (("pre", pre), ("size", size), ("head", head), ("up", above)):
        rows[name] = pd.array(np.maximum(values, 0), dtype="Int64")
        rows.loc[values < 0, name] = pd.NA
    return rows[["repo_id", "sha", "parent", "root_sha", "depth", "pre", "size", "head", "up"]]


def _jump(state: DataFrame, more: list[str], moved: dict) -> DataFrame:
    """One round of pointer doubling. Only nodes that still point somewhere are joined; finished ones are carried along."""
    open_, done = state.where(F.col("ptr").isNotNull()), state.where(F.col("ptr").isNull())
    target = state.select("repo_id", F.col("sha").alias("ptr"), F.col("ptr").alias("ptr2"), *[F.col(c).alias(f"{c}2") for c in more])
    joined = open_.join(target, ["repo_id", "ptr"], "left").withColumns(moved).withColumn("ptr", F.col("ptr2"))
    # the union has the partitions of both, which would add up from round to round and fill the driver with tasks
    return joined.select(state.columns).unionByName(done).coalesce(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _sibling_steps(trees: DataFrame) -> DataFrame:
    """(repo_id, sha, step, eldest): a child's place behind its parent, the largest subtree first, then by name.

    Sums run over (size, first letters of the name) of each parent and then over those, so the children of one parent
    are never in one task.
    """
    kids = trees.where(F.col("parent").isNotNull()).select("repo_id", "parent", "sha", "size", F.substring("sha", 1, 3).alias("part"))
    parts = kids.groupBy("repo_id", "parent", "size", "part").agg(F.sum("size").alias("n"))
    outer = W.partitionBy("repo_id", "parent").orderBy(F.col("size").desc(), "part")
    before = F.coalesce(F.sum("n").over(outer.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).drop("n")
    inner = W.partitionBy("repo_id", "parent", "size", "part").orderBy("sha").rowsBetween(W.unboundedPreceding, -1)
    inside = kids.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    step = F.col("before") + F.col("inside") + 1
    return inside.join(parts, ["repo_id", "parent", "size", "part"]).select("repo_id", "sha", step.alias("step"), (step == 1).alias("eldest"))


def _peel_rest(rows: pd.DataFrame) -> pd.DataFrame:
    """Root and depth of what doubling left open in one repository; ``over`` and ``above`` are those of a finished parent."""
    rows = rows.reset_index(drop=True)
    up = pd.Index(rows["sha"]).get_indexer(rows["parent"])
    root, depth, *_ = peel(up.astype(np.int64))
    found = root >= 0
    top = np.maximum(root, 0)
    rows["root_sha"] = np.where(found, rows["over"].to_numpy()[top], "")
    rows["depth"] = np.where(found, rows["above"].fillna(0).to_numpy(dtype=np.int64)[top] + 1 + depth, depth)
    return rows[["repo_id", "sha", "parent", "root_sha", "depth"]]


def rooted(nodes: DataFrame, peel_rows: int = PEEL_ROWS) -> DataFrame:
    """(repo_id, sha, parent, root_sha, depth) by pointer doubling over joins; ``nodes`` is (repo_id, sha, parent).

    Rounds end as soon as no repository has more than ``peel_rows`` nodes that still point somewhere: those are peeled.
    Otherwise each node on or leading to a cycle would take part in log2(2n) rounds, however shallow the trees are.
    """
    key = ["repo_id", "sha"]
    named = nodes.where(F.col("parent").isNotNull())
    own = nodes.select("repo_id", F.col("sha").alias("parent"))
    known = named.join(own, ["repo_id", "parent"], "left_semi").select(*key, "parent")
    base = cut(nodes.select(*key).join(known, key, "left"))
    top = F.col("parent").isNull()
    state, n, step = base.select(*key, F.col("parent").alias("ptr"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), F.when(top, F.col("sha")).alias("root_sha")), base.count(), 1
    while step < 2 * n and state.where(F.col("ptr").isNotNull()).groupBy("repo_id").count().where(F.col("count") > peel_rows).take(1):
        state = cut_round(_jump(state, ["depth", "root_sha"], {"depth": F.col("depth") + F.coalesce("depth2", F.lit(0)), "root_sha": F.coalesce("root_sha", "root_sha2")}))
        step *= 2
    done, open_ = state.where(F.col("ptr").isNull()).select(*key, "root_sha", "depth"), state.where(F.col("ptr").isNotNull())
    if step < 2 * n:
        ends = done.select("repo_id", F.col("sha").alias("parent"), F.col("root_sha").alias("over"), F.col("depth").alias("above"))
        rest = open_.select(*key).join(base, key).join(ends, ["repo_id", "parent"], "left")
        rest = rest.groupBy("repo_id").applyInPandas(_peel_rest, "repo_id string, sha string, parent string, root_sha string, depth long")
        return done.join(base, key).select(rest.columns).unionByName(rest)
    # who still points somewhere after more steps than there are nodes points onto a cycle
    on_cycle = open_.select("repo_id", F.col("ptr").alias("sha")).distinct().withColumn("on_cycle", F.lit(True))
    cyclic = open_.join(on_cycle, key, "left").select(*key, F.lit("").alias("root_sha"), F.when(F.col("on_cycle"), -1).otherwise(-2).cast("long").alias("depth"))
    return done.unionByName(cyclic).join(base, key).select(*key, "parent", "root_sha", "depth")


def double(nodes: DataFrame, peel_rows: int = PEEL_ROWS) -> DataFrame:
    """The same columns by pointer doubling over joins; ``nodes`` is (repo_id, sha, parent)."""
    key = ["repo_id", "sha"]
    found = cut(rooted(nodes, peel_rows))
    base = found.where(F.col("depth") >= 0)
    state = cut(base.select(*key, F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("size")))
    while (open_ := state.where(F.col("ptr").isNotNull())).take(1):
        # everything less than 2*step below a node, from its own share and that of the nodes `step` below
        handed = open_.groupBy("repo_id", F.col("ptr").alias("sha")).agg(F.sum("size").alias("handed"))
        grown = _jump(state, [], {})
        state = cut_round(grown.join(handed, key, "left").withColumn("size", F.col("size") + F.coalesce("handed", F.lit(0))).drop("handed"))
    trees = cut(base.join(state.select(*key, "size"), key).select(*key, "parent", "depth", "size"))
    # preorder: a node's place is the sum of the steps on its path
    steps = trees.join(_sibling_steps(trees), key, "left").withColumns({"step": F.coalesce("step", F.lit(0)), "eldest": F.coalesce("eldest", F.lit(False))})
    walk = cut(steps.select(*key, "parent", "depth", "size", "eldest", F.col("parent").alias("ptr"), F.col("step").cast("long").alias("pre"), F.when(F.col("parent").isNull(), F.col("sha")).alias("root_sha")))
    while walk.where(F.col("ptr").isNotNull()).take(1):
        walk = cut_round(_jump(walk, ["pre", "root_sha"], {"pre": F.col("pre") + F.coalesce("pre2", F.lit(0)), "root_sha": F.coalesce("root_sha", "root_sha2")}))
    # heavy paths: eldest children point up until they reach the first node of their path
    start = F.when(~F.col("eldest"), F.col("sha"))
    heads = cut(walk.select(*key, F.when(F.col("eldest"), F.col("parent")).alias("ptr"), start.alias("first")))
    while heads.where(F.col("ptr").isNotNull()).take(1):
        heads = cut_round(_jump(heads, ["first"], {"first": F.coalesce("first", "first2")}))
    firsts = walk.select("repo_id", F.col("sha").alias("first"), F.col("pre").alias("head"), F.col("parent").alias("over"))
    overs = walk.select("repo_id", F.col("sha").alias("over"), F.col("pre").alias("up"))
    top = firsts.where(F.col("over").isNull()).withColumn("up", F.lit(None).cast("long"))
    low = firsts.where(F.col("over").isNotNull()).join(overs, ["repo_id", "over"])
    paths = heads.join(top.unionByName(low).drop("over"), ["repo_id", "first"]).select(*key, "head", "up")
    columns = [*key, "parent", "root_sha", "depth", "pre", "size", "head", "up"]
    none = F.lit(None).cast("long")
    cyclic = found.where(F.col("depth") < 0).withColumns({"root_sha": F.lit(""), "pre": none, "size": none, "head": none, "up": none})
    return walk.join(paths, key).select(columns).unionByName(cyclic.select(columns))


def hierarchy(commits: DataFrame, peel_rows: int = PEEL_ROWS, places: bool = True) -> DataFrame:
    """(repo_id, sha, parent, root_sha, depth, pre, size, head, up): one row for each commit of each repository.

    Without ``places`` only the first five, which takes a third of the rounds for large repositories.
    """
    nodes = links(commits)
    sizes = commits.where(F.col("repo_id").isNotNull()).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > peel_rows).select("repo_id"))  # at most rows / peel_rows names
    columns = ["repo_id", "sha", "parent", "root_sha", "depth", *(["pre", "size", "head", "up"] if places else [])]
    if not large.take(1):
        return nodes.groupBy("repo_id").applyInPandas(_peel_repository, SCHEMA).select(columns)
    small = nodes.join(large, "repo_id", "left_anti").groupBy("repo_id").applyInPandas(_peel_repository, SCHEMA).select(columns)
    return small.unionByName((double if places else rooted)(nodes.join(large, "repo_id", "left_semi"), peel_rows).select(columns))


def _wanted(tree: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    return wanted.select("repo_id", "sha").distinct().join(tree.where(F.col("pre").isNotNull()), ["repo_id", "sha"]).select("repo_id", "root_sha", "sha", *columns)


def _in_ranges(ranges: DataFrame, tree: DataFrame, name: str) -> DataFrame:
    """(repo_id, sha, <name>_sha, <name>_depth): the nodes whose place is in [lo, hi] of (repo_id, root_sha, sha, lo, hi)."""
    cut_up = ranges.where(F.col("lo") <= F.col("hi")).withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))))
    u = tree.where(F.col("pre").isNotNull()).select("repo_id", "root_sha", F.floor(F.col("pre") / BLOCK).alias("block"), "pre", F.col("sha").alias(f"{name}_sha"), F.col("depth").alias(f"{name}_depth"))
    met = cut_up.join(u, ["repo_id", "root_sha", "block"]).where(F.col("pre").between(F.col("lo"), F.col("hi")))
    return met.select("repo_id", "sha", f"{name}_sha", f"{name}_depth")


def ancestors(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo_id, sha, ancestor_sha, ancestor_depth): the path from the root to each wanted node, itself included.

    The number of rows is the total length of the wanted paths, so callers ask for the nodes they need. At most
    log2(n) rounds find the heavy paths on the way up; nodes on or leading to a cycle have no path.
    """
    at = cut(_wanted(tree, wanted, F.col("pre").alias("hi"), F.col("head").alias("lo"), "up"))
    ranges, over = at.drop("up"), tree.where(F.col("pre").isNotNull()).select("repo_id", "root_sha", F.col("pre").alias("hi"), F.col("head").alias("lo"), F.col("up").alias("next"))
    while at.where(F.col("up").isNotNull()).take(1):
        climb = at.where(F.col("up").isNotNull()).select("repo_id", "root_sha", "sha", F.col("up").alias("hi"))
        at = cut_round(climb.join(over, ["repo_id", "root_sha", "hi"]).select("repo_id", "root_sha", "sha", "hi", "lo", F.col("next").alias("up")))
        ranges = ranges.unionByName(at.drop("up"))
    return _in_ranges(ranges, tree, "ancestor")


def descendants(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo_id, sha, descendant_sha, descendant_depth): all nodes below each wanted node."""
    v = _wanted(tree, wanted, (F.col("pre") + 1).alias("lo"), (F.col("pre") + F.col("size") - 1).alias("hi"))
    return _in_ranges(v, tree, "descendant")
