import random
from datetime import datetime

import numpy as np

from lodeline.operators.hierarchy import ancestors, descendants, hierarchy, peel

C = "row_id long, repo_id string, sha string, parents array<string>, acquired_at timestamp_ntz, depth string, size string"


def brute(data):
    last = {}
    for row, repo, sha, parents, at, *_ in data:
        if repo is None or sha is None:
            continue
        key = (at or datetime.min, row)
        if (repo, sha) not in last or key > last[repo, sha][0]:
            last[repo, sha] = (key, parents)
    up = {}
    for (repo, sha), (_, parents) in last.items():
        p = parents[0] if parents else None
        up[repo, sha] = (repo, p) if p is not None and (repo, p) in last else None
    out = {}
    for node in up:
        path, seen, at = [], set(), node
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            at = up[at]
        if at is None:
            out[node] = (path[-1][1], len(path) - 1)
        else:
            cycle = set(path[path.index(at) :])
            out[node] = ("", -1 if node in cycle else -2)
    return out, up


def made(seed, n=250):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        repo = "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None])
        k = rnd.randrange(n)
        p = rnd.choice([[f"s{rnd.randrange(n)}"], [f"s{k - 1}"], [f"s{k + 1}", "s0"], [], None, [None], ["absent"]])
        data.append((i, repo, rnd.choice([f"s{k}"] * 20 + [None]), p, datetime(2020, 1, 1 + rnd.randrange(20)), "x", "y"))
    data += [(9000, "a", "self", ["self"], datetime(2020, 1, 1), "x", "y"), (9001, "a", "to-self", ["self"], datetime(2020, 1, 1), "x", "y")]
    return data


def test_against_brute_force_both_ways(spark):
    for seed in (1, 2):
        data = made(seed)
        want, up = brute(data)
        df = spark.createDataFrame(data, C)
        for bound in (10_000, 30):
            got = hierarchy(df, bound).collect()
            assert {(r["repo_id"], r["sha"]): (r["root_sha"], r["depth"]) for r in got} == want
            assert len(got) == len(want)
            below = {}
            for node in want:
                at = up[node] if want[node][1] >= 0 else None
                while at is not None:
                    below[at] = below.get(at, 0) + 1
                    at = up[at]
            for r in got:
                node = (r["repo_id"], r["sha"])
                assert (r["size"] - 1 if r["depth"] >= 0 else None) == (below.get(node, 0) if r["depth"] >= 0 else None)


def test_paths_and_descendants_from_the_preorder(spark):
    data = made(5)
    want, up = brute(data)
    tree = hierarchy(spark.createDataFrame(data, C))
    nodes = [n for n in want if want[n][1] >= 0]
    wanted = spark.createDataFrame(nodes, "repo_id string, sha string")
    path = {}
    for r in ancestors(tree, wanted).collect():
        path.setdefault((r["repo_id"], r["sha"]), []).append((r["ancestor_depth"], r["ancestor_sha"]))
    for n in nodes:
        line, at = [], n
        while at is not None:
            line.append(at[1])
            at = up[at]
        assert [s for _, s in sorted(path[n])] == line[::-1]
    assert descendants(tree, wanted).count() == sum(len(p) - 1 for p in path.values())


def test_both_ways_give_the_same_places_and_lists(spark):
    data = made(7)
    small, large = (hierarchy(spark.createDataFrame(data, C), bound) for bound in (10_000, 30))
    columns = ["repo_id", "sha", "parent", "root_sha", "depth", "pre", "size", "head", "up"]
    assert sorted(map(str, small.select(columns).collect())) == sorted(map(str, large.select(columns).collect()))


def test_wide_and_deep_tree_lists(spark, monkeypatch):
    from lodeline.operators import hierarchy as H

    monkeypatch.setattr(H, "BLOCK", 7)
    data = [(i, "r", f"{i:03d}", [f"{(i - 1 if i % 3 else i // 2):03d}"] if i else None, datetime(2020, 1, 1), "x", "y") for i in range(120)]
    want, up = brute(data)
    df = spark.createDataFrame(data, C)
    tree = hierarchy(df)
    assert ancestors(tree, df).count() == sum(d + 1 for _, d in want.values())
    assert descendants(tree, df).count() == sum(d for _, d in want.values())


def test_long_chain_and_empty(spark):
    n = 5000
    up = np.arange(-1, n - 1)
    root, depth, pre, size, head, above = peel(up)
    assert (head == 0).all() and (above == -1).all()
    assert (root == 0).all() and (depth == np.arange(n)).all() and (pre == np.arange(n)).all() and (size == np.arange(n, 0, -1)).all()
    assert hierarchy(spark.createDataFrame([], C)).count() == 0


def test_large_repositories_without_places_and_with_few_rounds(spark, monkeypatch):
    from lodeline.operators import hierarchy as H

    data = made(11) + [(10_000 + i, "hot", f"deep{i}", [f"deep{i - 1}"] if i else None, datetime(2020, 1, 1), "x", "y") for i in range(60)]
    want, _ = brute(data)
    df = spark.createDataFrame(data, C)
    for bound, most in ((1, 40), (80, 2)):  # all rounds to the end; open ones peeled
        kept, cut = [], H.cut_round
        monkeypatch.setattr(H, "cut_round", lambda d: kept.append(cut(d)) or kept[-1])
        got = hierarchy(df, bound, places=False).collect()
        monkeypatch.setattr(H, "cut_round", cut)
        assert {(r["repo_id"], r["sha"]): (r["root_sha"], r["depth"]) for r in got} == want and len(got) == len(want)
        assert len(kept) <= most
        assert max(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() for d in kept or [df]) <= 100  # no growth by rounds
        assert max(d.rdd.getNumPartitions() for d in kept or [df]) <= 4  # as many as spark.sql.shuffle.partitions, in every round


def test_paths_and_descendants_of_all_commits_are_registered(spark, tmp_path):
    from lodeline.plans.problems import QUERIES

    data = [(i, "r", f"s{i}", [f"s{i - 1}"] if i % 40 else None, datetime(2020, 1, 1), "x", "y") for i in range(1, 120)]
    spark.createDataFrame(data, C).write.parquet(f"{tmp_path}/commit_record.parquet")
    want, _ = brute(data)
    paths = QUERIES["p6_all_paths"](spark, str(tmp_path)).collect()
    assert {(r["repo_id"], r["sha"]) for r in paths} == set(want) and len(paths) == sum(d + 1 for _, d in want.values())
    assert QUERIES["p6_all_descendants"](spark, str(tmp_path)).count() == sum(d for _, d in want.values())
