import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeline.functions.canonical import canonical_json
from lodeline.operators.history import HistoryStore, StaleWrite, apply_batch, as_of, build_chains

U = "delivery_id long, id string, attributes string, lifecycle string, source_observed_at timestamp_ntz, recorded_at timestamp_ntz, digest string, n long"
C = "change_id long, entity_id string, change_action string, changed_at timestamp_ntz, recorded_at timestamp_ntz, at string"
T0 = datetime(2020, 1, 1)


def t(h):
    return T0 + timedelta(hours=h)


def rows(df):
    return sorted((r["id"], r["valid_from"], r["valid_to"] or datetime.max, r["lifecycle"] or "") for r in df.collect())


def brute(updates, changes):
    """One entity after the other, one instant after the other."""
    events = {}
    for d, i, a, l, o, r, *_ in updates:
        if i is not None and (o or r) is not None:
            events.setdefault(i, []).append((o or r, r or datetime.min, True, d, canonical_json(a), l))
    known = set(events)
    for c, i, act, at, r, *_ in changes:
        if i in known and at is not None and act in ("retire", "reinstate"):
            events[i].append((at, r or datetime.min, False, c, None, "deleted" if act == "retire" else "active"))
    out = []
    for i, ev in events.items():
        ev.sort(key=lambda e: e[:4])
        state, report, versions = None, False, []
        attrs = None
        for k, (at, _, rep, _, a, l) in enumerate(ev):
            if rep:
                attrs, report = a, True
            if (k + 1 < len(ev) and ev[k + 1][0] == at) or not report:
                continue
            if state is None or state != (attrs, l):
                state = (attrs, l)
                versions.append((at, l))
        for k, (at, l) in enumerate(versions):
            out.append((i, at, versions[k + 1][0] if k + 1 < len(versions) else datetime.max, l or ""))
    return sorted(out)


def made(seed, n=300):
    rnd = random.Random(seed)
    ups, chs = [], []
    for d in range(n):
        i = "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "c", None])
        v = rnd.randrange(3)
        a = rnd.choice([json.dumps({"x": v, "y": [1, 2]}), json.dumps({"y": [1, 2], "x": float(v)}, indent=1), None, "no json"])
        ups.append((d, i, a, rnd.choice(["active", "deleted", None]), rnd.choice([t(rnd.randrange(60)), None]), t(100 + d), "x", 1))
    for c in range(60):
        chs.append((c, rnd.choice(["hot", "a", "zz", None]), rnd.choice(["retire", "reinstate", "other"]), rnd.choice([t(rnd.randrange(120)), None]), t(200 + c), "q"))
    return ups, chs


def frames(spark, ups, chs):
    return spark.createDataFrame(ups, U), spark.createDataFrame(chs, C)


def test_same_json_value_has_one_spelling():
    assert canonical_json('{"b":1,"a":[1, 2]}') == canonical_json('{"a": [1.0,2e0], "b": 10e-1}')
    assert canonical_json('"\\u00e9"') == canonical_json('"é"')
    assert canonical_json("[1,2]") != canonical_json("[2,1]")
    assert canonical_json("oops") not in (canonical_json('"oops"'), None) and canonical_json(None) is None
    assert canonical_json("123456789012345678901234567890") != canonical_json("123456789012345678901234567891")


def test_against_brute_force_and_hot_entities(spark):
    for seed in (1, 2):
        ups, chs = made(seed)
        u, c = frames(spark, ups, chs)
        want = brute(ups, chs)
        assert rows(build_chains(u, c)) == want
        assert rows(build_chains(u, c, hot_rows=20)) == want


def test_late_batch_equals_full_rebuild(spark):
    ups, chs = made(3)
    u, c = frames(spark, ups, chs)
    early = F.col("recorded_at") < F.lit(t(230)).cast("timestamp_ntz")
    before = apply_batch(None, u.where(early), c.where(early))
    touched = u.where(~early).select("id").unionByName(c.where(~early).select(F.col("entity_id").alias("id")))
    assert rows(apply_batch(before, u, c, touched)) == brute(ups, chs)


def test_empty_tables(spark):
    u, c = frames(spark, [], [])
    assert build_chains(u, c).count() == 0


def test_store_swaps_versions_and_reads_as_of(spark, tmp_path):
    ups, chs = made(4, 80)
    u, c = frames(spark, ups, chs)
    store = HistoryStore(spark, str(tmp_path / "h"), buckets=4)
    assert store.read() is None
    store.apply(u.limit(0), c)
    assert store.version() == 0
    after = store.apply(u, c.limit(0))
    assert store.version() == 1 and rows(after) == brute(ups, chs)
    at = F.lit(t(30)).cast("timestamp_ntz")
    per_entity = as_of(after, at).groupBy("id").count().collect()
    assert per_entity and all(r["count"] == 1 for r in per_entity)
    assert store.apply(u.limit(0), c.limit(0)).count() == after.count() and store.version() == 1  # nothing came, nothing is written


def test_batches_in_any_order_and_untouched_buckets_stay(spark, tmp_path):
    ups, chs = made(5, 120)
    u, c = frames(spark, ups, chs)
    store = HistoryStore(spark, str(tmp_path / "h"), buckets=8, hot_rows=20)
    for k in (2, 0, 1):
        store.apply(u.where(F.col("delivery_id") % 3 == k), c.where(F.col("change_id") % 3 == k))
    assert rows(store.read()) == brute(ups, chs)
    before = store._manifest(store.version())["chains"]
    store.apply(u.where("id = 'a'").limit(1), c.limit(0))
    after = store._manifest(store.version())["chains"]
    assert sum(before[k] != after[k] for k in before) <= 1
    kept = rows(store.read())
    store.vacuum(1)
    assert store.versions() == [3] and rows(store.read()) == kept


def test_two_writers_from_one_version_never_mix(spark, tmp_path, monkeypatch):
    ups, chs = made(6, 60)
    u, c = frames(spark, ups, chs)
    first, second = (HistoryStore(spark, str(tmp_path / "h"), buckets=4) for _ in range(2))
    first.apply(u.where("id = 'a'"), c.limit(0))
    monkeypatch.setattr(second, "version", lambda: 0)  # has read version 0 and is slower
    first.apply(u.where("id = 'b'"), c.limit(0))
    want = rows(first.read())
    with pytest.raises(StaleWrite):
        second.apply(u.where("id = 'c'"), c.limit(0))
    assert rows(first.read()) == want and first.versions() == [0, 1]
