import unicodedata
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodeline.functions.canonical import full_ref, repository_path
from lodeline.operators.snapshots import snapshot_changes

S = "entry_id long, repo_id string, snapshot_no int, is_complete boolean, path string, oid string, acquired_at timestamp_ntz, row_hash string, item_name string"
T0 = datetime(2020, 1, 1)


def run(spark, data):
    df = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(data)], S)
    out = snapshot_changes(df, repository_path(F.col("path")), F.lower("oid"), "path")
    return sorted(tuple(r) for r in out.collect())


def test_added_removed_changed_over_gaps_and_incomplete(spark):
    a, b = T0, T0 + timedelta(hours=1)
    nfd = unicodedata.normalize("NFD", "ü/é.py")
    data = [
        ("r", 1, True, "keep.py", "AA", a), ("r", 1, True, "gone.py", "bb", a), ("r", 1, True, nfd, "cc", a), ("r", 1, True, "unknown.py", None, a),
        ("r", 2, False, "keep.py", "zz", a),
        ("r", 5, True, ".\\keep.py", "aa", a), ("r", 5, True, "./ü/é.py", "dd", a), ("r", 5, True, "new.py", "ee", a), ("r", 5, True, "unknown.py", "ff", a),
        ("r", 5, True, "New.py", "ee", a), ("r", 5, True, "new.py", "e0", b), ("q", 1, True, "x", "1", a), (None, 1, True, "x", "1", a), ("r", 5, True, None, "1", a),
    ]
    assert run(spark, data) == [
        ("r", 5, "path", "New.py", "added"), ("r", 5, "path", "gone.py", "removed"), ("r", 5, "path", "new.py", "added"), ("r", 5, "path", "ü/é.py", "changed"),
    ]


def test_repeated_rows_ties_and_empty(spark):
    data = [("r", 1, True, "a", "1", T0), ("r", 2, True, "a", "2", T0), ("r", 2, True, "a", "2", T0)]
    assert run(spark, data) == [("r", 2, "path", "a", "changed")]
    assert run(spark, []) == []


def test_full_ref(spark):
    df = spark.createDataFrame([("main",), ("refs/tags/v1",), ("refsx",)], "r string").select(full_ref(F.col("r")))
    assert [r[0] for r in df.collect()] == ["refs/heads/main", "refs/tags/v1", "refs/heads/refsx"]
