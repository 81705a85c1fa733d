import ast
from datetime import datetime
from pathlib import Path

from lodeline.engine import Engine, Tables
from lodeline.operators import access as A
from lodeline.plans import registry

T0 = datetime(2020, 1, 1)
ROOT = Path(__file__).resolve().parents[1]


def engine(spark, access=None):
    entities = spark.createDataFrame(
        [("e1", "file", "git", "a.py", None, "active", '{"path":"src/session.py"}', T0), ("e2", "file", "git", "b.py", "r1", "active", '{"path":"src/b.py"}', T0), ("e3", "issue", "jira", "K-1", None, "deleted", '{"title":"session token lost"}', T0)],
        "id string, kind string, source_system string, source_id string, source_scope string, lifecycle string, attributes string, observed_at timestamp_ntz",
    )
    evidence = spark.createDataFrame(
        [("v1", "e1", "title", "session kept", "git", 60, 0.9, T0, "current", None), ("v2", "e1", "title", "token", "jira", 40, 0.5, T0, "current", None), ("v3", "e1", None, "secret session", "git", 0, None, None, "stale", "r1")],
        "evidence_id string, subject_id string, field_name string, statement string, source_system string, authority int, confidence double, observed_at timestamp_ntz, evidence_state string, permission_scope string",
    )
    edges = spark.createDataFrame([("e1", "links", "e2", T0, None), ("e2", "links", "e3", T0, None), ("e1", "links", "e3", T0, datetime(2020, 2, 1))], "from_id string, type string, to_id string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    return Engine(Tables(entities, evidence, edges), access)


def test_access_comes_first(spark):
    e = engine(spark)
    assert e.get_entity("e2").count() == 0 and e.get_entity("e1").count() == 1
    assert [tuple(r) for r in e.withheld().collect()] == [("permission", 1)]
    assert e.neighbours("e1").count() == 0 and e.neighbours("e1", depth=3).count() == 0  # e2 is hidden and not walked through
    assert {r["evidence_id"] for r in e.why("e1").collect()} == {"v1", "v2"}
    # what is hidden gives nothing away by its edges, evidence or answers
    assert e.neighbours("e2").count() == 0 and e.why("e2").count() == 0 and e.answer("e2").count() == 0
    wide = engine(spark, A.Access(grants=("r1",)))
    assert {(r["id"], r["depth"]) for r in wide.neighbours("e1", depth=3).collect()} == {("e2", 1), ("e3", 2)}
    assert {r["other_id"] for r in wide.neighbours("e1", at="2020-01-15 00:00:00").collect()} == {"e2", "e3"}


def test_search_find_answer_explain(spark):
    e = engine(spark)
    assert [r["id"] for r in e.search("session token").collect()] == ["e3", "e1"]  # all words first, then some
    assert [r["id"] for r in e.search("src/session.py").collect()] == ["e1"]
    assert e.search("").count() == 0 and e.search('"').count() == 0
    assert [r["because"] for r in e.explain("session token").orderBy("rank").collect()][0] is None
    assert {r["id"]: r["more"] for r in e.find(limit=1).collect()} == {"e1": True}
    assert [(r["field_name"], r["evidence_id"]) for r in e.answer("e1").collect()] == [("title", "v1")]


def test_a_path_that_names_nothing_is_searched(spark):
    assert [r["id"] for r in engine(spark).search("src/session").collect()] == ["e1", "e3"]


def test_pack(spark):
    entries, omitted = engine(spark).context_pack("session token", budget=12, limit=5)
    assert [r["id"] for r in entries.collect()] == ["e3"] and [tuple(r) for r in omitted.collect()] == [("budget", "items", 1)]


def test_every_check_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 100


def test_nothing_outside_the_subpackage_imports_it():
    for path in [*ROOT.glob("lodeline/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(".llm" in n for n in names), path


def test_plans_stay_in_the_jvm_and_use_no_cartesian_product(spark):
    for name in ("find_entities", "preferred_evidence", "exclusive_intervals", "evidence_state", "search_strict"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name
