import random
from datetime import datetime

from pyspark.sql import functions as F

from lodeline.functions import text as X
from lodeline.operators import access as A
from lodeline.operators import evaluation as M
from lodeline.operators import graph as G
from lodeline.operators import intervals as V
from lodeline.operators import ledger as L
from lodeline.operators import retrieval as R
from lodeline.operators import search as S
from lodeline.operators import similarity as D

T0 = datetime(2020, 1, 1)


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).collect()[0][0]


def test_grants_cover_themselves_and_below_only(spark):
    df = spark.createDataFrame([("a",), ("a:b",), ("ab",), ("b",), (None,)], "s string")
    kept = [r[0] for r in df.where(A.permitted(F.col("s"), ("a", " "))).collect()]
    assert kept == ["a", "a:b", None]
    assert [r[0] for r in df.where(A.permitted(F.col("s"), ())).collect()] == [None]


def test_exclusion_globs(spark):
    df = spark.createDataFrame([("docs/a.md",), ("src/docs",), ("src/x.py",), ("src/tests/y.py",), (None,)], "p string")
    rules = (A.Exclusion("docs/**"), A.Exclusion("tests"), A.Exclusion("*.py", "2099-01-01 00:00:00"))
    got = df.select(A.excluded_by(F.col("p"), F.lit(T0), rules)).collect()
    assert [r[0] for r in got] == ["docs/**", None, None, "tests", None]


def test_interval_end_is_outside(spark):
    df = spark.createDataFrame([(1, T0, datetime(2020, 1, 2)), (2, datetime(2020, 1, 2), None)], "k int, valid_from timestamp_ntz, valid_to timestamp_ntz")
    at = F.lit(datetime(2020, 1, 2)).cast("timestamp_ntz")
    assert [r["k"] for r in df.where(V.holds_at(at)).collect()] == [2]


def test_exclusive_edges_do_not_depend_on_arrival(spark):
    data = [("n", f"s{i % 3}", datetime(2020, 1, 1 + i), None) for i in range(9)]
    schema = "from_id string, to_id string, valid_from timestamp_ntz, valid_to timestamp_ntz"
    shuffled = data[:]
    random.Random(1).shuffle(shuffled)
    a, b = (V.exclusive(spark.createDataFrame(x, schema), ["from_id"]).orderBy("valid_from").collect() for x in (data, shuffled))
    assert a == b and a[0]["valid_to"] == datetime(2020, 1, 2) and a[-1]["valid_to"] is None


def test_traversal_ends_on_cycles_and_at_hidden_nodes(spark):
    hops = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "C"), ("C", "D"), ("A", "X"), ("X", "Y")], "id string, other_id string")
    seen = spark.createDataFrame([(x,) for x in "ABCDY"], "id string")
    got = {(r["id"], r["depth"]) for r in G.traverse(hops, spark.createDataFrame([("A",)], "id string"), 6, seen).collect()}
    assert got == {("B", 1), ("C", 2), ("D", 3)}


def test_components_of_long_chains(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("p", "q"), ("z", "z")]
    got = {r["id"]: r["component"] for r in G.components(spark.createDataFrame(links, "id string, other_id string")).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and got["q"] == "p" and got["z"] == "z"


def test_registered_closures_go_ten_hops(spark, tmp_path):
    from lodeline.plans import registry

    chain = [("r", f"{i:02}", [f"{i - 1:02}"] if i else None) for i in range(14)]
    spark.createDataFrame(chain, "repo_id string, sha string, parents array<string>").write.parquet(f"{tmp_path}/commit_record.parquet")
    spark.createDataFrame([(1, i, datetime(2020, 1, 1 + i)) for i in range(14)], "user_id long, event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    found = {name: {(r["id"], r["depth"]) for r in registry.queries()[name](spark, str(tmp_path)).collect()} for name in ("provenance", "dependents", "session_lineage")}
    assert found["provenance"] == {(f"r {13 - k:02}", k) for k in range(1, 11)}
    assert found["dependents"] == {(f"r {k:02}", k) for k in range(1, 11)}
    assert found["session_lineage"] == {(13 - k, k) for k in range(1, 11)}


def test_ancestor_difference_against_brute_force(spark):
    rnd = random.Random(7)
    up = {("a", i): [i - 1] if i else [] for i in range(23)} | {("b", i): rnd.sample(range(i), min(i, 2)) + ([900 + i] if i > 15 else []) for i in range(20)} | {("c", 0): [1], ("c", 1): [0, 2], ("c", 2): None}
    ends = {"a": (22, 8), "b": (19, 12), "c": (0, None)}

    def reach(repo, v):
        seen, todo = set(), [v]
        while todo:
            if (v := todo.pop()) is not None and v not in seen:
                seen.add(v)
                todo += up.get((repo, v)) or []
        return seen

    want = {(r, str(h), str(v), (r, v) in up) for r, (h, p) in ends.items() for v in reach(r, h) - reach(r, p)}
    parents = spark.createDataFrame([(r, str(v), p and [str(x) for x in p]) for (r, v), p in up.items()], "repo_id string, id string, parents array<string>")
    heads = spark.createDataFrame([(r, str(h), None if p is None else str(p)) for r, (h, p) in ends.items()], "repo_id string, head string, previous string")
    for rows in (1_000, 21):  # the second takes the long chain through joins
        got = list(map(tuple, G.ancestor_difference(parents, heads, rows).collect()))
        assert len(got) == len(want) and set(got) == want
    assert ("a", "22", "9", True) in want and any(not known for *_, known in want)


def test_full_tie_with_different_statements_has_no_preference(spark):
    schema = "evidence_id string, subject_id string, field_name string, source_system string, statement string, authority int, confidence double, observed_at timestamp_ntz"
    rows = [("a", "s", "f", "git", "1", 60, 0.9, T0), ("b", "s", "f", "jira", "2", 60, 0.9, T0), ("c", "t", None, "git", "1", 0, None, None), ("d", "t", None, "jira", "2", 20, None, T0)]
    assert [(r["subject_id"], r["evidence_id"]) for r in L.preferred(spark.createDataFrame(rows, schema)).collect()] == [("t", "c")]


def test_limits(spark):
    assert [R.clamp_limit(x) for x in (None, -1, 0, 7, 10_000, True, "9")] == [50, 50, 50, 7, 500, 50, 50]
    assert [R.clamp_offset(x) for x in (None, -3, 4)] == [0, 0, 4]


def test_ranking_metrics_by_hand(spark):
    judged = spark.createDataFrame([("q", i, i + 1, i in (1, 3)) for i in range(4)], "query_id string, item int, rank int, relevant boolean")
    assert M.precision(judged, 2).collect()[0]["value"] == 0.5
    assert M.recall(judged, 2).collect()[0]["value"] == 0.5
    assert M.reciprocal_rank(judged).collect()[0]["value"] == 0.5
    assert abs(M.ndcg(judged, 10).collect()[0]["value"] - (1 / 1.5849625 + 1 / 2.3219281) / (1 + 1 / 1.5849625)) < 1e-6


def test_greedy_admission_passes_over(spark):
    rows = spark.createDataFrame([("k", 1, 5), ("k", 2, 9), ("k", 3, 4), ("k", 4, 1)], "k string, item long, cost long")
    assert sorted(r["item"] for r in M.admit(rows, ["k"], "item", "cost", 10).collect()) == [1, 3, 4]


def test_greedy_admission_goes_on_to_the_last_row(spark):
    rnd = random.Random(5)
    data = [(k, i, rnd.choice([None, 0, *range(1, 60), 900])) for k in "ab" for i in range(1500)]
    data += [("c", i, 300) for i in range(700)] + [("c", 700, 100), ("c", 701, 0), ("c", 702, 1)]
    want, used = [], {}
    for k, i, cost in data:
        if cost is not None and used.get(k, 0) + cost <= 1000:
            want.append((k, i))
            used[k] = used.get(k, 0) + cost
    rnd.shuffle(data)
    got = M.admit(spark.createDataFrame(data, "k string, item long, cost long"), ["k"], "item", "cost", 1000).collect()
    assert sorted(map(tuple, got)) == sorted(want) and ("c", 700) in want


def test_query_lines():
    q = S.parse('Alpha "two words" -gone or')
    assert (q.groups, q.excluded) == (((("alpha",),), (("two", "word"),)), (("gone",),))
    assert S.parse("a1b or c2d tests").groups == ((("a1b",), ("c2d",)), (("test",),))
    assert S.relaxed(S.parse("a1b c2d")).groups == ((("a1b",), ("c2d",)),) and S.relaxed(S.parse("abc -def")) == S.parse("abc -def")
    assert S.parse('"').groups == () and S.parse("").terms == () and S.parse("the of").groups == ()


def test_lexemes_are_the_same_in_both_places(spark):
    for text in ("Classes indexing tried buses gas status", "Состояние 状態を保持 abc状態", "the a9 É_x", ""):
        assert one(spark, text, S.tokens) == S.lexemes_of(text), text


def test_text_functions(spark):
    assert one(spark, "", lambda v: X.estimate_tokens(v)) == 0 and one(spark, "ab cd", lambda v: X.estimate_tokens(v)) == 3
    assert one(spark, "a\r\nb\nc", lambda v: X.line_stats(v)["ending"]) == "mixed"
    assert one(spark, "Fixes #12 prefix #3 closes: o/r#4", X.closing_references) == ["#12", "o/r#4"]
    refs = one(spark, "fixes ABC-12 xABC-12 AB-1-2 o/r#5", lambda v: X.text_references(v, "issue"))
    assert [(r["ref"], r["closing"]) for r in refs] == [("ABC-12", True)]
    assert [r["ref"] for r in one(spark, "see o/r#5", lambda v: X.text_references(v, "number"))] == ["o/r#5"]
    assert one(spark, "<h1>A &amp; b</h1><p> c <b>d</b></p><p></p>", X.html_blocks) == ["A & b", "c d"]
    assert [one(spark, v, X.classify_query) for v in ("b9559ab", "abc123", "src/main.ts", "changes in src/main.ts")] == ["object", "prose", "path", "prose"]
    assert one(spark, "u+tag@Mail.example", X.normalise_address) == "u@mail.example"
    assert one(spark, "5+octo@users.noreply.github.com", X.login_of) == "octo" and one(spark, "a@b.example", X.login_of) is None
    assert one(spark, "https://u:pw@h/x?token=abc&n=1", X.redact_log) == "https://u:[redacted]@h/x?token=[redacted]&n=1"
    assert one(spark, "one two session three", lambda v: S.highlight(v, ("session",), 3)) == "two [session] three"
    assert one(spark, "DECISION: use X", X.memory_of).asDict() == {"kind": "decision", "origin": "explicit", "confidence": 0.95, "statement": "use X"}
    assert one(spark, "TODO:", X.memory_of) is None


def test_nearest_takes_the_lowest_ids_of_equal_scores(spark):
    vecs = [(i, [1.0, 2.0, 3.0] if i % 3 == 2 else [float(i % 7) - 9, 1.0, 0.5]) for i in range(3000)]
    random.Random(4).shuffle(vecs)
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").coalesce(1)
    got = D.nearest(df, df.where("vec_id = 1502"), 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 5, 8, 11, 14]


def test_nearest_pages_behind_unusable_queries(spark):
    vecs = [(i, [0.0, 0.0] if i in (1, 2, 3) else [float(i + 1), 1.0]) for i in range(8)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    got = D.nearest(df, df, 1, block=2).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(i, i) for i in (0, 4, 5, 6, 7)]


def test_nearest_and_near_duplicates_against_brute_force(spark):
    rnd = random.Random(3)
    vecs = [(i, [rnd.random() for _ in range(8)]) for i in range(60)] + [(60, None), (61, [0.0] * 8), (62, [1.0] * 3)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    got = {}
    for r in D.nearest(df, df.where("vec_id % 20 = 0"), 3, block=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    for q in (0, 20, 40):
        want = sorted(range(60), key=lambda v: (-cos(vecs[q][1], vecs[v][1]), v))[:3]
        assert [v for _, v in sorted(got[q])] == want

    words = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(50):
        base = rnd.sample(words, 25)
        texts += [" ".join(base), " ".join(base), " ".join([*base[:24], "changed"]), " ".join(base[:3])]
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "...")]
    out = {r["doc_id"]: r for r in D.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}

    def sh(t):
        w = t.split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))

    sets = {i: sh(t) for i, t in enumerate(texts)}
    classes = {}
    for i, s in sets.items():
        classes.setdefault(s, i)
    for i, s in sets.items():
        links = sum(1 for o in classes if o != s and len(o & s) >= 0.8 * len(o | s))
        assert out[i]["class_id"] == classes[s] and out[i]["links"] == links
    assert set(out) == set(sets)


def test_near_duplicates_keeps_no_sets_and_finds_all_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    frequent = [f"f{i}" for i in range(30)]
    texts = [" ".join(frequent + [f"w{rnd.randrange(99)}" for _ in range(k)]) for k in (0, 3, 8, 9) for _ in range(8)]
    texts += [" ".join(t.split()[k:]) for t in texts for k in (1, 4, 6)]
    kept, cut = [], D.cut
    monkeypatch.setattr(D, "cut", lambda df: kept.append(df.columns) or cut(df))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in D.near_duplicates(docs).collect()}
    assert kept and not any("s" in columns for columns in kept)  # sets take more room than the texts they are made of
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    classes = list(dict.fromkeys(sets))
    for i, s in enumerate(sets):
        assert out[i]["class_id"] == sets.index(s)
        assert out[i]["links"] == sum(o != s and len(o & s) >= 0.8 * len(o | s) for o in classes)
    assert D.near_duplicates(docs.limit(0)).collect() == []
