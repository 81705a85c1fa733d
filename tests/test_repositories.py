import json

import pyarrow as pa

from lodeline.sources import repositories as G
from lodeline.sources.content import dispatch


def texts(spark, text):
    return spark.createDataFrame([("r", text), ("empty", ""), ("null", None)], "repo_id string, text string")


def test_tree_refs_worktrees_status(spark):
    oid = "a" * 40
    tree = G.tree(texts(spark, f"100644 blob {oid}      12\ta b.txt\x00120000 blob {oid}       3\tlink\x00160000 commit {oid}       -\tsub\x00100755 blob {oid} 1\tx.sh\x00oops\x00")).collect()
    assert [(r["path"], r["kind"], r["size_bytes"]) for r in tree] == [("a b.txt", "file", 12), ("link", "symlink", 3), ("sub", "submodule", None), ("x.sh", "executable", 1)]
    refs = G.refs(texts(spark, f"refs/heads/main\t{oid}\t*\nrefs/tags/v1\t{oid}\t \nnope\n")).collect()
    assert [(r["ref_name"], r["is_head"]) for r in refs] == [("refs/heads/main", True), ("refs/tags/v1", False)]
    trees = G.worktrees(texts(spark, f"worktree /a\nHEAD {oid}\nbranch refs/heads/main\n\nworktree /b\nHEAD {oid}\ndetached\n\n")).collect()
    assert [(r["path"], r["branch"], r["detached"]) for r in trees] == [("/a", "refs/heads/main", False), ("/b", None, True)]
    lines = [f"1 M. N... 100644 100644 100644 {oid} {oid} a.txt", f"1 .M N... 100644 100644 100644 {oid} {oid} b c.txt", f"2 R. N... 100644 100644 100644 {oid} {oid} R100 new.txt\told.txt", "? u.txt", f"u UU N... 1 1 1 1 {oid} {oid} {oid} c.txt", "# branch.head main"]
    s = G.status(texts(spark, "\n".join(lines))).first()
    assert (s["staged"], s["unstaged"], s["untracked"], s["conflicted"]) == (2, 1, 1, 1) and s["sample"] == ["a.txt", "b c.txt", "c.txt", "new.txt", "u.txt"]


def test_history_of_odd_texts(spark):
    sha = "b" * 40
    good = "\x1f".join([sha, f"{sha} {sha}", "N", "n@x", "2020-01-01T00:00:00+02:00", "not a time", "subject \x1e"])
    rows = G.history(texts(spark, good + "\x00short\x1fentry\x00")).collect()
    assert len(rows) == 1 and rows[0]["parents"] == [sha, sha] and rows[0]["committed_at"] is None and rows[0]["subject"] == "subject \x1e"


def test_recorded_listings_and_rich_text(spark):
    body = json.dumps([{"id": 1, "number": 7, "title": "t", "user": {"login": "u"}}, {"id": 2}])
    df = spark.createDataFrame([("a", body), ("b", "{"), ("c", "[]"), ("d", None)], "scope string, body string")
    rows = {(r["scope"], r["id"]): (r["author"], r["problem"]) for r in G.recorded(df, "issue").collect()}
    assert rows[("a", "1")] == ("u", None) and rows[("a", "2")] == (None, None) and rows[("b", None)][1] == "unparseable"
    rich = json.dumps({"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": " b"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "c"}]}]})
    assert G.document_text(pa.array([rich, "plain", None, "[1]"])).to_pylist() == ["a b\nc", "plain", None, "[1]"]
    assert G.jql(["A", 'B"'], "2020-01-01") == 'project in ("A", "B\\"") AND updated >= "2020-01-01" ORDER BY updated ASC, key ASC'


def test_discovery_and_blobs(spark, tmp_path):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    (tmp_path / "b" / "c").mkdir(parents=True)
    (tmp_path / "b" / "c" / ".git").write_text("gitdir: x")
    for n in ("objects", "refs"):
        (tmp_path / "bare.git" / n).mkdir(parents=True)
    (tmp_path / "bare.git" / "HEAD").write_text("x")
    rows = G.discover(spark, [str(tmp_path)]).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["kind"], r["complete"]) for r in rows] == [("a", "repository", True), ("c", "worktree", True), ("bare.git", "bare", True)]
    files = spark.createDataFrame([("x", G.BLOB_BYTES + 1, b"1"), ("y", 1, b"1"), ("z", 0, None)], "path string, length long, content binary")
    assert [r["reason"] for r in G.blobs(files).collect()] == ["too-large", None, "unreadable"]


def test_python_outline():
    text = "import a.b as c\nfrom . import d\nclass K:\n    def m(self):\n        def n(): pass\ndef f(): pass\n"
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, "def ("])], names=["file_id", "text"])
    rows = next(G.python_outline(iter([batch]))).to_pylist()
    assert [(r["kind"], r["qualified_name"]) for r in rows] == [("import", "a.b"), ("import", "..d"), ("class", "K"), ("method", "K.m"), ("method", "K.m.n"), ("function", "f"), ("unparsed", None)]


def test_dispatch(spark):
    rows = [("a.py", "x", 1, None, "code"), ("a.md", "x", 1, None, None), ("a.xyz", "x", 1, None, None), ("a.py", "", 0, None, "code"), ("a.py", None, 9, "binary", "code"), ("a.py", "x", 5 << 20, None, "code"), (None, None, None, None, None)]
    got = dispatch(spark.createDataFrame(rows, "path string, text_content string, byte_size long, omitted_reason string, language_parser string")).collect()
    assert [(r["parser"], r["reason"]) for r in got] == [("code", None), ("markdown", None), (None, "no-parser"), (None, "empty"), (None, "binary"), (None, "too-large"), (None, "parser-failed")]
