"""Readers of what version control prints and of recorded answers of trackers and wikis; no process and no network here.

A job saves the text of the named command, or the JSON bodies of a listing, to files; these functions turn them into
tables inside Catalyst. Texts of other forms give no rows and never fail; each function names its limits.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one blob that is read, folders looked into, levels walked, sample paths of a status.
BLOB_BYTES, FOLDERS, LEVELS, SAMPLE = 8 << 20, 250_000, 8, 50


def _entries(texts: DataFrame, text: str, keep: list[str], separator: str = r"\x00") -> DataFrame:
    return texts.select(*keep, F.explode(F.filter(F.split(F.col(text), separator), lambda x: F.trim(x) != "")).alias("entry"))


def history(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """(keep, sha, parents, author_name, author_email, authored_at, committed_at, subject) from
    ``git log -z --format=%H%x1f%P%x1f%an%x1f%ae%x1f%aI%x1f%cI%x1f%s``; entries without seven fields are left out."""
    part = F.split(F.ltrim(F.col("entry"), F.lit("\n")), "\x1f", -1)
    rows = _entries(texts, text, list(keep)).withColumn("p", part).where((F.size("p") == 7) & F.get("p", F.lit(0)).rlike("^[0-9a-f]{40}([0-9a-f]{24})?$"))
    at = lambda i: F.get("p", F.lit(i))
    parents = F.filter(F.split(at(1), " "), lambda x: x != "")
    return rows.select(*keep, at(0).alias("sha"), parents.alias("parents"), at(2).alias("author_name"), at(3).alias("author_email"), F.try_to_timestamp(at(4)).alias("authored_at"), F.try_to_timestamp(at(5)).alias("committed_at"), at(6).alias("subject"))


def tree(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """(keep, path, oid, kind, file_mode, size_bytes) from ``git ls-tree -r -z -l``; kind is file, executable, symlink or submodule."""
    form = r"(?s)^(\d{6}) (blob|commit|tree) ([0-9a-f]{40,64}) +(\d+|-)\t(.*)$"
    rows = _entries(texts, text, list(keep)).where(F.col("entry").rlike(form))
    part = lambda i: F.regexp_extract("entry", form, i)
    kind = F.when(part(1) == "160000", "submodule").when(part(1) == "120000", "symlink").when(part(1) == "100755", "executable").otherwise("file")
    return rows.where(part(2) != "tree").select(*keep, part(5).alias("path"), part(3).alias("oid"), kind.alias("kind"), part(1).alias("file_mode"), part(4).try_cast("long").alias("size_bytes"))


def refs(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """(keep, ref_name, head_sha, is_head) from ``git for-each-ref --format='%(refname)%09%(objectname)%09%(HEAD)'``."""
    part = F.split("entry", "\t", -1)
    rows = _entries(texts, text, list(keep), r"\r?\n").where(F.col("entry").startswith("refs/") & (F.size(part) >= 2))
    return rows.select(*keep, F.get(part, F.lit(0)).alias("ref_name"), F.get(part, F.lit(1)).alias("head_sha"), (F.coalesce(F.get(part, F.lit(2)), F.lit("")) == "*").alias("is_head"))


def worktrees(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """(keep, path, head_sha, branch, bare, detached) from ``git worktree list --porcelain``: one block a tree, blank lines between."""
    blocks = _entries(texts, text, list(keep), r"(?:\r?\n){2,}").where(F.ltrim("entry").startswith("worktree "))
    line = lambda name: F.nullif(F.regexp_extract("entry", rf"(?m)^{name} (.*)$", 1), F.lit(""))
    return blocks.select(*keep, line("worktree").alias("path"), line("HEAD").alias("head_sha"), line("branch").alias("branch"), F.col("entry").rlike("(?m)^bare$").alias("bare"), F.col("entry").rlike("(?m)^detached$").alias("detached"))


def status(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """(keep, staged, unstaged, untracked, conflicted, sample) from ``git status --porcelain=v2``; at most SAMPLE paths."""
    rows = _entries(texts, text, list(keep), r"\r?\n").where(F.col("entry").rlike("^[12u?] "))
    kind, x, y = F.substring("entry", 1, 1), F.substring("entry", 3, 1), F.substring("entry", 4, 1)
    plain = kind.isin("1", "2")
    path = F.when(kind == "?", F.substring("entry", 3, 4096)).otherwise(F.regexp_extract("entry", r"^(?:1 (?:\S+ ){7}|2 (?:\S+ ){8}|u (?:\S+ ){9})([^\t]*)", 1))
    return rows.withColumn("path", path).groupBy(*keep).agg(
        F.count_if(plain & (x != ".")).alias("staged"), F.count_if(plain & (y != ".")).alias("unstaged"), F.count_if(kind == "?").alias("untracked"), F.count_if(kind == "u").alias("conflicted"),
        F.slice(F.array_sort(F.collect_set("path")), 1, SAMPLE).alias("sample"),
    )


def blobs(files: DataFrame) -> DataFrame:
    """(path, size_bytes, content, reason) of binaryFile rows: content up to BLOB_BYTES, else ``too-large``."""
    large = F.col("length") > BLOB_BYTES
    return files.select("path", F.col("length").alias("size_bytes"), F.when(~large, F.col("content")).alias("content"), F.when(large, "too-large").when(F.col("content").isNull(), "unreadable").alias("reason"))


def discover(spark: SparkSession, roots: list[str], levels: int = LEVELS, folders: int = FOLDERS) -> DataFrame:
    """(path, kind, complete): working trees and bare repositories below folders of the driver's machine; links are not
    followed. ``complete`` is false for all rows if the bound on folders was met."""
    found, seen, stack = [], 0, [(r, 0) for r in roots]
    while stack and seen < folders:
        folder, level = stack.pop()
        seen += 1
        try:
            names = {e.name: e for e in os.scandir(folder)}
        except OSError:
            continue
        if ".git" in names:
            found.append((folder, "worktree" if names[".git"].is_file(follow_symlinks=False) else "repository"))
        elif {"HEAD", "objects", "refs"} <= names.keys():
            found.append((folder, "bare"))
            continue
        if level < levels:
            stack += [(e.path, level + 1) for n, e in sorted(names.items(), reverse=True) if n != ".git" and e.is_dir(follow_symlinks=False)]
    return spark.createDataFrame([(p, k, not stack) for p, k in sorted(found)], "path string, kind string, complete boolean")


# fixed values: how each recorded listing names what is taken from it
PROJECT_FIELDS = {
    "issue": {"id": "$.id", "number": "$.number", "title": "$.title", "state": "$.state", "author": "$.user.login", "body": "$.body", "created": "$.created_at", "updated": "$.updated_at"},
    "pull_request": {"id": "$.id", "number": "$.number", "title": "$.title", "state": "$.state", "author": "$.user.login", "body": "$.body", "source_ref": "$.head.ref", "target_ref": "$.base.ref", "merged": "$.merged_at", "created": "$.created_at", "updated": "$.updated_at"},
    "review": {"id": "$.id", "state": "$.state", "author": "$.user.login", "body": "$.body", "created": "$.submitted_at"},
    "comment": {"id": "$.id", "author": "$.user.login", "body": "$.body", "created": "$.created_at", "updated": "$.updated_at"},
    "release": {"id": "$.id", "tag": "$.tag_name", "title": "$.name", "draft": "$.draft", "body": "$.body", "created": "$.published_at"},
    "deployment": {"id": "$.id", "ref": "$.ref", "environment": "$.environment", "created": "$.created_at"},
    "deployment_status": {"id": "$.id", "state": "$.state", "created": "$.created_at"},
    "tracker_issue": {"id": "$.id", "key": "$.key", "title": "$.fields.summary", "state": "$.fields.status.name", "type": "$.fields.issuetype.name", "priority": "$.fields.priority.name", "author": "$.fields.reporter.accountId", "created": "$.fields.created", "updated": "$.fields.updated", "body": "$.fields.description"},
    "page": {"id": "$.id", "title": "$.title", "space": "$.spaceId", "version": "$.version.number", "body": "$.body.storage.value", "created": "$.createdAt", "updated": "$.version.createdAt"},
}


def recorded(bodies: DataFrame, kind: str, items: str = "$", text: str = "body", keep: tuple[str, ...] = ("scope",)) -> DataFrame:
    """(keep, the fields of ``kind`` as text, problem): the items of recorded listing bodies, one row each.

    ``items`` is where in a body its list is. A body that is no JSON, or has no list there, is one row with its problem.
    """
    every = F.from_json(F.get_json_object(F.col(text), items), "array<string>")
    bad = F.when(F.try_parse_json(F.col(text)).isNull(), "unparseable").when(every.isNull(), "no-list")
    rows = bodies.select(*keep, bad.alias("problem"), F.explode_outer(F.when(bad.isNull(), every)).alias("item")).where(F.col("problem").isNotNull() | F.col("item").isNotNull())
    return rows.select(*keep, *[F.get_json_object("item", path).alias(name) for name, path in PROJECT_FIELDS[kind].items()], "problem")


def document_text(batches: pa.Array) -> pa.Array:
    """Plain text of tracker rich text (nested nodes): texts joined, a line for each block; other texts stay as they are."""
    import json

    blocks = {"paragraph", "heading", "listItem", "codeBlock", "blockquote", "tableRow", "hardBreak"}

    def flat(text):
        if text is None:
            return None
        try:
            top = json.loads(text)
        except ValueError:
            return text
        if not isinstance(top, dict):
            return text
        out, stack = [], [top]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif isinstance(node, dict):
                if isinstance(node.get("text"), str):
                    out.append(node["text"])
                children = node.get("content") if isinstance(node.get("content"), list) else []
                stack += [*(["\n"] if node.get("type") in blocks else []), *reversed(children)]
        lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
        return "\n".join(x for x in lines if x)

    return pa.array([flat(t) for t in batches.to_pylist()], type=pa.string())


def jql(projects: list[str] = (), since: str | None = None, types: list[str] = ()) -> str:
    """The search line for issues in order of change: quoted names, half-open in time."""
    quote = lambda v: '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    parts = [f"{field} in ({', '.join(map(quote, values))})" for field, values in (("project", projects), ("issuetype", types)) if values]
    parts += [f"updated >= {quote(since)}"] if since else []
    return (" AND ".join(parts) + " " if parts else "") + "ORDER BY updated ASC, key ASC"


def ingest_pages(previous: DataFrame, pages: DataFrame, most: int = 20) -> DataFrame:
    """(scope, cursor, window_start, pages, outcome): where each scope goes on after a batch of acquired pages.

    ``previous`` is (scope, cursor, window_start), ``pages`` is (scope, page_no, next_cursor, started, failed, digest,
    last_digest). Pages count up to the first failure and at most ``most``; an open cursor keeps its window's start; a
    scope whose first page is as it was is ``unchanged``; one that fails does not hold up the others.
    """
    bad = pages.where("failed").groupBy("scope").agg(F.min("page_no").alias("stop"))
    good = pages.join(bad, "scope", "left").where((F.col("stop").isNull() | (F.col("page_no") < F.col("stop"))) & (F.col("page_no") <= most))
    last = good.groupBy("scope").agg(F.count(F.lit(1)).alias("pages"), F.max_by(F.struct("next_cursor"), "page_no").alias("n"), F.min("started").alias("started"), F.min_by(F.col("digest").eqNullSafe(F.col("last_digest")), "page_no").alias("same"))
    rows = pages.select("scope").distinct().join(last, "scope", "left").join(bad, "scope", "left").join(previous.withColumnRenamed("cursor", "old"), "scope", "left")
    outcome = F.when(F.col("stop").isNotNull(), "failed").when(F.col("same"), "unchanged").when(F.col("n.next_cursor").isNotNull(), "partial").otherwise("complete")
    cursor = F.when(F.col("pages").isNull() | F.col("same"), F.col("old")).otherwise(F.col("n.next_cursor"))
    return rows.select("scope", cursor.alias("cursor"), F.when(F.col("old").isNotNull(), F.col("window_start")).otherwise(F.col("started")).alias("window_start"), F.coalesce("pages", F.lit(0)).alias("pages"), outcome.alias("outcome"))


def python_outline(texts: Iterator) -> Iterator:
    """(file_id, kind, name, qualified_name, parent, line, end_line, decorators, imports): declarations and imports of Python files.

    For mapInArrow over (file_id, text); a text that does not parse gives one row of kind ``unparsed``.
    """
    import ast

    names = ["file_id", "kind", "name", "qualified_name", "parent", "line", "end_line"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    for batch in texts:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                module = ast.parse(text or "")
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                rows.append((key, "unparsed", None, None, None, None, None))
                continue
            stack = [(n, None) for n in reversed(module.body)]
            while stack:
                node, parent = stack.pop()
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    full = f"{parent}.{node.name}" if parent else node.name
                    kind = "class" if isinstance(node, ast.ClassDef) else "method" if parent and parent[:1].isupper() else "function"
                    rows.append((key, kind, node.name, full, parent, node.lineno, node.end_lineno))
                    stack += [(n, full) for n in reversed(node.body)]
                elif isinstance(node, (ast.Import, ast.ImportFrom)):
                    base = ("." * node.level + (node.module or "")) if isinstance(node, ast.ImportFrom) else ""
                    rows += [(key, "import", a.asname or a.name, f"{base}.{a.name}" if base else a.name, parent, node.lineno, node.end_lineno) for a in node.names]
                elif isinstance(node, (ast.If, ast.Try, ast.With)):
                    stack += [(n, parent) for n in reversed(node.body)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=names)
