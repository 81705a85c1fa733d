"""Source files that do not parse: flagged one by one, and rates for each repository and language.

Method: each language has a grammar bundled with this package (``syntax/script.peg`` for JavaScript, TypeScript and TSX,
``syntax/python.peg``) that is compiled to a packrat parser, whose tables hold what every rule matched at every token;
the whole token stream is parsed, and the first token from which no parse can go on is reported. Statements that look
alike to the parser are judged once. Marks of a merge outside strings and comments are errors. Python texts that the
grammar takes are then handed to the compiler of the worker's own Python as an exact check of what no grammar tells
(such as a return outside functions); it can only add errors.

Defined cases: null texts and paths of no known extension are not judged; an empty text is valid; a text nested deeper
than the parser's stack, or one Python refuses to read (null characters), is an error at its start; repeated rows are
each judged; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def python_error(text: str) -> int | None:
    """Offset of the first error that the compiler of this Python finds in a text, None if there is none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "file", "exec", dont_inherit=True)
    except SyntaxError as e:
        starts = [0, *(m.end() for m in re.finditer(r"\r\n|\n|\r", text))]
        line = min(max((e.lineno or 1) - 1, 0), len(starts) - 1)
        return min(starts[line] + max((e.offset or 1) - 1, 0), len(text))
    except (ValueError, MemoryError, RecursionError, OverflowError):
        return 0
    return None


def first_error(language: str, text: str) -> int | None:
    """Offset of the first unrecoverable error, None for a valid text."""
    from lodeline.llm.syntax.packrat import grammar

    at = grammar(language).first_error(text.removeprefix("\ufeff"))
    return python_error(text) if at is None and language == "python" else at


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, str], int | None] = {}
    for batch in batches:
        ids, repos, languages, texts = (batch.column(i) for i in range(4))
        at = []
        for pair in zip(languages.to_pylist(), texts.to_pylist(), strict=True):
            if pair not in known:
                if len(known) > 2_000:
                    known.clear()
                known[pair] = first_error(*pair)
            at.append(known[pair])
        yield pa.RecordBatch.from_arrays([ids, repos, languages, pa.array(at, type=pa.int64())], names=["file_id", "repo_id", "language", "error_at"])


def spread(df: DataFrame, key: str, per_core: int = 4) -> DataFrame:
    """Rows dealt out evenly where a scan has fewer splits than the cluster has work for; large scans stay as they are."""
    wanted = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)


def judge_files(files: DataFrame, languages: DataFrame) -> DataFrame:
    """(file_id, repo_id, language, error_at): one row for each judged file; ``error_at`` is null for a valid one.

    ``languages`` is the register of extensions, one short row for each.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    register = languages.select(F.lower("extension").alias("extension"), "language").dropDuplicates(["extension"])
    rows = files.where(F.col("text_content").isNotNull()).select("file_id", "repo_id", "text_content", extension.alias("extension"))
    known = rows.join(F.broadcast(register), "extension").select("file_id", "repo_id", "language", "text_content")
    return spread(known, "file_id").mapInArrow(_judge, "file_id long, repo_id string, language string, error_at long")


def broken_rates(judged: DataFrame) -> DataFrame:
    """(repo_id, language, files, broken, rate): one small row for each repository and language."""
    sums = judged.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files"), F.count("error_at").alias("broken"))
    return sums.withColumn("rate", F.col("broken") / F.col("files"))
