"""Readers of tables and documents, and the exchange format; files go through Spark's own sources wherever it has one."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
#: Bounds of one workbook: cells read and bytes unpacked.
MAX_CELLS, MAX_BYTES = 200_000, 64 << 20


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A table with a header; quotes and line breaks in cells are fine, ragged rows are padded, blank ones dropped."""
    rows = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return rows.dropna("all")


def parse_csv(texts: DataFrame, key: str, text: str, separator: str = ",") -> DataFrame:
    """(key, rows, columns, ragged, blank) of tables held as text: relaxed quotes, a mark of byte order is dropped, blank rows
    are counted apart, ragged rows are those with another number of cells than the first."""
    quoted = r'"(?:[^"]|"")*"'
    # line breaks and separators inside quotes are taken out before lines and cells are counted
    calm = F.regexp_replace(F.regexp_replace(F.col(text), F.lit("^\ufeff"), F.lit("")), F.lit(quoted), F.lit("q"))
    lines = F.filter(F.split(F.regexp_replace(calm, F.lit(r"(?:\r\n|\r|\n)$"), F.lit("")), r"\r\n|\r|\n"), lambda x: F.lit(True))
    cells = F.transform(F.filter(lines, lambda x: F.trim(F.translate(x, separator, " ")) != ""), lambda x: F.length(x) - F.length(F.replace(x, F.lit(separator), F.lit(""))) + 1)
    out = texts.where(F.col(text).isNotNull()).select(key, cells.alias("c"), F.size(lines).alias("all"))
    first = F.coalesce(F.get("c", F.lit(0)), F.lit(0))
    return out.select(key, F.size("c").alias("rows"), first.alias("columns"), F.size(F.filter("c", lambda n: n != first)).alias("ragged"), (F.col("all") - F.size("c")).alias("blank"))


_WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAX_BLOCKS = 5_000  # fixed value


def _docx_blocks(data: bytes) -> Iterator[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.getinfo("word/document.xml").file_size > MAX_BYTES:
            raise ValueError("document too large")
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for p in root.iter(f"{_WORD_NS}p"):
        style = p.find(f"{_WORD_NS}pPr/{_WORD_NS}pStyle")
        name = (style.get(f"{_WORD_NS}val") if style is not None else "") or ""
        listed = p.find(f"{_WORD_NS}pPr/{_WORD_NS}numPr") is not None
        heading = re.match(r"Heading ?([1-6])$", name, re.I)
        text = "".join("\t" if t.tag.endswith("tab") else t.text or "" for t in p.iter() if t.tag in (f"{_WORD_NS}t", f"{_WORD_NS}tab")).strip()
        if text:
            yield f"h{heading.group(1)}" if heading else "li" if listed else "p", text


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(file, block_no, kind, text, problem): headings, paragraphs and list items of documents in order; an unreadable one is
    a row with its problem, and one with more than MAX_BLOCKS blocks ends with a row whose problem is ``truncated``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for n, (kind, text) in enumerate(_docx_blocks(data), 1):
                        if n > MAX_BLOCKS:
                            rows.append((name, n, None, None, "truncated"))
                            break
                        rows.append((name, n, kind, text, None))
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    rows.append((name, None, None, None, type(e).__name__))
            kinds = [("file", pa.string()), ("block_no", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("problem", pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "file string, block_no long, kind string, text string, problem string")


def _sheets(data: bytes) -> Iterator[tuple[str, int | None, list[str | None] | None]]:
    """(sheet, row, cells); a row of nulls says that the rest was left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > MAX_BYTES:
            raise ValueError("workbook too large")
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS)]
        cells = 0
        for n, title in enumerate(titles, 1):
            part = f"xl/worksheets/sheet{n}.xml"
            if part not in names:
                continue
            for k, row in enumerate(ElementTree.fromstring(z.read(part)).iter(f"{{{_NS['m']}}}row"), 1):
                out: list[str | None] = []
                for c in row.findall("m:c", _NS):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r") or "").group():
                        at = at * 26 + ord(ch) - 64
                    out += [None] * (at - 1 - len(out))
                    v, inline = c.find("m:v", _NS), c.find("m:is", _NS)
                    text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else v.text if v is not None else None
                    out.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
                    cells += 1
                yield title, int(row.get("r") or k), out
                if cells > MAX_CELLS:
                    yield title, None, None
                    return


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row_no, cells array<string>, problem): the cells of workbooks; an unreadable one is a row with its problem,
    and one with more than MAX_CELLS cells ends with a row whose problem is ``truncated``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(name, s, n, c, "truncated" if c is None else None) for s, n, c in _sheets(data)]
                except (zipfile.BadZipFile, KeyError, ValueError, IndexError, ElementTree.ParseError) as e:
                    rows.append((name, None, None, None, type(e).__name__))
            kinds = [("file", pa.string()), ("sheet", pa.string()), ("row_no", pa.int64()), ("cells", pa.list_(pa.string())), ("problem", pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "file string, sheet string, row_no long, cells array<string>, problem string")


def write_ndjson(df: DataFrame, path: str, kind: str) -> None:
    """One JSON object a line with its kind; a manifest beside it holds count and an order-free digest."""
    lines = df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct("*").alias("row"))).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/rows")
    _digest(df.sparkSession.read.text(f"{path}/rows")).withColumn("kind", F.lit(kind)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def _digest(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("value")), F.lit(0)).alias("digest"))


def read_ndjson(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The rows of an export whose kind, count and digest are as its manifest says; ValueError otherwise."""
    lines = spark.read.text(f"{path}/rows")
    said, seen = spark.read.json(f"{path}/manifest").first(), _digest(lines).first()
    if (said["kind"], said["n"], said["digest"]) != (kind, seen["n"], seen["digest"]):
        raise ValueError("export does not match its manifest")
    return lines.select(F.from_json("value", f"kind string, row struct<{schema}>").alias("j")).select("j.row.*")


def markdown_segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, level, title): ATX headings outside fenced code."""
    from pyspark.sql import Window as W

    kept = docs.where(F.col(text).rlike(r"(?m)^#{1,6}\s"))
    lines = kept.select(key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line_no", "line"))
    fences = F.count_if(F.col("line").rlike("^\\s{0,3}(?:```|~~~)")).over(W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow))
    shape = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
    found = lines.withColumn("fences", fences).where((F.col("fences") % 2 == 0) & F.col("line").rlike(shape))
    return found.select(key, "line_no", F.length(F.regexp_extract("line", shape, 1)).alias("level"), F.regexp_extract("line", shape, 2).alias("title"))
