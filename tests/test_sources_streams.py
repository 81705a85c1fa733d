import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeline.operators.merge import classify_import, upsert
from lodeline.operators.symbols import declarations, overloads, resolve
from lodeline.sources.files import markdown_segments, read_csv, read_ndjson, read_xlsx, write_ndjson
from lodeline.streaming.events import debounce, dedup_deliveries, ingest


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x, ""y""\nz"\n,\n2\n', encoding="utf-8")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'x, "y"\nz'), ("2", None)]


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hi</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(buffer.getvalue())
    (tmp_path / "b.xlsx").write_bytes(b"not a zip")
    rows = {r["file"].rsplit("/", 1)[1]: r for r in read_xlsx(spark, str(tmp_path)).collect()}
    assert rows["a.xlsx"]["cells"] == ["hi", None, "2"] and rows["b.xlsx"]["problem"] == "BadZipFile"


def test_ndjson_round_trip_and_tampering(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    write_ndjson(df, str(tmp_path / "x"), "thing")
    assert sorted(map(tuple, read_ndjson(spark, str(tmp_path / "x"), "thing", "id long, v string").collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        read_ndjson(spark, str(tmp_path / "x"), "other", "id long, v string")


def test_markdown_and_symbols(spark):
    df = spark.createDataFrame([(1, "# a\n```\n# no\n```\n## b ##\ntext"), (2, None), (3, "none")], "doc_id long, text string")
    assert [tuple(r) for r in markdown_segments(df, "doc_id", "text").orderBy("line_no").collect()] == [(1, 0, 1, "a"), (1, 4, 2, "b")]
    files = spark.createDataFrame([(1, "r", "a.ts", "export function f() {}\nfunction f() {}"), (2, "r", "b.py", "def g():\n  pass"), (3, "r", "c", None)], "file_id long, repo_id string, path string, text_content string")
    symbols = declarations(files)
    assert [(r["name"], r["overload"]) for r in overloads(symbols).orderBy("file_id", "nth").collect()] == [("f", 0), ("f", 1), ("g", 0)]
    refs = spark.createDataFrame([(1, "r", "f"), (1, "r", "g"), (1, "r", "h")], "file_id long, repo_id string, name string")
    assert {r["name"]: (r["target_file"], r["how"]) for r in resolve(refs, symbols).collect()} == {"f": (1, "local"), "g": (2, "unique"), "h": (None, "unresolved")}


def test_merges(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, h string")
    b = spark.createDataFrame([(2, "y"), (3, "w"), (4, "v")], "id long, h string")
    assert {r["id"]: r["outcome"] for r in upsert(a, b, ["id"], "h").collect()} == {1: "kept", 2: "unchanged", 3: "updated", 4: "created"}
    c = b.withColumn("p", F.when(F.col("id") == 4, "gone").otherwise("home"))
    homes = spark.createDataFrame([("home",)], "p string")
    assert {r["id"]: r["verdict"] for r in classify_import(a, c, "id", "h", homes, "p").collect()} == {2: "unchanged", 3: "conflicting", 4: "orphaned"}


def test_streams_resume_and_drop_repeats(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    t0 = datetime(2024, 1, 1)
    rows = [(i, "u", t0 + timedelta(minutes=10 * i)) for i in range(6)]
    schema = "event_id long, user_id string, ts timestamp"

    def write(df, number):
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        ingest(dedup_deliveries(stream, ["event_id"]), write, check)
        return sorted(r["event_id"] for r in spark.read.parquet(out).collect())

    spark.createDataFrame(rows[:3] + rows[:1], schema).coalesce(1).write.mode("append").parquet(src)
    assert run() == [0, 1, 2]
    spark.createDataFrame(rows[2:], schema).coalesce(1).write.mode("append").parquet(src)
    assert run() == [0, 1, 2, 3, 4, 5]


def test_debounce(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", t0), ("u", t0 + timedelta(seconds=50)), ("u", t0 + timedelta(minutes=5))], "user_id string, ts timestamp_ntz")
    assert sorted(r["n"] for r in debounce(df, "user_id", "1 minute").collect()) == [1, 2]
