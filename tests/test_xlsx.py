import csv
import datetime
import glob
import os
import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import validate
from tallyforge.schemas import FIELD, FIELDS
from tallyforge.sources import sinks, xlsx

NS = {"m": xlsx.MAIN}


def read(path):
    """Rows of a workbook as texts, its sheet's name; null cells are ''."""
    with zipfile.ZipFile(path) as archive:
        assert archive.testzip() is None and {"[Content_Types].xml", "_rels/.rels", "xl/workbook.xml"} < set(archive.namelist())
        sheet = ElementTree.fromstring(archive.read("xl/workbook.xml")).find("m:sheets/m:sheet", NS).get("name")
        rows = []
        for k, row in enumerate(ElementTree.fromstring(archive.read("xl/worksheets/sheet1.xml")).iterfind("m:sheetData/m:row", NS)):
            assert row.get("r") == str(k + 1)
            cells = {re.match("[A-Z]+", c.get("r"))[0]: {"1": "true", "0": "false"}[c.find("m:v", NS).text] if c.get("t") == "b" else "".join(c.itertext()) for c in row}
            rows.append(cells)
    width = len(rows[0])
    return [[r.get(xlsx.column_name(k), "") for k in range(width)] for r in rows], sheet


def results(spark):
    value = lambda v: F.struct(v.alias("value"), F.lit(0.95).alias("confidence"), v.alias("raw_text"), F.lit(False).alias("needs_review"))
    rows = spark.range(40).select(F.concat(F.lit("img <&> "), "id", F.lit(".png")).alias("filename"), F.lit("white").alias("receipt_type"), *(F.when(F.col("id") % 3 > 0, value(F.concat(F.lit(f"{f} é\"'\n"), F.col("id").cast("string")))).otherwise(F.lit(None).cast(FIELD)).alias(f) for f in FIELDS))
    return validate.validate(rows, F.lit(datetime.datetime(2025, 1, 1)))


def test_equals_csv(spark, tmp_path):
    rows = sinks.flat_row(results(spark)).repartition(3)
    sinks.write(rows, str(tmp_path / "x"), "xlsx")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(str(tmp_path / "c"))
    wanted, got = [], []
    for path in glob.glob(str(tmp_path / "c" / "*.csv")):
        with open(path, newline="", encoding="utf-8") as f:
            head, *body = csv.reader(f)
            wanted += body
    names = sorted(os.listdir(tmp_path / "x"))
    assert 1 <= len(names) <= 3 and all(re.fullmatch(r"receipts_\d{8}_\d{6}-\d{5}-000\.xlsx", n) for n in names)
    for name in names:
        (first, *body), sheet = read(tmp_path / "x" / name)
        assert first == list(sinks.EXPORT) == head and sheet == "Receipts"
        got += body
    assert sorted(got) == sorted(wanted) and len(got) == 40
    sinks.write(rows.limit(0), str(tmp_path / "x"), "xlsx")  # replaces what was there
    (only,) = glob.glob(str(tmp_path / "x" / "*"))
    assert read(only)[0] == [list(sinks.EXPORT)]


def test_failed_jobs_leave_nothing(spark, tmp_path):
    spark.dataSource.register(xlsx.XlsxDataSource)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("x"))
    for folder in (tmp_path / "new", tmp_path / "old"):
        if folder.name == "old":
            sinks.write(spark.range(3), str(folder), "xlsx")
        before = sorted(os.listdir(folder)) if folder.exists() else None
        with pytest.raises(Exception, match="broken"):
            bad.write.format("xlsx").option("path", str(folder)).mode("append").save()
        assert (sorted(os.listdir(folder)) if folder.exists() else None) == before
    with pytest.raises(Exception, match="32767"):
        spark.range(1).select(F.repeat(F.lit("x"), 40_000).alias("x")).write.format("xlsx").option("path", str(tmp_path / "new")).mode("append").save()
    assert not (tmp_path / "new").exists()


def test_cells_and_long_tables(spark, tmp_path):
    spark.dataSource.register(xlsx.XlsxDataSource)
    kind = "a long, b double, c boolean, d string, e array<int>, f date, g decimal(10,2)"
    rows = [(2**60, float("nan"), True, "\x00\x1f<b>", [1, 2], datetime.date(2025, 1, 2), None), (5, 1.5, False, " x ", [], None, None)]
    spark.createDataFrame(rows, kind).coalesce(1).write.format("xlsx").option("path", str(tmp_path / "t")).option("name", "n").mode("append").save()
    body, _ = read(tmp_path / "t" / "n-00000-000.xlsx")
    assert body[1:] == [[str(2**60), "nan", "true", "��<b>", "[1, 2]", "2025-01-02", ""], ["5", "1.5", "false", " x ", "[]", "", ""]]
    spark.range(0, 10, 1, 2).write.format("xlsx").option("path", str(tmp_path / "m")).option("maxRows", 3).option("sheet", "A & B").mode("append").save()
    parts = {os.path.basename(p): read(p) for p in glob.glob(str(tmp_path / "m" / "*.xlsx"))}
    assert len(parts) == 6 and all(len(b) <= 3 and s == "A & B" for b, s in parts.values())
    assert sorted(int(r[0]) for b, _ in parts.values() for r in b[1:]) == list(range(10))
    assert [xlsx.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    with pytest.raises(Exception, match="share"):
        spark.range(1).write.format("xlsx").option("path", "hdfs://host/x").mode("append").save()
