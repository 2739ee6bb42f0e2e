"""Workbooks as a sink: a Python data source that writes a workbook per task, from the standard library alone.

    spark.dataSource.register(XlsxDataSource)
    sinks.flat_row(results).write.format("xlsx").option("path", folder).mode("append").save()

Files appear at the job's commit, by renaming what tasks wrote aside; a job that fails leaves none.  ``path`` is a folder that
driver and executors share.  Rows are streamed into the archive, so memory follows a row; a sheet holds 1,048,575 of them
besides its header, and a task with more writes further files.
"""

from __future__ import annotations

import contextlib
import datetime
import decimal
import json
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SHEET = "Receipts"
#: Rows and characters of a cell that the format allows.
MOST_ROWS, MOST_CHARS = 1_048_576, 32_767
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def frame(sheet: str) -> dict[str, str]:
    """The parts of a workbook of one sheet, but for the sheet."""
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    return {
        "[Content_Types].xml": f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }


def column_name(k: int) -> str:
    """A, B, ... Z, AA, ..."""
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


def shown(value: object) -> str:
    """Text of a value that is no number: nested ones as JSON, characters that XML forbids as U+FFFD."""
    if isinstance(value, Row):
        value = value.asDict(recursive=True)
    text = json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, (dict, list, tuple)) else str(value)
    return "".join(c if c in "\t\n\r" or " " <= c <= "퟿" or "" <= c <= "�" or c > "￿" else "�" for c in text)


def cell(value: object, at: str) -> str:
    """A cell; nothing for null.  Whole numbers beyond 15 digits and what is not finite are text, as a cell holds doubles."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, decimal.Decimal)) and abs(value) < 10**15:
        return f'<c r="{at}"><v>{value}</v></c>'
    text = shown(value)
    if len(text) > MOST_CHARS:
        raise ValueError(f"A cell holds {MOST_CHARS} characters, {at} has {len(text)}")
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(path: str, columns: list[str], rows: Iterator, sheet: str = SHEET, most: int = MOST_ROWS) -> tuple[int, object]:
    """Writes rows up to a sheet's bound; how many, and the first row that was too many (or null)."""
    names = [column_name(k) for k in range(len(columns))]
    line = lambda values, n: f'<row r="{n}">{"".join(cell(v, f"{c}{n}") for c, v in zip(names, values, strict=True))}</row>'
    written, extra = 0, None
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in frame(sheet).items():
            archive.writestr(name, text)
        with archive.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as part:
            part.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>{line(columns, 1)}'.encode())
            for row in rows:
                if written + 1 == most:
                    extra = row
                    break
                written += 1
                part.write(line(row, written + 1).encode())
            part.write(b"</sheetData></worksheet>")
    return written, extra


@dataclass
class Written(WriterCommitMessage):
    """What a task has written aside, and the names its files are to get."""

    files: list[tuple[str, str]]


class XlsxWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        path = options.get("path", "")
        self.folder = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
        if not self.folder or "://" in self.folder:
            raise ValueError("xlsx needs the path of a folder that driver and executors share")
        self.columns, self.overwrite = schema.names, overwrite
        self.sheet, self.most = options.get("sheet", SHEET), int(options.get("maxRows", MOST_ROWS))
        self.name = options.get("name", f"receipts_{datetime.datetime.now():%Y%m%d_%H%M%S}")
        self.job = uuid.uuid4().hex
        self.aside = os.path.join(self.folder, f"_writing-{self.job}")
        os.makedirs(self.aside)  # here and not by tasks: one that outlives an aborted job finds nowhere to write

    def write(self, iterator: Iterator) -> Written:
        """Workbooks of a task's rows below a folder of the job; a task without rows writes none."""
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        files: list[tuple[str, str]] = []
        rows = iter(iterator)
        row = next(rows, None)
        while row is not None:
            target = f"{self.name}-{part:05d}-{len(files):03d}.xlsx"
            path = os.path.join(self.aside, f"{attempt}-{target}")
            first, row = row, None
            _, row = write_workbook(path, self.columns, (x for chain in ((first,), rows) for x in chain), self.sheet, self.most)
            files.append((path, target))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """All files get their names; with ``overwrite`` workbooks that were there go first.  A result without rows is a
        workbook with the header alone."""
        files = [f for m in messages if m for f in m.files]
        if not files:
            path = os.path.join(self.aside, "empty.xlsx")
            write_workbook(path, self.columns, iter(()), self.sheet)
            files = [(path, f"{self.name}-00000-000.xlsx")]
        if self.overwrite:
            for old in os.listdir(self.folder):
                if old.endswith(".xlsx"):
                    os.remove(os.path.join(self.folder, old))
        for path, target in files:
            os.replace(path, os.path.join(self.folder, target))
        shutil.rmtree(self.aside)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)
        with contextlib.suppress(OSError):  # a folder that was there before may hold other files
            os.rmdir(self.folder)


class XlsxDataSource(DataSource):
    """``format("xlsx")``: options ``path``, ``name`` (of files, before the part's number), ``sheet``, ``maxRows``."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(self.options, schema, overwrite)
