"""Workbooks (.xlsx) as a sink: df.write.format("xlsx").mode(...).save(path), after register(spark).

Tasks write their rows as fragments of the sheet, each attempt its own beside the path; the commit joins the fragments of the attempts that
succeeded, in order of partition, into the archive, streaming, and puts it in place in one move. Attempts that fail, and jobs that are
aborted, leave no row: fragments are deleted in either case. Mode "append" keeps the rows of the workbook that is there, if it is one that this sink wrote.
Order df by orderBy for an order; a sheet has 1,048,576 rows at most, more raise. Null is an empty cell; numbers and booleans are cells of
their kind, all else is text (control characters, which XML can't hold, become spaces).
"""

from __future__ import annotations

import math
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tessera.ship import ship

# The parts of the smallest workbook with one sheet, and the most rows a sheet holds.
MOST_ROWS = 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_SHEET = "xl/worksheets/sheet1.xml"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    f'<Override PartName="/{_SHEET}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="rows" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_OPEN, _CLOSE = f'<worksheet xmlns="{_MAIN}"><sheetData>', "</sheetData></worksheet>"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")

#: A row is one line of the sheet.
_ENDS = {"\n": "&#10;", "\r": "&#13;"}


def _cell(x: object) -> str:
    if x is None:
        return "<c/>"
    if isinstance(x, bool):
        return f'<c t="b"><v>{int(x)}</v></c>'
    if isinstance(x, int | float) and math.isfinite(x):
        return f"<c><v>{x!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub(" ", str(x)), _ENDS)}</t></is></c>'


def _row(values) -> bytes:
    return f"<row>{''.join(map(_cell, values))}</row>\n".encode()


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Fragment(WriterCommitMessage):
    part: int
    path: str
    rows: int


class WorkbookWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.folder = path, names, overwrite, f"{path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator) -> Fragment:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = _system(self.folder)
        system.create_dir(folder, recursive=True)
        name, rows = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}", 0
        with system.open_output_stream(name) as out:
            for rows, values in enumerate(iterator, 1):  # noqa: B007
                out.write(_row(values))
        return Fragment(context.partitionId(), name, rows)

    def commit(self, messages: list[Fragment | None]) -> None:
        system, path = _system(self.path)
        fragments = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        old = not self.overwrite and system.get_file_info(path).is_file
        had = 0
        try:
            with system.open_output_stream(f"{path}.new") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in _PARTS.items():
                    z.writestr(name, _HEAD + text)
                with z.open(_SHEET, "w", force_zip64=True) as sheet:
                    sheet.write((_HEAD + _OPEN).encode())
                    if old:
                        with system.open_input_file(path) as f, zipfile.ZipFile(f) as was, was.open(_SHEET) as lines:
                            for line in lines:  # a row a line, as _row writes them; the first also has the sheet's opening
                                at = line.find(b"<row>")
                                if at >= 0:
                                    sheet.write(line[at:])
                                    had += 1
                    else:
                        sheet.write(_row(self.names))
                        had = 1
                    if had + sum(m.rows for m in fragments) > MOST_ROWS:
                        raise ValueError(f"a sheet holds {MOST_ROWS} rows; these are {had + sum(m.rows for m in fragments)}")
                    for m in fragments:
                        with system.open_input_stream(m.path) as f:
                            while block := f.read(1 << 20):
                                sheet.write(block)
                    sheet.write(_CLOSE.encode())
            system.move(f"{path}.new", path)
        finally:
            self._clean()

    def abort(self, messages: list[Fragment | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        for path in (self.folder, f"{self.path}.new"):
            system, name = _system(path)
            info = system.get_file_info(name)
            if info.is_file:
                system.delete_file(name)
            elif info.type.name == "Directory":
                system.delete_dir(name)


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Workbook)
