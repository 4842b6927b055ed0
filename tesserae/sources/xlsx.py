"""Spreadsheets (Office Open XML) as a source and a sink, row by row, without further packages.

``read`` takes a file, or a folder of files with equal headers. Spark reads the files, one row each, which the
limit of uploads bounds; a task parses the XML as a stream and puts out a batch of rows at a time. Of each
file the first sheet counts, its first row is the header, and all cells are text as stored: dates are serial
numbers. Columns without a name are dropped, empty rows are skipped, missing and empty cells are null.

``write`` is a data source, ``df.write.format("xlsx")``: every task streams its rows into files of its own, which
appear when the whole job commits. Numbers and booleans are cells of their kind, all else is text; lists and
structs are JSON. Characters that XML can't hold are written in the format's own escape, ``_xHHHH_``. The folder
must be in a store that Arrow reaches from the executors. Nothing is cut; some programs show at most
32,767 characters of a cell.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a sheet beside its header, a limit of the format (1,048,576 with the header).
MOST_ROWS = 1_048_575
#: Rows of an Arrow batch when reading.
BATCH = 5_000

# Names of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
SHEET = "xl/worksheets/sheet1.xml"

_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_ODD = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def _plain(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


def _safe(text: str) -> str:
    return escape(_ODD.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def column_name(i: int) -> str:
    """A, B, ..., Z, AA, ..."""
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def column_number(name: str) -> int:
    n = 0
    for c in name:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(element: ElementTree.Element) -> str:
    """The text of a string item: runs together, phonetic hints left out."""
    parts = [t.text or "" for child in element if not child.tag.endswith("}rPh") for t in child.iter(f"{{{MAIN}}}t")]
    return _plain("".join(parts))


def _first_sheet(held: zipfile.ZipFile) -> str:
    book = ElementTree.fromstring(held.read("xl/workbook.xml"))
    sheet = book.find(f"{{{MAIN}}}sheets/{{{MAIN}}}sheet")
    links = ElementTree.fromstring(held.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target", "") for r in links if sheet is not None and r.get("Id") == sheet.get(f"{{{LINKS}}}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def rows_of(content: bytes) -> Iterator[list[str | None]]:
    """The rows of a file's first sheet, the header among them, as texts by column."""
    with zipfile.ZipFile(io.BytesIO(content)) as held:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in held.namelist():
            with held.open("xl/sharedStrings.xml") as stream:
                for _, element in ElementTree.iterparse(stream):
                    if element.tag == f"{{{MAIN}}}si":
                        shared.append(_text(element))
                        element.clear()
        with held.open(_first_sheet(held)) as stream:
            for _, element in ElementTree.iterparse(stream):
                if element.tag != f"{{{MAIN}}}row":
                    continue
                row: list[str | None] = []
                for cell in element.iter(f"{{{MAIN}}}c"):
                    at = column_number(cell.get("r", "")) if cell.get("r") else len(row)
                    row += [None] * (at + 1 - len(row))
                    kind, value = cell.get("t", "n"), cell.find(f"{{{MAIN}}}v")
                    if kind == "inlineStr":
                        inner = cell.find(f"{{{MAIN}}}is")
                        row[at] = _text(inner) if inner is not None else None
                    elif value is not None and value.text:
                        row[at] = shared[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}.get(value.text) if kind == "b" else _plain(value.text)
                element.clear()
                yield [c or None for c in row]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file or folder, all columns as text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls*").load(path).select("path", "content")

    def header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"path": name, "names": next(rows_of(content), [])}], pa.schema([("path", pa.string()), ("names", pa.list_(pa.string()))]))

    first = files.orderBy("path").limit(1).mapInArrow(header, "path string, names array<string>").first()
    names = [(i, n.strip()) for i, n in enumerate(first.names if first else []) if n and n.strip()]
    if not names:
        return spark.createDataFrame([], StructType())
    schema = pa.schema([(n, pa.string()) for _, n in names])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                held: list[list[str | None]] = []
                told = rows_of(content)
                next(told, None)
                for row in told:
                    if any(c is not None for c in row):
                        held.append(row)
                    if len(held) == BATCH:
                        yield _batch(held, names, schema)
                        held = []
                if held:
                    yield _batch(held, names, schema)

    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for _, n in names)
    return files.select("content").mapInArrow(rows, ddl)


def _batch(rows: list[list[str | None]], names: list[tuple[int, str]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], pa.string()) for i, _ in names], schema=schema)


class Sheet:
    """A file that takes rows one by one; nothing but the row at hand is held."""

    def __init__(self, out: Any, names: list[str]):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        for name, content in _frame().items():
            self.zip.writestr(name, content)
        self.part = self.zip.open(SHEET, "w", force_zip64=True)
        self.part.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
        self.rows = 0
        self.add(names)

    def add(self, values: list[Any]) -> None:
        self.rows += 1
        cells = "".join(_cell(f"{column_name(i)}{self.rows}", v) for i, v in enumerate(values) if v is not None)
        self.part.write(f'<row r="{self.rows}">{cells}</row>'.encode("utf-8", "replace"))

    def close(self) -> None:
        self.part.write(b"</sheetData></worksheet>")
        self.part.close()
        self.zip.close()


def _cell(at: str, value: Any) -> str:
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf") and not (isinstance(value, int) and abs(value) >= 10**15):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    if isinstance(value, (list, dict, Row)):
        value = json.dumps(value.asDict(True) if isinstance(value, Row) else value, ensure_ascii=False, default=str)
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{_safe(str(value))}</t></is></c>'


def _frame() -> dict[str, str]:
    """The parts of a workbook with one sheet beside the sheet itself."""
    head, kind = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "application/vnd.openxmlformats-officedocument.spreadsheetml"
    link = lambda n, what, to: f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="{n}" Type={quoteattr(f"{LINKS}/{what}")} Target="{to}"/></Relationships>'
    types = "".join(f'<Override PartName="/{part}" ContentType="{kind}.{name}+xml"/>' for part, name in (("xl/workbook.xml", "sheet.main"), (SHEET, "worksheet")))
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>',
        "_rels/.rels": head + link("r1", "officeDocument", "xl/workbook.xml"),
        "xl/workbook.xml": f'{head}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": head + link("r1", "worksheet", "worksheets/sheet1.xml"),
    }


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class XlsxWriter(DataSourceWriter):
    """Tasks write under hidden names, which the commit makes visible."""

    def __init__(self, path: str, names: list[str], overwrite: bool, most: int):
        self.path, self.names, self.overwrite, self.most = path, names, overwrite, most

    def write(self, iterator: Iterator[Row]) -> Written:
        store, folder = pf.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        files: list[str] = []
        sheet = stream = None
        for row in iterator:
            if sheet is None or sheet.rows > self.most:
                if sheet is not None:
                    sheet.close()
                    stream.close()
                files.append(f"part-{uuid.uuid4().hex}.xlsx")
                stream = store.open_output_stream(f"{folder}/_{files[-1]}", compression=None)
                sheet = Sheet(stream, self.names)
            sheet.add(list(row))
        if sheet is not None:
            sheet.close()
            stream.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = pf.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        made = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            for old in store.get_file_info(pf.FileSelector(folder)):
                if old.base_name.endswith(".xlsx") and not old.base_name.startswith("_"):
                    store.delete_file(old.path)
        if not made:  # a table without rows has a header
            made = ["part-empty.xlsx"]
            with store.open_output_stream(f"{folder}/_{made[0]}", compression=None) as stream:
                Sheet(stream, self.names).close()
        for f in made:
            store.move(f"{folder}/_{f}", f"{folder}/{f}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = pf.FileSystem.from_uri(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{folder}/_{f}")


class XlsxSource(DataSource):
    """The sink ``xlsx``; option ``rows`` lowers the rows of a file."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(self.options["path"], schema.names, overwrite, min(MOST_ROWS, int(self.options.get("rows", MOST_ROWS))))


def write(df: DataFrame, path: str, mode: str = "append", rows: int = MOST_ROWS) -> None:
    """Write spreadsheets of at most ``rows`` rows each."""
    df.sparkSession.dataSource.register(XlsxSource)
    df.write.format("xlsx").mode(mode).option("rows", rows).save(path)
