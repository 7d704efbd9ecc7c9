"""Workbooks and word documents read element by element, and a data source that plans them by file and sheet.

Nothing here holds a sheet, a document or the tree of one: XML elements are dropped as soon as their row is read, shared
strings beyond a few megabytes lie in the task's own temporary file. A file is opened where it is read, through the
Arrow file systems, so a large workbook is never one value of a row, and each of its sheets is a task of its own.
"""

from __future__ import annotations

import json
import os
import re
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from tempfile import SpooledTemporaryFile
from typing import BinaryIO, NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

CELLS = "path string, table_ix int, title string, row_ix int, col_ix int, raw string, error string"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Cells handed on at a time; bytes of shared strings held in memory; bytes and number of files in a task; size from which sheets are tasks.
SLICE, STRINGS, TASK_BYTES, TASK_FILES, SPLIT_BYTES = 50_000, 32 << 20, 32 << 20, 20_000, 8 << 20
# Number formats of the file format that show dates or times, and marks of such formats in custom ones.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
DATE_MARKS = re.compile(r"[ymdhs]", re.IGNORECASE)


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _elements(stream: BinaryIO, inside: str) -> Iterator[tuple[int, ElementTree.Element]]:
    """Elements as they end with their depth; those directly inside an ``inside`` element are dropped after use."""
    open_: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            open_.append(element)
            continue
        open_.pop()
        yield len(open_), element
        if open_ and open_[-1].tag == inside:
            open_[-1].clear()


def _text(element: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in element.iter(tag))


def _archive(file: BinaryIO) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(file)
    except pa.ArrowInvalid as short:  # a file too short to hold the end of an archive
        raise zipfile.BadZipFile("File is not a zip file") from short


class Strings:
    """Shared strings by number."""

    def __init__(self, archive: zipfile.ZipFile) -> None:
        self.ends, self.held = array("Q", [0]), SpooledTemporaryFile(max_size=STRINGS)
        if "xl/sharedStrings.xml" in archive.namelist():
            with archive.open("xl/sharedStrings.xml") as stream:
                for _, element in _elements(stream, f"{SHEET}sst"):
                    if element.tag == f"{SHEET}si":
                        self.held.write(_text(element, f"{SHEET}t").encode("utf-8", "surrogatepass"))
                        self.ends.append(self.held.tell())

    def __getitem__(self, number: int) -> str:
        if not 0 <= number < len(self.ends) - 1:
            raise IndexError(f"shared string {number} of {len(self.ends) - 1}")
        self.held.seek(self.ends[number])
        return self.held.read(self.ends[number + 1] - self.ends[number]).decode("utf-8", "surrogatepass")


def _column_number(reference: str) -> int:
    number = 0
    for letter in reference:
        if letter.isalpha():
            number = number * 26 + ord(letter.upper()) - 64
    return number - 1


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date or time."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    tree = ElementTree.fromstring(archive.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\\\.|\[(?![hms]+\])[^\]]*\]', "", f.get("formatCode", "")) for f in tree.iter(f"{SHEET}numFmt")}
    dated = {i for i, code in own.items() if DATE_MARKS.search(code)}
    dates = (DATE_FORMATS - own.keys()) | dated
    styles = tree.find(f"{SHEET}cellXfs")
    return {i for i, style in enumerate(styles if styles is not None else ()) if int(style.get("numFmtId", 0)) in dates}


def date_text(serial: str, base_1904: bool) -> str:
    """ISO text of a serial day number; a number below one is a time of day. What is no such number stays as it is."""
    try:
        days = float(serial)
    except ValueError:
        return serial
    whole = datetime(1904, 1, 1) if base_1904 else datetime(1899, 12, 30)
    if not base_1904 and 0 < days < 60:
        days += 1  # the file format counts a 29 February 1900 that never was
    if 0 <= float(serial) < 1:
        return (whole + timedelta(seconds=round(float(serial) * 86400))).time().isoformat()
    try:
        return (whole + timedelta(milliseconds=round(days * 86_400_000))).isoformat()
    except OverflowError:
        return serial


class Workbook:
    """Visible sheets of a workbook by their place, and the rows of one of them."""

    def __init__(self, file: BinaryIO) -> None:
        self.archive = _archive(file)
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.archive.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(self.archive.read("xl/workbook.xml"))
        self.base_1904 = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{SHEET}workbookPr"))
        self.sheets: dict[int, tuple[str, str]] = {}
        for ix, sheet in enumerate(book.iter(f"{SHEET}sheet")):
            if sheet.get("state", "visible") == "visible":
                target = links[sheet.get(RELATION)].lstrip("/")
                self.sheets[ix] = sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"
        self._strings: Strings | None = None
        self._dates: set[int] | None = None

    def _value(self, cell: ElementTree.Element) -> str | None:
        if self._strings is None:
            self._strings, self._dates = Strings(self.archive), _date_styles(self.archive)
        kind, value = cell.get("t", "n"), cell.find(f"{SHEET}v")
        text = value.text if value is not None else None
        if kind == "inlineStr":
            return _text(cell, f"{SHEET}t")
        if text is None:
            return None
        if kind == "s":
            return self._strings[int(text)]
        if kind == "b":
            return "true" if text == "1" else "false"
        return date_text(text, self.base_1904) if kind == "n" and int(cell.get("s", 0)) in self._dates else text

    def rows(self, ix: int) -> Iterator[list[str | None]]:
        """Rows with a value, as wide as their last cell."""
        with self.archive.open(self.sheets[ix][1]) as stream:
            for _, element in _elements(stream, f"{SHEET}sheetData"):
                if element.tag != f"{SHEET}row":
                    continue
                values = {}
                for place, cell in enumerate(element.iter(f"{SHEET}c")):
                    values[_column_number(cell.get("r")) if cell.get("r") else place] = self._value(cell)
                line = [values.get(i) for i in range(max(values, default=-1) + 1)]
                if any(v not in (None, "") for v in line):
                    yield line


def workbook_cells(path: str, file: BinaryIO, only: int | None = None) -> Iterator[tuple]:
    """``CELLS`` of the visible sheets, or of one; values are those stored, dates as ISO text.

    A workbook whose visible sheets are all empty is an error; where one sheet is read, the first visible one tells.
    """
    book, found = Workbook(file), False
    for ix, (name, _) in book.sheets.items():
        if only in (None, ix):
            for row_ix, row in enumerate(book.rows(ix)):
                found = True
                for col_ix, raw in enumerate(row):
                    yield path, ix, f"{stem(path)}: {name}", row_ix, col_ix, raw, None
    told = found or (only is not None and (only != min(book.sheets, default=only) or any(next(book.rows(ix), None) for ix in book.sheets)))
    if not told:
        raise ValueError("no visible non-empty sheets")


def _paragraphs(node: ElementTree.Element) -> str:
    return "\n".join(_text(p, f"{WORD}t") for p in node.iter(f"{WORD}p"))


def _blocks(file: BinaryIO) -> Iterator[tuple[str, int, list[str]]]:
    """Paragraphs (``p``) and table rows (``tr``, number of the table) of a document's body in order."""
    with _archive(file).open("word/document.xml") as stream:
        open_: list[ElementTree.Element] = []
        tables, seen = -1, False
        for event, element in ElementTree.iterparse(stream, events=("start", "end")):
            if event == "start":
                open_.append(element)
                if len(open_) == 3 and element.tag == f"{WORD}tbl":
                    seen = False
                continue
            open_.pop()
            tags = [e.tag for e in open_] if len(open_) <= 3 else []
            if tags[1:] == [f"{WORD}body", f"{WORD}tbl"] and element.tag == f"{WORD}tr":
                tables, seen = tables + (not seen), True
                yield "tr", tables, [_paragraphs(cell).strip() for cell in element.findall(f"{WORD}tc")]
                open_[-1].clear()
            elif tags[1:] == [f"{WORD}body"]:
                if element.tag == f"{WORD}p":
                    yield "p", tables, [_text(element, f"{WORD}t").strip()]
                open_[-1].clear()


def document_cells(path: str, file: BinaryIO) -> Iterator[tuple]:
    """``CELLS`` of the tables in a document's body; tables inside cells are text of those."""
    table, row_ix = -1, 0
    for kind, number, row in _blocks(file):
        if kind == "tr":
            table, row_ix = number, 0 if number != table else row_ix + 1
            for col_ix, raw in enumerate(row):
                yield path, number, f"{stem(path)} table {number + 1}", row_ix, col_ix, raw, None


def document_text(file: BinaryIO) -> str:
    """Paragraphs with text, then table rows, one a line."""
    paragraphs, rows = [], []
    for kind, _, parts in _blocks(file):
        if kind == "tr":
            rows.append(" | ".join(parts))
        elif parts[0]:
            paragraphs.append(parts[0])
    return "\n".join(paragraphs + rows)


def guarded(path: str, cells: Iterator[tuple]) -> Iterator[tuple]:
    """The cells, and an error row where the file cannot be read on; cells before the error stay."""
    try:
        yield from cells
    except Exception as error:
        yield path, None, None, None, None, None, f"{type(error).__name__}: {error}"


def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = [f.split()[0] for f in CELLS.split(", ")]
    while held := list(islice(rows, SLICE)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


class Files(InputPartition):
    """Files of one task, each whole (``None``) or one sheet of it; and where they are.

    The plan holds all partitions at once, of which there are few, but of files there may be millions: paths are kept packed.
    """

    def __init__(self, files: list[tuple[str, int | None]]) -> None:
        super().__init__(None)
        self.packed = zlib.compress(json.dumps(files, ensure_ascii=False).encode("utf-8", "surrogateescape"))

    @property
    def files(self) -> list[tuple[str, int | None]]:
        return [(path, only) for path, only in json.loads(zlib.decompress(self.packed).decode("utf-8", "surrogateescape"))]


class Listed(NamedTuple):
    path: str
    size: int


def listed(store: pafs.FileSystem, base: str) -> Iterator[Listed]:
    """Files below a folder, of a local disk one by one, of another store a folder at a time."""
    folders = [base]
    while folders:
        folder = folders.pop()
        if isinstance(store, pafs.LocalFileSystem):
            with os.scandir(folder) as entries:
                for entry in entries:
                    if entry.is_dir():
                        folders.append(entry.path)
                    elif entry.is_file():
                        yield Listed(entry.path, entry.stat().st_size)
            continue
        for info in store.get_file_info(pafs.FileSelector(folder)):
            if info.type == pafs.FileType.Directory:
                folders.append(info.path)
            elif info.type == pafs.FileType.File:
                yield Listed(info.path, info.size)


class OfficeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.kinds = tuple("." + k.strip() for k in options.get("kinds", "xlsx,docx").split(","))

    def _store(self) -> tuple[pafs.FileSystem, str]:
        root = self.root
        return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")

    def partitions(self) -> list[Files]:
        """Small files packed by size, in the order of the listing, which is not held; of a large workbook only the list of sheets is read here."""
        store, base = self._store()
        parts, held, size = [], [], 0
        for file in listed(store, base):
            if not file.path.lower().endswith(self.kinds):
                continue
            if file.size >= self.split_bytes and file.path.lower().endswith(".xlsx"):
                try:
                    with store.open_input_file(file.path) as opened:
                        sheets = list(Workbook(opened).sheets)
                except Exception:  # its task will tell
                    sheets = []
                parts += [Files([(file.path, ix)]) for ix in sheets or [None]]
                continue
            held.append((file.path, None))
            size += file.size
            if size >= self.task_bytes or len(held) >= TASK_FILES:
                parts.append(Files(held))
                held, size = [], 0
        return parts + [Files(held)] if held or not parts else parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()

        def cells() -> Iterator[tuple]:
            for path, only in partition.files:
                def opened(path: str = path, only: int | None = only) -> Iterator[tuple]:
                    with store.open_input_file(path) as file:
                        yield from workbook_cells(path, file, only) if path.lower().endswith(".xlsx") else document_cells(path, file)

                yield from guarded(path, opened())

        yield from batches_of(cells())


class OfficeTables(DataSource):
    """``spark.read.format("office_tables").option("path", folder)``: cells of all workbooks and documents below a folder.

    Options: ``kinds`` (``xlsx,docx``), ``task_bytes``, ``split_bytes``. Register with ``spark.dataSource.register``.
    """

    @classmethod
    def name(cls) -> str:
        return "office_tables"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> OfficeReader:
        return OfficeReader(dict(self.options))
