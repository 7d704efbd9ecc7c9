"""Small office archives for the reader queries and tests, made from rows of text."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _pack(files: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in files.items():
            archive.writestr(name, text)
    return buffer.getvalue()


def workbook(sheets: list[tuple[str, str, list[list[str | None]]]]) -> bytes:
    """``(name, state, rows)`` per sheet."""
    files, entries, links = {}, [], []
    for i, (name, state, rows) in enumerate(sheets, 1):
        lines = []
        for r, row in enumerate(rows, 1):
            cells = "".join(
                f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for c, v in enumerate(row) if v is not None
            )
            lines.append(f'<row r="{r}">{cells}</row>')
        files[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{SHEET_NS}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
        entries.append(f'<sheet name="{escape(name)}" sheetId="{i}" state="{state}" r:id="rId{i}"/>')
        links.append(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>')
    files["xl/workbook.xml"] = f'<workbook xmlns="{SHEET_NS}" xmlns:r="{LINK_NS}"><sheets>{"".join(entries)}</sheets></workbook>'
    files["xl/_rels/workbook.xml.rels"] = f"<Relationships>{''.join(links)}</Relationships>"
    return _pack(files)


def document(paragraphs: list[str], tables: list[list[list[str]]]) -> bytes:
    def p(text: str) -> str:
        return f"<w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p>"

    grid = "".join(
        "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>" for rows in tables
    )
    body = "".join(map(p, paragraphs)) + grid
    return _pack({"word/document.xml": f'<w:document xmlns:w="{WORD_NS}"><w:body>{body}</w:body></w:document>'})


@F.pandas_udf(BinaryType())
def workbook_of(table: pd.Series) -> pd.Series:
    """Workbook with a visible and a hidden sheet out of newline and tab separated cells."""
    rows = [[line.split("\t") for line in text.split("\n")] for text in table]
    return pd.Series([workbook([("Data", "visible", r), ("Old", "hidden", [["x"]])]) for r in rows])


@F.pandas_udf(BinaryType())
def document_of(table: pd.Series) -> pd.Series:
    rows = [[line.split("\t") for line in text.split("\n")] for text in table]
    return pd.Series([document([" Intro ", "", r[0][0]], [r, r[:1]]) for r in rows])


def store_files(files: DataFrame, folder: str) -> int:
    """Writes ``content`` to ``folder/path`` for every row, on the executors; a task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = f"{base}/{path}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
