"""Office files read element by element, whole and by sheet."""

import io
import pickle
import subprocess
import sys
import tracemalloc
import zipfile

import pytest

from plinth.plans.archives import document, workbook
from plinth.sources import files as S
from plinth.sources import office

DATA = [["Name", "Value"], ["a", "1"], [None, "2"], ["b", None]]


def cells(spark, folder, **options):
    return sorted((r.path.rsplit("/", 1)[-1], r.table_ix, r.title, r.row_ix, r.col_ix, r.raw, r.error) for r in S.read_office_tables(spark, str(folder), **options).collect())


@pytest.mark.parametrize("split", ["1", "100000"])
def test_files_and_sheets_are_tasks(spark, tmp_path, split):
    (tmp_path / "in").mkdir()
    book = workbook([("One", "visible", DATA), ("Empty", "visible", []), ("Old", "hidden", [["x"]]), ("Two", "visible", [["k"], ["v"]])])
    (tmp_path / "in/b.xlsx").write_bytes(book)
    (tmp_path / "in/none.xlsx").write_bytes(workbook([("E", "visible", []), ("F", "visible", [[None]])]))
    (tmp_path / "in/broken.XLSX").write_bytes(b"no archive")
    (tmp_path / "d.docx").write_bytes(document(["p"], [DATA[:2], [["x"]]]))
    (tmp_path / "note.txt").write_bytes(b"not read")
    got = cells(spark, tmp_path, split_bytes=split)
    told = {r[:4] + r[6:] for r in got}
    assert {("b.xlsx", 0, "b: One", i, None) for i in range(4)} | {("b.xlsx", 3, "b: Two", i, None) for i in range(2)} <= told
    assert [r[5] for r in got if r[:4] == ("b.xlsx", 0, "b: One", 2)] == [None, "2"]
    assert {(r[0], r[6]) for r in got if r[6]} == {("none.xlsx", "ValueError: no visible non-empty sheets"), ("broken.XLSX", "BadZipFile: File is not a zip file")}
    assert {r[2] for r in got if r[0] == "d.docx"} == {"d table 1", "d table 2"}
    assert S.read_office_tables(spark, str(tmp_path), split_bytes=split).rdd.getNumPartitions() == (7 if split == "1" else 1)
    rows = spark.createDataFrame([("in/b.xlsx", book)], "path string, content binary")
    assert sorted((r.table_ix, r.row_ix, r.col_ix, r.raw or "") for r in S.read_xlsx_datasets(rows).collect()) == sorted((r[1], r[3], r[4], r[5] or "") for r in got if r[0] == "b.xlsx")


def test_empty_folder(spark, tmp_path):
    assert cells(spark, tmp_path) == []


def test_tables_in_cells_and_paragraphs():
    nested = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    body = f"<w:p><w:r><w:t> P </w:t></w:r></w:p><w:tbl/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>out</w:t></w:r></w:p>{nested}</w:tc><w:tc/></w:tr></w:tbl><w:p/>"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{office.WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
    assert [(r[1], r[3], r[4], r[5]) for r in office.document_cells("d.docx", held)] == [(0, 0, 0, "out\nin"), (0, 0, 1, "")]
    assert office.document_text(held) == "P\nout\nin | "


LARGE = """
import resource, sys, zipfile
sys.path.insert(0, {root!r})
from plinth.plans.archives import LINK_NS, SHEET_NS
from plinth.sources import office
with zipfile.ZipFile({path!r}, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
    z.writestr("xl/workbook.xml", f'<workbook xmlns="{{SHEET_NS}}" xmlns:r="{{LINK_NS}}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
    z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
    with z.open("xl/sharedStrings.xml", "w", force_zip64=True) as out:
        out.write(f'<sst xmlns="{{SHEET_NS}}">'.encode())
        for k in range(200_000):
            out.write(f"<si><t>{{'s' * 190}}{{k}}</t></si>".encode())
        out.write(b"</sst>")
    with z.open("xl/worksheets/s.xml", "w", force_zip64=True) as out:
        out.write(f'<worksheet xmlns="{{SHEET_NS}}"><sheetData>'.encode())
        for k in range(200_000):
            out.write((f'<row r="{{k + 1}}"><c t="s"><v>{{k}}</v></c>' + f'<c t="str"><v>{{"x" * 300}}</v></c>' * 2 + "</row>").encode())
        out.write(b"</sheetData></worksheet>")
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
with open({path!r}, "rb") as file:
    n = sum(1 for _ in office.workbook_cells("w.xlsx", file))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_large_workbook_in_bounded_memory(tmp_path):
    """A workbook of 180 MB of XML; its tree alone would take several times that."""
    code = LARGE.format(root=str(__import__("pathlib").Path(__file__).resolve().parents[1]), path=str(tmp_path / "w.xlsx"))
    cells_read, grown_mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert cells_read == 600_000
    assert grown_mb < 100


def test_a_plan_holds_few_bytes_a_file(tmp_path):
    for k in range(6_000):
        (tmp_path / f"d{k}.docx").touch()
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "é.DOCX").touch()
    (tmp_path / "more" / "x.txt").touch()
    reader = office.OfficeReader({"path": str(tmp_path), "kinds": "docx"})
    tracemalloc.start()
    parts = reader.partitions()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    found = sorted(path for part in pickle.loads(pickle.dumps(parts)) for path, only in part.files if only is None)
    assert found == sorted([*(f"{tmp_path}/d{k}.docx" for k in range(6_000)), f"{tmp_path}/more/é.DOCX"])
    assert len(pickle.dumps(parts)) < 20 * 6_000
    assert held < 30 * 6_000
