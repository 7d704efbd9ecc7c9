"""Operators on small hand-made rows with known results."""

import pytest
from pyspark.sql import functions as F

from plinth.functions import textual as X
from plinth.operators import gates as G
from plinth.operators import layout as L
from plinth.operators import planning as P
from plinth.operators import tabletyping as T
from plinth.operators import texts as O
from plinth.operators import visuals as V
from plinth.plans.archives import workbook
from plinth.sources import files as S
from plinth.sources import metadata as M
from plinth.sources.sinks import publish_tables, published, tables_of


def cells_of(spark, tables):
    rows = [(name, r, c, raw) for name, matrix in tables.items() for r, row in enumerate(matrix) for c, raw in enumerate(row)]
    return spark.createDataFrame(rows, "asset_id string, row_ix int, col_ix int, raw string")


def assets_of(spark, names):
    return spark.createDataFrame(
        [("r", n, i, "dataset", "auto", None, None, None, None, None, None) for i, n in enumerate(names)],
        "request_id string, asset_id string, asset_ix int, kind string, hint_mode string, hint_kind string, hint_subtype string, diagram_type string, max_items int, max_rows int, max_columns int",
    )


def test_types_and_choice(spark):
    tables = {
        "months": [["Месяц", "Выручка"], ["Январь", "1,5"], ["Февраль", "2"]],
        "share": [["Region", "Share %"]] + [[f"r{i}", str(i)] for i in range(4)],
        "xy": [["X", "Y"], ["1", "2"], ["3", "4"]],
        "many": [["Category", "Value"]] + [[f"c{i}", str(i)] for i in range(7)],
        "dates": [["When", "Value"], ["2026-02-01", "2"], ["2026-01-01", "1"]],
        "text": [["A", "B"], ["007", "1 200"], ["1e5", ".5"]],
    }
    cells = cells_of(spark, tables)
    columns = T.infer_column_types(cells)
    chosen = {r.asset_id: (r.visual_kind, r.visual_subtype) for r in V.visual_choices(assets_of(spark, tables), columns).collect()}
    assert chosen == {
        "months": ("chart", "line"), "share": ("chart", "donut"), "xy": ("chart", "scatter"), "many": ("chart", "column"),
        "dates": ("chart", "line"), "text": ("table", None),
    }


def test_pages_keep_every_cell(spark):
    cells = cells_of(spark, {"wide": [["ID", "A", "B", "C"]] + [[str(r), f"a{r}", f"b{r}", f"c{r}"] for r in range(3)]})
    columns = T.infer_column_types(cells)
    sized = V.page_counts(V.visual_choices(assets_of(spark, ["wide"]), columns).withColumn("visual_kind", F.lit("table")).withColumn("max_rows", F.lit(2)).withColumn("max_columns", F.lit(3)))
    table = V.materialize_table(cells, sized.select("asset_id", "page_size", "max_columns"), columns).collect()
    assert len({(r.block, r.page) for r in table}) == 4
    assert {(r.row_ix, r.col_ix) for r in table} == {(r, c) for r in (1, 2, 3) for c in range(4)}
    assert {r.block for r in table if r.col_ix == 0} == {0, 1}


def test_digest_of_a_long_table(spark, monkeypatch):
    cells = cells_of(spark, {"t": [["a", "b"]] + [[str(i), "x"] for i in range(50)]})
    titles = spark.createDataFrame([("t", "T")], "asset_id string, title string")
    monkeypatch.setattr(T, "ROWS_PER_BLOCK", 7)
    first, again = (T.stable_asset_id(cells.repartition(n), titles).collect()[0].stable_id for n in (1, 5))
    other = T.stable_asset_id(cells.withColumn("raw", F.when((F.col("row_ix") == 30) & (F.col("col_ix") == 1), "y").otherwise(F.col("raw"))), titles).collect()[0].stable_id
    assert first == again and first.startswith("t-") and other != first


@pytest.mark.parametrize("text,numbers", [
    ("2 800 units", ["2800"]), ("18 000 and 12 000", ["18000", "12000"]), ("99,4%", ["99.4"]), ("a1 b-2 -3 +04.50", ["2", "-3", "4.5"]),
    ("12 345 678,90 %", ["12345678.9"]), ("x_7 7x 7", ["7"]),
])
def test_numbers(spark, text, numbers):
    row = spark.createDataFrame([(text,)], "t string").select(X.canonical_numbers(F.col("t")).alias("n")).collect()[0]
    assert row.n == numbers


def test_chunks(spark):
    request = spark.createDataFrame([("r", "Brief", "First line\r\n second line\n\n- one\n2) two\ntail\n-\n")], "request_id string, brief string, content_package string")
    rows = {r.source_id: r.text for r in O.chunk_sources(request).collect()}
    assert rows == {"brief": "Brief", "content_001": "First line second line", "content_002": "- one", "content_003": "2) two", "content_004": "tail -"}


def shapes_of(spark, boxes):
    rows = [("d", 1, i, "text", x, y, w, h, "") for i, (x, y, w, h) in enumerate(boxes, 1)]
    return spark.createDataFrame(rows, "deck_id string, slide_number int, shape_id int, type string, x double, y double, width double, height double, text string")


def test_grid_and_repeat(spark):
    grid = shapes_of(spark, [(.1 + .25 * c, .2 + .08 * r, .2, .05) for r in range(4) for c in range(3)])
    assert L.detect_grids(grid).count() == 12
    good = shapes_of(spark, [(.1 + .28 * i, .3 + .12 * f, .2, .06) for f in range(2) for i in range(3)])
    assert {r.field_id for r in L.detect_repeats(good, "y").collect()} == {"field_0", "field_1"}
    moved = shapes_of(spark, [(.55 if (i, f) == (2, 1) else .1 + .28 * i, .3 + .12 * f, .2, .06) for f in range(2) for i in range(3)])
    assert L.detect_repeats(moved, "y").count() == 0


def test_long_chain_of_groups_is_one_component(spark):
    rows = [("d", 1, g, g + s) for g in range(40) for s in (0, 1)] + [("d", 1, 99, 500), ("d", 1, 99, 501)]
    groups = spark.createDataFrame(rows, "deck_id string, slide_number int, group_id int, shape_id int")
    assert {r.component for r in L.merge_overlapping_groups(groups).collect()} == {0, 500}


def test_diagram_levels(spark):
    nodes = [("a", f"n{i}", f"n{i - 1}" if i else None) for i in range(20)] + [("a", "x", "y"), ("a", "y", "x"), ("a", "z", "ghost")]
    levels = {r.id: r.level for r in V.diagram_levels(spark.createDataFrame(nodes, "asset_id string, id string, parent_id string")).collect()}
    assert all(levels[f"n{i}"] == i for i in range(20)) and {levels[k] for k in "xyz"} == {20}


def brute_images(rows):
    load, out = {}, {}
    for image in sorted({(r["image_ix"], r["id"]) for r in rows}):
        options = [r for r in rows if r["id"] == image[1]]
        typed = [r for r in options if r["content_type"] in ("image", "profiles") and not load.get(r["number"])]
        pool = typed or [r for r in options if not load.get(r["number"])] or options
        pool = [r for r in pool if r["explicit"]] or pool
        best = min(pool, key=lambda r: (not r["exact"], r["identity_distance"], r["chunk_distance"], r["content_type"] not in ("image", "profiles"), load.get(r["number"], 0), r["number"]))
        load[best["number"]] = load.get(best["number"], 0) + 1
        out[image[1]] = best["number"]
    return out


def test_image_assignment_matches_brute_force(spark):
    import random
    rng = random.Random(3)
    rows = [
        dict(request_id="r", image_ix=i, id=f"i{i}", number=n, content_type=rng.choice(["image", "text", "profiles"]), explicit=rng.random() < .1,
             exact=rng.random() < .3, identity_distance=rng.randrange(4), chunk_distance=rng.randrange(3))
        for i in range(8) for n in range(1, 7)
    ]
    schema = "request_id string, image_ix int, id string, number int, content_type string, explicit boolean, exact boolean, identity_distance long, chunk_distance int"
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    assert {r.id: r.number for r in P.assign_images_to_slides(frame).collect()} == brute_images(rows)


def plain_distance(material, purpose, name):
    import re
    spots = [m.start() for m in re.finditer(re.escape(name), material)]
    stems = {w[:3] for w in re.findall(r"[a-zа-яё]{3,}", purpose)} - P.COMMON_STEMS
    starts = {s: [m.start() for m in re.finditer(rf"\b{s}", material)] for s in stems}
    return sum(min([P.FAR_NAME, *(abs(a - b) for a in starts[s] for b in spots)]) for s in stems)


def test_identity_distances(spark):
    import random
    rng = random.Random(5)
    pool = ["team", "Teamwork", "photo.png", "Anna", "отчёт", "про", "a-b", "x1 y", "pic.png", "with", "\n", "(a)", "ёлка", "te", "sub_team"]
    requests = [(f"r{i}", " ".join(rng.choices(pool, k=4)), " ".join(rng.choices(pool, k=rng.randrange(60)))) for i in range(8)]
    images = [(r[0], k, f"i{k}", n, f"{n}.stored") for r in requests for k, n in enumerate(["photo.png", "PIC.png", "(a)"])]
    slides = [(r[0], n, "text", " ".join(rng.choices(pool, k=5))) for r in requests for n in (1, 2, 40)]
    frames = [spark.createDataFrame(x, s) for x, s in (
        (requests, "request_id string, brief string, content_package string"), (images, "request_id string, image_ix int, id string, original_name string, asset_ref string"),
        (slides, "request_id string, number int, content_type string, purpose string"), ([("r0", "content_001", 1, "content", "photo.png")], "request_id string, source_id string, seq int, kind string, text string"),
        ([("r0", 1, "content_001")], "request_id string, number int, source_id string"))]
    scores = P.image_slide_scores(frames[0], frames[3], frames[1], frames[2], frames[4]).collect()
    texts = {r[0]: f"{r[1]}\n{r[2]}".lower() for r in requests}
    names, wishes = {(i[0], i[2]): i[3].lower() for i in images}, {(s[0], s[1]): s[3].lower() for s in slides}
    assert len(scores) == 72 and {r.number for r in scores} == {1, 2, 40}
    for r in scores:
        assert r.identity_distance == plain_distance(texts[r.request_id], wishes[r.request_id, r.number], names[r.request_id, r.id]), r


def test_ground_images(spark):
    images = spark.createDataFrame([("r", 0, "a", "team.png"), ("r", 1, "b", "anna.png"), ("r", 2, "c", "rest.png")], "request_id string, image_ix int, id string, original_name string")
    slots = spark.createDataFrame(
        [("r", 1, 0, "pic", "Intro", "no names"), ("r", 2, 0, "pic", "People", "about Anna"), ("r", 3, 0, "portrait", "Person", "nobody")],
        "request_id string, number int, slot_ix int, slot_id string, purpose string, text string",
    )
    assert {(r.id, r.number) for r in P.ground_images(images, slots).collect()} == {("b", 2), ("a", 3), ("c", 1)}


def test_readers_and_errors(spark):
    book = workbook([("Visible", "visible", [["Date", "Value"], ["2026-01-01", "3"]]), ("Hidden", "hidden", [["x"]])])
    files = spark.createDataFrame([("in/a.xlsx", bytearray(book)), ("in/b.xlsx", bytearray(b"junk"))], "path string, content binary")
    rows = S.read_xlsx_datasets(files).collect()
    assert {(r.title, r.row_ix, r.col_ix, r.raw) for r in rows if r.path == "in/a.xlsx"} == {
        ("a: Visible", 0, 0, "Date"), ("a: Visible", 0, 1, "Value"), ("a: Visible", 1, 0, "2026-01-01"), ("a: Visible", 1, 1, "3")
    }
    assert [r.error for r in rows if r.path == "in/b.xlsx"][0].startswith("BadZipFile")


def csv_rows(spark, content):
    files = spark.createDataFrame([("in/a.csv", bytearray(content))], "path string, content binary")
    rows = S.read_csv_datasets(files).collect()
    if rows[0].error:
        return rows[0].error
    out = {}
    for r in rows:
        out.setdefault(r.row_ix, {})[r.col_ix] = r.raw
    return [[row[c] for c in sorted(row)] for _, row in sorted(out.items())]


@pytest.mark.parametrize("content,rows", [
    (b"a,b\n1,2\n", [["a", "b"], ["1", "2"]]),
    (b"\xef\xbb\xbfa;b\r\n\"x;y\";\"say \"\"hi\"\"\"\r\n;\r\n1,5;2", [["a", "b"], ["x;y", 'say "hi"'], ["1,5", "2"]]),
    (b"a\tb\n\"two\nlines\"\t\n", [["a", "b"], ["two\nlines", ""]]),
    (b",a\n,1\n", [["", "a"], ["", "1"]]),
    (b'5" pipe,x\n6,y', [['5" pipe', "x"], ["6", "y"]]),
    (b"only\none", [["only"], ["one"]]),
    (b" \n,\n", "ValueError: no tabular data"),
    (b"a,\xff", "UnicodeDecodeError: not UTF-8"),
    (b"a;b\n" + b"x,y,z;1\n" * 3000, [["a", "b"]] + [["x,y,z", "1"]] * 3000),
])
def test_csv(spark, content, rows):
    assert csv_rows(spark, content) == rows


def test_native_dates_of_a_workbook(spark):
    import io
    import zipfile

    book = workbook([("S", "visible", [["When"]])])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            text = old.read(name)
            if name == "xl/worksheets/sheet1.xml":
                cells = b"".join(b'<c r="A%d" s="%d"><v>%s</v></c>' % (2 + i, s, v) for i, (s, v) in enumerate([(0, b"46023"), (1, b"46023"), (2, b"46023.5"), (3, b"46023"), (1, b"59")]))
                text = text.replace(b"</sheetData>", b"<row>" + cells.replace(b"<c ", b"</row><row><c ")[11:] + b"</row></sheetData>")
            new.writestr(name, text)
        new.writestr("xl/styles.xml", '''<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy hh:mm"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts>
<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>''')
    files = spark.createDataFrame([("in/a.xlsx", bytearray(out.getvalue()))], "path string, content binary")
    assert [r.raw for r in S.read_xlsx_datasets(files).orderBy("row_ix").collect()] == ["When", "46023", "2026-01-01T00:00:00", "2026-01-01T12:00:00", "46023", "1900-02-28T00:00:00"]


def test_slide_files_nest_without_limit(spark, tmp_path):
    import json
    element = {"shape_id": 9, "type": "text", "text": "deep", "box": {"x": 0.1, "y": 0.2, "width": 0.3, "height": 0.4}}
    for n in range(8):
        element = {"shape_id": n, "type": "group", "children": [element, {"shape_id": 100 + n, "type": "text", "text": "side"}]}
    folder = tmp_path / "deck-a" / "slides" / "1"
    folder.mkdir(parents=True)
    structure = {"structure_id": "grid_0", "kind": "grid", "cells": [{"row": 0, "column": 1, "shape_ids": [9]}], "decoration_shape_ids": [3]}
    (folder / "metadata.json").write_text(json.dumps({"slide_number": 1, "elements": [element], "structures": [structure], "vlm": {"status": "ok", "classification": "cover"}}))
    manifests = spark.createDataFrame([("deck-a", "3.0"), ("deck-b", "2.0")], "deck_id string, schema_version string")
    slides, issues = M.read_slide_metadata(M.read_slide_files(spark, str(tmp_path)), manifests)
    assert {(r.deck_id, r.code) for r in issues.collect()} == {("deck-b", "unsupported_manifest")}
    assert {(r.shape_id, r.depth, r.parent_shape_id) for r in M.shapes_of(slides).collect()} == {(9, 8, 0)} | {(100 + n, 8 - n, n) for n in range(8)}
    assert {(r.shape_id, r.role, r.row, r.col) for r in M.members_of(slides).collect()} == {(9, "content", 0, 1), (3, "decoration", None, None)}


def test_publish_never_overwrites(spark, tmp_path):
    frame, folder = spark.range(3), str(tmp_path / "out")
    assert publish_tables({}, folder) == 0 and tables_of(spark, folder) == []
    assert publish_tables({"one": frame}, folder) == 1
    with pytest.raises(FileExistsError):
        publish_tables({"two": frame, "one": frame}, folder)
    assert tables_of(spark, folder) == ["one"] and published(spark, folder, "one").count() == 3
    with pytest.raises(FileNotFoundError):
        published(spark, folder, "two")


def test_publish_all_or_nothing(spark, tmp_path):
    """The second table fails: no reader sees the first one, and the next publication is not in its way."""
    broken, folder = spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x")), str(tmp_path / "out")
    with pytest.raises(Exception, match="no"):
        publish_tables({"one": spark.range(3), "two": broken}, folder)
    assert tables_of(spark, folder) == []
    assert publish_tables({"one": spark.range(4), "two": spark.range(5).withColumn("k", F.col("id") % 2)}, folder, {"two": ["k"]}) == 1
    assert [published(spark, folder, n).count() for n in ("one", "two")] == [4, 5]
    with pytest.raises(Exception, match="no"):
        publish_tables({"one": spark.range(9), "two": broken}, folder, replace=True)
    assert [published(spark, folder, n).count() for n in ("one", "two")] == [4, 5]


def test_versions_stay_readable(spark, tmp_path):
    folder = str(tmp_path / "out")
    publish_tables({"one": spark.range(1), "two": spark.range(2)}, folder)
    assert publish_tables({"two": spark.range(7)}, folder, replace=True) == 2
    assert [published(spark, folder, n).count() for n in ("one", "two")] == [1, 7]
    assert published(spark, folder, "two", 1).count() == 2
    assert publish_tables({"three": spark.range(5)}, folder, keep=False) == 3
    assert tables_of(spark, folder) == ["three"]


def test_what_a_plan_makes_per_slot_is_not_shuffled(spark):
    where = "request_id string, deck_id string, number int"
    slides = spark.createDataFrame([("r", "k", 2, "f", 1, None), ("r", "k", 5, "none", 9, None)], f"{where}, template_family_id string, template_slide_number int, chart_asset_id string")
    payload = "kind string, action string, content_kind string, asset_id string, visual_kind string, visual_subtype string, text string"
    assignments = spark.createDataFrame(
        [("r", 2, 2, "s1", "text", "replace", "text", None, None, None, "second"), ("r", 2, 1, "s1", "text", "replace", "text", None, None, None, "first"),
         ("r", 2, 3, "s2", "visual", "replace", "visual", "x", "chart", "bar", None), ("r", 5, 1, "q", "text", "keep", None, None, None, None, None)],
        f"request_id string, number int, assign_ix int, slot_id string, {payload}",
    )
    families = spark.createDataFrame([("k", "f", 1, "text")], "deck_id string, family_id string, slide_number int, slide_class string")
    slots = spark.createDataFrame(
        [("k", 1, i, f"s{i}", kind, required, False, None, None) for i, kind, required in ((1, "text", True), (2, "visual", False), (3, "image", False), (4, "text", True))],
        "deck_id string, slide_number int, slot_ix int, slot_id string, kind string, required boolean, has_canvas boolean, cap_kinds array<string>, cap_subtypes array<string>",
    )
    cells = cells_of(spark, {"x": [["X", "Y"], ["1", "2"], ["3", "4"]]})
    choices = V.visual_choices(assets_of(spark, ["x"]), T.infer_column_types(cells)).withColumn("deck_id", F.lit("k")).withColumn("title", F.lit("t"))
    canvas = spark.createDataFrame([], "deck_id string, subtype string, family_id string, slide_number int")
    _, rows = P.canonicalize_plan(slides, assignments, families, slots, choices, canvas)
    found = sorted((r.number, r.slot_id, r.action, r.visual_subtype, r.text) for r in rows.collect())
    assert found == [(1, "s1", "replace", None, "first"), (1, "s2", "replace", "scatter", None), (1, "s3", "clear", None, None), (2, "q", "keep", None, None)]
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    normal = plan[: plan.index("template_slide_number", plan.index("slot_ix"))]
    assert "SortMergeJoin" not in normal and "ShuffledHashJoin" not in normal


def test_slots_of_a_slide_are_compared_in_its_row(spark):
    slides = spark.createDataFrame(
        [("r", "k", n, family, "text", template) for n, family, template in ((1, "f", 1), (2, "f", 2), (3, "f", 9), (4, "g", 1), (5, "f", 3))],
        "request_id string, deck_id string, number int, template_family_id string, template_class string, template_slide_number int",
    )
    families = spark.createDataFrame([("k", "f", n, "text") for n in (1, 2, 3)], "deck_id string, family_id string, slide_number int, slide_class string")
    slots = spark.createDataFrame(
        [("k", n, name, "text", True, 2, 9, [1]) for n, name in ((1, "a"), (1, "b"), (2, "a"), (2, None))],
        "deck_id string, slide_number int, slot_id string, kind string, required boolean, capacity int, max_chars int, targets array<int>",
    )
    uses = spark.createDataFrame(
        [("r", 1, "a", "cards", "clear", [1], 3, 12), ("r", 1, "b", "text", "replace", [2], None, None), ("r", 2, "a", "text", "replace", [1], 2, 9), ("r", 4, "a", "text", "clear", [1], 9, 99)],
        "request_id string, number int, slot_id string, kind string, action string, targets array<int>, n_items long, longest int",
    )
    issues = G.catalog_cover(slides, families, slots, uses)
    assert sorted((r.code, r.path) for r in issues.collect()) == [
        ("capacity_exceeded", "slides[0].a"), ("catalog_mismatch", "slides[0].a"), ("catalog_mismatch", "slides[0].b"), ("catalog_mismatch", "slides[1].assignments"),
        ("catalog_mismatch", "slides[2]"), ("catalog_mismatch", "slides[3]"), ("required_slot_cleared", "slides[0].a"), ("text_too_long", "slides[0].a"),
    ]
    assert "FullOuter" not in issues._jdf.queryExecution().sparkPlan().toString()
