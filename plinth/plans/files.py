"""Queries over the readers. File contents are made by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.numbering import ordered_text
from plinth.plans.archives import document_of, store_files, workbook_of
from plinth.plans.registry import Tables, define, query
from plinth.session import shared_folder
from plinth.sources import files as S
from plinth.sources import metadata as M
from plinth.sources import sinks


def _lines(t: Tables, separator: str) -> DataFrame:
    line = F.concat_ws(separator, "a", "b", "c")
    head = F.lit(separator.join(["Day", "Price", "Note"]))
    return t("file_rows").groupBy("o_custkey").agg(F.concat(head, F.lit("\n"), ordered_text(F.col("row_ix"), line, "\n")).alias("text"))


def _cells_sql(title: str, path: str) -> str:
    return f"""
SELECT {path} AS path, {title} AS title, row_ix, u.col_ix, u.raw FROM (
  SELECT o_custkey, row_ix, unnest([0, 1, 2]) AS col_ix, unnest([a, b, c]) AS raw FROM {{file_rows}}
  UNION ALL SELECT DISTINCT o_custkey, 0, unnest([0, 1, 2]), unnest(['Day', 'Price', 'Note']) FROM {{file_rows}}) u
"""


CSV_PATH = "'in/c' || CAST(o_custkey AS VARCHAR) || '.csv'"


@query("read_csv_datasets", "SELECT *, CAST(NULL AS VARCHAR) AS error FROM (" + _cells_sql("'c' || CAST(o_custkey AS VARCHAR)", CSV_PATH) + """) u
UNION ALL SELECT 'in/x' || CAST(c_custkey AS VARCHAR) || '.csv', NULL, NULL, NULL, NULL, CASE WHEN c_custkey % 2 = 0 THEN 'UnicodeDecodeError: not UTF-8' ELSE 'ValueError: no tabular data' END FROM {customer}
""")
def _(t: Tables):
    texts = [_lines(t, s).filter(F.col("o_custkey") % 3 == i) for i, s in enumerate((",", ";", "\t"))]
    marked = F.concat(F.when(F.col("o_custkey") % 2 == 0, F.lit("﻿")).otherwise(""), "text", F.lit("\n ,\n"))
    marked = F.when(F.col("o_custkey") % 3 == 0, marked).otherwise(F.col("text"))
    files = texts[0].unionByName(texts[1]).unionByName(texts[2]).select(
        F.format_string("in/c%d.csv", "o_custkey").alias("path"), F.encode(marked, "UTF-8").alias("content")
    )
    bad = t("customer").select(F.format_string("in/x%d.csv", "c_custkey").alias("path"), F.when(F.col("c_custkey") % 2 == 0, F.unhex(F.lit("41FF2C42"))).otherwise(F.encode(F.lit(" ,\n\n"), "UTF-8")).alias("content"))
    return S.read_csv_datasets(files.unionByName(bad)).select("path", "title", "row_ix", "col_ix", "raw", "error")


@query("read_xlsx_datasets", _cells_sql("'b' || CAST(o_custkey AS VARCHAR) || ': Data'", "'in/b' || CAST(o_custkey AS VARCHAR) || '.xlsx'"))
def _(t: Tables):
    """Read where they lie, every sheet a task of its own."""
    files = _lines(t, "\t").select(F.format_string("in/b%d.xlsx", "o_custkey").alias("path"), workbook_of("text").alias("content"))
    return _read_back(t, files, split_bytes=1 << 12)


def _read_back(t: Tables, files: DataFrame, **options: int) -> DataFrame:
    folder = shared_folder(t.spark, "office")
    store_files(files, folder)
    cells = S.read_office_tables(t.spark, folder, **{k: str(v) for k, v in options.items()})
    return cells.select(F.concat(F.lit("in/"), F.substring_index("path", "/", -1)).alias("path"), "title", "row_ix", "col_ix", "raw")


def _documents(t: Tables) -> DataFrame:
    return _lines(t, "\t").select(F.format_string("in/d%d.docx", "o_custkey").alias("path"), document_of("text").alias("content"))


@query("read_docx_tables", _cells_sql("'d' || CAST(o_custkey AS VARCHAR) || ' table 1'", "'in/d' || CAST(o_custkey AS VARCHAR) || '.docx'") + """
UNION ALL SELECT DISTINCT 'in/d' || CAST(o_custkey AS VARCHAR) || '.docx', 'd' || CAST(o_custkey AS VARCHAR) || ' table 2', 0, unnest([0, 1, 2]), unnest(['Day', 'Price', 'Note']) FROM {file_rows}
""")
def _(t: Tables):
    return _read_back(t, _documents(t), kinds="docx")


@query("extract_document_text", """
SELECT *, CAST(NULL AS VARCHAR) AS error FROM (
SELECT 'in/d' || CAST(o_custkey AS VARCHAR) || '.docx' AS path, 'Intro' || chr(10) || 'Day' || chr(10) || 'Day | Price | Note' || chr(10) || string_agg(a || ' | ' || b || ' | ' || c, chr(10) ORDER BY row_ix) || chr(10) || 'Day | Price | Note' AS text
FROM {file_rows} GROUP BY o_custkey
UNION ALL SELECT 'in/t' || CAST(doc_id AS VARCHAR) || '.md', text FROM {documents}) u
UNION ALL SELECT 'in/u' || CAST(n_nationkey AS VARCHAR) || CASE n_nationkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' ELSE '.docx' END, NULL,
  CASE n_nationkey % 3 WHEN 0 THEN 'UnsupportedFormat: PDF text is not extracted' WHEN 1 THEN 'UnicodeDecodeError: not UTF-8' ELSE 'BadZipFile: File is not a zip file' END FROM {nation}
""")
def _(t: Tables):
    plain = t("documents").select(F.format_string("in/t%d.md", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    suffix = F.when(F.col("n_nationkey") % 3 == 0, ".pdf").when(F.col("n_nationkey") % 3 == 1, ".txt").otherwise(".docx")
    bad = t("nation").select(F.concat(F.lit("in/u"), F.col("n_nationkey").cast("string"), suffix).alias("path"), F.unhex(F.lit("41FF42")).alias("content"))
    return S.extract_document_text(plain.unionByName(_documents(t)).unionByName(bad))


define("corpus", """
SELECT 'in/f' || CAST(doc_id AS STRING) || CASE doc_id % 7 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.csv' WHEN 3 THEN '.PNG' WHEN 4 THEN '.exe' WHEN 5 THEN '.docx' ELSE '' END AS path, text FROM {documents}
""")


@query("ingest_files", r"""
SELECT path, split_part(path, '/', 2) AS name, CASE WHEN path LIKE '%.%' THEN lower(split_part(path, '.', 2)) ELSE '' END AS ext,
  CASE WHEN path LIKE '%.TXT' OR path LIKE '%.md' OR path LIKE '%.docx' THEN 'text' WHEN path LIKE '%.csv' THEN 'structured' WHEN path LIKE '%.PNG' THEN 'image' ELSE 'rejected' END AS kind,
  strlen(text) AS size, sha256(text) AS sha256, path LIKE '%.%' AND path NOT LIKE '%.exe' AS accepted FROM {corpus}
""")
def _(t: Tables):
    return S.ingest_files(t("corpus").select("path", F.encode("text", "UTF-8").alias("content")))


@query("upload_quota", r"""
WITH r AS (SELECT *, sum(size) OVER (PARTITION BY request_id ORDER BY file_ix) AS run FROM {quota_files}),
 found AS (
 SELECT request_id, 'too_many_files' AS code, 'files' AS path FROM {quota_files} GROUP BY request_id HAVING count(*) > 10
 UNION ALL SELECT request_id, 'file_too_large', 'files[' || file_ix || ']' FROM {quota_files} WHERE size > 26214400
 UNION ALL SELECT request_id, 'content_too_large', 'files[' || min(file_ix) || ']' FROM r WHERE run > 104857600 GROUP BY request_id
 UNION ALL SELECT request_id, 'content_too_long', 'content' FROM {quota_texts} WHERE chars > 50000
 UNION ALL SELECT request_id, 'invalid_brief', 'brief' FROM {quota_requests} WHERE trim(brief) = ''
 UNION ALL SELECT request_id, 'invalid_slide_range', 'slide_count' FROM {quota_requests} WHERE NOT (1 <= slide_min AND slide_min <= slide_max AND slide_max <= 30))
SELECT request_id, code, path FROM found
""")
def _(t: Tables):
    return S.upload_quota(t("quota_requests"), t("quota_files"), t("quota_texts")).select("request_id", "code", "path")


@query("extract_markdown_tables", r"""
SELECT n_nationkey, table_ix, row_ix, col_ix, raw FROM (
  SELECT n_nationkey, 0 AS table_ix, 0 AS row_ix, unnest([0, 1]) AS col_ix, unnest(['Nation', 'Customers']) AS raw FROM {markdown_rows}
  UNION ALL SELECT n_nationkey, 0, 1, unnest([0, 1]), unnest([n_name, CAST(n AS VARCHAR)]) FROM {markdown_rows}
  UNION ALL SELECT n_nationkey, 0, 2, unnest([0, 1]), unnest([r_name, '']) FROM {markdown_rows}
  UNION ALL SELECT n_nationkey, 1, 0, unnest([0, 1]), unnest(['Region', 'Key']) FROM {markdown_rows}
  UNION ALL SELECT n_nationkey, 1, 1, unnest([0, 1]), unnest([r_name, CAST(n_regionkey AS VARCHAR)]) FROM {markdown_rows}) u
""")
def _(t: Tables):
    text = F.concat(
        F.lit("Intro a | b\nplain\n| Nation | Customers |\n|:---|---:|\n| "), "n_name", F.lit(" | "), F.col("n").cast("string"), F.lit(" | extra |\n"),
        "r_name", F.lit(" |\n\nx | y\nRegion | Key\n--- | ---\n"), "r_name", F.lit(" | "), F.col("n_regionkey").cast("string"), F.lit("\nend"),
    )
    return S.extract_markdown_tables(t("markdown_rows").select("n_nationkey", text.alias("text")), "n_nationkey")


@query("assemble_content", r"""
WITH p AS (SELECT request_id, file_ix, CASE WHEN kind = 'image' THEN 'Доступное изображение: ' || asset_ref || ' (исходное имя файла: ' || split_part(name, '/', 2) || ')' WHEN trim(text) <> '' THEN 'Документ ' || name || ':' || chr(10) || trim(text, ' ' || chr(10)) END AS piece FROM {parts_of_request}),
 f AS (SELECT request_id, string_agg(piece, chr(10) || chr(10) ORDER BY file_ix) AS body FROM p GROUP BY ALL)
SELECT r.request_id, concat_ws(chr(10) || chr(10), nullif(trim(content_text), ''), body) AS content FROM {request_forms} r LEFT JOIN f ON f.request_id = r.request_id
""")
def _(t: Tables):
    return S.assemble_content(t("request_forms"), t("parts_of_request"))


def _asset_json(t: Tables) -> DataFrame:
    """Dataset assets as JSON, one text per customer; some wrapped, some with faults."""
    row = F.struct(F.col("a").alias("day"), F.col("b").cast("double").alias("price"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("row_ix", row.alias("r")))), lambda x: x["r"])
    key = F.col("o_custkey")
    told = t("file_rows").groupBy("o_custkey").agg(rows.alias("rows"))
    kinds = F.when(key % 10 == 6, F.lit("money")).otherwise("number")
    columns = F.array(*[
        F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), kind.alias("type"), extra.alias("color"))
        for k, label, kind, extra in (("day", "Day", F.lit("date"), F.when(key % 4 == 1, F.lit("red"))), ("price", "Price", kinds, F.lit(None).cast("string")))
    ])
    asset = F.struct(
        F.when(key % 7 == 1, F.lit("-bad")).otherwise(F.format_string("set-%d", "o_custkey")).alias("id"), F.when(key % 5 == 2, F.lit("chart3d")).otherwise("dataset").alias("kind"),
        F.lit("Orders").alias("title"), columns.alias("columns"), F.col("rows").alias("rows"), F.when(key % 6 == 3, F.lit("x")).alias("colour"),
        F.when(key % 8 == 5, F.struct(F.lit("loud").alias("mode"), F.lit(None).cast("string").alias("kind"))).alias("visual_hint"), F.when(key % 9 == 0, F.lit(5)).alias("provenance"),
    )
    plain = F.to_json(asset)
    text = F.when(key % 3 == 0, plain).when(key % 3 == 1, F.concat(F.lit("["), plain, F.lit("]"))).otherwise(F.concat(F.lit('{"structured_assets":['), plain, F.lit("]}")))
    return told.select("o_custkey", F.when(key % 11 == 4, F.lit("{broken")).otherwise(text).alias("text"))


@query("read_json_assets", r"""
WITH k AS (SELECT DISTINCT o_custkey AS k FROM {file_rows}), ok AS (SELECT k FROM k WHERE k % 11 <> 4), known AS (SELECT k FROM ok WHERE k % 5 <> 2),
found AS (
  SELECT k, 'invalid_json' AS code, '' AS path FROM k WHERE k % 11 = 4
  UNION ALL SELECT k, 'unknown_kind', 'structured_assets[0]' FROM ok WHERE k % 5 = 2
  UNION ALL SELECT k, 'invalid_asset_id', 'structured_assets[0]' FROM ok WHERE k % 7 = 1
  UNION ALL SELECT k, 'unknown_field', 'structured_assets[0].colour' FROM known WHERE k % 6 = 3
  UNION ALL SELECT k, 'unknown_field', 'structured_assets[0].columns[0].color' FROM known WHERE k % 4 = 1
  UNION ALL SELECT k, 'invalid_value', 'structured_assets[0].columns[1].type' FROM known WHERE k % 10 = 6
  UNION ALL SELECT k, 'invalid_value', 'structured_assets[0].visual_hint.mode' FROM known WHERE k % 8 = 5
  UNION ALL SELECT k, 'wrong_type', 'structured_assets[0].provenance' FROM known WHERE k % 9 = 0)
SELECT CAST(k AS VARCHAR) AS request_id, code, path FROM found
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'row ' || row_ix || ' ' || a || ' ' || b, '' FROM {file_rows} WHERE o_custkey % 11 <> 4 AND o_custkey % 5 <> 2
""")
def _(t: Tables):
    assets, issues = S.read_json_assets(_asset_json(t), "o_custkey")
    cells = S.dataset_cells_of(assets, "o_custkey").filter("row_ix > 0").groupBy("o_custkey", "row_ix").agg(
        F.max(F.when(F.col("col_ix") == 0, F.col("raw"))).alias("a"), F.max(F.when(F.col("col_ix") == 1, F.col("raw"))).alias("b")
    )
    row = F.concat(F.lit("row "), F.col("row_ix").cast("string"), F.lit(" "), "a", F.lit(" "), F.col("b").cast("decimal(18,2)").cast("string"))
    return issues.select("request_id", "code", "path").unionByName(cells.select(F.col("o_custkey").cast("string").alias("request_id"), row.alias("code"), F.lit("").alias("path")))


@query("read_requests", r"""
SELECT CAST(c_custkey AS VARCHAR) AS request_id, code, path FROM (
SELECT c_custkey, unnest(list_filter([CASE WHEN c_custkey % 9 = 0 THEN 'brief_required' END, CASE WHEN NOT (1 <= c_custkey % 5 AND c_custkey % 5 <= c_custkey % 33 AND c_custkey % 33 <= 30) THEN 'invalid_slide_range' END,
  CASE WHEN c_custkey % 4 = 1 THEN 'content_required' END, CASE WHEN c_custkey % 4 = 2 THEN 'duplicate_asset_id' END, CASE WHEN c_custkey % 6 = 5 THEN 'duplicate_asset_ref' END],
  lambda c: c IS NOT NULL)) AS code, '' AS path FROM {customer}
UNION ALL SELECT c_custkey, 'unknown_field', 'theme' FROM {customer} WHERE c_custkey % 8 = 3
UNION ALL SELECT c_custkey, 'unknown_field', 'provided_images[1].width' FROM {customer} WHERE c_custkey % 10 = 7
UNION ALL SELECT c_custkey, 'missing_field', 'slide_count.max' FROM {customer} WHERE c_custkey % 33 = 32
UNION ALL SELECT c_custkey, 'missing_field', unnest(['structured_assets[0].title', 'structured_assets[0].columns', 'structured_assets[1].title', 'structured_assets[1].columns']) FROM {customer} WHERE c_custkey % 4 = 2) u
""")
def _(t: Tables):
    key = F.col("c_custkey")
    two = F.array(F.struct(F.lit("a").alias("id")), F.struct(F.lit("a").alias("id")))
    none = F.array().cast("array<struct<id:string>>")
    images = F.array(*[F.struct(F.lit(f"i{i}").alias("id"), F.lit("p.png").alias("original_name"), F.when(key % 6 == 5, "x.png").otherwise(F.lit(f"x{i}.png")).alias("asset_ref"), (F.when(key % 10 == 7, 640) if i else F.lit(None).cast("int")).alias("width")) for i in range(2)])
    body = F.struct(
        F.when(key % 9 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("brief"), F.when(key % 4 == 1, F.lit(" ")).otherwise("text").alias("content_package"),
        F.struct((key % 5).alias("min"), F.when(key % 33 < 32, key % 33).alias("max")).alias("slide_count"), F.when(key % 4 == 2, two).otherwise(none).alias("structured_assets"),
        images.alias("provided_images"), F.when(key % 8 == 3, F.lit("?")).alias("theme"),
    )
    _, issues = S.read_requests(t("customer").select("c_custkey", F.to_json(body).alias("text")), "c_custkey")
    return issues.select("request_id", "code", "path")


define("slide_statuses", "SELECT deck_id, slide_number, CASE p_partkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'disabled' ELSE 'error' END AS status, CASE WHEN p_partkey % 6 = 3 THEN 'poster' ELSE classification END AS classification, description, p_partkey FROM {slides}")
define("deck_manifests", "SELECT deck_id, CASE WHEN min(p_partkey) % 60 = 0 THEN '2.0' ELSE '3.0' END AS schema_version FROM {slides} GROUP BY deck_id")


@query("read_slide_metadata", r"""
SELECT s.deck_id, s.slide_number, CASE WHEN status = 'ok' AND classification <> 'poster' THEN classification END AS classification, CASE WHEN status = 'ok' THEN description END AS description, status AS vlm_status, count(x.shape_id) AS n_shapes
FROM {slide_statuses} s JOIN {deck_manifests} m ON m.deck_id = s.deck_id AND m.schema_version = '3.0' LEFT JOIN {shapes} x ON x.deck_id = s.deck_id AND x.slide_number = s.slide_number GROUP BY ALL
""")
def _(t: Tables):
    box = F.struct("x", "y", "width", "height")
    element = F.struct("shape_id", "name", "type", box.alias("box"), "placeholder_type", "alt_text", "text")
    elements = t.stored("shapes").groupBy("deck_id", "slide_number").agg(F.array_sort(F.collect_list(element)).alias("elements"))
    vlm = F.struct(F.col("status"), F.col("classification"), F.array(F.lit("a"), F.lit(" ")).alias("tags"), F.concat(F.lit(" "), "description", F.lit(" ")).alias("description"))
    texts = t("slide_statuses").join(elements, ["deck_id", "slide_number"], "left").select(
        "deck_id", F.to_json(F.struct("slide_number", F.col("p_partkey").alias("slide_id"), "elements", vlm.alias("vlm"))).alias("text")
    )
    slides, _ = M.read_slide_metadata(M.slides_of_json(texts), t("deck_manifests"))
    counts = M.shapes_of(slides).groupBy("deck_id", "slide_number").agg(F.count(F.lit(1)).alias("n_shapes"))
    return slides.select("deck_id", "slide_number", "classification", "description", "vlm_status").join(counts, ["deck_id", "slide_number"], "left").withColumn("n_shapes", F.coalesce("n_shapes", F.lit(0)))


@query("publish_tables", r"""
SELECT 1 AS version, 'assets' AS table_name, count(*) AS rows, sum(asset_ix) AS checksum FROM {assets}
UNION ALL SELECT 1, 'jobs', count(*), sum(strlen(id)) FROM {jobs}
UNION ALL SELECT 2, 'assets', count(*), sum(asset_ix) FROM {assets}
UNION ALL SELECT 2, 'jobs', count(*), sum(strlen(id)) FROM {jobs} WHERE status <> 'processing'
""")
def _(t: Tables):
    """Two versions of two tables, the second of one table only, read back as each version has them."""
    folder = shared_folder(t.spark, "published")
    sinks.publish_tables({"assets": t("assets"), "jobs": t("jobs")}, folder, {"assets": ["request_id"]})
    sinks.publish_tables({"jobs": t("jobs").filter("status <> 'processing'")}, folder, replace=True)
    told = []
    for version in (1, 2):
        for name, number in (("assets", F.sum("asset_ix")), ("jobs", F.sum(F.octet_length("id")))):
            rows = sinks.published(t.spark, folder, name, version).agg(F.count(F.lit(1)).alias("rows"), number.cast("long").alias("checksum"))
            told.append(rows.select(F.lit(version).alias("version"), F.lit(name).alias("table_name"), "rows", "checksum"))
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])
