"""Queries over typed tables and their visuals, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import tabletyping as T
from plinth.operators import visuals as V
from plinth.plans.registry import Tables, define, query

# --- checking SQL shared by several queries -------------------------------------------------------

define("x_typed", r"""
SELECT asset_id, row_ix, col_ix, raw, trim(coalesce(raw, '')) AS t,
  CASE WHEN trim(coalesce(raw, '')) = '' THEN 'null'
       WHEN lower(trim(raw)) IN ('true', 'false') THEN 'bool'
       WHEN regexp_matches(trim(raw), '^[-+]?(0|[1-9][0-9]*)([.,][0-9]+)?$') THEN 'number'
       ELSE 'text' END AS vt
FROM {dataset_cells}
""")
define("x_num", "SELECT *, CASE WHEN vt = 'number' THEN CAST(replace(t, ',', '.') AS DOUBLE) END AS num FROM {x_typed}")
define("x_heads", r"""
SELECT asset_id, col_ix, CASE WHEN t = '' THEN 'Column ' || CAST(col_ix + 1 AS VARCHAR) ELSE t END AS label
FROM {x_typed} WHERE row_ix = 0
""")
define("x_bases", r"""
SELECT asset_id, col_ix, label,
  coalesce(nullif(trim(regexp_replace(lower(label), '[^0-9a-z_]+', '_', 'g'), '_'), ''), 'column_' || CAST(col_ix + 1 AS VARCHAR)) AS base
FROM {x_heads}
""")
define("x_walk", r"""
SELECT asset_id, col_ix, label, base AS key, [base] AS used FROM {x_bases} WHERE col_ix = 0
UNION ALL
SELECT asset_id, col_ix, label, key, list_append(used, key) FROM (
  SELECT b.asset_id, b.col_ix, b.label, w.used,
    CASE WHEN NOT list_contains(w.used, b.base) THEN b.base
         ELSE list_filter(list_transform(range(2, 12), lambda n: b.base || '_' || CAST(n AS VARCHAR)), lambda c: NOT list_contains(w.used, c))[1] END AS key
  FROM x_walk w JOIN {x_bases} b ON b.asset_id = w.asset_id AND b.col_ix = w.col_ix + 1) step
""")
define("x_keys", "SELECT asset_id, col_ix, label, key FROM {x_walk}")
define("x_columns", r"""
SELECT k.asset_id, k.col_ix, k.label, k.key,
  CASE WHEN contains(lower(k.label), 'percent') OR contains(k.label, '%') THEN '%' END AS unit,
  CASE WHEN s.n_present = 0 THEN 'text' WHEN s.n_bool = s.n_present THEN 'boolean' WHEN s.n_number = s.n_present THEN 'number'
       WHEN s.n_date = s.n_present THEN 'date' ELSE 'text' END AS type,
  s.n_rows, s.label_chars, s.num_min, s.num_max
FROM {x_keys} k JOIN (
  SELECT asset_id, col_ix,
    count(*) FILTER (row_ix > 0) AS n_rows,
    count(*) FILTER (row_ix > 0 AND vt <> 'null') AS n_present,
    count(*) FILTER (row_ix > 0 AND vt = 'bool') AS n_bool,
    count(*) FILTER (row_ix > 0 AND vt = 'number') AS n_number,
    count(*) FILTER (row_ix > 0 AND vt = 'text' AND regexp_matches(t, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ].*)?$')) AS n_date,
    CAST(coalesce(sum(length(t)) FILTER (row_ix > 0), 0) AS BIGINT) AS label_chars,
    min(num) FILTER (row_ix > 0) AS num_min, max(num) FILTER (row_ix > 0) AS num_max
  FROM {x_num} GROUP BY ALL) s ON s.asset_id = k.asset_id AND s.col_ix = k.col_ix
""")
define("x_profile", r"""
SELECT asset_id, count(*) AS n_columns,
  count(*) FILTER (type = 'number') AS n_number, count(*) FILTER (type = 'text') AS n_text, count(*) FILTER (type = 'date') AS n_date,
  count(*) FILTER (type = 'number' AND (unit = '%' OR contains(key || ' ' || label, '%') OR contains(lower(key || ' ' || label), 'percent'))) AS n_percent,
  CASE WHEN count(*) FILTER (type = 'date') > 0 THEN count(*) FILTER (type = 'date')
       ELSE least(count(*) FILTER (type = 'text' AND regexp_matches(lower(key || ' ' || label), '(^|[^0-9a-z_])(date|datetime|time|day|week|month|quarter|year)([^0-9a-z_]|$)')), 1) END AS n_temporal,
  max(n_rows) AS n_rows,
  arg_min(label_chars / n_rows, col_ix) FILTER (type = 'text') AS mean_label,
  min(col_ix) FILTER (type IN ('text', 'date')) AS first_label_col,
  min(col_ix) FILTER (type = 'number' AND (unit = '%' OR contains(key || ' ' || label, '%'))) AS first_percent_col
FROM {x_columns} GROUP BY asset_id
""")
define("x_choice", r"""
SELECT *, split_part(v, '/', 1) AS vk0, CASE WHEN v LIKE '%/%' THEN split_part(v, '/', 2) END AS visual_subtype, nullif(split_part(v, '/', 1), '') AS visual_kind FROM (
SELECT a.*, p.* EXCLUDE (asset_id),
  CASE WHEN hint_mode = 'none' THEN ''
       WHEN hint_mode = 'force' THEN CASE WHEN hint_kind IN ('chart', 'diagram') AND coalesce(hint_subtype, '') NOT IN ('bar','column','line','area','pie','donut','scatter') THEN ''
            ELSE hint_kind || coalesce('/' || hint_subtype, '') END
       WHEN n_temporal > 0 AND n_number > 0 THEN 'chart/line'
       WHEN n_percent = 1 AND n_text > 0 THEN 'chart/donut'
       WHEN n_number = 2 AND n_text = 0 THEN 'chart/scatter'
       WHEN n_number = 1 AND n_text = 1 AND n_rows <= 6 THEN 'chart/donut'
       WHEN (n_number = 1 AND n_text = 1) OR (n_number > 0 AND n_text > 0 AND n_text < n_columns)
         THEN CASE WHEN coalesce(mean_label, 0) > 12 THEN 'chart/bar' ELSE 'chart/column' END
       ELSE 'table' END AS v
FROM {assets} a JOIN {x_profile} p ON p.asset_id = a.asset_id) chosen
""")
define("x_pages", r"""
SELECT *, greatest(1, CAST(ceil(n_rows / page_size) AS INT)) AS pages FROM (
SELECT *, CASE WHEN visual_kind = 'table' THEN coalesce(nullif(max_rows, 0), 12) ELSE coalesce(nullif(max_items, 0), 12) END AS page_size
FROM {x_choice}) sized
""")
define("x_selected", r"""
SELECT c.asset_id, c.col_ix, c.key, c.label, c.unit, c.type, c.num_min, c.num_max,
  CASE WHEN pair THEN CASE WHEN c.col_ix = first_label_col THEN 0 ELSE 1 END ELSE c.col_ix END AS position
FROM {x_columns} c JOIN (SELECT *, coalesce(visual_kind <> 'table' AND visual_subtype IN ('pie', 'donut')
    AND first_label_col IS NOT NULL AND first_percent_col IS NOT NULL, FALSE) AS pair FROM {x_choice}) v ON v.asset_id = c.asset_id
WHERE NOT pair OR c.col_ix = first_label_col OR c.col_ix = first_percent_col
""")


# --- typing and identity --------------------------------------------------------------------------

@query("clean_table_rows", r"""
WITH kept AS (SELECT asset_id, row_ix, row_number() OVER (PARTITION BY asset_id ORDER BY row_ix) - 1 AS new_ix, last_col FROM (
    SELECT asset_id, row_ix, max(col_ix) AS last_col, bool_or(raw IS NOT NULL AND raw <> '') AS keep FROM {dataset_raw} GROUP BY ALL) WHERE keep),
 wide AS (SELECT *, max(last_col) OVER (PARTITION BY asset_id) AS width FROM kept),
 slots AS (SELECT asset_id, row_ix, new_ix, unnest(range(0, width + 1)) AS col_ix FROM wide)
SELECT s.asset_id, s.new_ix AS row_ix, s.col_ix, r.raw FROM slots s
LEFT JOIN {dataset_raw} r ON r.asset_id = s.asset_id AND r.row_ix = s.row_ix AND r.col_ix = s.col_ix
""")
def _(t: Tables):
    return T.clean_table_rows(t("dataset_raw"))


@query("normalize_headers", "SELECT asset_id, col_ix, key, label FROM {x_keys}")
def _(t: Tables):
    return T.normalize_headers(t("dataset_cells"))


@query("parse_scalars", r"""
SELECT asset_id, row_ix, col_ix, vt AS value_type, num,
  CASE WHEN vt = 'bool' THEN lower(t) = 'true' END AS bool, CASE WHEN vt = 'text' THEN t END AS txt
FROM {x_num} WHERE row_ix > 0
""")
def _(t: Tables):
    return T.parse_scalars(t("dataset_cells"))


@query("infer_column_types", "SELECT asset_id, col_ix, key, label, type, n_rows, num_min, num_max FROM {x_columns}")
def _(t: Tables):
    columns = T.infer_column_types(t("dataset_cells"))
    return columns.select("asset_id", "col_ix", "key", "label", "type", "n_rows", "num_min", "num_max")


@query("tag_percent_unit", "SELECT asset_id, col_ix, label, unit FROM {x_columns}")
def _(t: Tables):
    return T.tag_percent_unit(T.header_labels(t("dataset_cells")))


_JSON_TEXT = r"""
 typed AS (SELECT asset_id, row_ix, col_ix, CASE WHEN row_ix = 0 THEN '"' || CASE WHEN t = '' THEN 'Column ' || CAST(col_ix + 1 AS VARCHAR) ELSE t END || '"'
    WHEN vt = 'null' THEN 'null' WHEN vt = 'bool' THEN lower(t) WHEN vt = 'text' THEN '"' || t || '"'
    ELSE replace(regexp_replace(regexp_replace(replace(t, ',', '.'), '(\.[0-9]*?)0+$', '\1'), '\.$', '.0'), '+', '') END AS j FROM {x_typed}),
 rowsj AS (SELECT asset_id, row_ix, '[' || string_agg(j, ',' ORDER BY col_ix) || ']' AS rj FROM typed GROUP BY ALL)"""


def _tree(rows: str) -> str:
    """Digest tree over the rows of a table, blocks of 4096 at three levels."""
    return f"""
 tree0 AS (SELECT asset_id, (row_ix - 1) // 4096 AS b, sha256(string_agg(rj, ',' ORDER BY row_ix)) AS d FROM {rows} WHERE row_ix > 0 GROUP BY ALL),
 tree1 AS (SELECT asset_id, b // 4096 AS b, sha256(string_agg(d, ',' ORDER BY tree0.b)) AS d FROM tree0 GROUP BY asset_id, tree0.b // 4096),
 tree2 AS (SELECT asset_id, b // 4096 AS b, sha256(string_agg(d, ',' ORDER BY tree1.b)) AS d FROM tree1 GROUP BY asset_id, tree1.b // 4096),
 body AS (SELECT asset_id, string_agg(d, ',' ORDER BY b) AS body FROM tree2 GROUP BY ALL)"""


@query("stable_asset_id", "WITH " + _JSON_TEXT + "," + _tree("rowsj") + r"""
, payload AS (SELECT r.asset_id, r.rj AS labels, coalesce(b.body, '') AS body FROM rowsj r LEFT JOIN body b ON b.asset_id = r.asset_id WHERE r.row_ix = 0)
SELECT p.asset_id, substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48) || '-' ||
  substr(sha256('{"columns":' || labels || ',"rows":[' || body || '],"title":"' || title || '"}'), 1, 10) AS stable_id
FROM payload p JOIN {assets} a ON a.asset_id = p.asset_id
""")
def _(t: Tables):
    return T.stable_asset_id(t("dataset_cells"), t("assets").select("asset_id", "title"))


@query("asset_content_hash", "WITH " + _JSON_TEXT + r"""
, members AS (SELECT y.asset_id, y.row_ix, '{' || string_agg('"' || k.key || '":' || y.j, ',' ORDER BY k.key) || '}' AS rj
    FROM typed y JOIN {x_keys} k ON k.asset_id = y.asset_id AND k.col_ix = y.col_ix WHERE y.row_ix > 0 GROUP BY ALL),""" + _tree("members") + r""",
 heads AS (SELECT asset_id, string_agg('{"key":"' || key || '","label":"' || label || '","type":"' || type || '","unit":' || coalesce('"' || unit || '"', 'null') || '}', ',' ORDER BY col_ix) AS cols FROM {x_columns} GROUP BY ALL)
SELECT a.asset_id, sha256('{"columns":[' || cols || '],"id":"' || a.asset_id || '","kind":"dataset","provenance":"' || provenance || '","rows":[' || coalesce(body, '') ||
  '],"source_refs":["' || request_id || '"],"title":"' || title || '","visual_hint":{"kind":' || coalesce('"' || hint_kind || '"', 'null') || ',"mode":"' || hint_mode ||
  '","subtype":' || coalesce('"' || hint_subtype || '"', 'null') || '}}') AS content_hash
FROM {assets} a JOIN heads h ON h.asset_id = a.asset_id LEFT JOIN body b ON b.asset_id = a.asset_id
""")
def _(t: Tables):
    return T.asset_content_hash(t("dataset_cells"), t("assets").withColumn("source_refs", F.array("request_id")))


define("asset_copies", """
SELECT o_orderpriority AS request_id, 'a-' || CAST(o_custkey AS STRING) AS asset_id, o_orderkey AS asset_ix,
       'h' || CAST(CASE WHEN o_custkey % 4 = 0 THEN o_orderkey % 2 ELSE 0 END AS STRING) AS content_hash
FROM {orders}
""")


@query("resolve_asset_conflicts", r"""
SELECT request_id, asset_id, min(asset_ix) AS asset_ix, count(DISTINCT content_hash) > 1 AS conflict FROM {asset_copies} GROUP BY ALL
""")
def _(t: Tables):
    kept, clashes = T.resolve_asset_conflicts(t("asset_copies"))
    asset_id = F.regexp_extract("message", r"(a-\d+)$", 1)
    first = t("asset_copies").groupBy("request_id", "asset_id").agg(F.min("asset_ix").alias("asset_ix"))
    clashed = clashes.select("request_id", asset_id.alias("asset_id")).join(first, ["request_id", "asset_id"])
    return kept.select("request_id", "asset_id", "asset_ix", F.lit(False).alias("conflict")).unionByName(
        clashed.select("request_id", "asset_id", "asset_ix", F.lit(True).alias("conflict"))
    )


@query("validate_assets", r"""
WITH hints AS (SELECT request_id, asset_id, unnest([
    CASE WHEN hint_mode = 'force' AND hint_kind IS NULL THEN 'forced_hint_without_kind' END,
    CASE WHEN hint_mode = 'force' AND hint_kind IN ('chart', 'diagram') AND coalesce(hint_subtype, '') = '' THEN 'forced_hint_without_subtype' END,
    CASE WHEN hint_mode = 'none' AND (hint_kind IS NOT NULL OR hint_subtype IS NOT NULL) THEN 'disabled_hint_selects' END,
    CASE WHEN hint_mode = 'force' AND hint_kind NOT IN ('table', 'chart') THEN 'forced_kind_not_allowed' END]) AS code FROM {assets}),
 vals AS (SELECT DISTINCT a.request_id, a.asset_id, c.key, CASE WHEN c.type = 'number' AND y.vt <> 'number' THEN 'value_not_number'
    WHEN c.type = 'boolean' AND y.vt <> 'bool' THEN 'value_not_boolean' WHEN c.type = 'text' AND y.vt <> 'text' THEN 'value_not_text'
    WHEN c.type = 'date' AND (y.vt <> 'text' OR try_cast(y.t AS TIMESTAMP) IS NULL) THEN 'value_not_iso_date' END AS code
  FROM {x_typed} y JOIN {x_columns} c ON c.asset_id = y.asset_id AND c.col_ix = y.col_ix JOIN {assets} a ON a.asset_id = y.asset_id
  WHERE y.row_ix > 0 AND y.vt <> 'null')
SELECT request_id, code, 'structured_assets[' || asset_id || ']' AS path, count(*) AS n FROM (
  SELECT request_id, asset_id, code FROM hints WHERE code IS NOT NULL UNION ALL SELECT request_id, asset_id, code FROM vals WHERE code IS NOT NULL) found
GROUP BY ALL
""")
def _(t: Tables):
    columns = T.infer_column_types(t("dataset_cells"))
    found = T.validate_assets(t("assets"), t("dataset_cells"), columns)
    return found.groupBy("request_id", "code", "path").agg(F.count(F.lit(1)).alias("n"))


@query("validate_diagrams", r"""
WITH known AS (SELECT DISTINCT asset_id, id FROM {diagram_nodes}),
 found AS (
  SELECT asset_id, 'unknown_edge_node' AS code FROM (SELECT asset_id, unnest([source, target]) AS id FROM {diagram_edges}) e WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.asset_id = e.asset_id AND k.id = e.id)
  UNION SELECT asset_id, 'unknown_parent' FROM {diagram_nodes} n WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known k WHERE k.asset_id = n.asset_id AND k.id = n.parent_id)
  UNION SELECT asset_id, 'invalid_order' FROM {diagram_order} GROUP BY asset_id HAVING count(*) <> count(DISTINCT id)
  UNION SELECT asset_id, 'duplicate_node_id' FROM {diagram_nodes} GROUP BY asset_id HAVING count(*) <> count(DISTINCT id)
  UNION SELECT asset_id, 'forced_kind_not_allowed' FROM {diagram_assets} WHERE hint_mode = 'force' AND hint_kind <> 'diagram')
SELECT a.request_id, f.code, 'structured_assets[' || f.asset_id || ']' AS path FROM found f JOIN {diagram_assets} a ON a.asset_id = f.asset_id
""")
def _(t: Tables):
    t, tasks = t.dealing("lineitem", lineitem="l_orderkey", orders="o_orderkey")
    found = T.validate_diagrams(t("diagram_assets"), t("diagram_nodes"), t("diagram_edges"), t("diagram_order"), tasks)
    return found.select("request_id", "code", "path")


@query("validate_shares", r"""
SELECT a.request_id, a.asset_id, CASE WHEN n.col_ix IS NULL THEN 'share_without_number' ELSE 'shares_not_100' END AS code
FROM (SELECT * FROM {assets} WHERE hint_subtype IN ('pie', 'donut')) a
LEFT JOIN (SELECT asset_id, min(col_ix) AS col_ix FROM {x_columns} WHERE type = 'number' GROUP BY ALL) n ON n.asset_id = a.asset_id
LEFT JOIN (SELECT asset_id, col_ix, sum(num) AS total, min(num) AS least FROM {x_num} WHERE row_ix > 0 GROUP BY ALL) s ON s.asset_id = n.asset_id AND s.col_ix = n.col_ix
WHERE n.col_ix IS NULL OR least < 0 OR abs(coalesce(total, 0) - 100) > 0.01
""")
def _(t: Tables):
    found = T.validate_shares(t("assets"), t("dataset_cells"), T.infer_column_types(t("dataset_cells")))
    return found.select("request_id", F.regexp_extract("path", r"\[(.*)\]", 1).alias("asset_id"), "code")


# --- visuals --------------------------------------------------------------------------------------

@query("column_profile", """
SELECT asset_id, n_columns, n_number, n_text, n_date, n_percent, n_temporal, n_rows, round(mean_label, 6) AS mean_label,
       first_label_col, first_percent_col FROM {x_profile}
""")
def _(t: Tables):
    profile = V.column_profile(T.infer_column_types(t("dataset_cells")))
    return profile.withColumn("mean_label", F.round("mean_label", 6))


def _choices(t: Tables):
    columns = T.infer_column_types(t("dataset_cells"))
    return V.visual_choices(t("assets"), columns), columns


@query("choose_visual", "SELECT request_id, asset_id, hint_mode, visual_kind, visual_subtype FROM {x_choice}")
def _(t: Tables):
    choices, _ = _choices(t)
    return choices.select("request_id", "asset_id", "hint_mode", "visual_kind", "visual_subtype")


@query("default_columns", "SELECT asset_id, position, col_ix, key FROM {x_selected}")
def _(t: Tables):
    return V.default_columns(*_choices(t))


@query("paginate_rows", r"""
SELECT asset_id, visual_kind, visual_subtype, page, (page - 1) * page_size + 1 AS first_row, least(page * page_size, n_rows) AS last_row
FROM (SELECT *, unnest(range(1, pages + 1)) AS page FROM {x_pages}) p
""")
def _(t: Tables):
    choices, _ = _choices(t)
    return V.paginate_rows(choices).select("asset_id", "visual_kind", "visual_subtype", "page", "first_row", "last_row")


@query("paginate_columns", r"""
WITH h AS (SELECT asset_id, list(key ORDER BY position) AS keys FROM {x_selected} GROUP BY ALL),
 b AS (SELECT p.asset_id, p.visual_kind, p.pages, CASE
     WHEN visual_kind IS DISTINCT FROM 'table' OR len(keys) <= coalesce(nullif(max_columns, 0), len(keys)) THEN [keys]
     WHEN max_columns = 1 THEN list_transform(keys, lambda k: [k])
     ELSE list_transform(range(2, len(keys) + 1, max_columns - 1), lambda i: list_concat(keys[1:1], keys[i:i + max_columns - 2])) END AS blocks
   FROM {x_pages} p JOIN h ON h.asset_id = p.asset_id),
 e AS (SELECT *, len(blocks) * pages > 30 AS overflow FROM b),
 u AS (SELECT *, unnest(range(0, len(blocks))) AS block FROM e WHERE NOT overflow),
 w AS (SELECT *, unnest(range(1, pages + 1)) AS page FROM u)
SELECT asset_id, overflow, block, page, array_to_string(blocks[block + 1], '|') AS selected_columns, block * pages + page - 1 AS seq FROM w
UNION ALL SELECT asset_id, overflow, NULL, NULL, NULL, NULL FROM e WHERE overflow
""")
def _(t: Tables):
    choices, columns = _choices(t)
    pages = V.paginate_columns(choices, V.default_columns(choices, columns))
    return pages.select("asset_id", "overflow", "block", "page", F.array_join("selected_columns", "|").alias("selected_columns"), "seq")


@query("paginate_items", r"""
SELECT n.asset_id, n.id, n.node_ix, coalesce(o.order_ix, n.node_ix) AS item_pos,
  CAST(floor(coalesce(o.order_ix, n.node_ix) / coalesce(a.max_items, 12)) AS BIGINT) + 1 AS page
FROM {diagram_nodes} n JOIN {diagram_assets} a ON a.asset_id = n.asset_id
LEFT JOIN {diagram_order} o ON o.asset_id = n.asset_id AND o.id = n.id
""")
def _(t: Tables):
    placed = V.ordered_items(t("diagram_nodes"), "node_ix", t("diagram_order"))
    return V.paginate_items(placed, t("diagram_assets")).select("asset_id", "id", "node_ix", "item_pos", "page")


define("x_values", r"""
SELECT *, CASE WHEN vt = 'null' THEN 'null' WHEN vt = 'bool' THEN lower(t) WHEN vt = 'text' THEN '"' || t || '"'
  ELSE replace(regexp_replace(regexp_replace(replace(t, ',', '.'), '(\.[0-9]*?)0+$', '\1'), '\.$', '.0'), '+', '') END AS value
FROM {x_num} WHERE row_ix > 0
""")


@query("materialize_table", r"""
WITH w AS (SELECT p.*, n_columns AS width, coalesce(nullif(max_columns, 0), n_columns) AS lim FROM {x_pages} p),
 k AS (SELECT *, CASE WHEN width <= lim THEN 1 WHEN lim = 1 THEN width ELSE CAST(ceil((width - 1) / (lim - 1)) AS BIGINT) END AS nb FROM w WHERE visual_kind = 'table'),
 cells AS (SELECT k.asset_id, k.page_size, k.nb, k.lim, v.row_ix, v.col_ix, c.label, v.value, unnest(range(0, k.nb)) AS block
   FROM k JOIN {x_values} v ON v.asset_id = k.asset_id JOIN {x_columns} c ON c.asset_id = v.asset_id AND c.col_ix = v.col_ix)
SELECT asset_id, block, CAST(floor((row_ix - 1) / page_size) AS BIGINT) + 1 AS page, row_ix, col_ix, label, value FROM cells
WHERE nb = 1 OR (lim = 1 AND block = col_ix) OR (lim > 1 AND (col_ix = 0 OR block = CAST(floor((col_ix - 1) / (lim - 1)) AS BIGINT)))
""")
def _(t: Tables):
    choices, columns = _choices(t)
    tables = V.page_counts(choices.filter("visual_kind = 'table'")).select("asset_id", "page_size", "max_columns")
    return V.materialize_table(t("dataset_cells"), tables, columns)


MATERIALIZE_CHART_SQL = r"""
WITH nums AS (SELECT s.*, p.visual_subtype, row_number() OVER (PARTITION BY s.asset_id ORDER BY position) AS rn, p.page_size
    FROM {x_selected} s JOIN {x_pages} p ON p.asset_id = s.asset_id WHERE s.type = 'number' AND p.visual_kind = 'chart'),
 series AS (SELECT * FROM nums WHERE visual_subtype <> 'scatter' OR rn = 2),
 axis AS (SELECT asset_id, min(num_min) AS axis_min, max(num_max) AS axis_max, arg_min(unit, position) FILTER (TRUE) AS u0, count(*) AS n,
    first(unit ORDER BY position) AS unit FROM series GROUP BY asset_id),
 cat AS (SELECT p.asset_id, CASE WHEN p.visual_subtype = 'scatter' THEN (SELECT min(col_ix) FROM nums WHERE nums.asset_id = p.asset_id)
    ELSE (SELECT arg_min(s.col_ix, s.position) FROM {x_selected} s WHERE s.asset_id = p.asset_id AND s.type <> 'number') END AS cat_col
    FROM {x_pages} p WHERE p.visual_kind = 'chart')
SELECT s.asset_id, s.visual_subtype AS chart_type, CAST(floor((v.row_ix - 1) / s.page_size) AS BIGINT) + 1 AS page, v.row_ix,
  CASE WHEN cat.cat_col IS NULL THEN CAST(v.row_ix AS VARCHAR) ELSE nullif(c.t, '') END AS category,
  s.label AS series, v.num AS value, axis.unit, axis_min, axis_max, (axis.n > 1 OR s.visual_subtype IN ('pie', 'donut')) AS legend
FROM series s JOIN axis ON axis.asset_id = s.asset_id JOIN cat ON cat.asset_id = s.asset_id
JOIN {x_num} v ON v.asset_id = s.asset_id AND v.col_ix = s.col_ix AND v.row_ix > 0
LEFT JOIN {x_num} c ON c.asset_id = s.asset_id AND c.col_ix = cat.cat_col AND c.row_ix = v.row_ix
"""


@query("materialize_chart", MATERIALIZE_CHART_SQL)
def materialize_chart(t: Tables):
    choices, columns = _choices(t)
    roles = V.chart_roles(V.page_counts(choices), columns, V.default_columns(choices, columns))
    return V.materialize_chart(t("dataset_cells"), roles)


@query("materialize_items", r"""
WITH placed AS (SELECT n.asset_id, n.id, CAST(floor(coalesce(o.order_ix, n.node_ix) / coalesce(a.max_items, 12)) AS BIGINT) + 1 AS page
  FROM {diagram_nodes} n JOIN {diagram_assets} a ON a.asset_id = n.asset_id LEFT JOIN {diagram_order} o ON o.asset_id = n.asset_id AND o.id = n.id)
SELECT asset_id, page, 'node' AS part, id AS first_id, CAST(NULL AS VARCHAR) AS second_id FROM placed
UNION ALL SELECT DISTINCT e.asset_id, s.page, 'edge', e.source, e.target FROM {diagram_edges} e
  JOIN placed s ON s.asset_id = e.asset_id AND s.id = e.source JOIN placed d ON d.asset_id = e.asset_id AND d.id = e.target AND d.page = s.page
""")
def _(t: Tables):
    placed = V.paginate_items(V.ordered_items(t("diagram_nodes"), "node_ix", t("diagram_order")), t("diagram_assets"))
    nodes, edges = V.materialize_diagram(placed, t("diagram_edges"))
    none = F.lit(None).cast("string")
    return nodes.select("asset_id", "page", F.lit("node").alias("part"), F.col("id").alias("first_id"), none.alias("second_id")).unionByName(
        edges.select("asset_id", "page", F.lit("edge").alias("part"), F.col("source").alias("first_id"), F.col("target").alias("second_id")).distinct()
    )


@query("diagram_topology", r"""
WITH RECURSIVE walk AS (
  SELECT asset_id, id, 0 AS level FROM {diagram_nodes} WHERE parent_id IS NULL
  UNION ALL SELECT n.asset_id, n.id, w.level + 1 FROM walk w JOIN {diagram_nodes} n ON n.asset_id = w.asset_id AND n.parent_id = w.id),
 top AS (SELECT asset_id, max(level) AS top FROM walk GROUP BY ALL),
 placed AS (SELECT n.asset_id, n.id, coalesce(o.order_ix, n.node_ix) AS pos FROM {diagram_nodes} n LEFT JOIN {diagram_order} o ON o.asset_id = n.asset_id AND o.id = n.id)
SELECT n.asset_id, 'level' AS part, n.id, CAST(coalesce(w.level, coalesce(top.top, -1) + 1) AS VARCHAR) AS value
FROM {diagram_nodes} n LEFT JOIN walk w ON w.asset_id = n.asset_id AND w.id = n.id LEFT JOIN top ON top.asset_id = n.asset_id
UNION ALL SELECT asset_id, 'link', source, target FROM {diagram_edges}
UNION ALL SELECT a.asset_id, 'link', a.id, b.id FROM placed a JOIN placed b ON a.asset_id = b.asset_id AND b.pos = a.pos + 1
  WHERE a.asset_id NOT IN (SELECT asset_id FROM {diagram_edges})
""")
def _(t: Tables):
    levels = V.diagram_levels(t("diagram_nodes"))
    placed = V.ordered_items(t("diagram_nodes"), "node_ix", t("diagram_order"))
    links = V.diagram_links(placed, t("diagram_edges"))
    return levels.select("asset_id", F.lit("level").alias("part"), "id", F.col("level").cast("string").alias("value")).unionByName(
        links.select("asset_id", F.lit("link").alias("part"), F.col("source").alias("id"), F.col("target").alias("value"))
    )
