"""Inputs derived from the given tables, in SQL that Spark and the checking engine both read.

Every derived table uses all rows of the tables it comes from; remainders of keys only vary the
content of rows, they never drop any.
"""

from plinth.plans.registry import define

# One dataset per customer: its orders in key order, with a column layout that depends on the key.
define("ds_rows", """
SELECT 'ds-' || CAST(o_custkey AS STRING) AS asset_id,
       CAST(o_custkey % 6 AS INT) AS layout,
       o_orderkey,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS row_ix,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS c_date,
       CASE WHEN o_orderkey % 5 = 0
            THEN replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.', ',')
            ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS c_price,
       CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE ' ' || o_orderstatus || ' ' END AS c_status,
       o_orderpriority AS c_priority,
       CASE WHEN o_orderkey % 3 = 0 THEN 'TRUE' ELSE 'false' END AS c_flag,
       CAST(o_orderkey % 41 AS STRING) AS c_share,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS STRING) ELSE '00' || CAST(o_orderkey AS STRING) END AS c_mixed
FROM {orders}
""")

define("ds_heads", """
SELECT DISTINCT 'ds-' || CAST(o_custkey AS STRING) AS asset_id, CAST(o_custkey % 6 AS INT) AS layout FROM {orders}
""")

define("dataset_cells", """
SELECT asset_id, row_ix, CAST(item_ix AS INT) AS col_ix, item AS raw FROM (
  SELECT asset_id, 0 AS row_ix, layout, @LIST(
    CASE layout WHEN 0 THEN ' Month ' WHEN 1 THEN 'Priority' WHEN 2 THEN 'Price' WHEN 3 THEN 'Priority' WHEN 4 THEN 'Date' ELSE 'Status' END;
    CASE layout WHEN 0 THEN 'Total price' WHEN 1 THEN 'Share %' WHEN 2 THEN 'Qty' WHEN 3 THEN 'Price' WHEN 4 THEN 'Status' ELSE 'Flag' END;
    CASE layout WHEN 4 THEN '' ELSE 'Mixed' END;
    'Status'; 'Status 2'; 'Status_2')@
  FROM {ds_heads}
  UNION ALL
  SELECT asset_id, row_ix, layout, @LIST(
    CASE layout WHEN 0 THEN c_date WHEN 1 THEN c_priority WHEN 2 THEN c_price WHEN 3 THEN c_priority WHEN 4 THEN c_date ELSE c_status END;
    CASE layout WHEN 0 THEN c_price WHEN 1 THEN c_share WHEN 2 THEN c_share WHEN 3 THEN c_price WHEN 4 THEN c_status ELSE c_flag END;
    CASE layout WHEN 4 THEN c_priority ELSE c_mixed END;
    c_flag; c_price; c_share)@
  FROM {ds_rows}
) lists
WHERE item_ix < CASE layout WHEN 4 THEN 6 WHEN 5 THEN 3 ELSE 2 END
""")

# The same cells with blank rows and missing trailing cells, as a reader may deliver them.
define("dataset_raw", """
SELECT c.asset_id, c.row_ix, c.col_ix,
       CASE WHEN r.o_orderkey % 13 = 0 THEN '' WHEN r.o_orderkey % 17 = 0 AND c.col_ix > 0 THEN NULL ELSE c.raw END AS raw
FROM {dataset_cells} c LEFT JOIN {ds_rows} r ON c.asset_id = r.asset_id AND c.row_ix = r.row_ix
WHERE c.col_ix = 0 OR r.o_orderkey IS NULL OR r.o_orderkey % 19 <> 0
""")

define("assets", """
SELECT 'r' || CAST(c_nationkey AS STRING) AS request_id,
       'ds-' || CAST(c_custkey AS STRING) AS asset_id,
       c_custkey AS asset_ix,
       'dataset' AS kind,
       c_mktsegment || ' orders / ' || c_name AS title,
       CASE c_custkey % 10 WHEN 7 THEN 'none' WHEN 8 THEN 'force' WHEN 9 THEN 'force' ELSE 'auto' END AS hint_mode,
       CASE c_custkey % 10 WHEN 8 THEN 'chart' WHEN 9 THEN CASE WHEN c_custkey % 4 = 1 THEN 'diagram' ELSE 'table' END
            WHEN 7 THEN CASE WHEN c_custkey % 3 = 0 THEN 'table' END END AS hint_kind,
       CASE c_custkey % 10 WHEN 8 THEN CASE c_custkey % 4 WHEN 0 THEN 'pie' WHEN 2 THEN 'sankey' ELSE 'area' END END AS hint_subtype,
       'extracted' AS provenance,
       CAST(CASE WHEN c_custkey % 3 = 0 THEN 4 + c_custkey % 5 END AS INT) AS max_items,
       CAST(CASE WHEN c_custkey % 2 = 0 THEN 3 + c_custkey % 7 END AS INT) AS max_rows,
       CAST(CASE WHEN c_custkey % 5 < 3 THEN 1 + c_custkey % 4 END AS INT) AS max_columns,
       CAST(NULL AS STRING) AS diagram_type
FROM {customer}
WHERE c_custkey IN (SELECT o_custkey FROM {orders})
""")

# Diagrams: one per order, its lines as nodes. Parents form trees; some point at themselves in a ring.
define("diagram_rows", """
SELECT 'dg-' || CAST(l_orderkey AS STRING) AS asset_id, l_orderkey,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS node_ix,
       count(*) OVER (PARTITION BY l_orderkey) AS n_nodes,
       l_partkey, l_suppkey, l_shipdate
FROM {lineitem}
""")
define("diagram_nodes", """
SELECT asset_id, node_ix, 'n' || CAST(node_ix AS STRING) AS id, 'Part ' || CAST(l_partkey AS STRING) AS label,
       CASE WHEN l_orderkey % 7 = 3 THEN 'n' || CAST((node_ix + 1) % n_nodes AS STRING)
            WHEN l_orderkey % 7 = 4 AND node_ix = 1 THEN 'ghost'
            WHEN node_ix = 0 THEN NULL
            WHEN l_orderkey % 2 = 0 THEN 'n' || CAST(node_ix - 1 AS STRING)
            ELSE 'n' || CAST((node_ix - node_ix % 2) / 2 AS INT) END AS parent_id
FROM {diagram_rows}
""".replace("'n' || CAST((node_ix - node_ix % 2) / 2 AS INT)", "'n' || CAST(CAST((node_ix - node_ix % 2) / 2 AS INT) AS STRING)"))
define("diagram_order", """
SELECT asset_id, CAST(n_nodes - 1 - node_ix AS INT) AS order_ix,
       'n' || CAST(CASE WHEN l_orderkey % 9 = 2 AND node_ix = 1 THEN 0 ELSE node_ix END AS STRING) AS id
FROM {diagram_rows} WHERE l_orderkey % 3 = 0
""")
define("diagram_edges", """
SELECT asset_id, 'n' || CAST(node_ix AS STRING) AS source,
       'n' || CAST(CASE WHEN l_orderkey % 11 = 5 AND node_ix = 2 THEN 99 ELSE (node_ix + 2) % n_nodes END AS STRING) AS target
FROM {diagram_rows} WHERE l_orderkey % 4 = 0
""")
define("diagram_assets", """
SELECT 'r' || CAST(o_custkey AS STRING) AS request_id, 'dg-' || CAST(o_orderkey AS STRING) AS asset_id, 'diagram' AS kind,
       CASE WHEN o_orderkey % 5 = 0 THEN 'force' ELSE 'auto' END AS hint_mode,
       CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'diagram' ELSE 'table' END END AS hint_kind,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 END AS INT) AS max_items
FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem})
""")

# Requests: one per document. Sentences become paragraphs and clauses become list items.
define("requests", """
SELECT 'q' || CAST(doc_id AS STRING) AS request_id, doc_id,
       'Report on ' || source || '. Use dataset: "ds-' || CAST(doc_id % 400 AS STRING) || '" as a ' ||
       CASE doc_id % 5 WHEN 0 THEN 'donut' WHEN 1 THEN 'table' WHEN 2 THEN 'trend' WHEN 3 THEN 'кольцевая диаграмма' ELSE 'bar chart' END ||
       chr(10) || 'таблицы sales_' || source || ' and photo_' || CAST(doc_id AS STRING) || '.png, (logo-' || lang || '.JPG) dataset id = ds-' ||
       CAST(doc_id + 1 AS STRING) AS brief,
       '# ' || source || chr(10) || chr(10) || '   ## ' || lang || '  ' || chr(10) || chr(10) ||
       replace(replace(replace(text, '. ', '.' || chr(10) || chr(10)), ', ', chr(10) || '- '), '! ', chr(10) || '2) ') ||
       chr(10) || 'Total 12 345 chars; ' || CAST(n_chars AS STRING) || ' (+' || CAST(doc_id % 100 AS STRING) || ',50 %)' || chr(10) ||
       'Anna ' || CAST(doc_id % 7 AS STRING) || ' has experience: ' || source || '. responsible for ' || lang AS content_package,
       CAST(1 + doc_id % 3 AS INT) AS slide_min, CAST(3 + doc_id % 9 AS INT) AS slide_max
FROM {documents}
""")
define("request_assets", """
SELECT request_id, doc_id AS asset_ix, 'ds-' || CAST(doc_id % 300 AS STRING) AS asset_id, '{"id":' || CAST(doc_id AS STRING) || '}' AS json,
       brief AS title
FROM {requests}
""".replace("'{\"id\":' || CAST(doc_id AS STRING) || '}'", "'[' || CAST(doc_id AS STRING) || ']'"))
define("request_images", """
SELECT request_id, CAST(0 AS INT) AS image_ix, 'image:' || CAST(doc_id AS STRING) AS id,
       'Photo_' || CAST(doc_id - doc_id % 2 AS STRING) || '.PNG' AS original_name, 'store/' || request_id || '/a' || CAST(doc_id AS STRING) || '.png' AS asset_ref
FROM {requests}
UNION ALL
SELECT request_id, 1, 'image:x' || CAST(doc_id AS STRING), 'up/logo-en.jpg', 'store/b' || CAST(doc_id AS STRING) || '.jpg' FROM {requests}
""")

# Slides: one per part, its lines as shapes; twenty slides make a deck. Five arrangements.
_SLIDE_CLASSES = ["cover", "agenda", "section", "content_text", "content_visual", "comparison", "process", "timeline",
                  "metrics", "table", "chart", "quote", "profile", "closing", "other"]
_CLASS_CASE = "CASE CAST(p_partkey * 7 + floor(p_partkey / 15.0) AS BIGINT) % 15 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_SLIDE_CLASSES)) + " END"
define("slides", f"""
SELECT 'k' || CAST(CAST((p_partkey - p_partkey % 20) / 20 AS INT) AS STRING) AS deck_id, CAST(p_partkey % 20 + 1 AS INT) AS slide_number, p_partkey,
       CASE WHEN p_partkey % 13 = 5 THEN NULL ELSE {_CLASS_CASE} END AS classification,
       CASE WHEN p_partkey % 11 <> 3 THEN p_name || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'line chart' WHEN 1 THEN 'Donut' WHEN 2 THEN 'barometer' ELSE 'plain' END END AS description,
       p_brand AS font, p_type AS colour
FROM {{part}}
""")
define("shape_rows", """
SELECT l_partkey, CAST(l_partkey % 5 AS INT) AS layout,
       CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS INT) AS ix,
       l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus
FROM {lineitem}
""")
define("shape_grid", """
SELECT *, CAST(floor((ix - CASE WHEN layout = 0 THEN 1 ELSE 0 END) / 3.0) AS INT) AS by_three, CAST(floor(ix / 2.0) AS INT) AS by_two,
       CASE WHEN layout = 3 AND l_linenumber % 4 = 0 THEN 'image' WHEN layout = 3 AND l_linenumber = 5 THEN 'chart' WHEN layout = 3 AND l_linenumber = 6 THEN 'table'
            WHEN layout = 4 AND ix % 9 IN (0, 5) THEN 'image' WHEN layout = 0 AND ix = 0 THEN 'image' WHEN layout IN (1, 2) AND ix % 23 = 22 THEN 'image' ELSE 'text' END AS type
FROM {shape_rows}
""")
define("shapes", """
SELECT 'k' || CAST(CAST((l_partkey - l_partkey % 20) / 20 AS INT) AS STRING) AS deck_id, CAST(l_partkey % 20 + 1 AS INT) AS slide_number,
       l_partkey, layout, ix, ix + 1 AS shape_id, type, l_returnflag, l_linestatus, l_orderkey,
       CAST(CASE layout WHEN 0 THEN CASE WHEN ix = 0 THEN 50 ELSE 50 + 250 * ((ix + 2) % 3) END WHEN 1 THEN 20 + 60 * (by_two % 15) WHEN 2 THEN 100 + 300 * (ix % 3) WHEN 3 THEN (l_orderkey * 37) % 880
                 ELSE CASE WHEN ix = 0 THEN 50 ELSE (l_orderkey * 41) % 900 END END AS DOUBLE) / 1000 AS x,
       CAST(CASE layout WHEN 0 THEN CASE WHEN ix = 0 THEN 115 ELSE 100 + 50 * (by_three % 16) END WHEN 1 THEN 300 + 200 * (ix % 2) WHEN 2 THEN 50 + 50 * (by_three % 18) + 17 * (ix % 3)
                 WHEN 3 THEN (l_suppkey * 53 + l_orderkey) % 940 ELSE CASE WHEN ix = 0 THEN 300 WHEN ix = 1 THEN 60 ELSE (l_suppkey * 67 + l_orderkey) % 950 END END AS DOUBLE) / 1000 AS y,
       CAST(CASE layout WHEN 0 THEN CASE WHEN type = 'image' THEN 700 ELSE 200 END WHEN 1 THEN 50 WHEN 2 THEN 200
                 WHEN 3 THEN CASE WHEN type = 'image' THEN 300 ELSE 80 END ELSE CASE WHEN ix = 0 THEN 900 ELSE 60 END END AS DOUBLE) / 1000 AS width,
       CAST(CASE layout WHEN 0 THEN CASE WHEN type = 'image' THEN 5 ELSE 30 END WHEN 1 THEN 40 WHEN 2 THEN 30
                 WHEN 3 THEN CASE WHEN type = 'image' THEN 250 ELSE 40 END ELSE CASE WHEN ix = 0 THEN 600 WHEN ix % 9 = 5 THEN 10 ELSE 40 END END AS DOUBLE) / 1000 AS height,
       CASE WHEN layout = 4 AND ix = 1 THEN 'title' WHEN layout = 3 AND ix = 1 THEN 'center_title' WHEN ix % 10 = 7 THEN 'body' END AS placeholder_type,
       CASE WHEN ix % 12 = 11 THEN 'Company Logo' WHEN layout = 3 AND ix % 6 = 4 THEN 'deck:visual:chart, table' WHEN ix % 17 = 3 THEN 'deck:visual' ELSE 'Box ' || CAST(ix AS STRING) END AS name,
       CASE WHEN ix % 19 = 6 THEN 'brand mark' END AS alt_text,
       CASE WHEN type <> 'text' THEN NULL WHEN ix % 8 = 5 THEN ' Insert  Text: ' WHEN layout = 2 THEN CASE ix % 3 WHEN 0 THEN 'Name' WHEN 1 THEN 'Role' ELSE 'Bio' END
            ELSE 'Text ' || l_returnflag || CAST(ix AS STRING) END AS text,
       (layout = 3 AND ix % 7 = 2) AS in_group
FROM {shape_grid}
""")

# Jobs: one per order; their events: one per line, with ids that grow within a job.
define("jobs", """
SELECT 'j' || CAST(o_orderkey AS STRING) AS id, 'u' || CAST(o_custkey % 23 AS STRING) AS owner_id, 't' || CAST(o_custkey AS STRING) AS template_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'template_analysis' ELSE 'generation' END AS type,
       CASE o_orderkey % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'processing' WHEN 3 THEN 'failed' WHEN 4 THEN 'canceled' ELSE 'ready' END AS status,
       CASE o_orderkey % 5 WHEN 0 THEN 'validating' WHEN 1 THEN 'enriching_visuals' WHEN 2 THEN 'building_catalog' ELSE 'generating_slides' END AS stage,
       CAST(o_orderkey % 100 AS INT) AS progress, o_orderdate AS created_at, CAST(o_orderkey % 4 - 2 AS INT) AS system_resume_count,
       CASE o_orderkey % 6 WHEN 0 THEN '["slow model"]' WHEN 1 THEN '[`code`:`system_resume`,`path`:``]' WHEN 2 THEN '["a", [`code`:`number_not_grounded`,`path`:`x`]]' ELSE '[]' END AS raw_warnings,
       CASE WHEN o_orderkey % 8 < 5 THEN 'm/base-' || CAST(o_orderkey % 4 AS STRING) END AS pinned_model,
       CASE o_orderkey % 9 WHEN 0 THEN 'needs_review' WHEN 1 THEN NULL ELSE 'passed' END AS plan_status,
       CASE o_orderkey % 10 WHEN 0 THEN 'fallback' WHEN 1 THEN 'primary' WHEN 2 THEN 'other' END AS plan_kind,
       CASE WHEN o_orderkey % 12 = 2 THEN 'Used FALLBACK layout' WHEN o_orderkey % 12 = 5 THEN 'Упрощённый вид' ELSE 'fine' END AS plan_warning,
       CASE WHEN o_orderkey % 2 = 0 THEN 'qa/' || CAST(o_orderkey AS STRING) END AS qa_path, CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 11 END AS INT) AS n_previews
FROM {orders}
""")
define("job_events", """
SELECT job_id, id, stage, CAST(id % 90 AS INT) AS progress, CAST(CASE WHEN l_linenumber > 2 THEN l_linenumber END AS INT) AS done,
       CAST(CASE WHEN l_linenumber > 2 THEN l_linenumber + l_suppkey % 5 END AS INT) AS total, created_at
FROM (
  SELECT 'j' || CAST(l_orderkey AS STRING) AS job_id, l_linenumber, l_suppkey, l_shipdate AS created_at,
         l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id,
         CASE (l_partkey + l_linenumber) % 12 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'canceled' WHEN 3 THEN 'resuming' WHEN 4 THEN 'enriching_visuals'
              WHEN 5 THEN 'enriching_visuals' WHEN 6 THEN 'content_analysis' ELSE 'generating_slides' END AS stage
  FROM {lineitem}) e
""")
define("templates", """
SELECT 't' || CAST(c_custkey AS STRING) AS id, 'u' || CAST(c_custkey % 23 AS STRING) AS owner_id, 's' || CAST(c_custkey AS STRING) AS sha256, c_name AS name,
       CASE c_custkey % 6 WHEN 0 THEN 'deleted' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'ready' END AS status,
       CASE WHEN c_custkey % 4 <> 3 THEN 'm/base-' || CAST(c_custkey % 4 AS STRING) END AS model_path
FROM {customer}
""")
define("uploads", """
SELECT o_orderkey AS upload_ix, 'u' || CAST(o_custkey % 23 AS STRING) AS owner_id,
       's' || CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 2 ELSE o_custkey END AS STRING) AS sha256, 'up' || CAST(o_orderkey AS STRING) AS name
FROM {orders}
""")
define("job_pages", """
SELECT 'u' || CAST(c_custkey % 23 AS STRING) AS owner_id, max(CASE WHEN c_custkey % 2 = 0 THEN 'j' || CAST(c_custkey * 3 + 1 AS STRING) END) AS cursor,
       CAST(max(c_custkey % 70) AS INT) AS "limit" FROM {customer} GROUP BY 'u' || CAST(c_custkey % 23 AS STRING)
""".replace('"limit"', "page_limit"))
define("call_log", """
SELECT ts, 'INFO llm_call job=' || CASE WHEN user_id % 5 = 0 THEN '-' ELSE 'j' || CAST(user_id AS STRING) END || ' stage=' || event_type || ' attempt=' || CAST(1 + event_id % 2 AS STRING) ||
       ' latency=' || CAST(CAST(value AS DECIMAL(18,3)) AS STRING) || ' response_id=- output_tokens=' || CASE WHEN event_id % 4 = 0 THEN 'None' ELSE CAST(event_id % 900 AS STRING) END ||
       ' usage=null outcome=' || CASE WHEN event_type = 'error' THEN 'error error_category=server' ELSE 'success error_category=none' END AS value
FROM {events}
""")
define("soak_runs", """
SELECT event_type AS batch, event_id AS run, value AS seconds, CAST(event_id % 33 AS INT) AS llm_calls, user_id % 40 = 0 AS fallback,
       CAST(CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS INT) AS n_errors, event_id % 77 <> 0 AS slides_match FROM {events}
""")

# Catalog inputs: slots over shapes and over one structure per slide of the first two arrangements.
_SPECS = """
SELECT deck_id, slide_number, ix AS slot_ix,
       CASE WHEN ix = 4 THEN 'visual' WHEN ix = 8 THEN 'fallback_title' WHEN ix = 9 THEN 'fallback_text' WHEN ix = 12 THEN 'visual_3' ELSE 's' || CAST(ix AS STRING) END AS slot_id,
       CASE type WHEN 'image' THEN CASE WHEN ix % 7 = 3 THEN 'text' ELSE 'image' END WHEN 'text' THEN CASE WHEN l_linestatus = 'O' THEN 'text' ELSE 'bullet_list' END ELSE 'visual' END AS kind,
       CASE WHEN type = 'image' THEN CASE WHEN ix % 2 = 0 THEN 'Main visual' ELSE 'photo' END WHEN ix = 1 THEN 'Slide title' ELSE 'body text' END AS role,
       'shape' AS target_type, CASE WHEN ix % 37 = 33 THEN 900 ELSE shape_id END AS shape_id, CAST(NULL AS STRING) AS structure_id, CAST(NULL AS STRING) AS structure_kind,
       ix % 3 = 0 AS required, CAST(CASE WHEN ix % 4 = 0 THEN 40 END AS INT) AS max_chars
FROM {shapes} @SOME
UNION ALL
SELECT deck_id, slide_number, 900, 'structured',
       CASE p_partkey % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'cards' WHEN 2 THEN 'profiles' WHEN 3 THEN 'text' WHEN 4 THEN 'bullet_list' WHEN 5 THEN 'metrics' ELSE 'image' END,
       'structured body', 'structure', NULL,
       CASE p_partkey % 5 WHEN 0 THEN 'grid_0' WHEN 1 THEN 'repeat_0' WHEN 3 THEN 'static_visual_0' ELSE 'ghost_0' END,
       CASE p_partkey % 5 WHEN 0 THEN 'grid' WHEN 1 THEN 'repeat' WHEN 3 THEN 'static_visual' END, TRUE, NULL
FROM {slides}
"""
define("cat_specs", _SPECS.replace("@SOME", ""))
# For the queries over shapes that no slot owns: some shapes have no slot.
define("free_specs", _SPECS.replace("@SOME", "WHERE layout >= 2 AND l_returnflag <> 'R'"))
define("free_owned", "SELECT deck_id, slide_number, slot_id, shape_id FROM {free_specs} WHERE target_type = 'shape'")
define("cat_roles", """
SELECT deck_id, slide_number, 'structured' AS slot_id,
       CASE WHEN p_partkey % 8 = 3 THEN CASE item_ix WHEN 0 THEN 'title' ELSE 'body' END ELSE 'field_' || CAST(item_ix AS STRING) END AS field_id,
       CASE WHEN p_partkey % 8 = 3 THEN 'field_' || CAST(item_ix AS STRING) WHEN p_partkey % 8 = 5 THEN 'title' WHEN p_partkey % 7 = 2 THEN CASE item_ix WHEN 0 THEN 'name' ELSE 'details' END ELSE item END AS role
FROM (SELECT deck_id, slide_number, p_partkey, @LIST('title'; 'body')@ FROM {slides} WHERE p_partkey % 5 < 2) r
""")
define("cat_fields", """
SELECT deck_id, slide_number, 'repeat_0' AS structure_id, CAST(item_ix AS INT) AS field_ix, item AS field_id
FROM (SELECT deck_id, slide_number, @LIST('field_0'; 'field_1')@ FROM {slides} WHERE p_partkey % 5 = 1) f
""")
define("cat_members", """
SELECT deck_id, slide_number, CASE layout WHEN 0 THEN 'grid_0' ELSE 'repeat_0' END AS structure_id, CASE layout WHEN 0 THEN 'grid' ELSE 'repeat' END AS kind, 1 AS header_rows, shape_id,
       CASE WHEN type = 'text' THEN 'content' ELSE 'decoration' END AS role,
       CASE WHEN layout = 0 AND type = 'text' THEN CAST(floor((ix - 1) / 3.0) AS INT) END AS row, CASE WHEN layout = 0 AND type = 'text' THEN CAST((ix + 2) % 3 AS INT) END AS col,
       CASE WHEN layout = 1 THEN 'field_' || CAST(ix % 2 AS STRING) END AS field_id, CASE WHEN layout = 1 THEN CAST(floor(ix / 2.0) AS INT) END AS item_ix
FROM {shapes} WHERE layout < 2
""")
define("cat_owned", "SELECT deck_id, slide_number, slot_id, shape_id FROM {cat_specs} WHERE target_type = 'shape'")
define("cat_structural", "SELECT DISTINCT deck_id, slide_number, shape_id FROM {cat_members}")
define("cat_families", """
SELECT deck_id, CAST(p_partkey % 6 AS INT) AS family_ix, CASE WHEN p_partkey % 6 = 5 THEN 'fam4' WHEN p_partkey % 6 = 3 THEN 'fam2_cover' ELSE 'fam' || CAST(p_partkey % 6 AS STRING) END AS family_id,
       slide_number, slide_number AS place, coalesce(classification, 'other') AS classification
FROM {slides}
""")
define("cat_groups", """
SELECT deck_id, family_ix, family_id, CASE WHEN place % 19 = 7 THEN 77 ELSE slide_number END AS slide_number FROM {cat_families}
UNION ALL SELECT deck_id, 0, 'fam0', slide_number FROM {cat_families} WHERE classification = 'quote'
""")
define("cat_canvases", """
SELECT deck_id, slide_number, family_ix, CAST(0 AS INT) AS slot_ix, CAST(30 AS DOUBLE) / 1000 AS x, CAST(220 + (p_partkey * 31) % 600 AS DOUBLE) / 1000 AS y,
       CAST(CASE WHEN p_partkey % 14 = 9 THEN 990 ELSE 940 END AS DOUBLE) / 1000 AS width, CAST(680 - (p_partkey * 31) % 600 AS DOUBLE) / 1000 AS height,
       CASE p_partkey % 7 WHEN 0 THEN 'bar' WHEN 1 THEN 'donut' WHEN 2 THEN 'column' WHEN 3 THEN 'scatter' WHEN 4 THEN 'pie' WHEN 5 THEN 'line' ELSE 'area' END AS preferred
FROM (SELECT s.*, f.family_ix FROM {slides} s JOIN {cat_families} f ON f.deck_id = s.deck_id AND f.slide_number = s.slide_number) j
WHERE classification IN ('chart', 'content_visual', 'metrics', 'comparison')
""")

# Plans: one per customer, its orders as slides, their lines as assignments.
define("pl_slides", """
SELECT 'r' || CAST(o_custkey AS STRING) AS request_id, 'k' || CAST(o_custkey % 10 AS STRING) AS deck_id, o_orderkey,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS number,
       CASE o_orderkey % 14 WHEN 0 THEN 'cover' WHEN 1 THEN 'text' WHEN 2 THEN 'bullets' WHEN 3 THEN 'cards' WHEN 4 THEN 'profiles' WHEN 5 THEN 'metrics' WHEN 6 THEN 'table' WHEN 7 THEN 'chart'
            WHEN 8 THEN 'diagram' WHEN 9 THEN 'pictogram_grid' WHEN 10 THEN 'process' WHEN 11 THEN 'timeline' WHEN 12 THEN 'image' ELSE 'closing' END AS content_type,
       'Slide ' || o_orderpriority || ' ' || o_orderstatus AS purpose,
       CASE o_orderkey % 7 WHEN 5 THEN 'fam2_cover' WHEN 6 THEN 'nofam' ELSE 'fam' || CAST(o_orderkey % 7 AS STRING) END AS template_family_id,
       CAST(o_orderkey % 22 + 1 AS INT) AS template_slide_number,
       CASE WHEN o_orderkey % 9 = 4 THEN 'ds-' || CAST(o_custkey AS STRING) WHEN o_orderkey % 37 = 5 THEN 'ds-none' END AS chart_asset_id
FROM {orders}
""")
define("pl_assets", """
SELECT request_id, CAST(item_ix AS INT) AS asset_ix, item AS asset_id FROM (
  SELECT 'r' || CAST(c_custkey AS STRING) AS request_id, @LIST('ds-' || CAST(c_custkey AS STRING); 'ds-' || CAST(c_custkey + 1 AS STRING))@ FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders})) a
WHERE item IN (SELECT asset_id FROM {assets})
""")
define("pl_assignments", """
SELECT s.request_id, s.deck_id, s.number, l_orderkey,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS assign_ix,
       CASE WHEN l_partkey % 11 = 0 THEN 'slide_title' WHEN l_partkey % 13 = 1 THEN 'visual' ELSE 's' || CAST(l_partkey % 14 AS STRING) END AS slot_id,
       CASE l_suppkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'bullet_list' WHEN 2 THEN 'visual' WHEN 3 THEN 'image' ELSE 'text' END AS kind,
       CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'clear' WHEN l_returnflag = 'R' THEN 'keep' WHEN l_linenumber = 6 THEN 'generate' ELSE 'replace' END AS action,
       CASE WHEN l_returnflag <> 'R' THEN CASE l_suppkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'bullet_list' WHEN 2 THEN 'visual' WHEN 3 THEN 'image' ELSE 'text' END END AS content_kind,
       CASE WHEN l_returnflag <> 'R' AND l_suppkey % 5 = 2 THEN CASE WHEN l_partkey % 3 = 0 THEN 'ds-missing' ELSE 'ds-' || substr(s.request_id, 2) END END AS asset_id,
       CASE WHEN l_returnflag <> 'R' AND l_suppkey % 5 = 2 THEN CASE WHEN l_partkey % 2 = 0 THEN 'chart' ELSE 'table' END END AS visual_kind,
       CASE WHEN l_returnflag <> 'R' AND l_suppkey % 5 = 2 AND l_partkey % 2 = 0 THEN 'bar' END AS visual_subtype,
       CASE WHEN l_returnflag <> 'R' AND l_suppkey % 5 IN (0, 4) THEN 'Words ' || CAST(l_partkey AS STRING) END AS text,
       CAST(CASE WHEN l_returnflag <> 'R' AND l_suppkey % 5 = 2 THEN 1 + l_linenumber % 2 END AS INT) AS page
FROM {lineitem} JOIN {pl_slides} s ON s.o_orderkey = l_orderkey
""")
define("pl_slots", """
SELECT deck_id, slide_number, slot_ix, slot_id, CASE WHEN slot_id = 'structured' THEN 'visual' ELSE kind END AS kind, role, required, FALSE AS has_canvas,
       CASE WHEN slot_id = 'structured' OR kind = 'visual' THEN CASE slide_number % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'chart|diagram' ELSE 'table|chart' END END AS caps,
       CASE WHEN (slot_id = 'structured' OR kind = 'visual') AND slide_number % 3 = 1 THEN 'bar|line' END AS subs,
       CAST(CASE WHEN slide_number % 4 = 1 THEN 5 END AS INT) AS max_items, CAST(CASE WHEN slide_number % 4 = 2 THEN 3 END AS INT) AS max_rows, CAST(CASE WHEN slide_number % 4 = 3 THEN 2 END AS INT) AS max_columns
FROM {cat_specs}
UNION ALL
SELECT deck_id, slide_number, 950, 'chart_visual', 'visual', 'native chart canvas', TRUE, TRUE, 'chart', NULL, 12, NULL, NULL FROM {cat_canvases}
""")
define("pl_families", "SELECT deck_id, family_id, slide_number, classification AS slide_class FROM {cat_families}")
define("pl_limits", "SELECT request_id, CAST(max(number) + 6 AS INT) AS slide_max FROM {pl_slides} GROUP BY request_id")
define("pl_pages", """
SELECT a.request_id, a.asset_id, CAST(1 + length(a.asset_id) * (a.asset_ix + 3) % 4 AS INT) AS n_pages, l.slide_max FROM {pl_assets} a JOIN {pl_limits} l ON l.request_id = a.request_id
""")

# Gate inputs: the plans again with zero-based places, references and authored strings.
define("gt_slides", """
SELECT s.request_id, s.deck_id, CAST(s.number - 1 AS INT) AS slide_ix, CAST(CASE WHEN o_orderkey % 61 = 3 THEN s.number + 1 ELSE s.number END AS INT) AS number, s.purpose, s.o_orderkey,
       s.template_family_id, s.template_slide_number, CASE WHEN o_orderkey % 5 = 0 THEN 'cover' ELSE coalesce(f.slide_class, 'other') END AS template_class, s.chart_asset_id
FROM {pl_slides} s LEFT JOIN {pl_families} f ON f.deck_id = s.deck_id AND f.family_id = s.template_family_id AND f.slide_number = s.template_slide_number
""")
define("gt_uses", """
SELECT request_id, CAST(number - 1 AS INT) AS slide_ix, CAST(assign_ix - 1 AS INT) AS assign_ix, slot_id, kind, action, content_kind, asset_id, visual_kind, visual_subtype, page, text, l_orderkey,
       CAST(CASE WHEN slot_id LIKE 's_' OR slot_id LIKE 's__' THEN CAST(substr(slot_id, 2) AS INT) + 1 ELSE 5 END AS INT) AS target,
       CASE WHEN action IN ('clear', 'keep') THEN NULL WHEN assign_ix = 3 THEN 'ghost' ELSE 'content_00' || CAST(1 + number % 3 AS STRING) END AS ref_one,
       CASE WHEN content_kind = 'visual' AND number % 4 <> 0 THEN 'asset:' || asset_id WHEN content_kind = 'image' THEN 'image:1' END AS ref_two,
       CASE WHEN content_kind = 'image' AND assign_ix <> 4 THEN 'pic' || CAST(number % 3 AS STRING) || '.png' END AS asset_ref
FROM {pl_assignments}
""")
define("gt_values", """
SELECT request_id, slide_ix, assign_ix, CAST(CASE WHEN content_kind = 'bullet_list' THEN item_ix END AS INT) AS entry_ix, item AS value FROM (
  SELECT *, @LIST('Point ' || CAST(slide_ix AS STRING) || ' of 12 345'; 'Second 7,50% ' || slot_id; 'Third item that is rather long for a box')@ FROM {gt_uses} WHERE content_kind IN ('text', 'bullet_list', 'image')) v
WHERE content_kind = 'bullet_list' OR item_ix = 0
""")
define("gt_sources", """
SELECT request_id, item AS source_id, 'content' AS kind, CASE item_ix WHEN 0 THEN '12345 items, 7.5 and 3 pic0.png' WHEN 1 THEN '1 2 3 4 5 6 7 8 9' WHEN 2 THEN 'none 12 345' WHEN 3 THEN 'see pic1.png' ELSE 'data' END AS text
FROM (SELECT request_id, @LIST('content_001'; 'content_002'; 'content_003'; 'image:1'; 'asset:ds-' || substr(request_id, 2))@ FROM {pl_limits}) s
""")
define("gt_requests", "SELECT request_id, CAST(3 AS INT) AS slide_min, CAST(slide_max - 5 - length(request_id) % 3 AS INT) AS slide_max, 'Deck with Pic0.png inside' AS brief, 'Body pic2.png' AS content_package FROM {pl_limits}")
define("gt_facts", """
SELECT request_id, 'fact_' || CAST(item_ix AS STRING) AS fact_id, CAST(item_ix AS INT) AS fact_ix, item AS ref, item_ix <> 3 AS mandatory, CASE WHEN item_ix = 2 THEN 'constraint' ELSE 'content' END AS fact_type
FROM (SELECT request_id, @LIST('content_001'; 'content_003'; 'content_009'; 'content_008'; 'content_007')@ FROM {pl_limits}) f
""")
define("gt_images", """
SELECT request_id, CAST(item_ix AS INT) AS image_ix, 'image:' || CAST(item_ix AS STRING) AS id, item AS asset_ref, CASE item_ix WHEN 0 THEN 'PIC0.png' WHEN 1 THEN 'other.png' ELSE 'pic2.PNG' END AS original_name
FROM (SELECT request_id, @LIST('pic0.png'; 'pic1.png'; 'pic2.png')@ FROM {pl_limits}) i
""")
define("gt_decks", "SELECT request_id, 'deck.title' AS path, 'Deck of 12345 and 99' AS text, CASE WHEN length(request_id) % 2 = 0 THEN 'content_001' ELSE 'ghost' END AS ref FROM {pl_limits}")
define("gt_slots", """
SELECT p.deck_id, p.slide_number, p.slot_id, p.kind, p.required, p.has_canvas, p.caps, p.subs, p.max_items, p.max_rows, p.max_columns, c.max_chars, CAST(coalesce(c.shape_id, 5) AS INT) AS target,
       CAST(CASE WHEN p.kind = 'bullet_list' AND p.slot_ix % 2 = 0 THEN 2 END AS INT) AS capacity
FROM {pl_slots} p LEFT JOIN {cat_specs} c ON c.deck_id = p.deck_id AND c.slide_number = p.slide_number AND c.slot_id = p.slot_id
""")

# Table rows as text lines, one file per customer.
define("file_rows", """
SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS row_ix, CAST(CAST(o_orderdate AS DATE) AS STRING) AS a,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS b, 'note ' || o_orderpriority AS c FROM {orders}
""")
define("quota_files", """
SELECT 'q' || CAST(o_custkey AS STRING) AS request_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS file_ix,
       CAST(o_totalprice AS BIGINT) * CASE WHEN o_orderkey % 3 = 0 THEN 90 ELSE 40 END AS size FROM {orders}
""")
define("quota_requests", "SELECT 'q' || CAST(c_custkey AS STRING) AS request_id, CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE c_name END AS brief, CAST(c_custkey % 5 AS INT) AS slide_min, CAST(c_custkey % 33 AS INT) AS slide_max FROM {customer}")
define("quota_texts", "SELECT 'q' || CAST(doc_id AS STRING) AS request_id, n_chars AS chars FROM {documents}")
define("markdown_rows", """
SELECT n_nationkey, n_name, r_name, n_regionkey, count(c_custkey) AS n FROM {nation} JOIN {region} ON n_regionkey = r_regionkey JOIN {customer} ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name, r_name, n_regionkey
""")
define("parts_of_request", """
SELECT 'v' || CAST(conv_id AS STRING) AS request_id, turn AS file_ix, role || '/f' || CAST(turn AS STRING) || CASE WHEN turn % 3 = 1 THEN '.png' ELSE '.md' END AS name,
       CASE WHEN turn % 3 = 1 THEN 'image' ELSE 'text' END AS kind, CASE WHEN turn % 3 <> 1 THEN ' ' || text || ' ' END AS text,
       CASE WHEN turn % 3 = 1 THEN 'store' || CAST(turn AS STRING) || '.png' END AS asset_ref
FROM (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM {conversations} GROUP BY conv_id, turn) c
""")
define("request_forms", "SELECT DISTINCT 'v' || CAST(conv_id AS STRING) AS request_id, CASE WHEN conv_id % 2 = 0 THEN ' Form text ' ELSE '' END AS content_text FROM {conversations}")
