"""Queries over template catalogs, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import catalog as C
from plinth.plans.registry import Tables, define, query


def on(a: str, b: str, *more: str) -> str:
    return " AND ".join([f"{a}.{c} = {b}.{c}" for c in ("deck_id", "slide_number", *more)])


define("descriptors", "SELECT deck_id, slide_number, CASE p_partkey % 2 WHEN 0 THEN 'chart' ELSE 'table' END AS classification, 'described ' || CAST(p_partkey AS STRING) AS description FROM {slides}")


@query("resolve_slide_semantics", f"""
SELECT s.deck_id, s.slide_number, coalesce(s.classification, d.classification) AS classification, coalesce(s.description, d.description) AS description
FROM {{slides}} s LEFT JOIN {{descriptors}} d ON {on("s", "d")}
""")
def _(t: Tables):
    return C.resolve_slide_semantics(t("slides"), t("descriptors")).select(*C.SLIDE, "classification", "description")


define("slide_sizes", "SELECT deck_id, slide_number, CAST(count(*) AS INT) AS n_elements FROM {shapes} GROUP BY deck_id, slide_number")
define("x_packed", r"""
SELECT deck_id, slide_number, n_elements, rn, 0 AS batch, 1 AS cnt, n_elements AS els FROM {x_sized} WHERE rn = 1
UNION ALL
SELECT s.deck_id, s.slide_number, s.n_elements, s.rn, CASE WHEN p.cnt >= 6 OR p.els + s.n_elements > 120 THEN p.batch + 1 ELSE p.batch END,
  CASE WHEN p.cnt >= 6 OR p.els + s.n_elements > 120 THEN 1 ELSE p.cnt + 1 END, CASE WHEN p.cnt >= 6 OR p.els + s.n_elements > 120 THEN s.n_elements ELSE p.els + s.n_elements END
FROM x_packed p JOIN {x_sized} s ON s.deck_id = p.deck_id AND s.rn = p.rn + 1
""")
define("x_sized", "SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY slide_number) AS rn FROM {slide_sizes}")


@query("pack_batches", "SELECT deck_id, slide_number, n_elements, batch FROM {x_packed}")
def _(t: Tables):
    return C.pack_batches(t("slide_sizes"))


@query("normalize_repeat_slots", f"""
WITH pairs AS (SELECT s.deck_id, s.slide_number, s.slot_id, s.kind, s.structure_kind, list(r.field_id ORDER BY r.field_id) FILTER (r.field_id IS NOT NULL) AS ks, list(r.role ORDER BY r.field_id) FILTER (r.role IS NOT NULL) AS vs
   FROM {{cat_specs}} s LEFT JOIN {{cat_roles}} r ON {on("r", "s", "slot_id")} GROUP BY ALL),
 c AS (SELECT *, structure_kind = 'repeat' AND kind IN ('text', 'bullet_list') AS cards,
   structure_kind = 'repeat' AND list_sort(ks) <> ['field_0', 'field_1'] AND len(ks) = 2 AND list_sort(vs) = ['field_0', 'field_1'] AS flip FROM pairs)
SELECT deck_id, slide_number, slot_id, CASE WHEN cards THEN 'cards' ELSE kind END AS kind,
  CASE WHEN cards THEN 'field_0=title|field_1=body' WHEN flip THEN vs[2] || '=' || ks[2] || '|' || vs[1] || '=' || ks[1]
       WHEN ks IS NULL THEN '' ELSE ks[1] || '=' || vs[1] || '|' || ks[2] || '=' || vs[2] END AS roles
FROM c
""")
def _(t: Tables):
    specs, roles = C.normalize_repeat_slots(t.stored("cat_specs"), t.stored("cat_roles"), t.stored("cat_fields"))
    told = roles.groupBy(*C.SLOT).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "field_id", "role"))), "|").alias("roles"))
    return specs.select(*C.SLOT, "kind").join(told, C.SLOT, "left").withColumn("roles", F.coalesce("roles", F.lit("")))


define("cat_structures", "SELECT deck_id, slide_number, CASE p_partkey % 5 WHEN 0 THEN 'grid_0' WHEN 1 THEN 'repeat_0' ELSE 'static_visual_0' END AS structure_id, CASE p_partkey % 5 WHEN 0 THEN 'grid' WHEN 1 THEN 'repeat' ELSE 'static_visual' END AS kind FROM {slides}")
define("batch_slides", "SELECT deck_id, slide_number FROM {slides}")
define("described_slides", "SELECT deck_id, CASE WHEN classification = 'quote' THEN slide_number + 100 ELSE slide_number END AS slide_number FROM {slides} UNION ALL SELECT deck_id, slide_number FROM {slides} WHERE classification = 'cover'")


@query("validate_slot_targets", f"""
WITH p AS (SELECT s.deck_id, s.slide_number, s.slot_id, s.kind, s.target_type, s.structure_id, s.shape_id, k.kind AS sk, list(r.field_id) FILTER (r.field_id IS NOT NULL) AS ks, list(r.role) FILTER (r.role IS NOT NULL) AS vs
   FROM {{cat_specs}} s LEFT JOIN {{cat_roles}} r ON {on("r", "s", "slot_id")} LEFT JOIN {{cat_structures}} k ON {on("k", "s", "structure_id")} GROUP BY ALL),
 q AS (SELECT *, CASE kind WHEN 'cards' THEN ['title','body','value'] WHEN 'profiles' THEN ['name','role','details'] WHEN 'metrics' THEN ['label','value','unit'] END AS allowed FROM p),
 r AS (SELECT deck_id, slide_number, slot_id, unnest([
   CASE WHEN target_type = 'shape' AND ks IS NOT NULL THEN 'field_roles_on_shape' END,
   CASE WHEN target_type <> 'shape' AND sk IS NULL THEN 'unknown_structure' END,
   CASE WHEN target_type <> 'shape' AND sk = 'static_visual' THEN 'static_visual_slot' END,
   CASE WHEN target_type <> 'shape' AND sk = 'grid' AND kind <> 'table' THEN 'grid_requires_table' END,
   CASE WHEN target_type <> 'shape' AND sk = 'grid' AND ks IS NOT NULL THEN 'grid_with_field_roles' END,
   CASE WHEN target_type <> 'shape' AND sk = 'repeat' AND allowed IS NULL THEN 'repeat_kind_unsupported' END,
   CASE WHEN sk = 'repeat' AND allowed IS NOT NULL AND list_sort(ks) <> ['field_0','field_1'] THEN 'repeat_fields_mismatch' END,
   CASE WHEN sk = 'repeat' AND allowed IS NOT NULL AND NOT list_has_all(allowed, vs) THEN 'repeat_role_unknown' END,
   CASE WHEN sk = 'repeat' AND allowed IS NOT NULL AND vs[1] = vs[2] THEN 'repeat_role_repeated' END]) AS code FROM q)
SELECT * FROM r WHERE code IS NOT NULL
UNION ALL SELECT deck_id, slide_number, slot_id, 'unknown_shape' FROM q WHERE target_type = 'shape' AND NOT EXISTS (SELECT 1 FROM {{shapes}} x WHERE {on("x", "q", "shape_id")})
UNION ALL SELECT deck_id, slide_number, max(slot_id), 'target_owned_twice' FROM q GROUP BY deck_id, slide_number, target_type, shape_id, structure_id HAVING count(*) > 1
UNION ALL SELECT deck_id, slide_number, NULL, 'slide_not_described' FROM {{batch_slides}} b WHERE NOT EXISTS (SELECT 1 FROM {{described_slides}} d WHERE {on("d", "b")})
UNION ALL SELECT deck_id, slide_number, NULL, 'slide_not_expected' FROM {{described_slides}} d WHERE NOT EXISTS (SELECT 1 FROM {{batch_slides}} b WHERE {on("d", "b")})
UNION ALL SELECT deck_id, slide_number, NULL, 'slide_described_twice' FROM {{described_slides}} GROUP BY ALL HAVING count(*) > 1
""")
def _(t: Tables):
    return C.validate_slot_targets(
        t.stored("cat_specs").drop("structure_kind"), t.stored("cat_roles"), t.stored("cat_fields"), t.stored("shapes"), t.stored("cat_structures"), t("batch_slides"), t("described_slides")
    )


@query("expand_bindings", f"""
SELECT s.deck_id, s.slide_number, s.slot_id, s.shape_id,
  CASE WHEN s.kind = 'visual' THEN CASE WHEN x.type IN ('chart', 'table') THEN x.type ELSE 'visual' END WHEN s.kind = 'image' THEN CASE WHEN x.type = 'image' THEN 'image' ELSE 'image_box' END ELSE x.type END AS renderer,
  CASE WHEN s.kind IN ('visual', 'image') THEN NULL WHEN s.kind = 'bullet_list' THEN '/items' ELSE '/text' END AS value_path,
  CASE WHEN s.kind = 'bullet_list' THEN 'paragraphs' ELSE 'scalar' END AS mode
FROM {{cat_specs}} s JOIN {{shapes}} x ON {on("x", "s", "shape_id")} WHERE s.target_type = 'shape' AND (x.type <> 'image' OR s.kind = 'image')
UNION ALL SELECT s.deck_id, s.slide_number, s.slot_id, m.shape_id, 'text',
  CASE WHEN m.row < m.header_rows THEN '/columns/' || m.col ELSE '/rows/' || (m.row - m.header_rows) || '/' || m.col END, 'scalar'
FROM {{cat_specs}} s JOIN {{cat_members}} m ON {on("m", "s", "structure_id")} WHERE m.kind = 'grid' AND m.role = 'content'
UNION ALL SELECT s.deck_id, s.slide_number, s.slot_id, m.shape_id, 'text', '/items/' || m.item_ix || '/' || r.role, CASE WHEN r.role = 'details' THEN 'paragraphs' ELSE 'scalar' END
FROM {{cat_specs}} s JOIN {{cat_members}} m ON {on("m", "s", "structure_id")} JOIN {{cat_roles}} r ON {on("r", "s", "slot_id")} AND r.field_id = m.field_id WHERE m.kind = 'repeat' AND m.role = 'content'
""")
def _(t: Tables):
    bound = C.expand_bindings(t.stored("cat_specs"), t.stored("cat_roles"), t.stored("shapes"), t.stored("cat_members").drop("structure_kind"))
    return bound.select(*C.SLOT, "shape_id", "renderer", "value_path", "mode")


define("cap_shapes", """
SELECT *, CASE WHEN type = 'chart' THEN CASE l_returnflag WHEN 'A' THEN 'XlChartType.DOUGHNUT' WHEN 'N' THEN 'XY_SCATTER' ELSE 'SURFACE' END END AS chart_type,
       CASE WHEN type = 'table' THEN CAST(1 + ix % 4 AS INT) END AS table_rows, CASE WHEN type = 'table' THEN CAST(2 + ix % 3 AS INT) END AS table_columns FROM {shapes}
""")


@query("visual_capabilities", r"""
SELECT deck_id, slide_number, shape_id, CASE WHEN type IN ('chart', 'table') THEN type WHEN name LIKE 'deck:visual:%' THEN 'chart|table' ELSE 'table|chart|diagram|pictogram_grid' END AS kinds,
  CASE WHEN type = 'chart' THEN CASE l_returnflag WHEN 'A' THEN 'donut' WHEN 'N' THEN 'scatter' ELSE '' END WHEN type = 'table' THEN ''
    ELSE 'bar|column|line|area|pie|donut|scatter|process|timeline|cycle|hierarchy|comparison' END AS subtypes,
  CASE WHEN type IN ('chart', 'table') THEN 'existing_object' ELSE 'container' END AS render_mode, round(width / height, 6) AS aspect_ratio,
  CASE WHEN table_rows IS NOT NULL THEN greatest(1, table_rows - 1) END AS max_rows, table_columns AS max_columns FROM {cap_shapes}
""")
def _(t: Tables):
    caps = C.visual_capabilities(t.stored("cap_shapes"))
    return caps.select(*C.SLIDE, "shape_id", F.array_join("cap_kinds", "|").alias("kinds"), F.array_join("cap_subtypes", "|").alias("subtypes"), "render_mode",
                       F.round("aspect_ratio", 6).alias("aspect_ratio"), "max_rows", "max_columns")


@query("promote_visual_image", f"""
WITH b AS (SELECT s.deck_id, s.slide_number, s.slot_id FROM {{cat_specs}} s JOIN {{shapes}} x ON {on("x", "s", "shape_id")} JOIN {{slides}} k ON {on("k", "s")}
  WHERE s.target_type = 'shape' AND s.kind = 'image' AND x.type = 'image' AND NOT x.in_group AND s.role = 'Main visual' AND k.classification IN ('chart', 'content_visual')
  QUALIFY row_number() OVER (PARTITION BY s.deck_id, s.slide_number ORDER BY x.width * x.height DESC, s.slot_ix) = 1)
SELECT s.deck_id, s.slide_number, s.slot_id, CASE WHEN b.slot_id IS NOT NULL THEN 'visual' ELSE kind END AS kind, s.required AND b.slot_id IS NULL AS required, b.slot_id IS NOT NULL AS promoted
FROM {{cat_specs}} s LEFT JOIN b ON {on("b", "s", "slot_id")}
""")
def _(t: Tables):
    return C.promote_visual_image(t.stored("cat_specs"), t.stored("shapes"), t("slides")).select(*C.SLOT, "kind", "required", "promoted")


define("x_unowned", f"""
SELECT * FROM {{shapes}} s WHERE NOT EXISTS (SELECT 1 FROM {{free_owned}} o WHERE {on("o", "s", "shape_id")}) AND NOT EXISTS (SELECT 1 FROM {{cat_structural}} m WHERE {on("m", "s", "shape_id")})
""")


def free_names(base: str, source: str, order: str) -> str:
    """Checking SQL: the n-th row of a slide gets the n-th name not taken."""
    return f"""
 ranked AS (SELECT *, row_number() OVER (PARTITION BY deck_id, slide_number ORDER BY {order}) AS rk FROM {source}),
 names AS (SELECT deck_id, slide_number, nm, row_number() OVER (PARTITION BY deck_id, slide_number ORDER BY n) AS rk FROM (
   SELECT d.deck_id, d.slide_number, n, CASE WHEN n = 1 THEN '{base}' ELSE '{base}_' || CAST(n AS VARCHAR) END AS nm
   FROM (SELECT DISTINCT deck_id, slide_number FROM ranked) d, (SELECT unnest(range(1, 80)) AS n) k) g
   WHERE NOT EXISTS (SELECT 1 FROM {{free_specs}} c WHERE {on("c", "g")} AND c.slot_id = g.nm))"""


@query("unclaimed_visuals", "WITH cand AS (SELECT *, CASE WHEN type IN ('chart', 'table') THEN 0 ELSE 1 END AS grp FROM {x_unowned} WHERE NOT in_group AND (type IN ('chart', 'table') OR name LIKE 'deck:visual%')),"
       + free_names("visual", "cand", "grp, shape_id") + f"""
SELECT r.deck_id, r.slide_number, n.nm AS slot_id, r.shape_id, CASE WHEN grp = 0 THEN type ELSE 'visual' END AS renderer FROM ranked r JOIN names n ON {on("n", "r", "rk")}
""")
def _(t: Tables):
    found = C.unclaimed_visuals(t.stored("shapes"), t.stored("free_specs"), t.stored("free_owned"), t.stored("cat_structural"))
    return found.select(*C.SLOT, "shape_id", "renderer")


@query("fallback_slots", "WITH cand AS (SELECT * FROM {x_unowned} WHERE type = 'text' AND placeholder_type IN ('title', 'center_title')),"
       + free_names("fallback_title", "cand", "shape_id") + f""",
 g AS (SELECT *, row_number() OVER (PARTITION BY deck_id, slide_number ORDER BY shape_id) - 1 AS i, count(*) OVER (PARTITION BY deck_id, slide_number) AS n FROM {{x_unowned}}
   WHERE type = 'text' AND coalesce(placeholder_type, '') NOT IN ('title', 'center_title') AND trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), '.:*') IN ('insert text', 'text', 'title'))
SELECT r.deck_id, r.slide_number, n.nm AS slot_id, 'text' AS kind, r.shape_id, '/text' AS value_path, CAST(NULL AS BIGINT) AS capacity FROM ranked r JOIN names n ON {on("n", "r", "rk")}
UNION ALL SELECT deck_id, slide_number, CASE WHEN EXISTS (SELECT 1 FROM {{free_specs}} c WHERE {on("c", "g")} AND c.slot_id = 'fallback_text') THEN 'fallback_text_2' ELSE 'fallback_text' END,
  CASE WHEN n > 1 THEN 'bullet_list' ELSE 'text' END, shape_id, CASE WHEN n > 1 THEN '/items/' || i ELSE '/text' END, CASE WHEN n > 1 THEN n END FROM g
""")
def _(t: Tables):
    return C.fallback_slots(t.stored("shapes"), t.stored("free_specs"), t.stored("free_owned"), t.stored("cat_structural"))


define("x_titles", f"""
SELECT s.deck_id, s.slide_number, o.shape_id, x.y + x.height AS bottom FROM {{cat_specs}} s JOIN {{cat_owned}} o ON {on("o", "s", "slot_id")} LEFT JOIN {{shapes}} x ON {on("x", "o", "shape_id")}
WHERE s.kind = 'text' AND (s.role = 'Slide title' OR x.placeholder_type IN ('title', 'center_title'))
""")
define("x_canvas", f"""
SELECT k.deck_id, k.slide_number, greatest(0.22, coalesce(max(t.bottom), 0.0) + 0.03) AS y, k.dedicated, k.description FROM (
  SELECT *, coalesce(bool_or(classification = 'chart') OVER (PARTITION BY deck_id), FALSE) AS dedicated FROM {{slides}}) k JOIN {{x_titles}} t ON {on("t", "k")}
WHERE CASE WHEN dedicated THEN classification = 'chart' ELSE classification = 'content_visual' END GROUP BY ALL HAVING greatest(0.22, coalesce(max(t.bottom), 0.0) + 0.03) < 0.90
""")


@query("synthesize_chart_canvas", f"""
SELECT c.deck_id, c.slide_number, round(c.y, 6) AS y, round(0.90 - c.y, 6) AS height, dedicated AS required,
  array_to_string(list_filter([CASE WHEN lower(description) LIKE '%donut%' THEN 'donut' END, CASE WHEN lower(description) LIKE '%line%' THEN 'line' END, CASE WHEN lower(description) LIKE '%bar%' THEN 'bar' END], lambda v: v IS NOT NULL), '|') AS preferred,
  (SELECT string_agg(CAST(shape_id AS VARCHAR), '|' ORDER BY shape_id) FROM (SELECT shape_id FROM {{x_titles}} t WHERE {on("t", "c")} UNION SELECT shape_id FROM {{shapes}} x WHERE {on("x", "c")} AND (name = 'Company Logo' OR alt_text = 'brand mark' OR (x.y >= 0.9 AND x.height <= 0.1))) u) AS preserved
FROM {{x_canvas}} c
""")
def _(t: Tables):
    slides = t("slides").withColumn("tags", F.array().cast("array<string>")).withColumn("chart_text", F.lit(""))
    slots = t.stored("cat_specs").select(*C.SLOT, "kind", "role")
    canvases, kept = C.synthesize_chart_canvas(slides, slots, t.stored("cat_owned"), t.stored("shapes"))
    listed = kept.groupBy(*C.SLIDE).agg(F.array_join(F.array_sort(F.collect_list("shape_id")).cast("array<string>"), "|").alias("preserved"))
    return canvases.join(listed, C.SLIDE).select(*C.SLIDE, F.round("y", 6).alias("y"), F.round("height", 6).alias("height"), "required", F.array_join("preferred_subtypes", "|").alias("preferred"), "preserved")


SELECT_CANVAS = r"""
SELECT deck_id, subtype, slide_number FROM {cat_canvases}, (SELECT unnest(['bar', 'column', 'line', 'area', 'pie', 'donut', 'scatter']) AS subtype) k
QUALIFY row_number() OVER (PARTITION BY deck_id, subtype ORDER BY CASE WHEN preferred = subtype THEN 0 WHEN (preferred IN ('pie', 'donut')) = (subtype IN ('pie', 'donut')) THEN 1 ELSE 2 END,
  -(width * height), slide_number, family_ix, slot_ix) = 1
"""


def canvases_of(t: Tables):
    return t.stored("cat_canvases").withColumn("preferred_subtypes", F.array("preferred"))


@query("select_chart_canvas", SELECT_CANVAS)
def _(t: Tables):
    return C.select_chart_canvas(canvases_of(t))


define("x_parts", r"""
SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY family_ix, first) AS rn, count(*) OVER (PARTITION BY deck_id, family_ix) > 1 AS mixed,
  list(family_id) OVER (PARTITION BY deck_id) AS reserved FROM (
  SELECT deck_id, family_ix, family_id, classification, min(place) AS first FROM {cat_families} GROUP BY ALL) p
""")
define("x_named", r"""
SELECT deck_id, 0::BIGINT AS rn, 0 AS family_ix, '' AS classification, '' AS name, CAST([] AS VARCHAR[]) AS used FROM (SELECT DISTINCT deck_id FROM {x_parts}) d
UNION ALL
SELECT deck_id, rn, family_ix, classification, name, list_append(used, name) FROM (
  SELECT p.deck_id, p.rn, p.family_ix, p.classification, n.used,
    CASE WHEN NOT mixed AND NOT list_contains(n.used, p.family_id) THEN p.family_id
         ELSE list_filter(list_transform(range(1, 60), lambda k: CASE WHEN mixed THEN p.family_id || '_' || p.classification ELSE p.family_id END || CASE WHEN k = 1 THEN '' ELSE '_' || CAST(k AS VARCHAR) END),
              lambda c: NOT list_contains(n.used, c) AND NOT list_contains(p.reserved, c))[1] END AS name
  FROM x_named n JOIN {x_parts} p ON p.deck_id = n.deck_id AND p.rn = n.rn + 1) s
""")


@query("split_mixed_families", r"""
SELECT f.deck_id, f.slide_number, f.classification, n.name AS family_id FROM {cat_families} f JOIN {x_named} n ON n.deck_id = f.deck_id AND n.family_ix = f.family_ix AND n.classification = f.classification AND n.rn > 0
""")
def _(t: Tables):
    groups = t.stored("cat_families").drop("classification")
    return C.split_mixed_families(groups, t.stored("cat_families").select(*C.SLIDE, "classification"))


@query("validate_grouping", f"""
SELECT coalesce(s.deck_id, g.deck_id) AS deck_id, CASE WHEN g.n IS NULL THEN 'slide_without_family' WHEN s.deck_id IS NULL THEN 'unknown_slide' ELSE 'slide_in_two_families' END AS code,
  CAST(coalesce(s.slide_number, g.slide_number) AS VARCHAR) AS item
FROM {{slides}} s FULL OUTER JOIN (SELECT deck_id, slide_number, count(*) AS n FROM {{cat_groups}} GROUP BY ALL) g ON {on("g", "s")} WHERE g.n IS NULL OR s.deck_id IS NULL OR g.n > 1
UNION ALL SELECT deck_id, 'duplicate_family_id', family_id FROM (SELECT DISTINCT deck_id, family_ix, family_id FROM {{cat_groups}}) d GROUP BY deck_id, family_id HAVING count(*) > 1
""")
def _(t: Tables):
    return C.validate_grouping(t.stored("cat_groups"), t("slides"))


define("cat_bindings", "SELECT deck_id, slide_number, slot_id, CASE WHEN shape_id % 23 = 5 THEN shape_id + 1 ELSE shape_id END AS shape_id FROM {cat_owned} UNION ALL SELECT deck_id, slide_number, slot_id, shape_id FROM {cat_owned} WHERE slot_id = 's7'")
define("cat_targets", "SELECT deck_id, slide_number, slot_id, shape_id FROM {cat_owned} UNION ALL SELECT deck_id, slide_number, 'chart_visual', 6 FROM {cat_owned} WHERE slot_id = 's5'")
define("cat_slots", """
SELECT deck_id, slide_number, slot_id, kind, FALSE AS has_canvas FROM {cat_owned_specs}
UNION ALL SELECT deck_id, slide_number, 'chart_visual', 'visual', TRUE FROM {cat_canvases}
UNION ALL SELECT deck_id, slide_number, CASE WHEN kind = 'image' THEN 'chart_visual' ELSE 's4x' END, kind, kind = 'image' FROM {cat_owned_specs} WHERE slot_id IN ('s10', 's11')
""")
define("cat_owned_specs", "SELECT deck_id, slide_number, slot_id, kind FROM {cat_specs} WHERE target_type = 'shape'")
define("cat_statics", "SELECT deck_id, slide_number, shape_id FROM {shapes} WHERE l_returnflag = 'R' OR ix = 3")


@query("validate_catalog", f"""
SELECT deck_id, slide_number, 'duplicate_slot_id' AS code, slot_id AS item FROM {{cat_slots}} GROUP BY ALL HAVING count(*) > 1
UNION SELECT deck_id, slide_number, 'shape_in_two_slots', CAST(shape_id AS VARCHAR) FROM {{cat_targets}} GROUP BY deck_id, slide_number, shape_id HAVING count(*) > 1
UNION SELECT t.deck_id, t.slide_number, 'shape_editable_and_static', CAST(t.shape_id AS VARCHAR) FROM {{cat_targets}} t JOIN {{cat_statics}} s ON {on("s", "t", "shape_id")}
UNION SELECT deck_id, slide_number, 'slide_in_two_families', NULL FROM {{cat_groups}} GROUP BY deck_id, slide_number HAVING count(*) > 1
UNION SELECT deck_id, NULL, 'duplicate_family_id', family_id FROM (SELECT DISTINCT deck_id, family_ix, family_id FROM {{cat_groups}}) d GROUP BY deck_id, family_id HAVING count(*) > 1
UNION SELECT deck_id, slide_number, 'duplicate_binding', slot_id FROM {{cat_bindings}} GROUP BY deck_id, slide_number, slot_id, shape_id HAVING count(*) > 1
UNION SELECT d.deck_id, d.slide_number, 'bindings_not_cover_targets', d.slot_id FROM (
  (SELECT deck_id, slide_number, slot_id, shape_id FROM {{cat_bindings}} EXCEPT SELECT deck_id, slide_number, slot_id, shape_id FROM {{cat_targets}})
  UNION ALL (SELECT deck_id, slide_number, slot_id, shape_id FROM {{cat_targets}} EXCEPT SELECT deck_id, slide_number, slot_id, shape_id FROM {{cat_bindings}})) d
  JOIN {{cat_slots}} s ON {on("s", "d", "slot_id")} WHERE NOT s.has_canvas
UNION SELECT deck_id, slide_number, 'slot_without_target', slot_id FROM {{cat_slots}} s WHERE NOT has_canvas AND NOT EXISTS (SELECT 1 FROM {{cat_targets}} t WHERE {on("t", "s", "slot_id")})
UNION SELECT deck_id, slide_number, 'canvas_on_wrong_slot', slot_id FROM {{cat_slots}} WHERE has_canvas AND (kind <> 'visual' OR slot_id <> 'chart_visual')
UNION SELECT s.deck_id, s.slide_number, 'canvas_with_target', s.slot_id FROM {{cat_slots}} s JOIN {{cat_targets}} t ON {on("t", "s", "slot_id")} WHERE s.has_canvas
UNION SELECT deck_id, slide_number, 'canvas_out_of_slide', NULL FROM {{cat_canvases}} WHERE x + width > 1.000001 OR y + height > 1.000001 OR width <= 0 OR height <= 0
""")
def _(t: Tables):
    return C.validate_catalog(t.stored("cat_groups"), t.stored("cat_slots"), t.stored("cat_targets"), t.stored("cat_bindings"), t.stored("cat_statics"), canvases_of(t))


define("cat_variants", "SELECT deck_id, family_id, slide_number, 'v' AS description FROM {cat_families}")
define("cat_family_rows", "SELECT DISTINCT deck_id, family_id, 'other' AS slide_class, 'about ' || family_id AS description FROM {cat_families}")
define("cat_selected", "SELECT deck_id, family_id, slide_number FROM {cat_families} WHERE classification NOT IN ('cover', 'closing')")


@query("project_catalog", f"""
WITH p AS (SELECT v.deck_id, v.family_id, v.slide_number, s.slot_id FROM {{cat_variants}} v JOIN {{cat_selected}} c ON {on("c", "v", "family_id")} JOIN {{cat_specs}} s ON {on("s", "v")})
SELECT deck_id, 'family' AS kind, family_id AS value, count(*) AS n FROM p GROUP BY ALL
UNION ALL SELECT deck_id, 'variant', CAST(slide_number AS VARCHAR), count(*) FROM p GROUP BY ALL
UNION ALL SELECT deck_id, 'slot', slot_id, count(*) FROM p GROUP BY ALL
""")
def _(t: Tables):
    slots = t.stored("cat_specs").select(*C.SLOT, "kind", "role", "required", "max_chars")
    projected = C.project_catalog(t.stored("cat_family_rows"), t.stored("cat_variants"), slots, t.stored("cat_selected"))
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in (("family", "family_id"), ("variant", "slide_number"), ("slot", "slot_id"))]))
    counted = projected.select("deck_id", values.alias("e")).groupBy("deck_id", "e.kind", "e.value").agg(F.count(F.lit(1)).alias("n"))
    return C.catalog_enums(projected).join(counted, ["deck_id", "kind", "value"])


define("manifests", "SELECT deck_id, 'h' || CAST(min(p_partkey) % 50 AS STRING) AS source_sha256 FROM {slides} GROUP BY deck_id")
define("stored_catalogs", "SELECT deck_id, 'h' || CAST(min(p_partkey) % 40 AS STRING) AS source_sha256, CASE WHEN max(p_partkey) % 3 = 0 THEN '4.0' ELSE '5.0' END AS schema_version, 'catalog_v8' AS prompt_version FROM {slides} GROUP BY deck_id")


@query("catalog_freshness", r"""
SELECT m.deck_id, EXISTS (SELECT 1 FROM {stored_catalogs} c WHERE c.deck_id = m.deck_id AND c.source_sha256 = m.source_sha256 AND c.schema_version = '5.0' AND c.prompt_version = 'catalog_v8') AS reusable FROM {manifests} m
""")
def _(t: Tables):
    return C.catalog_freshness(t("manifests"), t("stored_catalogs"), "5.0", "catalog_v8")
