"""Queries over plans, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import catalog as C
from plinth.operators import planning as P
from plinth.operators import tabletyping as T
from plinth.operators import texts as O
from plinth.operators import visuals as V
from plinth.plans.catalogs import SELECT_CANVAS, canvases_of, on
from plinth.plans.registry import Tables, define, query
from plinth.session import set_down, shared_folder
from plinth.sources.planstore import PlanStore


def choices_of(t: Tables, listed: str = "pl_assets"):
    """Choice and profile per (request, asset) of the plans, with the request's deck."""
    assets = t("assets").drop("request_id", "asset_ix", "max_items", "max_rows", "max_columns")
    profile = V.column_profile(T.infer_column_types(t("dataset_cells")))
    chosen = V.choose_visual(assets.join(profile, "asset_id", "left"))
    decks = t.stored("pl_slides").select("request_id", "deck_id").distinct()
    return set_down(t.stored(listed).select("request_id", "asset_ix", "asset_id").join(chosen, "asset_id").join(decks, "request_id"))


def slots_of(t: Tables):
    split = [F.split(c, r"\|").alias(a) for c, a in (("caps", "cap_kinds"), ("subs", "cap_subtypes"))]
    return t.stored("pl_slots").select("*", *split).drop("caps", "subs")


def canvas_choice_of(t: Tables):
    best = C.select_chart_canvas(canvases_of(t))
    return set_down(best.join(t.stored("pl_families").drop("slide_class"), ["deck_id", "slide_number"]).withColumn("slot_id", F.lit("chart_visual")).withColumn("max_items", F.lit(12)))


define("x_canvas_choice", SELECT_CANVAS)
for _name, _listed in (("x_plan_choice", "pl_assets"), ("x_outline_choice", "ol_assets")):
    define(_name, f"""
SELECT a.request_id, a.asset_ix, d.deck_id, c.* EXCLUDE (request_id, asset_ix, max_items, max_rows, max_columns) FROM {{{_listed}}} a JOIN {{x_choice}} c ON c.asset_id = a.asset_id
JOIN (SELECT DISTINCT request_id, deck_id FROM {{pl_slides}}) d ON d.request_id = a.request_id
""")


def fits(v: str, caps: str = "caps", subs: str = "subs") -> str:
    """Checking SQL of the capability test for a ``kind/subtype`` text."""
    return (f"(list_contains(string_split({caps}, '|'), split_part({v}, '/', 1)) AND (split_part({v}, '/', 2) = '' OR {subs} IS NULL OR list_contains(string_split({subs}, '|'), split_part({v}, '/', 2))))")


CAPPED = f"CASE WHEN v = '' THEN NULL WHEN caps IS NULL OR {fits('v')} THEN v WHEN hint_mode = 'force' THEN NULL WHEN list_contains(string_split(caps, '|'), 'table') THEN 'table' END"


def guidance_of(t: Tables, listed: str):
    slots = slots_of(t).filter("kind = 'visual'").join(t.stored("pl_families").drop("slide_class"), ["deck_id", "slide_number"])
    return P.asset_guidance(choices_of(t, listed), slots, canvas_choice_of(t))


def guidance_sql(choice: str) -> str:
    """Checking SQL of the guidance over a table of choices."""
    return f"""
WITH w AS (SELECT * FROM {{{choice}}} WHERE hint_mode <> 'none'),
 ch AS (SELECT w.*, f.family_id, c.slide_number FROM w JOIN {{x_canvas_choice}} c ON c.deck_id = w.deck_id AND c.subtype = w.visual_subtype JOIN {{pl_families}} f ON {on("f", "c")} WHERE w.visual_kind = 'chart'),
 ot AS (SELECT w.*, s.slide_number, s.slot_id, f.family_id, s.max_items, s.max_rows, s.max_columns, {CAPPED} AS cv FROM w JOIN {{pl_slots}} s ON s.deck_id = w.deck_id JOIN {{pl_families}} f ON {on("f", "s")}
   WHERE w.visual_kind IS DISTINCT FROM 'chart' AND NOT s.has_canvas AND s.kind = 'visual'),
 ok AS (SELECT *, bool_or(cv = v) OVER (PARTITION BY request_id, asset_id) AS has_exact FROM ot WHERE cv IS NOT NULL),
 pg AS (SELECT *, CASE WHEN cv LIKE 'table%' THEN greatest(1, ceil(n_rows / coalesce(max_rows, 12))) ELSE greatest(1, ceil(n_rows / coalesce(max_items, 12))) END AS pages, coalesce(max_columns, n_columns) AS lim FROM ok WHERE NOT has_exact OR cv = v)
SELECT request_id, asset_id, family_id, slide_number, 'chart_visual' AS slot_id, 'chart' AS visual_kind, visual_subtype, CAST(greatest(1, ceil(n_rows / 12)) AS BIGINT) AS expected_pages FROM ch
UNION ALL SELECT request_id, asset_id, family_id, slide_number, slot_id, split_part(cv, '/', 1), CASE WHEN cv LIKE '%/%' THEN split_part(cv, '/', 2) END,
  CAST(pages * CASE WHEN cv NOT LIKE 'table%' OR n_columns <= lim THEN 1 WHEN lim = 1 THEN n_columns ELSE ceil((n_columns - 1) / (lim - 1)) END AS BIGINT) FROM pg
UNION ALL SELECT request_id, asset_id, NULL, NULL, NULL, 'text', NULL, NULL FROM w WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.request_id = w.request_id AND ch.asset_id = w.asset_id)
  AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.request_id = w.request_id AND ok.asset_id = w.asset_id)
"""


@query("asset_guidance", guidance_sql("x_plan_choice"))
def _(t: Tables):
    found, lost = guidance_of(t, "pl_assets")
    none = F.lit(None)
    empty = lost.select("request_id", "asset_id", none.cast("string").alias("family_id"), none.cast("int").alias("slide_number"), none.cast("string").alias("slot_id"),
                        F.lit("text").alias("visual_kind"), none.cast("string").alias("visual_subtype"), none.cast("int").alias("expected_pages"))
    return found.unionByName(empty)


# Outlines: the slides of the plans with material, up to six assets each, and citations of assets.
define("ol_assets", """
SELECT l.request_id, CAST(item_ix AS INT) AS asset_ix, item AS asset_id, a.title, a.hint_mode FROM (
  SELECT 'r' || CAST(c_custkey AS STRING) AS request_id, c_custkey, @LIST('ds-' || CAST(c_custkey AS STRING); 'ds-' || CAST(c_custkey + 1 AS STRING); 'ds-' || CAST(c_custkey + 2 AS STRING);
    'ds-' || CAST(c_custkey + 3 AS STRING); 'ds-' || CAST(c_custkey + 4 AS STRING); 'ds-' || CAST(c_custkey + 5 AS STRING))@ FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders})) l
JOIN {assets} a ON a.asset_id = l.item WHERE item_ix <= c_custkey % 6
""")
define("ol_slides", """
SELECT s.request_id, s.deck_id, s.number, s.content_type, CAST(CASE WHEN s.o_orderkey % 3 = 1 THEN s.o_orderkey % 4 ELSE 0 END AS INT) AS n_images,
       CASE s.o_orderkey % 3 WHEN 0 THEN 'Review of ' || c.c_mktsegment WHEN 1 THEN s.purpose ELSE 'Preorders: ' || c.c_name END AS purpose,
       CASE s.o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Notes on ' || coalesce(n.c_name, 'nobody') || chr(10) || 'and their ORDERS' WHEN 2 THEN 'Building a household furniture plan' ELSE 'machinery, automobiles' END AS cited,
       CASE WHEN s.o_orderkey % 11 = 3 THEN 'asset:ds-' || CAST(o.o_custkey + s.o_orderkey % 3 AS STRING) END AS source_id
FROM {pl_slides} s JOIN {orders} o ON o.o_orderkey = s.o_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey LEFT JOIN {customer} n ON n.c_custkey = o.o_custkey + s.o_orderkey % 5
""")
define("x_outline_guidance", guidance_sql("x_outline_choice"))
define("x_ol_compatible", "SELECT * FROM {x_outline_guidance} WHERE family_id IS NOT NULL")
define("x_ol_shown", "SELECT request_id, asset_id, arg_min(visual_kind, row(family_id, slide_number, slot_id)) AS visual_kind FROM {x_ol_compatible} GROUP BY ALL")
define("x_ol_placed", """
SELECT a.request_id, a.asset_ix, a.asset_id, a.title, s.visual_kind, row_number() OVER (PARTITION BY a.request_id ORDER BY a.asset_ix) AS k FROM {ol_assets} a
JOIN {x_ol_shown} s ON s.request_id = a.request_id AND s.asset_id = a.asset_id WHERE a.hint_mode <> 'none'
""")
define("x_ol_overflow", """
SELECT s.request_id FROM (SELECT request_id, count(*) AS n FROM {ol_slides} GROUP BY ALL) s LEFT JOIN (SELECT request_id, count(*) AS m FROM {x_ol_placed} GROUP BY ALL) a ON a.request_id = s.request_id
WHERE n > 30 OR coalesce(m, 0) > n
""")
define("x_ol_wishes", r"""
SELECT p.request_id, p.k, p.asset_id, s.number, coalesce(s.source_id = 'asset:' || p.asset_id, FALSE) AS explicit, s.content_type IN ('table', 'chart', 'diagram', 'pictogram_grid', p.visual_kind) AS typed,
  len(list_filter(list_distinct(regexp_extract_all(lower(p.title), '[\p{L}\p{N}_-]{3,}')), lambda w: contains(lower(s.cited), w) OR contains(lower(s.purpose), w))) AS overlap
FROM {x_ol_placed} p JOIN {ol_slides} s ON s.request_id = p.request_id WHERE p.request_id NOT IN (SELECT request_id FROM {x_ol_overflow})
""")
define("x_ol_taken", """
SELECT request_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS asset_id, CAST(NULL AS INT) AS number, CAST([] AS INT[]) AS taken FROM (SELECT DISTINCT request_id FROM {x_ol_wishes}) r
UNION ALL
(SELECT request_id, k, asset_id, number, list_append(taken, number) FROM (
  SELECT w.request_id, w.k, w.asset_id, w.number, t.taken, row_number() OVER (PARTITION BY w.request_id ORDER BY NOT w.explicit, NOT w.typed, -w.overlap, w.number) AS rn
  FROM x_ol_taken t JOIN {x_ol_wishes} w ON w.request_id = t.request_id AND w.k = t.k + 1 AND NOT list_contains(t.taken, w.number)) c WHERE rn = 1)
""")


def outline_of(t: Tables):
    """Slides, assets and word overlaps of the outlines."""
    slides, assets = t.stored("ol_slides"), t.stored("ol_assets")
    return slides, assets, set_down(O.word_overlap_score(assets.select("request_id", "asset_id", "title"), slides.select("request_id", "number", "purpose", "cited")))


def refs_of(slides):
    return slides.filter("source_id IS NOT NULL").select("request_id", "number", "source_id")


@query("assign_assets_to_slides", r"""
SELECT request_id, asset_id, number, NULL AS code FROM {x_ol_taken} WHERE k > 0 UNION ALL SELECT request_id, NULL, NULL, 'content_overflow' FROM {x_ol_overflow}
""")
def _(t: Tables):
    slides, assets, overlap = outline_of(t)
    compatible, _ = guidance_of(t, "ol_assets")
    shown = set_down(compatible.groupBy("request_id", "asset_id").agg(F.min_by("visual_kind", F.struct("family_id", "slide_number", "slot_id")).alias("visual_kind")))
    placed = assets.filter("hint_mode <> 'none'").join(shown, ["request_id", "asset_id"], "left_semi")
    overflow = P.overflow_issues(slides, placed)
    taken = P.assign_assets_to_slides(P.asset_pairs(slides, placed, overlap, refs_of(slides), shown), overflow)
    none = F.lit(None)
    return taken.withColumn("code", none.cast("string")).unionByName(overflow.select("request_id", none.cast("string").alias("asset_id"), none.cast("int").alias("number"), "code"))


define("outline_types", """
SELECT request_id, number, purpose, slide_max, CASE number % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'text' WHEN 2 THEN 'profiles' ELSE 'cards' END AS content_type FROM {outline_slides}
""")


@query("assign_images_to_slides")
def _(t: Tables):
    sources = O.chunk_sources(t("requests"), None, t("request_images"))
    needed = O.required_images(t("requests"), t("request_images"))
    return P.assign_images_to_slides(P.image_slide_scores(t("requests"), sources, needed, t("outline_types"), t("outline_refs")))


define("x_ol_wanted", """
SELECT s.request_id, s.deck_id, s.number, s.n_images, w.asset_id, CASE WHEN w.asset_id IS NULL AND s.content_type IN ('table', 'chart', 'diagram', 'pictogram_grid') THEN 'text' ELSE s.content_type END AS content_type
FROM {ol_slides} s LEFT JOIN {x_ol_taken} w ON w.request_id = s.request_id AND w.number = s.number WHERE s.request_id NOT IN (SELECT request_id FROM {x_ol_overflow})
""")


@query("choose_variant", f"""
WITH o AS (SELECT deck_id, slide_number, count(*) FILTER (kind = 'image') AS n_image, count(*) FILTER (required) AS n_required, list(DISTINCT kind) AS kinds, bool_or(required AND kind IN ('visual', 'table', 'chart')) AS heavy FROM {{pl_slots}} GROUP BY ALL),
 v AS (SELECT f.*, o.* EXCLUDE (deck_id, slide_number) FROM {{pl_families}} f JOIN o ON {on("o", "f")}),
 c AS (SELECT w.*, v.family_id, v.slide_number, v.slide_class, v.kinds, v.n_image, v.n_required, g.visual_kind, g.expected_pages AS pages FROM {{x_ol_wanted}} w JOIN {{x_ol_compatible}} g ON g.request_id = w.request_id AND g.asset_id = w.asset_id
      JOIN v ON v.deck_id = w.deck_id AND v.slide_number = g.slide_number
   UNION ALL SELECT w.*, v.family_id, v.slide_number, v.slide_class, v.kinds, v.n_image, v.n_required, NULL, 1 FROM {{x_ol_wanted}} w JOIN v ON v.deck_id = w.deck_id WHERE w.asset_id IS NULL AND NOT v.heavy),
 b AS (SELECT * FROM c WHERE n_image >= n_images QUALIFY row_number() OVER (PARTITION BY request_id, number ORDER BY
    CASE WHEN slide_class = CASE content_type WHEN 'cover' THEN 'cover' WHEN 'profiles' THEN 'profile' WHEN 'metrics' THEN 'metrics' WHEN 'table' THEN 'table' WHEN 'chart' THEN 'chart' WHEN 'process' THEN 'process' WHEN 'timeline' THEN 'timeline'
      WHEN 'closing' THEN 'closing' WHEN 'diagram' THEN 'content_visual' WHEN 'pictogram_grid' THEN 'content_visual' WHEN 'image' THEN 'content_visual' ELSE 'content_text' END THEN 0 ELSE 1 END, pages,
    CASE WHEN list_contains(kinds, CASE content_type WHEN 'bullets' THEN 'bullet_list' WHEN 'cards' THEN 'cards' WHEN 'profiles' THEN 'profiles' WHEN 'metrics' THEN 'metrics' WHEN 'process' THEN 'process' WHEN 'timeline' THEN 'timeline' ELSE 'text' END) THEN 0 ELSE 1 END,
    abs(n_image - n_images), n_required, slide_number, coalesce(visual_kind, '')) = 1)
SELECT w.request_id, w.number, w.content_type, w.asset_id, b.family_id AS template_family_id, b.slide_number AS template_slide_number, CASE WHEN b.visual_kind = 'chart' THEN b.asset_id END AS chart_asset_id, NULL AS code, NULL AS path
FROM {{x_ol_wanted}} w JOIN b ON b.request_id = w.request_id AND b.number = w.number
UNION ALL SELECT w.request_id, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN n_images > 0 THEN 'content_overflow' ELSE 'incompatible_template' END, 'slides[' || (number - 1) || ']'
FROM {{x_ol_wanted}} w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.request_id = w.request_id AND b.number = w.number)
UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, 'content_overflow', 'slides' FROM {{x_ol_overflow}}
""")
def _(t: Tables):
    """The whole chain: overlaps, guidance, assignment, text fall-back, templates, and an issue for all that has none."""
    slides, assets, overlap = outline_of(t)
    compatible, _ = guidance_of(t, "ol_assets")
    variants = P.variant_summary(t.stored("pl_families"), t.stored("pl_slots"))
    found, issues = P.resolve_outline(slides, assets, overlap, refs_of(slides), set_down(compatible), variants)
    columns = ["number", "content_type", "asset_id", "template_family_id", "template_slide_number", "chart_asset_id"]
    told = found.select("request_id", *columns, F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("path"))
    return told.unionByName(issues.select("request_id", "code", "path"), allowMissingColumns=True)


define("x_repaired", """
SELECT s.*, o.slide_class AS own, k.cls, u.fam AS only_fam, u.cls AS only_cls, o.slide_class IS NULL AND k.cls IS NOT NULL AND u.fam IS NOT NULL AS crossed FROM {pl_slides} s
LEFT JOIN {pl_families} o ON o.deck_id = s.deck_id AND o.family_id = s.template_family_id AND o.slide_number = s.template_slide_number
LEFT JOIN (SELECT deck_id, family_id, min(slide_class) AS cls FROM {pl_families} GROUP BY ALL) k ON k.deck_id = s.deck_id AND k.family_id = s.template_family_id
LEFT JOIN (SELECT deck_id, slide_number, min(family_id) AS fam, min(slide_class) AS cls FROM {pl_families} GROUP BY ALL HAVING count(*) = 1) u ON u.deck_id = s.deck_id AND u.slide_number = s.template_slide_number
""")


@query("expand_plan", """
SELECT a.request_id, a.number, a.slot_id, CASE WHEN crossed THEN only_fam ELSE r.template_family_id END AS template_family_id, coalesce(CASE WHEN crossed THEN only_cls ELSE coalesce(own, cls) END, 'content_text') AS template_class,
  CASE WHEN s.slot_id IS NOT NULL AND content_kind <> s.kind AND NOT s.required THEN s.kind WHEN s.slot_id IS NOT NULL AND content_kind <> s.kind THEN content_kind ELSE coalesce(s.kind, content_kind, 'text') END AS kind,
  CASE WHEN s.slot_id IS NOT NULL AND content_kind <> s.kind AND NOT s.required THEN 'clear' ELSE a.action END AS action,
  CASE WHEN s.slot_id IS NOT NULL AND content_kind <> s.kind AND NOT s.required THEN NULL ELSE content_kind END AS content_kind
FROM {pl_assignments} a JOIN {x_repaired} r ON r.request_id = a.request_id AND r.number = a.number
LEFT JOIN {pl_slots} s ON s.deck_id = a.deck_id AND s.slide_number = r.template_slide_number AND s.slot_id = a.slot_id AND (r.own IS NOT NULL OR r.crossed)
""")
def _(t: Tables):
    slides, rows = P.expand_plan(t.stored("pl_slides"), t.stored("pl_assignments").drop("deck_id"), t.stored("pl_families"), t.stored("pl_slots"))
    return rows.join(slides.select(*P.PLAN_SLIDE, "template_family_id", "template_class"), P.PLAN_SLIDE)


def canonical(t: Tables):
    slides = t.stored("pl_slides").select("request_id", "deck_id", "number", "template_family_id", "template_slide_number", "chart_asset_id")
    return P.canonicalize_plan(slides, t.stored("pl_assignments").drop("deck_id", "page"), t.stored("pl_families"), slots_of(t), choices_of(t), canvas_choice_of(t))


define("x_charted", """
SELECT r.*, coalesce(r.chart_asset_id, u.one) AS chart_id FROM {x_repaired} r LEFT JOIN (SELECT request_id, number, min(asset_id) AS one FROM {pl_assignments} WHERE content_kind = 'visual' AND visual_kind = 'chart'
  GROUP BY ALL HAVING count(DISTINCT asset_id) = 1) u ON u.request_id = r.request_id AND u.number = r.number
""")
define("x_placed", f"""
SELECT r.*, p.visual_subtype AS chart_sub, c.slide_number AS canvas, f.family_id AS canvas_family, f.slide_class AS canvas_class FROM {{x_charted}} r
LEFT JOIN {{x_plan_choice}} p ON p.request_id = r.request_id AND p.asset_id = r.chart_id AND p.visual_kind = 'chart'
LEFT JOIN {{x_canvas_choice}} c ON c.deck_id = r.deck_id AND c.subtype = p.visual_subtype LEFT JOIN {{pl_families}} f ON {on("f", "c")}
""")


@query("canonicalize_plan", f"""
WITH first AS (SELECT * FROM {{pl_assignments}} QUALIFY row_number() OVER (PARTITION BY request_id, number, slot_id ORDER BY assign_ix) = 1),
 title AS (SELECT * FROM {{pl_assignments}} WHERE content_kind = 'text' QUALIFY row_number() OVER (PARTITION BY request_id, number ORDER BY CASE WHEN slot_id = 'slide_title' THEN 0 ELSE 1 END, assign_ix) = 1),
 base AS (SELECT p.request_id, p.number, p.deck_id, p.chart_id, p.chart_sub, p.canvas, CASE WHEN canvas IS NOT NULL THEN canvas_family WHEN crossed THEN only_fam ELSE p.template_family_id END AS fam,
   coalesce(p.canvas, p.template_slide_number) AS sl, CASE WHEN canvas IS NOT NULL THEN canvas_class WHEN crossed THEN only_cls ELSE coalesce(own, cls) END AS cl, canvas IS NOT NULL OR own IS NOT NULL OR crossed AS known FROM {{x_placed}} p),
 r AS (SELECT b.*, s.slot_id, s.kind AS sk, s.required, s.has_canvas, s.caps, s.subs, a.kind, a.action, a.content_kind, a.asset_id, a.visual_kind, a.visual_subtype, a.text, a.slot_id IS NOT NULL AS has_a,
     t.text AS ttext, t.slot_id IS NOT NULL AS has_t, t.action AS taction, w.v, w.hint_mode, w.asset_id IS NOT NULL AS known_asset
   FROM base b JOIN {{pl_slots}} s ON s.deck_id = b.deck_id AND s.slide_number = b.sl LEFT JOIN first a ON a.request_id = b.request_id AND a.number = b.number AND a.slot_id = s.slot_id
   LEFT JOIN title t ON t.request_id = b.request_id AND t.number = b.number LEFT JOIN {{x_plan_choice}} w ON w.request_id = b.request_id AND w.asset_id = a.asset_id WHERE b.known),
 q AS (SELECT *, {CAPPED} AS cv,
   CASE WHEN canvas IS NOT NULL THEN CASE WHEN has_canvas THEN 'chart' WHEN sk = 'text' AND has_t THEN 'title' WHEN NOT required THEN 'clear' END
        WHEN NOT required AND (NOT has_a OR (action IN ('keep', 'generate') AND sk <> 'image') OR (content_kind = 'visual' AND NOT known_asset)) THEN 'clear' WHEN has_a THEN 'own' END AS how FROM r)
SELECT request_id, number, fam AS template_family_id, sl AS template_slide_number, cl AS template_class, slot_id,
  CASE how WHEN 'chart' THEN 'visual' WHEN 'own' THEN kind ELSE sk END AS kind, CASE how WHEN 'chart' THEN 'replace' WHEN 'title' THEN taction WHEN 'clear' THEN 'clear' ELSE action END AS action,
  CASE how WHEN 'chart' THEN chart_id WHEN 'own' THEN asset_id END AS asset_id,
  CASE how WHEN 'chart' THEN 'chart' WHEN 'own' THEN CASE WHEN content_kind = 'visual' AND known_asset AND cv IS NOT NULL THEN split_part(cv, '/', 1) ELSE visual_kind END END AS visual_kind,
  CASE how WHEN 'chart' THEN chart_sub WHEN 'own' THEN CASE WHEN content_kind = 'visual' AND known_asset AND cv IS NOT NULL THEN nullif(split_part(cv, '/', 2), '') ELSE visual_subtype END END AS visual_subtype,
  CASE how WHEN 'title' THEN ttext WHEN 'own' THEN text END AS text
FROM q WHERE how IS NOT NULL
UNION ALL SELECT b.request_id, b.number, b.fam, b.sl, b.cl, a.slot_id, a.kind, a.action, a.asset_id, a.visual_kind, a.visual_subtype, a.text FROM base b JOIN {{pl_assignments}} a ON a.request_id = b.request_id AND a.number = b.number WHERE NOT b.known
""")
def _(t: Tables):
    _, rows = canonical(t)
    return rows.select(
        *P.PLAN_SLIDE, "template_family_id", "template_slide_number", "template_class", "slot_id", "kind", "action", "asset_id", "visual_kind", "visual_subtype", "text"
    )


define("gr_used", """
SELECT DISTINCT request_id, number, asset_id FROM {pl_assignments} WHERE content_kind = 'visual' UNION SELECT request_id, number, chart_asset_id FROM {pl_slides} WHERE chart_asset_id IS NOT NULL
""")
define("gr_cited", "SELECT request_id, number, substr(source_id, 7) AS asset_id FROM {ol_slides} WHERE source_id IS NOT NULL")
define("gr_texts", "SELECT request_id, number, purpose || ' ' || cited AS text FROM {ol_slides}")
define("gr_titles", "SELECT request_id, asset_ix, asset_id, CASE WHEN asset_ix % 3 = 1 THEN 'household' ELSE title END AS title FROM {ol_assets}")
define("gr_slides", """
SELECT s.request_id, s.deck_id, s.number, s.template_family_id, s.template_slide_number, coalesce(f.slide_class, 'other') AS template_class, s.chart_asset_id FROM {pl_slides} s
LEFT JOIN {pl_families} f ON f.deck_id = s.deck_id AND f.family_id = s.template_family_id AND f.slide_number = s.template_slide_number
""")
define("gr_slots", "SELECT deck_id, slide_number, slot_ix, slot_id, kind, required, CAST(CASE WHEN slot_ix % 4 = 0 THEN 12 END AS INT) AS max_chars FROM {pl_slots}")
define("x_gr_selected", """
SELECT c.request_id, c.asset_id, t.asset_ix, t.title, d.deck_id, c.family_id, f.slide_class, c.slide_number, c.slot_id, c.visual_kind, c.visual_subtype,
  dense_rank() OVER (PARTITION BY c.request_id ORDER BY t.asset_ix) AS k
FROM (SELECT * FROM {x_ol_compatible} QUALIFY row_number() OVER (PARTITION BY request_id, asset_id ORDER BY family_id, slide_number, slot_id) = 1) c
JOIN {gr_titles} t ON t.request_id = c.request_id AND t.asset_id = c.asset_id JOIN (SELECT DISTINCT request_id, deck_id FROM {pl_slides}) d ON d.request_id = c.request_id
JOIN {pl_families} f ON f.deck_id = d.deck_id AND f.family_id = c.family_id AND f.slide_number = c.slide_number
""")
define("x_gr_options", """
SELECT * FROM (SELECT a.request_id, a.k, a.asset_id, s.number, CASE WHEN EXISTS (SELECT 1 FROM {gr_used} u WHERE u.request_id = a.request_id AND u.asset_id = a.asset_id AND u.number = s.number) THEN 0
   WHEN EXISTS (SELECT 1 FROM {gr_cited} c WHERE c.request_id = a.request_id AND c.asset_id = a.asset_id AND c.number = s.number) THEN 1 WHEN contains(lower(s.text), lower(a.title)) THEN 2 WHEN s.number > 1 THEN 3 END AS rank
   FROM {x_gr_selected} a JOIN {gr_texts} s ON s.request_id = a.request_id) o WHERE rank IS NOT NULL
""")
define("x_gr_taken", """
SELECT request_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS asset_id, CAST(NULL AS INT) AS number, CAST([] AS INT[]) AS taken FROM (SELECT DISTINCT request_id FROM {x_gr_selected}) r
UNION ALL
(SELECT request_id, k, asset_id, number, CASE WHEN number IS NULL THEN taken ELSE list_append(taken, number) END FROM (
  SELECT t.request_id, a.k, a.asset_id, o.number, t.taken, row_number() OVER (PARTITION BY t.request_id ORDER BY o.rank NULLS LAST, o.number) AS rn
  FROM x_gr_taken t JOIN {x_gr_selected} a ON a.request_id = t.request_id AND a.k = t.k + 1 LEFT JOIN {x_gr_options} o ON o.request_id = a.request_id AND o.k = a.k AND NOT list_contains(t.taken, o.number)) c WHERE rn = 1)
""")


@query("ground_assets", r"""
WITH c AS (SELECT w.number, s.* FROM {x_gr_taken} w JOIN {x_gr_selected} s ON s.request_id = w.request_id AND s.asset_id = w.asset_id WHERE w.number IS NOT NULL),
 l AS (SELECT c.request_id, c.number, c.asset_id, c.title, c.visual_kind, c.visual_subtype, v.slot_ix, v.slot_id, v.kind, v.required, v.max_chars, v.slot_id = c.slot_id AS shows
   FROM c JOIN {gr_slots} v ON v.deck_id = c.deck_id AND v.slide_number = c.slide_number),
 p AS (SELECT *, CASE WHEN NOT shows AND kind = 'text' THEN row_number() OVER (PARTITION BY request_id, number, NOT shows AND kind = 'text' ORDER BY slot_ix, slot_id) END AS place FROM l),
 a AS (SELECT request_id, number, action, text, row_number() OVER (PARTITION BY request_id, number ORDER BY assign_ix) AS place FROM {pl_assignments} WHERE content_kind = 'text'),
 m AS (SELECT p.*, a.place IS NOT NULL AS written, a.action AS w_action, a.text AS w_text FROM p LEFT JOIN a ON a.request_id = p.request_id AND a.number = p.number AND a.place = p.place),
 r AS (SELECT request_id, number, slot_ix AS assign_ix, slot_id, CASE WHEN shows THEN 'visual' ELSE kind END AS kind,
   CASE WHEN shows THEN 'replace' WHEN kind = 'text' AND written THEN w_action WHEN kind = 'text' AND required THEN 'replace' WHEN kind = 'image' AND required THEN 'keep' WHEN NOT required THEN 'clear' END AS action,
   CASE WHEN shows THEN 'visual' WHEN kind = 'text' AND (written OR required) THEN 'text' END AS content_kind, CASE WHEN shows THEN asset_id END AS asset_id, CASE WHEN shows THEN visual_kind END AS visual_kind,
   CASE WHEN shows THEN visual_subtype END AS visual_subtype, CASE WHEN shows THEN NULL WHEN kind = 'text' AND written THEN w_text WHEN kind = 'text' AND required THEN CASE WHEN max_chars > 0 THEN substr(title, 1, max_chars) ELSE title END END AS text FROM m),
 o AS (SELECT * FROM r WHERE action IS NOT NULL
   UNION ALL SELECT request_id, number, assign_ix, slot_id, kind, action, content_kind, asset_id, visual_kind, visual_subtype, text FROM {pl_assignments} x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.request_id = x.request_id AND c.number = x.number))
SELECT o.*, CASE WHEN c.number IS NOT NULL THEN c.family_id ELSE s.template_family_id END AS template_family_id, CASE WHEN c.number IS NOT NULL THEN c.slide_number ELSE s.template_slide_number END AS template_slide_number,
  CASE WHEN c.number IS NOT NULL THEN c.slide_class ELSE s.template_class END AS template_class, CASE WHEN c.number IS NULL THEN s.chart_asset_id WHEN c.visual_kind = 'chart' THEN c.asset_id END AS chart_asset_id
FROM o JOIN {gr_slides} s ON s.request_id = o.request_id AND s.number = o.number LEFT JOIN c ON c.request_id = o.request_id AND c.number = o.number
""")
def _(t: Tables):
    """Claims and the slots they rewrite, each row with the template its slide has then."""
    compatible, _ = guidance_of(t, "ol_assets")
    pick = F.struct("family_id", "slide_number", "slot_id", "visual_kind", "visual_subtype")
    best = set_down(compatible.groupBy("request_id", "asset_id").agg(F.min(pick).alias("p")).select("request_id", "asset_id", "p.*"))
    decks = t.stored("pl_slides").select("request_id", "deck_id").distinct()
    selected = best.join(t("gr_titles"), ["request_id", "asset_id"]).join(decks, "request_id").join(t.stored("pl_families"), ["deck_id", "family_id", "slide_number"])
    titles = selected.select("request_id", "asset_ix", "asset_id", "title")
    claimed = set_down(P.ground_assets(P.ground_options(t("gr_texts"), titles, t("gr_used"), t("gr_cited"))))
    rows = t.stored("pl_assignments").drop("deck_id", "l_orderkey", "page")
    slides, laid = P.rewrite_claimed(t("gr_slides"), rows, claimed, selected, t("gr_slots"))
    return laid.join(slides.drop("deck_id"), P.PLAN_SLIDE)


define("image_slots", """
SELECT request_id, number, CAST(1 AS INT) AS slot_ix, CASE WHEN number % 3 = 0 THEN 'portrait' ELSE 'picture' END AS slot_id, purpose,
       CASE WHEN number % 2 = 0 THEN purpose ELSE 'plain' END AS text FROM {outline_slides}
""")


@query("ground_images", r"""
WITH RECURSIVE im AS (SELECT request_id, image_ix, id, lower(original_name) AS full_name, regexp_replace(lower(regexp_extract(original_name, '[^/\\]*$')), '(.)\.[^.]*$', '\1') AS stem FROM {request_images}),
 hits AS (SELECT s.request_id, s.number, s.slot_id, list(i.id ORDER BY i.image_ix) AS ids FROM {image_slots} s JOIN im i ON i.request_id = s.request_id
   WHERE contains(lower(s.text), i.full_name) OR (i.stem <> '' AND contains(lower(s.text), i.stem)) GROUP BY ALL),
 turns AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY number) AS k FROM hits),
 served AS (SELECT DISTINCT request_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS INT) AS number, CAST(NULL AS VARCHAR) AS slot_id, CAST(NULL AS VARCHAR) AS id, CAST([] AS VARCHAR[]) AS taken FROM turns
   UNION ALL SELECT t.request_id, t.k, t.number, t.slot_id, list_filter(t.ids, lambda x: NOT list_contains(s.taken, x))[1],
     list_concat(s.taken, list_filter(t.ids, lambda x: NOT list_contains(s.taken, x))[1:1]) FROM served s JOIN turns t ON t.request_id = s.request_id AND t.k = s.k + 1),
 named AS (SELECT request_id, number, slot_id, id FROM served WHERE id IS NOT NULL),
 ri AS (SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY image_ix) AS place FROM im i WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.request_id = i.request_id AND n.id = i.id)),
 rs AS (SELECT request_id, number, slot_id, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN regexp_matches(lower(concat_ws(' ', purpose, slot_id)), 'photo|portrait|avatar|портрет|profile|профил') THEN 0 ELSE 1 END, number, slot_ix) AS place
   FROM {image_slots} s WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.request_id = s.request_id AND n.number = s.number AND n.slot_id = s.slot_id))
SELECT request_id, id, number, slot_id FROM named UNION ALL SELECT ri.request_id, ri.id, rs.number, rs.slot_id FROM ri JOIN rs ON rs.request_id = ri.request_id AND rs.place = ri.place
""")
def _(t: Tables):
    return P.ground_images(t("request_images").select("request_id", "image_ix", "id", "original_name"), t("image_slots"))


# Pages of each asset: row pages by column blocks, the blocks outside.
define("pl_cells", """
SELECT request_id, asset_id, CAST(block * n_pages + page - 1 AS INT) AS seq, page, 'k0,k' || CAST(block + 1 AS STRING) AS selected_columns,
       CASE WHEN length(request_id) % 3 = 1 THEN 'chart' ELSE 'table' END AS visual_kind, CASE WHEN length(request_id) % 3 = 1 THEN 'bar' END AS visual_subtype
FROM (SELECT b.request_id, b.asset_id, b.n_pages, b.page, CAST(item AS INT) AS block FROM (
  SELECT *, @LIST(0; 1)@ FROM (SELECT request_id, asset_id, n_pages, CAST(item AS INT) AS page FROM (SELECT *, @LIST(1; 2; 3; 4)@ FROM {pl_pages}) p WHERE item <= n_pages) q) b) c
WHERE block <= length(asset_id) % 2
""")
define("pl_shown", "SELECT a.*, CASE WHEN content_kind = 'visual' THEN 'all' END AS selected_columns FROM {pl_assignments} a")


@query("paginate_plan", r"""
WITH v AS (SELECT *, count(*) OVER (PARTITION BY request_id, asset_id) AS uses, count(*) OVER (PARTITION BY request_id, number) AS nv FROM {pl_shown} WHERE content_kind = 'visual'),
 g AS (SELECT request_id, asset_id, count(*) AS n FROM {pl_cells} GROUP BY ALL),
 f AS (SELECT s.request_id, s.number, s.chart_asset_id, g.asset_id AS fan, coalesce(g.n, 1) AS n FROM {pl_slides} s LEFT JOIN v ON v.request_id = s.request_id AND v.number = s.number AND v.uses = 1 AND v.nv = 1
   LEFT JOIN g ON g.request_id = v.request_id AND g.asset_id = v.asset_id),
 w AS (SELECT *, count(*) OVER (PARTITION BY request_id) + sum(n - 1) OVER (PARTITION BY request_id ORDER BY number) AS needed FROM f),
 bad AS (SELECT w.request_id, arg_min(fan, number) AS fan FROM w JOIN {pl_limits} l ON l.request_id = w.request_id WHERE fan IS NOT NULL AND needed > slide_max GROUP BY w.request_id),
 c AS (SELECT *, unnest(range(0, n)) AS copy FROM f WHERE request_id NOT IN (SELECT request_id FROM bad)),
 d AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY number, copy) AS new_number FROM c),
 a AS (SELECT d.request_id, d.new_number AS number, x.slot_id, x.assign_ix, x.content_kind, x.visual_kind, d.chart_asset_id, CASE WHEN x.content_kind = 'visual' AND d.fan IS NOT NULL THEN z.page ELSE x.page END AS page,
   CASE WHEN x.content_kind = 'visual' AND d.fan IS NOT NULL THEN z.selected_columns ELSE x.selected_columns END AS selected_columns, x.text
   FROM d JOIN {pl_shown} x ON x.request_id = d.request_id AND x.number = d.number LEFT JOIN {pl_cells} z ON z.request_id = d.request_id AND z.asset_id = d.fan AND z.seq = d.copy),
 m AS (SELECT *, bool_or(content_kind = 'visual' AND visual_kind = 'chart' AND page > 1 AND chart_asset_id IS NOT NULL) OVER (PARTITION BY request_id, number) AS later,
   arg_min(slot_id, assign_ix) FILTER (content_kind = 'text' AND text IS NOT NULL) OVER (PARTITION BY request_id, number) AS first_text FROM a)
SELECT request_id, number, slot_id, assign_ix, page, selected_columns, CASE WHEN later AND slot_id = first_text THEN text || ' (продолжение)' ELSE text END AS text, NULL AS code FROM m
UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, NULL, 'structured_assets[' || fan || ']', 'content_overflow' FROM bad
""")
def _(t: Tables):
    """Plans spread over their pages, and in place of each plan that does not fit its issue (the path as ``text``)."""
    slides = t.stored("pl_slides").select(*P.PLAN_SLIDE, "chart_asset_id")
    _, rows, issues = P.paginate_plan(slides, t.stored("pl_shown").drop("deck_id", "l_orderkey"), t.stored("pl_cells"), t("pl_limits"))
    told = rows.select(*P.PLAN_SLIDE, "slot_id", "assign_ix", "page", "selected_columns", "text", F.lit(None).cast("string").alias("code"))
    return told.unionByName(issues.select("request_id", F.col("path").alias("text"), "code"), allowMissingColumns=True)


define("pl_unique", "SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY request_id, number, slot_id ORDER BY assign_ix) AS rn FROM {pl_shown} a) u WHERE rn = 1")
define("pl_flags", """
SELECT request_id, number, slot_id, length(slot_id) = 2 AND number % 7 = 0 AS required, CASE WHEN l_orderkey % 4 <> 0 THEN CASE WHEN l_orderkey % 9 = 3 THEN 'table' ELSE 'table|chart' END END AS caps,
       CASE WHEN l_orderkey % 5 = 1 THEN 'line|bar' WHEN l_orderkey % 25 = 7 THEN 'line' END AS subs
FROM {pl_unique} WHERE l_orderkey % 23 <> 4
""")


@query("remap_pages", r"""
WITH u AS (SELECT a.*, f.required, f.caps, f.subs, row_number() OVER (PARTITION BY a.request_id, a.asset_id ORDER BY a.number, a.assign_ix) - 1 AS seq, count(*) OVER (PARTITION BY a.request_id, a.asset_id) AS uses
   FROM {pl_unique} a JOIN {pl_flags} f ON f.request_id = a.request_id AND f.number = a.number AND f.slot_id = a.slot_id
   WHERE content_kind = 'visual' AND NOT EXISTS (SELECT 1 FROM {pl_slides} s WHERE s.request_id = a.request_id AND s.chart_asset_id = a.asset_id)),
 n AS (SELECT request_id, asset_id, count(*) AS n FROM {pl_cells} GROUP BY ALL),
 p AS (SELECT u.request_id, u.asset_id, u.number, u.slot_id, u.seq, u.uses, n.n, z.page AS cell_page, z.selected_columns AS cell_columns, z.visual_kind AS cell_kind, z.visual_subtype AS cell_subtype,
   CASE WHEN u.seq >= n.n THEN u.required ELSE u.caps IS NOT NULL AND NOT (list_contains(string_split(u.caps, '|'), z.visual_kind)
     AND (z.visual_subtype IS NULL OR u.subs IS NULL OR list_contains(string_split(u.subs, '|'), z.visual_subtype))) END AS unfit
   FROM u JOIN n ON n.request_id = u.request_id AND n.asset_id = u.asset_id LEFT JOIN {pl_cells} z ON z.request_id = u.request_id AND z.asset_id = u.asset_id AND z.seq = u.seq),
 k AS (SELECT * FROM (SELECT *, bool_or(unfit) OVER (PARTITION BY request_id, asset_id) AS refused FROM p) q WHERE uses > 1 AND uses >= n AND NOT refused)
SELECT a.request_id, a.number, a.slot_id, CASE WHEN k.seq >= k.n THEN 'clear' ELSE a.action END AS action, CASE WHEN k.seq >= k.n THEN NULL ELSE a.asset_id END AS asset_id,
  CASE WHEN k.seq IS NULL THEN a.page ELSE k.cell_page END AS page, CASE WHEN k.seq IS NULL THEN a.selected_columns ELSE k.cell_columns END AS selected_columns,
  CASE WHEN k.seq IS NULL THEN a.visual_kind ELSE k.cell_kind END AS visual_kind, CASE WHEN k.seq IS NULL THEN a.visual_subtype ELSE k.cell_subtype END AS visual_subtype
FROM {pl_unique} a LEFT JOIN k ON k.request_id = a.request_id AND k.number = a.number AND k.slot_id = a.slot_id
""")
def _(t: Tables):
    slots = t.stored("pl_flags").select(*P.PLAN_SLOT, "required", F.split("caps", r"\|").alias("cap_kinds"), F.split("subs", r"\|").alias("cap_subtypes"))
    charts = t.stored("pl_slides").filter("chart_asset_id IS NOT NULL").select("request_id", F.col("chart_asset_id").alias("asset_id")).distinct()
    out = P.remap_pages(t.stored("pl_unique").drop("rn", "deck_id", "l_orderkey"), t.stored("pl_cells"), slots, charts)
    return out.select(*P.PLAN_SLOT, "action", "asset_id", "page", "selected_columns", "visual_kind", "visual_subtype")


# Bindings of the assigned slots and flattened values of their content.
define("pl_bindings", """
SELECT request_id, number, slot_id, CAST(assign_ix * 10 + item_ix AS INT) AS shape_id, CASE WHEN kind IN ('image', 'visual') THEN kind ELSE 'text' END AS renderer, item AS path_one,
       CASE WHEN item = '/fields/a' THEN '/fields/b' END AS path_two, CASE WHEN item = '/items' THEN 'paragraphs' ELSE 'scalar' END AS mode, ' / ' AS separator,
       CASE WHEN l_orderkey % 3 = 0 THEN 'keep' ELSE 'clear' END AS missing_action
FROM (SELECT *, @LIST('/text'; '/items'; '/items/1'; '/fields/a')@ FROM {pl_unique}) b
""")
define("pl_values", """
SELECT request_id, number, slot_id, item AS pointer, CASE WHEN item_ix = 2 AND l_orderkey % 4 = 1 THEN '' ELSE slot_id || item END AS value
FROM (SELECT *, @LIST('/text'; '/items/0'; '/items/1'; '/items/10'; '/fields/a'; '/fields/b')@ FROM {pl_unique} WHERE action NOT IN ('clear', 'keep')) v
WHERE CASE kind WHEN 'text' THEN item_ix IN (0, 4, 5) ELSE item_ix IN (1, 2, 3) END
""")


@query("compile_render_ops", r"""
WITH b AS (SELECT p.*, a.action FROM {pl_bindings} p JOIN {pl_unique} a ON a.request_id = p.request_id AND a.number = p.number AND a.slot_id = p.slot_id),
 x AS (SELECT request_id, number, slot_id, pointer, value, regexp_replace(pointer, '/[0-9]+$', '') AS parent, try_cast(regexp_extract(pointer, '/([0-9]+)$', 1) AS INT) AS item FROM {pl_values} WHERE value <> ''),
 w AS (SELECT request_id, number, slot_id, shape_id, mode, unnest([path_one, path_two]) AS path, unnest([0, 1]) AS path_ix FROM b WHERE action NOT IN ('clear', 'keep')),
 h AS (SELECT w.*, x.value, 0 AS item FROM w JOIN x ON x.request_id = w.request_id AND x.number = w.number AND x.slot_id = w.slot_id AND x.pointer = w.path
   UNION ALL SELECT w.*, x.value, x.item FROM w JOIN x ON x.request_id = w.request_id AND x.number = w.number AND x.slot_id = w.slot_id AND x.parent = w.path WHERE w.mode = 'paragraphs' AND x.item IS NOT NULL),
 v AS (SELECT request_id, number, slot_id, shape_id, CASE WHEN mode = 'paragraphs' THEN array_to_string(list(value ORDER BY path_ix, item), '|') ELSE array_to_string(list(value ORDER BY path_ix, item), ' / ') END AS text FROM h GROUP BY request_id, number, slot_id, shape_id, mode)
SELECT b.request_id, b.number, b.slot_id, b.shape_id, b.renderer,
  CASE WHEN b.action IN ('clear', 'keep') OR b.renderer <> 'text' THEN b.action WHEN v.text IS NULL THEN b.missing_action ELSE 'replace' END AS action,
  CASE WHEN b.renderer = 'text' THEN v.text END AS text
FROM b LEFT JOIN v ON v.request_id = b.request_id AND v.number = b.number AND v.slot_id = b.slot_id AND v.shape_id = b.shape_id
""")
def compiled(t: Tables):
    bindings = t.stored("pl_bindings").withColumn("value_paths", F.filter(F.array("path_one", "path_two"), lambda p: p.isNotNull()))
    ops = P.compile_render_ops(t.stored("pl_unique"), bindings, t.stored("pl_values"))
    return ops.withColumn("text", F.array_join("text", "|"))


define("pl_hashes", "SELECT deck_id, 'c' || CAST(count(*) AS STRING) AS catalog_hash FROM {pl_slots} GROUP BY deck_id")
define("pl_briefs", """
SELECT request_id, max(deck_id) AS deck_id, 'brief ' || request_id AS brief, max(purpose) AS content_package, CAST(1 AS INT) AS slide_min, CAST(max(number) AS INT) AS slide_max, 'h' || CAST(sum(o_orderkey) AS STRING) AS assets_hash
FROM {pl_slides} GROUP BY request_id
""")


@query("plan_fingerprint", r"""
WITH k AS (SELECT b.request_id, sha256(concat_ws(chr(31), brief, content_package, CAST(slide_min AS VARCHAR), CAST(slide_max AS VARCHAR), assets_hash, catalog_hash, 'v6')) AS plan_key
  FROM {pl_briefs} b JOIN {pl_hashes} h ON h.deck_id = b.deck_id)
SELECT request_id, plan_key, 'plan of ' || substr(plan_key, 1, 12) AS plan, CASE WHEN plan_key IN (SELECT plan_key FROM k WHERE length(request_id) % 2 = 0) THEN 1 ELSE 2 END AS run FROM k
""")
def _(t: Tables):
    """Two runs over one store: some requests first, then all of them. ``run`` is the one that computed the plan."""
    keys = set_down(P.plan_fingerprint(t.stored("pl_briefs"), t.stored("pl_hashes"), "v6"))
    folder = shared_folder(t.spark, "plans")
    store = PlanStore(t.spark, folder, "plan STRING, run INT", "plans_" + folder[-32:], buckets=8)

    def plans(run: int):
        return lambda fresh: fresh.select("plan_key", F.concat(F.lit("plan of "), F.substring("plan_key", 1, 12)).alias("plan"), F.lit(run).alias("run"))

    store.resolve(keys.filter("length(request_id) % 2 = 0"), plans(1))
    found = set_down(store.resolve(keys, plans(2)))
    store.forget()
    return found.select("request_id", "plan_key", "plan", "run")



