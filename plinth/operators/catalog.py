"""Slots, bindings, capabilities, chart canvases and families of template slides.

``specs``: ``deck_id, slide_number, slot_ix, slot_id, kind, role, target_type, shape_id, structure_id,
required, max_chars``; ``roles``: ``deck_id, slide_number, slot_id, field_id, role``; ``members``: the
structure members of ``layout``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.numbering import renumber_by
from plinth.functions.scalars import squeeze
from plinth.issues import union_all
from plinth.operators.layout import SLIDE

SLOT = [*SLIDE, "slot_id"]
# Fixed values.
BATCH_SLIDES, BATCH_ELEMENTS = 6, 120
CHART_SUBTYPES = ["bar", "column", "line", "area", "pie", "donut", "scatter"]
RADIAL = ["pie", "donut"]
CHART_WORDS = {
    "donut": "donut|doughnut|кольцев",
    "pie": "pie|кругов",
    "scatter": "scatter|xy_|точеч",
    "area": "area|област",
    "line": "line|линейн|линия",
    "column": "column|столбчат|вертикальн",
    "bar": "bar|полос|горизонтальн",
}
VISUAL_KINDS = ["table", "chart", "diagram", "pictogram_grid"]
ALL_SUBTYPES = [*CHART_SUBTYPES, "process", "timeline", "cycle", "hierarchy", "comparison"]
FIELD_ROLES = {
    "cards": ["title", "body", "value"],
    "profiles": ["name", "role", "details"],
    "metrics": ["label", "value", "unit"],
    "timeline": ["date", "title", "description"],
    "process": ["title", "description"],
}
PLACEHOLDER_TEXTS = [
    "text", "текст", "title", "заголовок", "subtitle", "подзаголовок",
    "description", "описание", "value", "показатель", "insert text",
]
TITLE_WORDS = ["title", "heading", "header", "заголовок"]
VISUAL_ROLE_WORDS = ["visual", "визуал", "график", "chart"]
BRAND = r"(?:^|[^a-zа-яё])(logo|brand|логотип|бренд)(?:$|[^a-zа-яё])"
MARKER = "deck:visual"  # default marker of a placeholder for visuals
CANVAS_LEFT, CANVAS_WIDTH, CANVAS_TOP, CANVAS_BOTTOM, CANVAS_GAP = 0.03, 0.94, 0.22, 0.90, 0.03


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def resolve_slide_semantics(slides: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Class and description of the annotation, else of the descriptor."""
    other = descriptors.select(*SLIDE, F.col("classification").alias("_c"), F.col("description").alias("_d"))
    return slides.join(other, SLIDE, "left").withColumn("classification", F.coalesce("classification", "_c")).withColumn(
        "description", F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("_d"))
    ).drop("_c", "_d")


def pack_batches(slides: DataFrame) -> DataFrame:
    """Add ``batch`` per deck: at most six slides and, past the first, 120 elements.

    The packing is sequential inside a deck, so a deck (one file, two integers per slide) is one group.
    """

    def pack(deck: pd.DataFrame) -> pd.DataFrame:
        deck = deck.sort_values("slide_number")
        batches, batch, count, elements = [], 0, 0, 0
        for n in deck["n_elements"].tolist():
            if count >= BATCH_SLIDES or (count and elements + n > BATCH_ELEMENTS):
                batch, count, elements = batch + 1, 0, 0
            count, elements = count + 1, elements + n
            batches.append(batch)
        return deck.assign(batch=batches)

    narrow = slides.select(*SLIDE, F.col("n_elements").cast("int"))
    return narrow.groupBy("deck_id").applyInPandas(pack, "deck_id string, slide_number int, n_elements int, batch int")


def _slot_fields(specs: DataFrame, roles: DataFrame, fields: DataFrame) -> DataFrame:
    """Specs with their ordered structure fields and their field-to-role pairs.

    ``fields``: ``deck_id, slide_number, structure_id, field_ix, field_id`` - a handful per structure.
    """
    listed = fields.groupBy(*SLIDE, "structure_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("field_ix", "field_id"))), lambda f: f["field_id"]).alias("fields")
    )
    mapped = roles.groupBy(*SLOT).agg(F.array_sort(F.collect_list(F.struct("field_id", F.col("role").alias("to")))).alias("pairs"))
    none = F.array().cast("array<string>")
    return specs.join(listed, [*SLIDE, "structure_id"], "left").join(mapped, SLOT, "left").withColumn(
        "fields", F.coalesce("fields", none)
    ).withColumn("pairs", F.coalesce("pairs", F.array().cast(mapped.schema["pairs"].dataType)))


def _same_set(left: Column, right: Column) -> Column:
    return (F.size(F.array_except(left, right)) == 0) & (F.size(F.array_except(right, left)) == 0)


def normalize_repeat_slots(specs: DataFrame, roles: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Specs and roles with reversed role maps turned round and plain text repeats made cards.

    ``specs`` also carries ``structure_kind``.
    """
    joined = _slot_fields(specs, roles, fields)
    keys, values = F.transform("pairs", lambda p: p["field_id"]), F.transform("pairs", lambda p: p["to"])
    repeat = F.coalesce(F.col("structure_kind") == "repeat", F.lit(False))
    reversed_map = repeat & ~_same_set(keys, F.col("fields")) & (F.size("pairs") == F.size("fields")) & _same_set(values, F.col("fields"))
    turned = F.when(
        reversed_map, F.transform("pairs", lambda p: F.struct(p["to"].alias("field_id"), p["field_id"].alias("to")))
    ).otherwise(F.col("pairs"))
    as_cards = repeat & F.col("kind").isin("text", "bullet_list") & (F.size("fields") > 0) & (F.size("fields") <= 3)
    card_roles = words(FIELD_ROLES["cards"])
    cards = F.transform("fields", lambda f, i: F.struct(f.alias("field_id"), F.get(card_roles, i).alias("to")))
    fixed = joined.withColumn("pairs", F.when(as_cards, cards).otherwise(turned)).withColumn(
        "kind", F.when(as_cards, "cards").otherwise(F.col("kind"))
    )
    out_roles = fixed.select(*SLOT, F.inline("pairs")).withColumnRenamed("to", "role")
    return fixed.drop("fields", "pairs"), out_roles


def validate_slot_targets(
    specs: DataFrame, roles: DataFrame, fields: DataFrame, shapes: DataFrame, structures: DataFrame,
    expected: DataFrame | None = None, described: DataFrame | None = None,
) -> DataFrame:
    """``deck_id, slide_number, slot_id, code``. ``expected`` and ``described``: the batch's slides."""
    known = structures.select(*SLIDE, "structure_id", F.col("kind").alias("structure_kind")).distinct()
    joined = _slot_fields(specs, roles, fields).join(known, [*SLIDE, "structure_id"], "left")
    on_shape, sk = F.col("target_type") == "shape", F.col("structure_kind")
    keys, values = F.transform("pairs", lambda p: p["field_id"]), F.transform("pairs", lambda p: p["to"])
    allowed = F.create_map(*[x for kind, names in FIELD_ROLES.items() for x in (F.lit(kind), words(names))])
    roles_of_kind = F.try_element_at(allowed, F.col("kind"))
    repeat = ~on_shape & (sk == "repeat")
    fits = repeat & roles_of_kind.isNotNull()
    rules = [
        ("field_roles_on_shape", on_shape & (F.size("pairs") > 0)),
        ("unknown_structure", ~on_shape & sk.isNull()),
        ("static_visual_slot", ~on_shape & (sk == "static_visual")),
        ("grid_requires_table", ~on_shape & (sk == "grid") & (F.col("kind") != "table")),
        ("grid_with_field_roles", ~on_shape & (sk == "grid") & (F.size("pairs") > 0)),
        ("repeat_kind_unsupported", repeat & roles_of_kind.isNull()),
        ("repeat_fields_mismatch", fits & ~_same_set(keys, F.col("fields"))),
        ("repeat_role_unknown", fits & (F.size(F.array_except(values, roles_of_kind)) > 0)),
        ("repeat_role_repeated", fits & (F.size(F.array_distinct(values)) < F.size(values))),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in rules]), lambda c: c.isNotNull())
    target = F.when(on_shape, F.concat(F.lit("shape:"), "shape_id")).otherwise(F.concat(F.lit("structure:"), "structure_id"))
    shared = specs.select(*SLOT, target.alias("target")).groupBy(*SLIDE, "target").agg(
        F.count(F.lit(1)).alias("n"), F.max("slot_id").alias("slot_id")
    ).filter("n > 1")
    unknown = specs.filter(on_shape).join(shapes.select(*SLIDE, "shape_id"), [*SLIDE, "shape_id"], "left_anti")
    frames = [
        joined.select(*SLOT, F.explode(found).alias("code")),
        unknown.select(*SLOT, F.lit("unknown_shape").alias("code")),
        shared.select(*SLOT, F.lit("target_owned_twice").alias("code")),
    ]
    if expected is not None and described is not None:
        none = F.lit(None).cast("string").alias("slot_id")
        frames += [
            expected.join(described, SLIDE, "left_anti").select(*SLIDE, none, F.lit("slide_not_described").alias("code")),
            described.join(expected, SLIDE, "left_anti").select(*SLIDE, none, F.lit("slide_not_expected").alias("code")),
            described.groupBy(*SLIDE).count().filter("count > 1").select(*SLIDE, none, F.lit("slide_described_twice").alias("code")),
        ]
    return union_all(frames)


def expand_bindings(specs: DataFrame, roles: DataFrame, shapes: DataFrame, members: DataFrame) -> DataFrame:
    """One binding per shape with its renderer, mode and JSON pointer.

    Image shapes are skipped for slots of other kinds. ``members`` carries ``kind`` and ``header_rows``.
    """
    typed = shapes.select(*SLIDE, "shape_id", F.col("type").alias("shape_type"))
    columns = [*SLOT, "slot_ix", "shape_id", "renderer", "value_path", "mode", "place", "place_in"]
    single = specs.filter("target_type = 'shape'").join(typed, [*SLIDE, "shape_id"]).filter(
        "shape_type <> 'image' or kind = 'image'"
    )
    kind, shape_type = F.col("kind"), F.col("shape_type")
    native = shape_type.isin("table", "chart")
    renderer = (
        F.when((kind == "visual") & native, shape_type)
        .when(kind == "visual", "visual")
        .when((kind == "image") & (shape_type == "image"), "image")
        .when(kind == "image", "image_box")
        .otherwise(shape_type)
    )
    plain = ~kind.isin("visual", "image")
    path = F.when(plain & native, "/").when(plain & (kind == "bullet_list"), "/items").when(plain, "/text")
    mode = F.when(plain & native, "native").when(plain & (kind == "bullet_list"), "paragraphs").otherwise("scalar")
    one = single.withColumn("renderer", renderer).withColumn("value_path", path).withColumn("mode", mode).withColumn("place", F.lit(0)).withColumn("place_in", F.lit(0))
    body = F.col("row") - F.col("header_rows")
    inside = specs.filter("target_type = 'structure'").select(*SLOT, "slot_ix", "structure_id").join(
        members.filter("role = 'content'").drop("role"), [*SLIDE, "structure_id"]
    )
    grid = inside.filter("kind = 'grid'").withColumn("renderer", F.lit("text")).withColumn("mode", F.lit("scalar")).withColumn(
        "value_path",
        F.when(F.col("row") < F.col("header_rows"), F.format_string("/columns/%d", "col")).otherwise(
            F.format_string("/rows/%d/%d", body, F.col("col"))
        ),
    ).withColumn("place", F.col("row")).withColumn("place_in", F.col("col"))
    repeat = inside.filter("kind = 'repeat'").join(roles, [*SLOT, "field_id"]).withColumn("renderer", F.lit("text")).withColumn(
        "value_path", F.format_string("/items/%d/%s", F.col("item_ix"), F.col("role"))
    ).withColumn("mode", F.when(F.col("role") == "details", "paragraphs").otherwise("scalar")).withColumn("place", F.col("item_ix")).withColumn("place_in", F.lit(0))
    return union_all([df.select(*columns) for df in (one, grid, repeat)])


def visual_capabilities(shapes: DataFrame, tag: str = MARKER) -> DataFrame:
    """Kinds, subtypes, size and grid limits of a shape used as a visual anchor.

    ``shapes`` may carry ``chart_type, table_rows, table_columns``; ``tag`` marks a placeholder for a visual.
    """
    marker = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("alt_text", F.lit(""))))
    named = F.regexp_extract(marker, tag + r":([a-z_, -]+)", 1)
    listed = F.filter(F.split(named, "[, ]+"), lambda v: v.isin(VISUAL_KINDS))
    kind = F.col("type")
    kinds = F.when(kind.isin("chart", "table"), F.array(kind)).when(F.size(listed) > 0, listed).otherwise(words(VISUAL_KINDS))
    native = F.lower(F.coalesce("chart_type", F.lit("")))
    tokens = [("bar", "bar"), ("column", "column"), ("line", "line"), ("area", "area"), ("pie", "pie"), ("doughnut", "donut"), ("xy_", "scatter"), ("scatter", "scatter")]
    found = F.coalesce(*[F.when(F.contains(native, F.lit(token)), F.lit(value)) for token, value in tokens])
    none = F.array().cast("array<string>")
    subtypes = (
        F.when((kind == "chart") & found.isNotNull(), F.array(found))
        .when(kind.isin("chart", "table"), none)
        .otherwise(words(ALL_SUBTYPES))
    )
    width, height = (F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(0.01)) for c in ("width", "height"))
    return shapes.select(
        *SLIDE, "shape_id", kinds.alias("cap_kinds"), subtypes.alias("cap_subtypes"),
        F.when(kind.isin("chart", "table"), "existing_object").otherwise("container").alias("render_mode"),
        width.alias("cap_width"), height.alias("cap_height"), (width / height).alias("aspect_ratio"),
        F.lit(12).alias("max_items"),
        F.when(F.col("table_rows").isNotNull(), F.greatest(F.lit(1), F.col("table_rows") - 1)).alias("max_rows"),
        F.col("table_columns").alias("max_columns"),
    )


def chart_preferences(text: Column) -> Column:
    """Chart subtypes hinted at in a text, in a fixed order."""
    return F.filter(
        F.array(*[F.when(F.lower(text).rlike(pattern), F.lit(name)) for name, pattern in CHART_WORDS.items()]), lambda s: s.isNotNull()
    )


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\wа-яё]+)"), F.lit(1))


def promote_visual_image(specs: DataFrame, shapes: DataFrame, slides: DataFrame) -> DataFrame:
    """On chart and content-visual slides the largest free image slot with a visual role becomes a visual."""
    visual = slides.filter(F.col("classification").isin("chart", "content_visual")).select(*SLIDE)
    images = shapes.filter("type = 'image' and not in_group").select(*SLIDE, "shape_id", (F.col("width") * F.col("height")).alias("area"))
    able = specs.filter("target_type = 'shape' and kind = 'image'").filter(F.arrays_overlap(tokens(F.col("role")), words(VISUAL_ROLE_WORDS)))
    best = able.join(visual, SLIDE, "left_semi").join(images, [*SLIDE, "shape_id"]).groupBy(*SLIDE).agg(
        F.max_by("slot_id", F.struct(F.col("area"), -F.col("slot_ix"))).alias("slot_id")
    ).withColumn("promoted", F.lit(True))
    won = F.coalesce("promoted", F.lit(False))
    return specs.join(best, SLOT, "left").withColumn("kind", F.when(won, "visual").otherwise(F.col("kind"))).withColumn(
        "role", F.when(won, "structured visual").otherwise(F.col("role"))
    ).withColumn("required", F.col("required") & ~won).withColumn("promoted", won)


def _free_shapes(shapes: DataFrame, owned: DataFrame, structural: DataFrame) -> DataFrame:
    keys = [*SLIDE, "shape_id"]
    return shapes.join(owned.select(*keys), keys, "left_anti").join(structural.select(*keys), keys, "left_anti")


def _free_names(candidates: DataFrame, existing: DataFrame, base: str, rank: str) -> DataFrame:
    """Name the zero-based ``rank``-th candidate of a slide ``base``, ``base_2``, ... past taken names."""
    number = F.when(F.col("slot_id") == base, F.lit(1)).otherwise(
        F.regexp_extract("slot_id", rf"^{base}_(\d+)$", 1).try_cast("int")
    )
    taken = existing.select(*SLIDE, number.alias("n")).filter("n is not null").groupBy(*SLIDE).agg(F.array_sort(F.collect_set("n")).alias("taken"))
    none = F.array().cast("array<int>")
    joined = candidates.join(taken, SLIDE, "left").withColumn("taken", F.coalesce("taken", none))
    # The k-th free number: step over every taken number that is not beyond it.
    number = F.aggregate("taken", F.col(rank) + 1, lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    return joined.withColumn("_n", number).withColumn(
        "slot_id", F.when(F.col("_n") == 1, F.lit(base)).otherwise(F.concat(F.lit(f"{base}_"), "_n"))
    ).drop("taken", "_n")


def unclaimed_visuals(shapes: DataFrame, slots: DataFrame, owned: DataFrame, structural: DataFrame, tag: str = MARKER) -> DataFrame:
    """Optional visual slots for free native charts, tables and marked shapes.

    ``slots``: ``deck_id, slide_number, slot_id`` in use; ``owned`` and ``structural``: shapes that
    belong to slots or structures.
    """
    marker = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("alt_text", F.lit(""))))
    native = F.col("type").isin("chart", "table")
    free = _free_shapes(shapes, owned, structural).filter("not in_group").filter(native | F.contains(marker, F.lit(tag)))
    order = F.when(native, 0).otherwise(1)
    ranked = renumber_by(
        free.withColumn("_group", order), SLIDE, F.col("_group") * (1 << 20) + F.floor(F.col("shape_id") / 65536), ["_group", "shape_id"], "rank"
    )
    named = _free_names(ranked, slots, "visual", "rank")
    return named.select(
        *SLOT, F.lit("visual").alias("kind"), F.lit("structured visual").alias("role"), "shape_id",
        F.when(native, F.col("type")).otherwise("visual").alias("renderer"), F.lit(False).alias("required"), F.lit(12).alias("capacity"),
    )


def is_placeholder(text: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(squeeze(F.lower(text)), F.lit("")), "^[.:*]+|[.:*]+$", "")
    return plain.isin(PLACEHOLDER_TEXTS)


def fallback_slots(shapes: DataFrame, slots: DataFrame, owned: DataFrame, structural: DataFrame) -> DataFrame:
    """Slots for free title placeholders and one shared slot for free generic placeholders, per shape:
    ``slot_id, kind, shape_id, value_path, capacity``."""
    free = _free_shapes(shapes, owned, structural).filter("type = 'text'")
    is_title = F.coalesce(F.lower("placeholder_type").isin("title", "center_title"), F.lit(False))
    bucket = F.floor(F.col("shape_id") / 65536)
    titles = _free_names(renumber_by(free.filter(is_title), SLIDE, bucket, ["shape_id"], "rank"), slots, "fallback_title", "rank").select(
        *SLOT, F.lit("text").alias("kind"), "shape_id", F.lit("/text").alias("value_path"), F.lit(None).cast("int").alias("capacity")
    )
    generic = renumber_by(free.filter(~is_title & is_placeholder(F.col("text"))), SLIDE, bucket, ["shape_id"], "place")
    sizes = generic.groupBy(*SLIDE).agg(F.count(F.lit(1)).cast("int").alias("n"))
    shared = _free_names(sizes.withColumn("rank", F.lit(0)), slots, "fallback_text", "rank")
    many = F.col("n") > 1
    texts = generic.join(shared, SLIDE).select(
        *SLOT, F.when(many, "bullet_list").otherwise("text").alias("kind"), "shape_id",
        F.when(many, F.concat(F.lit("/items/"), "place")).otherwise("/text").alias("value_path"),
        F.when(many, F.col("n")).alias("capacity"),
    )
    return titles.unionByName(texts)



def synthesize_chart_canvas(slides: DataFrame, slots: DataFrame, targets: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chart canvases, one per fitting slide, and the shapes each must preserve.

    ``slides``: class, description, ``tags``, ``chart_text``; ``slots``: ``slot_id, kind, role``;
    ``targets``: ``slot_id, shape_id``; ``shapes``: top-level shapes.
    """
    dedicated = slides.groupBy("deck_id").agg(F.bool_or(F.coalesce(F.col("classification") == "chart", F.lit(False))).alias("dedicated"))
    wanted = F.when(F.col("dedicated"), F.col("classification") == "chart").otherwise(F.col("classification") == "content_visual")
    candidates = slides.join(dedicated, "deck_id").filter(wanted)
    by_role = F.arrays_overlap(F.regexp_extract_all(F.lower("role"), F.lit("([a-zа-яё]+)"), F.lit(1)), words(TITLE_WORDS))
    place = shapes.select(*SLIDE, "shape_id", F.lower(F.coalesce("placeholder_type", F.lit(""))).alias("place"), (F.col("y") + F.col("height")).alias("bottom"))
    told = slots.filter("kind = 'text'").join(targets, SLOT).join(place, [*SLIDE, "shape_id"], "left").withColumn(
        "by_place", F.coalesce(F.col("place").isin("title", "center_title"), F.lit(False))
    )
    title_slots = told.groupBy(*SLOT).agg(F.bool_or(by_role | F.col("by_place")).alias("is_title")).filter("is_title")
    titles = told.join(title_slots, SLOT, "left_semi").join(candidates.select(*SLIDE), SLIDE, "left_semi").select(*SLIDE, "shape_id", "bottom")
    tops = titles.groupBy(*SLIDE).agg(F.greatest(F.lit(CANVAS_TOP), F.coalesce(F.max("bottom"), F.lit(0.0)) + CANVAS_GAP).alias("y"))
    text = F.concat_ws(" ", F.coalesce(F.array_join("tags", " "), F.lit("")), "description", "chart_text")
    canvases = candidates.join(tops.filter(F.col("y") < CANVAS_BOTTOM), SLIDE).select(
        *SLIDE, F.lit(CANVAS_LEFT).alias("x"), "y", F.lit(CANVAS_WIDTH).alias("width"), (F.lit(CANVAS_BOTTOM) - F.col("y")).alias("height"),
        chart_preferences(text).alias("preferred_subtypes"), F.col("dedicated").alias("required"),
    )
    semantic = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("alt_text", F.lit(""))))
    footer = (F.col("y") >= 0.90) & (F.col("height") <= 0.10)
    kept = shapes.filter(semantic.rlike(BRAND) | footer).select(*SLIDE, "shape_id").unionByName(titles.select(*SLIDE, "shape_id"))
    preserved = kept.join(canvases.select(*SLIDE), SLIDE, "left_semi").distinct()
    return canvases, preserved



def select_chart_canvas(canvases: DataFrame) -> DataFrame:
    """Best canvas per deck and chart subtype: exact preference, same family, any; then area, slide.

    Rows: ``deck_id, slide_number, width, height, preferred_subtypes`` and optional ``family_ix, slot_ix``
    for full ties. Seven rows per canvas meet in one min aggregation.
    """
    subtype = F.explode(words(CHART_SUBTYPES)).alias("subtype")
    rows = canvases.select("*", subtype)
    if "supported_subtypes" in canvases.columns:
        rows = rows.filter(F.array_contains("supported_subtypes", F.col("subtype")))
    radial = F.col("subtype").isin(RADIAL)
    family = F.exists("preferred_subtypes", lambda s: s.isin(RADIAL) == radial)
    match = F.when(F.array_contains("preferred_subtypes", F.col("subtype")), 0).when(family, 1).otherwise(2)
    ties = [c for c in ("family_ix", "slot_ix") if c in canvases.columns]
    order = F.struct(match, -(F.col("width") * F.col("height")), F.col("slide_number"), *map(F.col, ties))
    return rows.groupBy("deck_id", "subtype").agg(F.min_by("slide_number", order).alias("slide_number"))


def split_mixed_families(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """``deck_id, family_id, slide_number, classification``: families of one class each.

    ``groups``: ``deck_id, family_ix, family_id, slide_number, place``. Names are resolved in family
    order per deck, over one entry per (family, class).
    """
    told = groups.join(classes, SLIDE)
    parts = told.groupBy("deck_id", "family_ix", "family_id", "classification").agg(F.min("place").alias("first"))
    packed = parts.groupBy("deck_id").agg(
        F.array_sort(F.collect_list(F.struct("family_ix", "first", "family_id", "classification"))).alias("parts"),
    )
    numbers = F.transform("parts", lambda p: p["family_ix"])
    reserved = F.transform("parts", lambda p: p["family_id"])

    def name(used: Column, part: Column) -> Column:
        mixed = F.size(F.filter(numbers, lambda n: n == part["family_ix"])) > 1
        base = F.when(mixed, F.concat_ws("_", part["family_id"], part["classification"])).otherwise(part["family_id"])
        tries = F.concat(F.array(base), F.transform(F.sequence(F.lit(2), F.size("parts") + F.size(used) + 2), lambda n: F.concat(base, F.lit("_"), n)))
        free = F.filter(tries, lambda c: ~F.array_contains(used, c) & ~F.array_contains(reserved, c))
        keep = ~mixed & ~F.array_contains(used, part["family_id"])
        return F.concat(used, F.array(F.when(keep, part["family_id"]).otherwise(F.get(free, F.lit(0)))))

    names = F.aggregate("parts", F.array().cast("array<string>"), name)
    named = packed.select("deck_id", F.inline(F.arrays_zip(F.col("parts").alias("p"), names.alias("new_id"))))
    return told.join(
        named.select("deck_id", "p.family_ix", "p.classification", "new_id"), ["deck_id", "family_ix", "classification"]
    ).select(*SLIDE, "classification", F.col("new_id").alias("family_id"))


def validate_grouping(groups: DataFrame, slides: DataFrame) -> DataFrame:
    """``deck_id, code, item``. ``groups``: ``deck_id, family_ix, family_id, slide_number``."""
    counted = slides.select(*SLIDE).distinct().withColumn("known", F.lit(True)).join(
        groups.groupBy(*SLIDE).agg(F.count(F.lit(1)).alias("n")), SLIDE, "full_outer"
    )
    code = F.when(F.col("n").isNull(), "slide_without_family").when(F.col("known").isNull(), "unknown_slide").when(F.col("n") > 1, "slide_in_two_families")
    slides_bad = counted.withColumn("code", code).filter("code is not null").select("deck_id", "code", F.col("slide_number").cast("string").alias("item"))
    families = groups.select("deck_id", "family_ix", "family_id").distinct().groupBy("deck_id", "family_id").count().filter("count > 1")
    return slides_bad.unionByName(families.select("deck_id", F.lit("duplicate_family_id").alias("code"), F.col("family_id").alias("item")))


def validate_catalog(
    families: DataFrame, slots: DataFrame, targets: DataFrame, bindings: DataFrame, statics: DataFrame, canvases: DataFrame
) -> DataFrame:
    """``deck_id, slide_number, code, item`` for everything a catalog must not hold.

    ``families``: ``deck_id, family_ix, family_id, slide_number``; ``slots``: ``slot_id, kind, has_canvas``.
    """
    none = F.lit(None).cast("string")

    def rule(df: DataFrame, code: str, item: Column = none) -> DataFrame:
        number = F.col("slide_number") if "slide_number" in df.columns else F.lit(None).cast("int")
        return df.select("deck_id", number.alias("slide_number"), F.lit(code).alias("code"), item.cast("string").alias("item")).distinct()

    keys = [*SLOT, "shape_id"]
    plain = slots.filter("not has_canvas")
    bound, meant = bindings.select(*keys).distinct(), targets.select(*keys).distinct()
    fits = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("width") > 0) & (F.col("height") > 0) & (
        F.col("x") + F.col("width") <= 1.000001
    ) & (F.col("y") + F.col("height") <= 1.000001)
    preserved = F.col("preferred_subtypes")
    return union_all([
        rule(slots.groupBy(*SLOT).count().filter("count > 1"), "duplicate_slot_id", F.col("slot_id")),
        rule(targets.groupBy(*SLIDE, "shape_id").count().filter("count > 1"), "shape_in_two_slots", F.col("shape_id")),
        rule(targets.join(statics.select(*SLIDE, "shape_id"), [*SLIDE, "shape_id"], "left_semi"), "shape_editable_and_static", F.col("shape_id")),
        rule(families.groupBy(*SLIDE).count().filter("count > 1"), "slide_in_two_families"),
        rule(families.select("deck_id", "family_ix", "family_id").distinct().groupBy("deck_id", "family_id").count().filter("count > 1"), "duplicate_family_id", F.col("family_id")),
        rule(bindings.groupBy(*keys).count().filter("count > 1"), "duplicate_binding", F.col("slot_id")),
        rule(bound.join(meant, keys, "left_anti").unionByName(meant.join(bound, keys, "left_anti")).join(plain, SLOT, "left_semi"), "bindings_not_cover_targets", F.col("slot_id")),
        rule(plain.join(targets, SLOT, "left_anti"), "slot_without_target", F.col("slot_id")),
        rule(slots.filter("has_canvas and (kind <> 'visual' or slot_id <> 'chart_visual')"), "canvas_on_wrong_slot", F.col("slot_id")),
        rule(slots.filter("has_canvas").join(targets, SLOT, "left_semi"), "canvas_with_target", F.col("slot_id")),
        rule(canvases.filter(~fits), "canvas_out_of_slide"),
        rule(canvases.filter(F.size(preserved) > F.size(F.array_distinct(preserved))), "duplicate_preferred_subtype"),
    ])


def project_catalog(families: DataFrame, variants: DataFrame, slots: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Slots without their bindings, for variants that have any; optionally only ``selected`` variants.

    ``variants``: ``deck_id, family_id, slide_number, description``.
    """
    kept = variants if selected is None else variants.join(selected, ["deck_id", "family_id", "slide_number"], "left_semi")
    columns = [c for c in slots.columns if c not in ("bindings", "value_path", "renderer", "mode")]
    return kept.join(slots.select(*columns), SLIDE).join(
        families.select("deck_id", "family_id", "slide_class", F.col("description").alias("family_description")), ["deck_id", "family_id"]
    )


def catalog_enums(projected: DataFrame) -> DataFrame:
    """Distinct names a plan may choose from: ``deck_id, kind, value``."""
    parts = [("family", "family_id"), ("variant", "slide_number"), ("slot", "slot_id")]
    named = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("value")) for kind, column in parts]))
    return projected.select("deck_id", named.alias("e")).select("deck_id", "e.kind", "e.value").distinct()


def catalog_freshness(manifests: DataFrame, catalogs: DataFrame, schema_version: str, prompt_version: str) -> DataFrame:
    """``deck_id, reusable``: the stored catalog has the deck's source hash and the current versions."""
    current = catalogs.filter((F.col("schema_version") == schema_version) & (F.col("prompt_version") == prompt_version)).select(
        "deck_id", "source_sha256"
    ).distinct().withColumn("reusable", F.lit(True))
    return manifests.join(current, ["deck_id", "source_sha256"], "left").select("deck_id", F.coalesce("reusable", F.lit(False)).alias("reusable"))
