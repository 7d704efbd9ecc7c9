"""Layout mining over shape boxes: clusters, bands, grids, repeats, visual groups.

``shapes``: ``deck_id, slide_number, shape_id, type, x, y, width, height`` (boxes in slide units) and
optionally text fields. Slides are never gathered: clusters are found on the distinct coordinates of a
slide, and the number of bands per slide is bounded by the slide size over the tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.numbering import renumber, renumber_by
from plinth.functions.scalars import bound, squeeze
from plinth.functions.selection import median_by_counts
from plinth.issues import union_all
from plinth.session import set_down

SLIDE = ["deck_id", "slide_number"]
# Fixed values.
ALIGN_LIMIT = 0.035
THIN = 0.012
COVERAGE = 0.75
VISUAL_CLASSES = ["chart", "timeline", "process", "comparison", "content_visual"]
CELL = 0.05  # bin of the containment join; any value gives the same result


def flatten_shapes(slides: DataFrame) -> DataFrame:
    """Leaves of the nested ``elements`` column, depth first, with ``in_group`` and ``depth``.

    The nesting is as deep as the read schema; each level is one ``explode``.
    """
    keys = [c for c in slides.columns if c != "elements"]
    level = slides.select(
        *keys, F.lit(False).alias("in_group"), F.lit(None).cast("int").alias("parent_shape_id"),
        F.array().cast("array<int>").alias("path"), F.posexplode("elements").alias("pos", "e"),
    )
    frames, depth = [], 0
    fields = None
    while True:
        names = level.schema["e"].dataType.fieldNames()
        fields = fields or [n for n in names if n != "children"]
        path = F.concat("path", F.array("pos"))
        frames.append(
            level.filter("e.type <> 'group'").select(
                *keys, *[F.col("e")[n].alias(n) for n in fields], "in_group", "parent_shape_id",
                F.lit(depth).alias("depth"), path.alias("path"),
            )
        )
        if "children" not in names:
            return union_all(frames)
        level = level.select(
            *keys, (F.col("in_group") | (F.col("e.type") == "group")).alias("in_group"),
            F.col("e.shape_id").alias("parent_shape_id"), path.alias("path"),
            F.posexplode("e.children").alias("pos", "e"),
        )
        depth += 1


def chart_inventory(shapes: DataFrame) -> DataFrame:
    """Distinct non-empty labels of native charts in first-seen order: ``part, ix, label``."""
    parts = [
        F.struct(F.lit(part).alias("part"), F.array_distinct(F.filter(F.transform(F.col(column), squeeze), lambda t: t != "")).alias("labels"))
        for part, column in (("category", "chart.category_labels"), ("series", "chart.series_names"))
    ]
    told = shapes.filter("chart is not null").select(*SLIDE, "shape_id", F.inline(F.array(*parts)))
    return told.select(*SLIDE, "shape_id", "part", F.posexplode("labels").alias("ix", "label"))


def table_inventory(shapes: DataFrame) -> DataFrame:
    return shapes.filter("table is not null").select(*SLIDE, "shape_id", F.inline("table.cells"))


def style_tokens(slides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sorted distinct fonts and colours per slide, and the same rolled up per deck."""

    def tidy(column: str) -> Column:
        return F.array_sort(F.array_distinct(F.filter(column, lambda t: t.isNotNull() & (t != ""))))

    per_slide = slides.select(*SLIDE, tidy("theme_fonts").alias("fonts"), tidy("palette").alias("colours"))
    tokens = union_all([
        per_slide.select("deck_id", F.lit(kind).alias("kind"), F.explode(column).alias("token"))
        for kind, column in (("font", "fonts"), ("colour", "colours"))
    ])
    return per_slide, tokens.distinct()


def center(axis: str) -> Column:
    return F.col(axis) + F.col("width" if axis == "x" else "height") / 2


def _cluster_starts(centres: Column, tolerance: Column) -> Column:
    """First centre of each cluster, walking sorted ``(c, n)`` pairs with the running mean."""
    empty = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("starts"))

    def step(state: Column, one: Column) -> Column:
        joins = (state["n"] > 0) & (F.abs(one["c"] - state["total"] / state["n"]) <= tolerance)
        weight = one["c"] * one["n"]
        return F.when(
            joins,
            F.struct((state["total"] + weight).alias("total"), (state["n"] + one["n"]).alias("n"), state["starts"].alias("starts")),
        ).otherwise(
            F.struct(weight.alias("total"), one["n"].alias("n"), F.concat(state["starts"], F.array(one["c"])).alias("starts"))
        )

    return F.aggregate(centres, empty, step, lambda s: s["starts"])


def cluster_axis(shapes: DataFrame, axis: str, tolerances: DataFrame) -> DataFrame:
    """Add ``centre`` and ``cluster`` along ``axis``. ``tolerances``: ``deck_id, slide_number, tolerance``.

    The walk over a slide's centres is cut where it can be cut: a centre further than the tolerance from the one on its
    left starts a cluster whatever came before, as the running mean never lies right of the last centre. Such gaps lie
    between stretches of one tolerance each, so a slide's own window has one row per stretch, and the pieces in between
    are walked apart, in tasks of their own. Shapes with one centre always share a cluster and count as one step.
    """
    placed = shapes.withColumn("centre", center(axis))
    stretch = F.floor(F.col("centre") / F.greatest("tolerance", F.lit(1e-9))).alias("stretch")
    steps = placed.join(tolerances, SLIDE).groupBy(*SLIDE, "tolerance", stretch, "centre").agg(F.count(F.lit(1)).alias("n"))
    held = steps.groupBy(*SLIDE, "tolerance", "stretch").agg(
        F.sort_array(F.collect_list(F.struct(F.col("centre").alias("c"), "n"))).alias("centres"), F.min("centre").alias("first"), F.max("centre").alias("last")
    )
    along = Window.partitionBy(*SLIDE).orderBy("stretch")
    cut = F.coalesce(F.col("first") - F.lag("last").over(along) > F.col("tolerance"), F.lit(True))
    pieces = held.withColumn("cut", cut.cast("int")).withColumn("piece", F.sum("cut").over(along)).groupBy(*SLIDE, "tolerance", "piece").agg(
        F.sort_array(F.collect_list(F.struct("stretch", "centres"))).alias("held")
    )
    centres = F.flatten(F.transform("held", lambda h: h["centres"]))
    starts = pieces.select(*SLIDE, _cluster_starts(centres, F.col("tolerance")).alias("starts")).groupBy(*SLIDE).agg(F.flatten(F.collect_list("starts")).alias("starts"))
    index = F.size(F.filter("starts", lambda s: s <= F.col("centre"))) - 1
    return placed.join(starts, SLIDE).withColumn("cluster", index.cast("int")).drop("starts")


def tolerance(shapes: DataFrame, size: str, factor: float, low: float, high: float) -> DataFrame:
    """Clamped share of the median size, with the number of shapes it rests on."""
    sized = median_by_counts(shapes, SLIDE, size)
    return sized.select(*SLIDE, F.col("n").alias("n_free"), F.greatest(F.lit(low), F.least(F.lit(high), F.col("median") * factor)).alias("tolerance"))


def bands(clustered: DataFrame, item_axis: str) -> DataFrame:
    """Members of clusters of two or more: ``cluster, shape_id, ix, anchor, n, band_centre``."""
    sizes = clustered.groupBy(*SLIDE, "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg("centre").alias("band_centre")
    ).filter("n >= 2")
    members = clustered.withColumn("item_centre", center(item_axis)).withColumn("anchor", F.col(item_axis))
    bucket = F.floor(F.col("item_centre") * 256)
    numbered = renumber_by(members, [*SLIDE, "cluster"], bucket, ["item_centre", "shape_id"], "ix")
    return numbered.join(sizes, [*SLIDE, "cluster"]).select(
        *SLIDE, "cluster", "shape_id", "ix", "anchor", "n", "band_centre"
    )


def align_bands(members: DataFrame) -> DataFrame:
    """``cluster, other`` pairs (each with itself too) of equal size whose edges agree place by place.

    Bands of a slide are at least one tolerance apart, so a slide has few of them however many
    shapes it holds; members only meet the member at the same place of another band.
    """
    left = members.select(*SLIDE, "n", "ix", "cluster", "anchor")
    right = members.select(*SLIDE, "n", "ix", F.col("cluster").alias("other"), F.col("anchor").alias("other_anchor"))
    near = F.abs(F.col("anchor") - F.col("other_anchor")) <= ALIGN_LIMIT
    return (
        left.join(right, [*SLIDE, "n", "ix"])
        .groupBy(*SLIDE, "n", "cluster", "other").agg(F.bool_and(near).alias("aligned"))
        .filter("aligned").drop("aligned")
    )


def regular(values: Column) -> Column:
    """True for evenly spaced sorted values; fewer than three always are."""

    def even(gaps: Column, ranked: Column) -> Column:
        count = F.size(ranked)
        middle = (F.get(ranked, F.floor((count - 1) / 2).cast("int")) + F.get(ranked, F.floor(count / 2).cast("int"))) / 2
        return bound(middle, lambda m: (m > 0.01) & bound(
            F.greatest(F.lit(0.018), m * 0.35), lambda limit: F.forall(gaps, lambda g: F.abs(g - m) <= limit)
        ))

    def told(v: Column) -> Column:
        gaps = F.zip_with(F.slice(v, F.lit(2), F.size(v) - 1), F.slice(v, F.lit(1), F.size(v) - 1), lambda a, b: a - b)
        return F.when(F.size(v) < 3, F.lit(True)).otherwise(bound(gaps, lambda g: bound(F.array_sort(g), lambda ranked: even(g, ranked))))

    return bound(values, told)


def spacing_regular(bands_of_slide: DataFrame) -> DataFrame:
    """``deck_id, slide_number, is_regular`` over the centres of a slide's bands."""
    centres = F.array_sort(F.collect_list("band_centre"))
    distinct = bands_of_slide.select(*SLIDE, "cluster", "band_centre").distinct()
    return distinct.groupBy(*SLIDE).agg(F.count(F.lit(1)).alias("n_bands"), regular(centres).alias("is_regular"))


def band_rows(clustered: DataFrame, item_axis: str) -> DataFrame:
    """Clusters of two or more as rows: ``cluster, n, band_centre, members``, the members in their order along the band.

    A row holds one band, not a slide; place and edge of a member are its index and ``anchor``.
    """
    one = F.struct(center(item_axis).alias("item_centre"), "shape_id", F.col(item_axis).alias("anchor"))
    return clustered.groupBy(*SLIDE, "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg("centre").alias("band_centre"), F.sort_array(F.collect_list(one)).alias("members")
    ).filter("n >= 2")


def _best_alignment(held: DataFrame, free: DataFrame, least: int, spaced: bool) -> DataFrame:
    """Members of the widest aligned set of bands per slide, ``band_ix`` in order of centres and ``ix`` along the band.

    ``held``: ``band_rows``. Bands of a slide are at least a tolerance apart, so few meet, each as the edges of its members.
    """
    edges = F.transform("members", lambda m: m["anchor"])
    left = held.select(*SLIDE, "n", "cluster", edges.alias("edges"))
    right = held.select(*SLIDE, "n", F.col("cluster").alias("other"), "band_centre", edges.alias("other_edges"))
    near = F.forall(F.zip_with("edges", "other_edges", lambda a, b: F.abs(a - b) <= ALIGN_LIMIT), lambda close: close)
    sets = left.join(right, [*SLIDE, "n"]).filter(near).groupBy(*SLIDE, "n", "cluster").agg(
        F.sort_array(F.collect_list(F.struct(F.col("band_centre").alias("c"), F.col("other").alias("b")))).alias("set")
    ).filter(F.size("set") >= least)
    if spaced:
        sets = sets.filter(regular(F.transform("set", lambda s: s["c"])))
    total = F.col("n") * F.size("set")
    best = sets.groupBy(*SLIDE).agg(
        F.max_by(F.struct("set", total.alias("total")), F.struct(total, -F.col("cluster"))).alias("best")
    )
    chosen = best.join(free, SLIDE).filter(F.col("best.total") >= F.col("n_free") * COVERAGE).select(*SLIDE, F.posexplode("best.set").alias("band_ix", "s"))
    return chosen.select(*SLIDE, "band_ix", F.col("s.b").alias("cluster")).join(held, [*SLIDE, "cluster"]).select(
        *SLIDE, "band_ix", F.posexplode("members").alias("ix", "m")
    ).select(*SLIDE, "band_ix", "ix", F.col("m.shape_id").alias("shape_id"))


def _without(shapes: DataFrame, occupied: DataFrame | None) -> DataFrame:
    return shapes if occupied is None else shapes.join(occupied, [*SLIDE, "shape_id"], "left_anti")


MEMBER_COLUMNS = [*SLIDE, "structure_id", "kind", "shape_id", "role", "row", "col", "field_id", "item_ix"]


def detect_grids(shapes: DataFrame) -> DataFrame:
    """Members of the grid of each slide that has one.

    A grid covers three quarters of the free texts, so a slide cannot hold two.
    """
    texts = shapes.filter("type = 'text'")
    free = tolerance(texts, "height", 0.45, 0.009, 0.025).filter("n_free >= 6")
    held = set_down(band_rows(cluster_axis(texts, "y", free.select(*SLIDE, "tolerance")), "x"))
    none = F.lit(None).cast("string")
    return _best_alignment(held, free, 3, True).select(
        *SLIDE, F.lit("grid_0").alias("structure_id"), F.lit("grid").alias("kind"), "shape_id",
        F.lit("content").alias("role"), F.col("band_ix").alias("row"), F.col("ix").alias("col"),
        none.alias("field_id"), none.cast("int").alias("item_ix"),
    )


def grid_decorations(shapes: DataFrame, grids: DataFrame) -> DataFrame:
    """Images that cross a grid's box and are thin or contain it."""
    boxes = grids.select(*SLIDE, "structure_id", "shape_id").join(shapes, [*SLIDE, "shape_id"]).groupBy(*SLIDE, "structure_id").agg(
        F.min("x").alias("left"), F.max(F.col("x") + F.col("width")).alias("right"),
        F.min("y").alias("top"), F.max(F.col("y") + F.col("height")).alias("bottom"),
    )
    images = shapes.filter("type = 'image'").join(boxes, SLIDE)
    x2, y2 = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    thin = F.least("width", "height") <= THIN
    crosses = (F.col("x") <= F.col("right")) & (x2 >= F.col("left")) & (F.col("y") <= F.col("bottom")) & (y2 >= F.col("top"))
    contains = (
        (F.col("x") <= F.col("left") + 0.02) & (x2 >= F.col("right") - 0.02)
        & (F.col("y") <= F.col("top") + 0.02) & (y2 >= F.col("bottom") - 0.02)
    )
    none = F.lit(None).cast("int")
    return images.filter(crosses & (thin | contains)).select(
        *SLIDE, "structure_id", F.lit("grid").alias("kind"), "shape_id", F.lit("decoration").alias("role"),
        none.alias("row"), none.alias("col"), F.lit(None).cast("string").alias("field_id"), none.alias("item_ix"),
    )


def detect_repeats(shapes: DataFrame, axis: str) -> DataFrame:
    """Members of a repeated component whose fields are bands along ``axis`` and items are places."""
    texts = shapes.filter("type = 'text'").filter(F.least("width", "height") > THIN)
    size = "height" if axis == "y" else "width"
    free = tolerance(texts, size, 0.55, 0.012, 0.035).filter("n_free >= 4")
    held = set_down(band_rows(cluster_axis(texts, axis, free.select(*SLIDE, "tolerance")), "x" if axis == "y" else "y"))
    none = F.lit(None).cast("int")
    return _best_alignment(held, free, 2, False).select(
        *SLIDE, F.lit("repeat_0").alias("structure_id"), F.lit("repeat").alias("kind"), "shape_id",
        F.lit("content").alias("role"), none.alias("row"), none.alias("col"),
        F.concat(F.lit("field_"), "band_ix").alias("field_id"), F.col("ix").alias("item_ix"),
    )


def containment_groups(shapes: DataFrame) -> DataFrame:
    """``group_id, shape_id`` for each image that has at least two shape centres inside it.

    Both sides meet on (slide, bin of the centre): a shape lies in one bin, an image covers a bounded
    number of them.
    """
    slack = 0.015
    images = shapes.filter("type = 'image'").filter(F.least("width", "height") > THIN).select(
        *SLIDE, F.col("shape_id").alias("group_id"), (F.col("x") - slack).alias("x1"), (F.col("x") + F.col("width") + slack).alias("x2"),
        (F.col("y") - slack).alias("y1"), (F.col("y") + F.col("height") + slack).alias("y2"),
    )

    def bins(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / CELL), F.floor(F.col(high) / CELL)))

    covered = images.withColumn("bx", bins("x1", "x2")).withColumn("by", bins("y1", "y2"))
    points = shapes.select(*SLIDE, "shape_id", center("x").alias("cx"), center("y").alias("cy")).withColumn(
        "bx", F.floor(F.col("cx") / CELL)
    ).withColumn("by", F.floor(F.col("cy") / CELL))
    inside = F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2"))
    held = points.join(covered, [*SLIDE, "bx", "by"]).filter(inside).select(*SLIDE, "group_id", "shape_id")
    large = held.groupBy(*SLIDE, "group_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return held.join(large, [*SLIDE, "group_id"], "left_semi")


def composite_groups(shapes: DataFrame, slides: DataFrame) -> DataFrame:
    """On visual slide classes with two images: everything below the top image, as group -1."""
    tops = shapes.filter("type = 'image'").filter(F.least("width", "height") > THIN).groupBy(*SLIDE).agg(
        F.count(F.lit(1)).alias("n"), F.min("y").alias("top")
    ).filter("n >= 2")
    visual = slides.filter(F.col("classification").isin(VISUAL_CLASSES)).select(*SLIDE)
    below = shapes.join(tops.join(visual, SLIDE, "left_semi"), SLIDE).filter(center("y") >= F.col("top") - 0.02)
    wide = below.groupBy(*SLIDE).agg(F.count(F.lit(1)).alias("m")).filter("m >= 2")
    return below.join(wide, SLIDE, "left_semi").select(*SLIDE, F.lit(-1).alias("group_id"), "shape_id")


def merge_overlapping_groups(groups: DataFrame) -> DataFrame:
    """``shape_id, component``: groups that share a shape become one, named by its least shape.

    Least labels spread through groups and are then shortcut through their own labels, so the number
    of rounds grows with the logarithm of the chain length. Each round is checkpointed.
    """
    groups = set_down(groups.select(*SLIDE, "group_id", "shape_id").distinct())
    labels = set_down(groups.select(*SLIDE, "shape_id").distinct().withColumn("component", F.col("shape_id")))
    while True:
        through = groups.join(labels, [*SLIDE, "shape_id"]).groupBy(*SLIDE, "group_id").agg(F.min("component").alias("component"))
        spread = groups.join(through, [*SLIDE, "group_id"]).groupBy(*SLIDE, "shape_id").agg(F.min("component").alias("near"))
        target = spread.select(*SLIDE, F.col("shape_id").alias("near"), F.col("near").alias("far"))
        moved = spread.join(target, [*SLIDE, "near"]).join(labels, [*SLIDE, "shape_id"]).select(
            *SLIDE, "shape_id", F.least("near", "far").alias("component"), F.col("component").alias("before")
        )
        moved = set_down(moved)
        labels = moved.drop("before")
        if moved.filter("component <> before").isEmpty():
            return labels


def detect_static_visuals(shapes: DataFrame, slides: DataFrame) -> DataFrame:
    groups = containment_groups(shapes).unionByName(composite_groups(shapes, slides))
    merged = merge_overlapping_groups(groups)
    order = renumber(merged.select(*SLIDE, "component").distinct(), SLIDE, "component", "group_ix")
    none = F.lit(None).cast("int")
    return merged.join(order, [*SLIDE, "component"]).select(
        *SLIDE, F.concat(F.lit("static_visual_"), "group_ix").alias("structure_id"), F.lit("static_visual").alias("kind"),
        "shape_id", F.lit("content").alias("role"), none.alias("row"), none.alias("col"),
        F.lit(None).cast("string").alias("field_id"), none.alias("item_ix"),
    )


def detect_structures(shapes: DataFrame, slides: DataFrame) -> DataFrame:
    """Grids, then repeats by rows, then by columns, then visual groups; no shape is used twice."""
    keys = [*SLIDE, "shape_id"]
    shapes = set_down(shapes)
    grids = set_down(detect_grids(shapes))
    taken = set_down(grids.unionByName(grid_decorations(shapes, grids).join(grids, keys, "left_anti")))
    by_rows = set_down(detect_repeats(set_down(_without(shapes, taken.select(*keys))), "y"))
    used = taken.select(*keys).unionByName(by_rows.select(*keys))
    by_columns = detect_repeats(set_down(_without(shapes, used)), "x")
    has_rows = by_rows.select(*SLIDE).distinct().withColumn("_first", F.lit(True))
    by_columns = by_columns.join(has_rows, SLIDE, "left").withColumn(
        "structure_id", F.when(F.col("_first"), F.lit("repeat_1")).otherwise(F.lit("repeat_0"))
    ).drop("_first")
    found = set_down(union_all([df.select(*MEMBER_COLUMNS) for df in (taken, by_rows, by_columns)]))
    rest = set_down(_without(shapes, found.select(*keys)))
    return found.unionByName(detect_static_visuals(rest, slides).select(*MEMBER_COLUMNS))


def split_repeat_cycles(members: DataFrame, shapes: DataFrame) -> DataFrame:
    """Repeats with more than three fields become more items when their texts cycle; others are dropped.

    ``members``: repeat rows with ``field_ix, item_ix``. Every member is compared with the member of
    the same item one period back, for the periods 1, 2 and 3.
    """
    keys = [*SLIDE, "structure_id"]
    text = F.coalesce(squeeze(F.lower(F.col("text"))), F.lit(""))
    told = members.join(shapes.select(*SLIDE, "shape_id", text.alias("sign")), [*SLIDE, "shape_id"])
    sizes = told.groupBy(*keys).agg(
        (F.max("field_ix") + 1).alias("n_fields"), (F.max("item_ix") + 1).alias("n_items")
    )
    wide = told.join(sizes.filter("n_fields > 3"), keys)
    base = told.select(*keys, "item_ix", F.col("field_ix").alias("base_ix"), F.col("sign").alias("base_sign"))
    tried = wide.withColumn("period", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).filter("n_fields % period = 0")
    same = tried.withColumn("base_ix", F.pmod("field_ix", "period")).join(base, [*keys, "item_ix", "base_ix"]).groupBy(
        *keys, "period"
    ).agg(F.bool_and(F.col("sign") == F.col("base_sign")).alias("same"))
    periods = same.filter("same").groupBy(*keys).agg(F.min("period").alias("period"))
    split = wide.join(periods, keys).select(
        *keys, "shape_id", F.pmod("field_ix", "period").cast("int").alias("field_ix"),
        (F.floor(F.col("field_ix") / F.col("period")) * F.col("n_items") + F.col("item_ix")).cast("int").alias("item_ix"),
    )
    narrow = told.join(sizes.filter("n_fields <= 3"), keys).select(*keys, "shape_id", "field_ix", "item_ix")
    return narrow.unionByName(split)


def validate_structures(structures: DataFrame, members: DataFrame, shapes: DataFrame) -> DataFrame:
    """``deck_id, slide_number, structure_id, code`` for broken structures.

    A content member without its place, or a placed member that is not content (role ``cell``), means
    that cells or items do not cover the content exactly.
    """
    keys = [*SLIDE, "structure_id"]
    kinds = structures.select(*keys, "kind").distinct()
    placed = F.when(F.col("kind") == "grid", F.col("row").isNotNull() & F.col("col").isNotNull()).when(
        F.col("kind") == "repeat", F.col("item_ix").isNotNull() & F.col("field_id").isNotNull()
    ).otherwise(F.lit(True))
    typed = members.join(kinds, keys)
    uncovered = typed.filter(((F.col("role") == "content") & ~placed) | (F.col("role") == "cell"))
    items = typed.filter("kind = 'repeat' and item_ix is not null and field_id is not null")
    fields = items.select(*keys, "field_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fields"))
    partial = items.select(*keys, "item_ix", "field_id").distinct().groupBy(*keys, "item_ix").agg(
        F.count(F.lit(1)).alias("n")
    ).join(fields, keys).filter("n <> n_fields")
    owners = members.select(*keys, "shape_id").distinct().groupBy(*SLIDE, "shape_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("structure_id").alias("structure_id")
    )
    rules = [
        ("duplicate_structure_id", structures.groupBy(*keys).count().filter("count > 1")),
        ("content_not_covered", uncovered),
        ("repeat_item_incomplete", partial),
        ("header_rows_not_less", structures.filter("kind = 'grid' and header_rows >= rows")),
        ("unknown_shape", members.join(shapes.select(*SLIDE, "shape_id"), [*SLIDE, "shape_id"], "left_anti")),
        ("shape_with_two_owners", owners.filter("n > 1")),
    ]
    return union_all([df.select(*keys, F.lit(code).alias("code")).distinct() for code, df in rules])


