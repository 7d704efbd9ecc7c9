"""Choice of a visual per dataset, its pages, and the data each page shows.

``columns`` is the output of ``infer_column_types``; ``assets`` holds ``asset_id, kind, hint_mode,
hint_kind, hint_subtype, diagram_type``. Capabilities, where given, are the columns ``cap_kinds``,
``cap_subtypes``, ``max_items``, ``max_rows``, ``max_columns``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import scalars as S
from plinth.session import set_down

# Fixed values.
SUBTYPES = {
    "chart": ["bar", "column", "line", "area", "pie", "donut", "scatter"],
    "diagram": ["process", "timeline", "cycle", "hierarchy", "comparison"],
}
TEMPORAL_WORDS = [
    "date", "datetime", "time", "day", "week", "month", "quarter", "year",
    "дата", "время", "день", "неделя", "месяц", "квартал", "год",
]
DEFAULT_PAGE = 12
MAX_SLIDES = 30


def column_profile(columns: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """One row per asset, from one row per column. ``selected``: ``asset_id, key`` to look at."""
    if selected is not None:
        columns = columns.join(selected, ["asset_id", "key"], "left_semi")
    number, text, date = (F.col("type") == t for t in ("number", "text", "date"))
    name = F.lower(F.concat_ws(" ", "key", "label"))
    temporal = text & F.arrays_overlap(F.split(name, r"(?U)\W+"), F.array(*map(F.lit, TEMPORAL_WORDS)))
    percent = number & ((F.coalesce("unit", F.lit("")) == "%") | S.has_percent(name))
    first_text = F.min_by(F.struct("n_rows", "label_chars"), F.when(text, F.col("col_ix")))
    return columns.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.count_if(number).alias("n_number"),
        F.count_if(text).alias("n_text"),
        F.count_if(date).alias("n_date"),
        F.count_if(percent).alias("n_percent"),
        F.bool_or(temporal).alias("temporal_text"),
        F.max("n_rows").alias("n_rows"),
        F.min(F.when(text | date, F.col("col_ix"))).alias("first_label_col"),
        F.min(F.when(percent, F.col("col_ix"))).alias("first_percent_col"),
        first_text.alias("_first"),
    ).select(
        "*",
        F.when(F.col("n_date") > 0, F.col("n_date")).otherwise(F.col("temporal_text").cast("int")).alias("n_temporal"),
        F.when(F.col("_first.n_rows") > 0, F.col("_first.label_chars") / F.col("_first.n_rows")).alias("mean_label"),
    ).drop("_first", "temporal_text")


def _visual(kind: str, subtype: str | None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(subtype).cast("string").alias("subtype"))


def preferred_visual() -> Column:
    """Ordered rule chain over the columns of ``column_profile`` and ``assets``."""
    number, text = F.col("n_number"), F.col("n_text")
    by_label = F.when(F.coalesce("mean_label", F.lit(0.0)) > 12, _visual("chart", "bar")).otherwise(
        _visual("chart", "column")
    )
    dataset = (
        F.when((F.col("n_temporal") > 0) & (number > 0), _visual("chart", "line"))
        .when((F.col("n_percent") == 1) & (text > 0), _visual("chart", "donut"))
        .when((number == 2) & (text == 0), _visual("chart", "scatter"))
        .when((number == 1) & (text == 1) & (F.col("n_rows") <= 6), _visual("chart", "donut"))
        .when((number == 1) & (text == 1), by_label)
        .when((number > 0) & (text > 0) & (text < F.col("n_columns")), by_label)
        .otherwise(_visual("table", None))
    )
    diagram = F.struct(F.lit("diagram").alias("kind"), F.col("diagram_type").alias("subtype"))
    return (
        F.when(F.col("kind") == "diagram", diagram)
        .when(F.col("kind") == "pictogram_grid", _visual("pictogram_grid", None))
        .otherwise(dataset)
    )


def supports(kind: Column, subtype: Column, has_caps: Column) -> Column:
    """Slot capability test; a slot without capabilities accepts everything."""
    any_subtype = (F.coalesce(subtype, F.lit("")) == "") | (F.size(F.coalesce("cap_subtypes", F.array())) == 0)
    listed = F.array_contains("cap_kinds", kind) & (any_subtype | F.array_contains("cap_subtypes", subtype))
    return ~has_caps | F.coalesce(listed, F.lit(False))


def choose_visual(profiled: DataFrame, with_caps: bool = False) -> DataFrame:
    """Add ``visual_kind, visual_subtype, visual_error`` to assets joined with their profile."""
    has_caps = F.col("cap_kinds").isNotNull() if with_caps else F.lit(False)

    def fits(kind: Column, subtype: Column) -> Column:
        return supports(kind, subtype, has_caps) if with_caps else F.lit(True)

    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("subtype"))
    forced_kind = F.coalesce("hint_kind", F.lit("table"))
    forced_subtype = F.col("hint_subtype")
    unsupported = F.lit(False)
    for kind, subtypes in SUBTYPES.items():
        unsupported = unsupported | ((F.col("hint_kind") == kind) & ~F.coalesce(forced_subtype.isin(subtypes), F.lit(False)))
    unsupported = F.coalesce(unsupported, F.lit(False))
    forced = F.struct(forced_kind.alias("kind"), forced_subtype.alias("subtype"))
    wanted = profiled.withColumn("_want", preferred_visual())
    want_fits = fits(F.col("_want.kind"), F.col("_want.subtype"))
    automatic = (
        F.when(want_fits, F.col("_want"))
        .when((F.col("kind") == "dataset") & fits(F.lit("table"), F.lit(None).cast("string")), _visual("table", None))
        .otherwise(none)
    )
    mode = F.col("hint_mode")
    misfit = ~fits(forced_kind, forced_subtype)
    picked = (
        F.when(mode == "none", none)
        .when((mode == "force") & (unsupported | misfit), none)
        .when(mode == "force", forced)
        .otherwise(automatic)
    )
    error = F.when((mode == "force") & unsupported, "unsupported_forced_subtype").when(
        (mode == "force") & misfit, "forced_visual_incompatible"
    )
    return (
        wanted.withColumn("_picked", picked)
        .withColumn("visual_error", error)
        .withColumn("visual_kind", F.col("_picked.kind"))
        .withColumn("visual_subtype", F.col("_picked.subtype"))
        .drop("_want", "_picked")
    )


def visual_choices(assets: DataFrame, columns: DataFrame) -> DataFrame:
    """Unconstrained choice per asset, with the profile columns kept for paging."""
    return choose_visual(assets.join(column_profile(columns), "asset_id", "left"))


def default_columns(choices: DataFrame, columns: DataFrame) -> DataFrame:
    """``asset_id, position, col_ix, key``: all columns, or label and share for pie and donut."""
    radial = F.col("visual_subtype").isin("pie", "donut") & (F.col("visual_kind") != "table")
    pair = F.coalesce(radial & F.col("first_label_col").isNotNull() & F.col("first_percent_col").isNotNull(), F.lit(False))
    is_label, is_share = F.col("col_ix") == F.col("first_label_col"), F.col("col_ix") == F.col("first_percent_col")
    keys = choices.select("asset_id", "first_label_col", "first_percent_col", pair.alias("pair"))
    return (
        columns.join(keys, "asset_id")
        .filter(~F.col("pair") | is_label | is_share)
        .select(
            "asset_id",
            F.when(F.col("pair"), F.when(is_label, 0).otherwise(1)).otherwise(F.col("col_ix")).alias("position"),
            "col_ix",
            "key",
        )
    )


def _page_size(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit(0)), F.lit(DEFAULT_PAGE))


def page_counts(sized: DataFrame) -> DataFrame:
    """Resolve ``page_size`` and ``pages`` once; every later step reads them from here."""
    size = F.when(F.col("visual_kind") == "table", _page_size("max_rows")).otherwise(_page_size("max_items"))
    return sized.withColumn("page_size", size.cast("int")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.coalesce("n_rows", F.lit(0)) / F.col("page_size"))).cast("int")
    )


def paginate_rows(sized: DataFrame) -> DataFrame:
    """One row per page with the source rows it covers."""
    first = (F.col("page") - 1) * F.col("page_size") + 1
    return (
        page_counts(sized)
        .withColumn("page", F.explode(F.sequence(F.lit(1), F.col("pages"))))
        .withColumn("first_row", first)
        .withColumn("last_row", F.least(first + F.col("page_size") - 1, F.col("n_rows")))
    )


def column_blocks(keys: Column, max_columns: Column) -> Column:
    """Blocks of keys: the first key repeats in each, followed by ``max_columns - 1`` others."""
    width = F.size(keys)
    starts = F.sequence(F.lit(1), width - 1, F.greatest(max_columns - 1, F.lit(1)))
    return (
        F.when(width <= max_columns, F.array(keys))
        .when(max_columns == 1, F.transform(keys, lambda k: F.array(k)))
        .otherwise(F.transform(starts, lambda i: F.concat(F.slice(keys, 1, 1), F.slice(keys, i + 1, max_columns - 1))))
    )


def paginate_columns(sized: DataFrame, chosen: DataFrame, max_slides: int = MAX_SLIDES) -> DataFrame:
    """Block-outer, page-inner selections per asset, or a row with ``overflow`` and no page.

    ``chosen`` is the output of ``default_columns``: a table's header, one small group per asset.
    """
    header = chosen.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("position", "key"))).alias("h"))
    keys = F.transform("h", lambda c: c["key"])
    limit = F.coalesce(F.nullif(F.col("max_columns"), F.lit(0)), F.size("keys"))
    table = F.col("visual_kind") == "table"
    blocks = F.when(table, column_blocks(F.col("keys"), limit)).otherwise(F.array("keys"))
    counted = (
        page_counts(sized).join(header, "asset_id").withColumn("keys", keys).withColumn("blocks", blocks)
        .withColumn("n_selections", F.size("blocks") * F.col("pages"))
        .withColumn("overflow", F.col("n_selections") > max_slides)
    )
    kept = F.when(F.col("overflow"), F.array().cast("array<array<string>>")).otherwise(F.col("blocks"))
    return (
        counted.select("*", F.posexplode_outer(kept).alias("block", "selected_columns"))
        .withColumn("page", F.explode_outer(F.when(~F.col("overflow"), F.sequence(F.lit(1), F.col("pages")))))
        .withColumn("seq", F.col("block") * F.col("pages") + F.col("page") - 1)
        .drop("h", "keys", "blocks")
    )


def ordered_items(items: DataFrame, item_ix: str, order: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Position of each item: the given order where an asset has one, else its own index."""
    own = items.withColumn("_own", F.col(item_ix))
    if order is None:
        return own.withColumn("item_pos", F.col("_own")).drop("_own")
    listed = order.select("asset_id", F.col(key), F.col("order_ix").alias("_listed"))
    return own.join(listed, ["asset_id", key], "left").withColumn("item_pos", F.coalesce("_listed", "_own")).drop("_own", "_listed")


def paginate_items(placed: DataFrame, assets: DataFrame) -> DataFrame:
    """Page of every placed item; ``assets`` may carry ``max_items``."""
    size = _page_size("max_items").cast("int")
    return placed.join(assets.select("asset_id", size.alias("page_size")), "asset_id").withColumn(
        "page", (F.floor(F.col("item_pos") / F.col("page_size")) + 1).cast("int")
    )


def materialize_table(cells: DataFrame, pages: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells of each table page in source order.

    ``pages``: ``asset_id, page_size, max_columns`` - one row per asset; the page of a cell is
    arithmetic on its row and column, so nothing is grouped or sorted.
    """
    width = columns.groupBy("asset_id").agg(F.count(F.lit(1)).cast("int").alias("width"))
    settings = pages.join(width, "asset_id").withColumn(
        "limit", F.coalesce(F.nullif(F.col("max_columns"), F.lit(0)), F.col("width"))
    )
    rest = F.greatest(F.col("limit") - 1, F.lit(1))
    n_blocks = (
        F.when(F.col("width") <= F.col("limit"), 1)
        .when(F.col("limit") == 1, F.col("width"))
        .otherwise(F.ceil((F.col("width") - 1) / rest).cast("int"))
    )
    block = F.when(F.col("n_blocks") == 1, F.array(F.lit(0))).when(
        F.col("limit") == 1, F.array(F.col("col_ix"))
    ).when(F.col("col_ix") == 0, F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(
        F.array(F.floor((F.col("col_ix") - 1) / rest).cast("int"))
    )
    labels = columns.select("asset_id", "col_ix", "label")
    return (
        cells.filter("row_ix > 0")
        .join(settings.withColumn("n_blocks", n_blocks.cast("int")), "asset_id")
        .join(labels, ["asset_id", "col_ix"])
        .withColumn("block", F.explode(block))
        .select(
            "asset_id", "block",
            (F.floor((F.col("row_ix") - 1) / F.col("page_size")) + 1).cast("int").alias("page"),
            "row_ix", "col_ix", "label", S.json_scalar(F.col("raw")).alias("value"),
        )
    )


def chart_roles(choices: DataFrame, columns: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per chart asset: category column, series columns and the axis range over all its rows."""
    picked = columns.join(chosen.select("asset_id", "col_ix", "position"), ["asset_id", "col_ix"])
    number = F.col("type") == "number"
    packed = F.struct("position", "col_ix", "label", "unit", "num_min", "num_max")
    roles = picked.groupBy("asset_id").agg(
        F.array_sort(F.collect_list(F.when(number, packed))).alias("numbers"),
        F.min_by("col_ix", F.when(~number, F.col("position"))).alias("label_col"),
    )
    scatter = F.col("visual_subtype") == "scatter"
    series = F.when(scatter, F.slice("numbers", 2, 1)).otherwise(F.col("numbers"))
    return (
        choices.filter("visual_kind = 'chart'").join(roles, "asset_id")
        .withColumn("series", series)
        .filter(F.size("series") > 0)
        .withColumn("category_col", F.when(scatter, F.element_at("numbers", 1)["col_ix"]).otherwise(F.col("label_col")))
        .withColumn("axis_min", F.array_min(F.transform("series", lambda s: s["num_min"])))
        .withColumn("axis_max", F.array_max(F.transform("series", lambda s: s["num_max"])))
        .withColumn("unit", F.element_at("series", 1)["unit"])
        .withColumn("legend", (F.size("series") > 1) | F.col("visual_subtype").isin("pie", "donut"))
    )


def materialize_chart(cells: DataFrame, roles: DataFrame) -> DataFrame:
    """Flat ``category, series, value`` points. ``roles`` needs ``page_size`` beside ``chart_roles``.

    Only cells of charted assets are grouped, and of these only the columns shown; both joins and the grouping share one
    partitioning by asset.
    """
    wanted = roles.select("asset_id", F.array_compact(F.concat(F.array("category_col"), F.transform("series", lambda s: s["col_ix"]))).alias("wanted"))
    shown = F.when(F.array_contains("wanted", F.col("col_ix")), F.struct("col_ix", "raw"))
    rows = cells.filter("row_ix > 0").join(wanted, "asset_id").groupBy("asset_id", "row_ix").agg(
        F.map_from_entries(F.collect_list(shown)).alias("by_col")
    )
    category = F.when(F.col("category_col").isNull(), F.col("row_ix").cast("string")).otherwise(
        F.nullif(S.strip(F.try_element_at("by_col", F.col("category_col"))), F.lit(""))
    )
    point = F.explode("series")
    value = S.number_value(F.try_element_at("by_col", F.col("one.col_ix")))
    return (
        rows.join(roles, "asset_id")
        .withColumn("one", point)
        .select(
            "asset_id",
            F.col("visual_subtype").alias("chart_type"),
            (F.floor((F.col("row_ix") - 1) / F.col("page_size")) + 1).cast("int").alias("page"),
            "row_ix",
            category.alias("category"),
            F.col("one.label").alias("series"),
            value.alias("value"),
            "unit", "axis_min", "axis_max", "legend",
        )
    )


def materialize_diagram(placed: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their page, and the edges whose two ends share a page.

    ``placed`` is the output of ``paginate_items`` over nodes.
    """
    ends = placed.select("asset_id", "id", "page")
    kept = (
        edges.join(ends.withColumnRenamed("id", "source"), ["asset_id", "source"])
        .join(ends.withColumnRenamed("id", "target"), ["asset_id", "target", "page"], "left_semi")
    )
    return placed, kept


def diagram_levels(nodes: DataFrame) -> DataFrame:
    """Depth of each node along its parents; nodes that never reach a root share the next level.

    Parent pointers are doubled each round, so rounds grow with the logarithm of the depth.
    """
    state = nodes.select(
        "asset_id", "id",
        F.nullif(F.col("parent_id"), F.lit("")).alias("up"),
    ).withColumn("steps", F.when(F.col("up").isNull(), 0).otherwise(1)).withColumn("done", F.col("up").isNull())
    state = set_down(state)
    open_before = -1
    while True:
        n_open = state.filter("not done").count()
        if n_open in (0, open_before):
            break
        open_before = n_open
        above = state.select(
            "asset_id", F.col("id").alias("up"), F.col("up").alias("up2"),
            F.col("steps").alias("steps2"), F.col("done").alias("done2"),
        )
        moving = state.filter("not done").join(above, ["asset_id", "up"], "left")
        stepped = moving.select(
            "asset_id", "id",
            F.when(F.col("done2"), F.lit(None)).otherwise(F.coalesce("up2", "up")).alias("up"),
            (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"),
            F.coalesce("done2", F.lit(False)).alias("done"),
        )
        state = set_down(state.filter("done").unionByName(stepped))
    deepest = state.filter("done").groupBy("asset_id").agg(F.max("steps").alias("deepest"))
    return state.join(deepest, "asset_id", "left").select(
        "asset_id", "id",
        F.when(F.col("done"), F.col("steps")).otherwise(F.coalesce("deepest", F.lit(-1)) + 1).cast("int").alias("level"),
    )


def diagram_links(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """The given edges, or for a diagram without any, consecutive pairs along the order."""
    bare = placed.join(edges.select("asset_id").distinct(), "asset_id", "left_anti")
    after = bare.select("asset_id", (F.col("item_pos") - 1).alias("item_pos"), F.col("id").alias("target"))
    chained = bare.join(after, ["asset_id", "item_pos"]).select("asset_id", F.col("id").alias("source"), "target")
    return edges.select("asset_id", "source", "target").unionByName(chained)
