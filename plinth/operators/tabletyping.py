"""Typing and identity of tables held as long cells.

``cells``: ``asset_id, row_ix, col_ix, raw`` with ``row_ix`` 0 as the header. Nothing here gathers
the rows of a table: types, labels and label lengths come out of one partial aggregation per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import scalars as S
from plinth.functions.numbering import renumber
from plinth.issues import issue_rows, union_all

# Rows, and digests, that are joined before each digest of a table's tree.
ROWS_PER_BLOCK = 4096


def clean_table_rows(cells: DataFrame) -> DataFrame:
    """Drop rows without content, close the gaps in ``row_ix``, pad rows to the widest one."""
    filled = F.col("raw").isNotNull() & (F.col("raw") != "")
    rows = cells.groupBy("asset_id", "row_ix").agg(
        F.bool_or(filled).alias("keep"),
        F.map_from_entries(F.collect_list(F.struct("col_ix", "raw"))).alias("by_col"),
        F.max("col_ix").alias("last_col"),
    )
    kept = renumber(rows.filter("keep"), ["asset_id"], "row_ix", "new_ix")
    width = rows.filter("keep").groupBy("asset_id").agg(F.max("last_col").alias("width"))
    padded = kept.join(width, "asset_id").select(
        "asset_id",
        F.col("new_ix").alias("row_ix"),
        "by_col",
        F.explode(F.sequence(F.lit(0), F.col("width"))).alias("col_ix"),
    )
    value = F.try_element_at("by_col", F.col("col_ix"))
    return padded.select("asset_id", "row_ix", "col_ix", value.alias("raw"))


def header_labels(cells: DataFrame) -> DataFrame:
    """``asset_id, col_ix, label``: blank header cells become ``Column n``."""
    text = S.strip(F.coalesce("raw", F.lit("")))
    label = F.when(F.coalesce("raw", F.lit("")) == "", F.concat(F.lit("Column "), F.col("col_ix") + 1)).otherwise(text)
    return cells.filter("row_ix = 0").select("asset_id", "col_ix", label.alias("label"))


def unique_names(bases: Column) -> Column:
    """Give each base its first free name among ``base, base_2, base_3, ...`` in order."""

    def add(done: Column, base: Column) -> Column:
        suffixes = F.transform(F.sequence(F.lit(2), F.size(done) + 2), lambda n: F.concat(base, F.lit("_"), n))
        free = F.filter(F.concat(F.array(base), suffixes), lambda name: ~F.array_contains(done, name))
        return F.concat(done, F.array(free[0]))

    return F.aggregate(bases, F.array().cast("array<string>"), add)


def key_base(label: Column, col_ix: Column) -> Column:
    slug = F.regexp_replace(F.lower(S.strip(label)), r"(?U)\W+", "_")
    slug = F.regexp_replace(slug, "^_+|_+$", "")
    return F.when(slug == "", F.concat(F.lit("column_"), col_ix + 1)).otherwise(slug)


def _with_keys(columns: DataFrame, carry: list[str]) -> DataFrame:
    """Add ``key``. ``columns`` has one row per table column, so a group is one table's header."""
    fields = ["col_ix", "label", *carry]
    packed = columns.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("cols"))
    bases = F.transform("cols", lambda c: key_base(c["label"], c["col_ix"]))
    return packed.select(
        "asset_id", F.inline(F.arrays_zip(F.col("cols").alias("c"), unique_names(bases).alias("key")))
    ).select("asset_id", "c.*", "key")


def normalize_headers(cells: DataFrame) -> DataFrame:
    return _with_keys(header_labels(cells), []).select("asset_id", "col_ix", "key", "label")


def parse_scalars(cells: DataFrame) -> DataFrame:
    """Tagged union of every body cell."""
    kind = S.value_type(F.col("raw"))
    return cells.filter("row_ix > 0").select(
        "asset_id",
        "row_ix",
        "col_ix",
        kind.alias("value_type"),
        F.when(kind == "number", S.number_value(F.col("raw"))).alias("num"),
        F.when(kind == "bool", F.lower(S.strip(F.col("raw"))) == "true").alias("bool"),
        F.when(kind == "text", S.strip(F.col("raw"))).alias("txt"),
    )


def _column_statistics(cells: DataFrame) -> DataFrame:
    body = F.col("row_ix") > 0
    text = S.strip(F.coalesce("raw", F.lit("")))
    kind = S.value_type(F.col("raw"))
    present = body & (kind != "null")
    label = F.when(text == "", F.concat(F.lit("Column "), F.col("col_ix") + 1)).otherwise(text)
    return cells.groupBy("asset_id", "col_ix").agg(
        F.max(F.when(F.col("row_ix") == 0, label)).alias("label"),
        F.count(F.when(body, 1)).alias("n_rows"),
        F.count(F.when(present, 1)).alias("n_present"),
        F.count(F.when(present & (kind == "bool"), 1)).alias("n_bool"),
        F.count(F.when(present & (kind == "number"), 1)).alias("n_number"),
        F.count(F.when(present & (kind == "text") & text.rlike(S.DATE_PATTERN), 1)).alias("n_date"),
        F.coalesce(F.sum(F.when(body, F.length(text))), F.lit(0)).alias("label_chars"),
        F.min(F.when(body & (kind == "number"), S.number_value(F.col("raw")))).alias("num_min"),
        F.max(F.when(body & (kind == "number"), S.number_value(F.col("raw")))).alias("num_max"),
    )


def infer_column_types(cells: DataFrame) -> DataFrame:
    """``dataset_columns`` plus the counts that later steps need."""
    typed = _column_statistics(cells).withColumn(
        "type",
        F.when(F.col("n_present") == 0, "text")
        .when(F.col("n_bool") == F.col("n_present"), "boolean")
        .when(F.col("n_number") == F.col("n_present"), "number")
        .when(F.col("n_date") == F.col("n_present"), "date")
        .otherwise("text"),
    )
    carry = ["type", "n_rows", "n_present", "n_number", "n_bool", "label_chars", "num_min", "num_max"]
    return tag_percent_unit(_with_keys(typed, carry))


def tag_percent_unit(columns: DataFrame) -> DataFrame:
    return columns.withColumn("unit", F.when(S.has_percent(F.col("label")), F.lit("%")))


def _row_texts(cells: DataFrame) -> DataFrame:
    """Canonical JSON of each row; the header row keeps its labels as strings."""
    text = F.when(
        F.col("row_ix") == 0,
        S.json_string(
            F.when(F.coalesce("raw", F.lit("")) == "", F.concat(F.lit("Column "), F.col("col_ix") + 1)).otherwise(
                S.strip(F.col("raw"))
            )
        ),
    ).otherwise(S.json_scalar(F.col("raw")))
    pairs = F.array_sort(F.collect_list(F.struct("col_ix", text.alias("t"))))
    return cells.groupBy("asset_id", "row_ix").agg(
        F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda p: p["t"]), ","), F.lit("]")).alias("row_json")
    )


def _joined(position: str, text: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position), F.col(text))))
    return F.array_join(F.transform(pairs, lambda p: p[text]), ",")


def _bounded_bodies(rows: DataFrame) -> DataFrame:
    """One digest per table out of ``asset_id, row_ix, row_json``.

    Rows are joined and digested per block, then blocks of digests twice more, whatever the size of the table, so no
    task holds a long one and a table has one identity.
    """
    block = F.floor((F.col("row_ix") - 1) / ROWS_PER_BLOCK).alias("block")
    digests = rows.groupBy("asset_id", block).agg(F.sha2(_joined("row_ix", "row_json"), 256).alias("text"))
    for _ in range(2):
        upper = F.floor(F.col("block") / ROWS_PER_BLOCK).alias("block")
        digests = digests.groupBy("asset_id", upper).agg(F.sha2(_joined("block", "text"), 256).alias("text"))
    return digests.groupBy("asset_id").agg(_joined("block", "text").alias("body"))


def body_payloads(cells: DataFrame) -> DataFrame:
    rows = _row_texts(cells)
    labels = rows.filter("row_ix = 0").select("asset_id", F.col("row_json").alias("labels"))
    return labels.join(_bounded_bodies(rows.filter("row_ix > 0")), "asset_id", "left").withColumn(
        "body", F.coalesce("body", F.lit(""))
    )


def slug(title: Column) -> Column:
    text = F.regexp_replace(F.lower(S.strip(title)), "[^A-Za-z0-9]+", "-")
    text = F.substring(F.regexp_replace(text, "^-+|-+$", ""), 1, 48)
    return F.when(text == "", F.lit("dataset")).otherwise(text)


def stable_asset_id(cells: DataFrame, titles: DataFrame) -> DataFrame:
    """``titles``: ``asset_id, title``. Equal tables with equal titles get equal ids."""
    payload = F.concat(
        F.lit('{"columns":'), "labels", F.lit(',"rows":['), "body", F.lit('],"title":'),
        S.json_string(F.col("title")), F.lit("}"),
    )
    return body_payloads(cells).join(titles, "asset_id").select(
        "asset_id",
        F.concat(slug(F.col("title")), F.lit("-"), F.substring(F.sha2(payload, 256), 1, 10)).alias("stable_id"),
    )


def asset_content_hash(cells: DataFrame, assets: DataFrame) -> DataFrame:
    """sha256 of the key-sorted compact JSON of a dataset asset.

    ``assets``: ``asset_id, title, hint_mode, hint_kind, hint_subtype, provenance, source_refs``.
    """
    columns = infer_column_types(cells)

    def optional(column: Column) -> Column:
        return F.coalesce(S.json_string(column), F.lit("null"))

    column_json = F.concat(
        F.lit('{"key":'), S.json_string(F.col("key")), F.lit(',"label":'), S.json_string(F.col("label")),
        F.lit(',"type":"'), F.col("type"), F.lit('","unit":'), optional(F.col("unit")), F.lit("}"),
    )
    headers = columns.withColumn("json", column_json).groupBy("asset_id").agg(_joined("col_ix", "json").alias("columns_json"))
    # Row objects list their members by key, not by position.
    typed = cells.filter("row_ix > 0").join(
        columns.select("asset_id", "col_ix", "key"), ["asset_id", "col_ix"]
    ).select(
        "asset_id", "row_ix", "key",
        F.concat(S.json_string(F.col("key")), F.lit(":"), S.json_scalar(F.col("raw"))).alias("member"),
    )
    rows = typed.groupBy("asset_id", "row_ix").agg(
        F.concat(F.lit("{"), _joined("key", "member"), F.lit("}")).alias("row_json")
    )
    bodies = _bounded_bodies(rows)
    refs = F.concat(F.lit("["), F.array_join(F.transform("source_refs", S.json_string), ","), F.lit("]"))
    payload = F.concat(
        F.lit('{"columns":['), "columns_json", F.lit('],"id":'), S.json_string(F.col("asset_id")),
        F.lit(',"kind":"dataset","provenance":"'), "provenance", F.lit('","rows":['),
        F.coalesce("body", F.lit("")), F.lit('],"source_refs":'), refs, F.lit(',"title":'),
        S.json_string(F.col("title")), F.lit(',"visual_hint":{"kind":'), optional(F.col("hint_kind")),
        F.lit(',"mode":"'), "hint_mode", F.lit('","subtype":'), optional(F.col("hint_subtype")), F.lit("}}"),
    )
    return assets.join(headers, "asset_id").join(bodies, "asset_id", "left").select(
        "asset_id", F.sha2(payload, 256).alias("content_hash")
    )


def resolve_asset_conflicts(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``assets``: ``request_id, asset_id, asset_ix, content_hash``.

    Returns the kept assets, first occurrence of each id, and one issue per id with two bodies.
    """
    keys = ["request_id", "asset_id"]
    grouped = assets.groupBy(*keys).agg(
        F.min("asset_ix").alias("asset_ix"),
        F.min("content_hash").alias("content_hash"),
        F.max("content_hash").alias("other_hash"),
    )
    clash = F.col("content_hash") != F.col("other_hash")
    kept = grouped.filter(~clash).drop("other_hash")
    message = F.concat(F.lit("conflicting structured asset id: "), F.col("asset_id"))
    return kept, issue_rows(grouped.filter(clash), "asset_id_conflict", "structured_assets", message)


def iso_datetime(text: Column) -> Column:
    """True where the text is a full ISO date or timestamp."""
    value = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    shaped = value.rlike(r"^\d{4}-\d{2}-\d{2}(?:.\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?(?:[+-]\d{2}:?\d{2}(?::?\d{2})?)?)?$")
    clock = F.regexp_extract(value, r"^.{10}.(\d{2}(?::\d{2}){0,2})", 1)
    hour, minute, second = (F.coalesce(F.get(F.split(clock, ":"), F.lit(i)).try_cast("int"), F.lit(0)) for i in range(3))
    clock_ok = (hour < 24) & (minute < 60) & (second < 60)
    return shaped & F.substring(value, 1, 10).try_cast("date").isNotNull() & clock_ok


def _dataset_issue(df: DataFrame, code: str, message: Column) -> DataFrame:
    path = F.concat(F.lit("structured_assets["), F.col("asset_id"), F.lit("]"))
    return issue_rows(df, code, path, message)


def validate_values(assets: DataFrame, cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Distinct (column, rule) breaches of the declared types."""
    typed = parse_scalars(cells).filter("value_type <> 'null'").join(
        columns.select("asset_id", "col_ix", "key", "type"), ["asset_id", "col_ix"]
    )
    kind, declared = F.col("value_type"), F.col("type")
    code = (
        F.when((declared == "number") & (kind != "number"), "value_not_number")
        .when((declared == "boolean") & (kind != "bool"), "value_not_boolean")
        .when((declared == "text") & (kind != "text"), "value_not_text")
        .when((declared == "date") & ((kind != "text") | ~iso_datetime(F.col("txt"))), "value_not_iso_date")
    )
    broken = typed.withColumn("code", code).filter("code is not null").select("asset_id", "key", "code").distinct()
    return _dataset_issue(
        broken.join(assets.select("request_id", "asset_id"), "asset_id"),
        F.col("code"),
        F.concat(F.lit("dataset value for "), F.col("key"), F.lit(" breaks its declared type")),
    )


# Which kinds each asset kind may force.
FORCEABLE = {"dataset": ["table", "chart"], "diagram": ["diagram"], "pictogram_grid": ["pictogram_grid"]}


def validate_assets(assets: DataFrame, cells: DataFrame, columns: DataFrame) -> DataFrame:
    """``assets``: ``request_id, asset_id, kind, hint_mode, hint_kind, hint_subtype``."""
    mode, kind, subtype = F.col("hint_mode"), F.col("hint_kind"), F.col("hint_subtype")
    forced = mode == "force"
    allowed = F.lit(False)
    for asset_kind, kinds in FORCEABLE.items():
        allowed = allowed | ((F.col("kind") == asset_kind) & kind.isin(kinds))
    rules = [
        (forced & kind.isNull(), "forced_hint_without_kind"),
        (forced & kind.isin("chart", "diagram") & F.coalesce(subtype, F.lit("")).isin(""), "forced_hint_without_subtype"),
        ((mode == "none") & (kind.isNotNull() | subtype.isNotNull()), "disabled_hint_selects"),
        (forced & kind.isNotNull() & ~allowed, "forced_kind_not_allowed"),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(code)) for test, code in rules]), lambda c: c.isNotNull())
    hints = assets.select("request_id", "asset_id", F.explode(found).alias("code"))
    repeated = columns.groupBy("asset_id", "key").count().filter("count > 1").join(
        assets.select("request_id", "asset_id"), "asset_id"
    )
    expected = columns.groupBy("asset_id").agg(F.count(F.lit(1)).alias("width"))
    short = (
        cells.filter("row_ix > 0").groupBy("asset_id", "row_ix").agg(F.count(F.lit(1)).alias("n"))
        .join(expected, "asset_id").filter("n <> width").select("asset_id").distinct()
        .join(assets.select("request_id", "asset_id"), "asset_id")
    )
    return union_all([
        _dataset_issue(hints, F.col("code"), F.lit("visual hint is inconsistent")),
        _dataset_issue(repeated, "duplicate_column_key", F.concat(F.lit("column key repeats: "), F.col("key"))),
        _dataset_issue(short, "row_columns_mismatch", F.lit("a row does not have exactly the declared columns")),
        validate_values(assets, cells, columns),
    ])


DIAGRAM_RULES = {
    "duplicate_node_id": "diagram node ids must be unique",
    "invalid_order": "diagram order must contain every node exactly once",
    "unknown_edge_node": "diagram edge references an unknown node",
    "unknown_parent": "diagram parent_id references an unknown node",
}


def validate_diagrams(assets: DataFrame, nodes: DataFrame, edges: DataFrame, order: DataFrame, tasks: int | None = None) -> DataFrame:
    """``nodes``: ``asset_id, node_ix, id, parent_id``; ``edges``: ``asset_id, source, target``;
    ``order``: ``asset_id, order_ix, id`` (may hold no rows for an asset).

    All uses of an id are counted together, then the ids of an asset. ``tasks``: into how many tasks both are dealt; it should
    follow the rows, so that what a task holds does not.
    """
    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(tasks, *keys) if tasks else df

    owners = dealt(assets.select("request_id", "asset_id", "kind", "hint_mode", "hint_kind"), "asset_id")
    uses = {
        "n_node": nodes.select("asset_id", "id"),
        "n_end": edges.select("asset_id", F.explode(F.array("source", "target")).alias("id")),
        "n_parent": nodes.filter("parent_id is not null").select("asset_id", F.col("parent_id").alias("id")),
        "n_order": order.select("asset_id", "id"),
    }
    told = dealt(union_all([df.select("asset_id", "id", F.lit(use).alias("use")) for use, df in uses.items()]), "asset_id", "id")
    by_id = told.groupBy("asset_id", "id").agg(*[F.count_if(F.col("use") == use).alias(use) for use in uses])
    # An id without a value equals none.
    known, placed = (F.col("id").isNotNull() & (F.col(n) > 0) for n in ("n_node", "n_order"))
    unplaced = F.bool_or((F.col("n_node") > 0) & ~placed) & F.bool_or(F.col("n_order") > 0)
    broken = {
        "duplicate_node_id": F.bool_or(F.col("n_node") > 1),
        "invalid_order": unplaced | F.bool_or((F.col("n_order") > 1) | ((F.col("n_order") > 0) & ~known)),
        "unknown_edge_node": F.bool_or((F.col("n_end") > 0) & ~known),
        "unknown_parent": F.bool_or((F.col("n_parent") > 0) & ~known),
    }
    codes = F.array_compact(F.array(*[F.when(F.col(code), F.lit(code)) for code in broken]))
    by_asset = dealt(by_id, "asset_id").groupBy("asset_id").agg(*[test.alias(code) for code, test in broken.items()])
    found = by_asset.select("asset_id", F.explode(codes).alias("code")).join(owners, "asset_id")
    message = F.create_map(*[F.lit(x) for rule in DIAGRAM_RULES.items() for x in rule])[F.col("code")]
    forced = owners.filter("kind = 'diagram' and hint_mode = 'force' and hint_kind <> 'diagram'").select("asset_id").distinct()
    return union_all([
        _dataset_issue(found, F.col("code"), message),
        _dataset_issue(forced.join(owners, "asset_id"), "forced_kind_not_allowed", F.lit("diagram asset can only force diagram visualization")),
    ])


def validate_shares(assets: DataFrame, cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Pie and donut hints: the first numeric column is non-negative and sums to 100."""
    shares = assets.filter(F.col("hint_subtype").isin("pie", "donut")).select("request_id", "asset_id")
    numbers = columns.filter("type = 'number'").groupBy("asset_id").agg(F.min("col_ix").alias("col_ix"))
    sums = parse_scalars(cells).join(numbers, ["asset_id", "col_ix"]).groupBy("asset_id").agg(
        F.sum(F.col("num").cast("decimal(28,6)")).alias("total"), F.min("num").alias("least")
    )
    checked = shares.join(numbers, "asset_id", "left").join(sums, "asset_id", "left")
    missing = checked.filter("col_ix is null")
    wrong = checked.filter("col_ix is not null and (least < 0 or abs(coalesce(total, 0) - 100) > 0.01)")
    return union_all([
        _dataset_issue(missing, "share_without_number", F.lit("share dataset has no numeric column")),
        _dataset_issue(wrong, "shares_not_100", F.lit("pie/donut shares must sum to 100")),
    ])
