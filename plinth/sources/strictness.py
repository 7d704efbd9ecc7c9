"""Strict shapes of JSON assets and requests: every nested field has a known name, an accepted type and a lawful value.

A document is walked as a VARIANT, one level at a time: a value is replaced by itself and its children, each with its
path (``columns[2].unit``) and its shape (``dataset.columns[].unit``). Shapes are looked up in one table of fields; what
has no entry there is unknown and not entered. The walk is as deep as the table, one pass inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.issues import issue_rows, union_all

TEXT, OPTIONAL = ["STRING"], ["STRING", "VOID"]
SCALAR = ["STRING", "BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN", "VOID"]
FILLED = r"\S"
# Fields of requests and of the asset kinds with accepted types, whether they must be there, and what their text must match.
_ID = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"
_COMMON = {
    "": (["OBJECT"], False, None),
    ".id": (TEXT, True, _ID), ".kind": (TEXT, False, None), ".title": (TEXT, True, FILLED),
    ".visual_hint": (["OBJECT"], False, None), ".visual_hint.mode": (TEXT, False, "^(auto|none|force)$"),
    ".visual_hint.kind": (OPTIONAL, False, "^(table|chart|diagram|pictogram_grid)$"), ".visual_hint.subtype": (OPTIONAL, False, None),
    ".source_refs": (["ARRAY"], False, None), ".source_refs[]": (TEXT, False, None), ".provenance": (TEXT, False, "^(provided|extracted|inferred)$"),
}
_KINDS = {
    "dataset": {
        ".columns": (["ARRAY"], True, None), ".columns[]": (["OBJECT"], False, None), ".columns[].key": (TEXT, True, FILLED), ".columns[].label": (TEXT, True, FILLED),
        ".columns[].type": (TEXT, True, "^(text|number|date|boolean)$"), ".columns[].unit": (OPTIONAL, False, None),
        ".rows": (["ARRAY"], False, None), ".rows[]": (["OBJECT"], False, None), ".rows[].*": (SCALAR, False, None),
    },
    "diagram": {
        ".diagram_type": (TEXT, True, "^(process|timeline|cycle|hierarchy|comparison)$"), ".nodes": (["ARRAY"], True, None), ".nodes[]": (["OBJECT"], False, None),
        ".nodes[].id": (TEXT, True, FILLED), ".nodes[].label": (TEXT, True, FILLED), ".nodes[].description": (OPTIONAL, False, None), ".nodes[].parent_id": (OPTIONAL, False, None),
        ".nodes[].icon_query": (OPTIONAL, False, None), ".edges": (["ARRAY"], False, None), ".edges[]": (["OBJECT"], False, None), ".edges[].source": (TEXT, True, FILLED),
        ".edges[].target": (TEXT, True, FILLED), ".edges[].label": (OPTIONAL, False, None), ".order": (["ARRAY"], False, None), ".order[]": (TEXT, False, None),
    },
    "pictogram_grid": {
        ".items": (["ARRAY"], True, None), ".items[]": (["OBJECT"], False, None), ".items[].label": (TEXT, True, FILLED), ".items[].value": (SCALAR, False, None),
        ".items[].icon_query": (TEXT, True, FILLED),
    },
}
_REQUEST = {
    "": (["OBJECT"], False, None), ".brief": (TEXT, True, None), ".content_package": (TEXT, False, None), ".slide_count": (["OBJECT"], True, None),
    ".slide_count.min": (["BIGINT"], True, None), ".slide_count.max": (["BIGINT"], True, None), ".structured_assets": (["ARRAY"], False, None),
    ".structured_assets[]": (["OBJECT"], False, None), ".provided_images": (["ARRAY"], False, None), ".provided_images[]": (["OBJECT"], False, None),
    ".provided_images[].id": (TEXT, True, FILLED), ".provided_images[].original_name": (TEXT, True, FILLED), ".provided_images[].asset_ref": (TEXT, True, FILLED),
}
#: Lists that must hold something.
_FILLED_LISTS = ["dataset.columns", "diagram.nodes", "pictogram_grid.items"]
#: A value of this shape is an asset: its fields are those of its kind.
ASSET = "request.structured_assets[]"

FIELDS = {f"request{k}": v for k, v in _REQUEST.items()} | {f"{kind}{k}": v for kind, own in _KINDS.items() for k, v in (_COMMON | own).items()}
DEPTH = max(shape.count(".") + shape.count("[]") for shape in FIELDS) + 2
REQUIRED: dict[str, list[str]] = {}
for _shape, (_, _must, _) in FIELDS.items():
    if _must:
        REQUIRED.setdefault(_shape.rpartition(".")[0], []).append(_shape.rpartition(".")[2])


def _lookup(table: dict[str, Column], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)]), key)


def _type(node: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)


def _kind(node: Column) -> Column:
    return F.coalesce(F.try_variant_get(node, "$.kind", "string"), F.lit("dataset"))


def _children(path: Column, inside: Column, node: Column, kind: Column) -> Column:
    def child(at: Column, shape: Column, value: Column) -> Column:
        within = F.when(shape == ASSET, _kind(value)).otherwise(shape)
        return F.struct(at.alias("path"), shape.alias("shape"), within.alias("inside"), value.alias("node"), F.lit(False).alias("entered"))

    fields = F.transform(
        F.map_entries(F.try_variant_get(node, "$", "map<string,variant>")),
        lambda e: child(F.concat(path, F.when(path == "", "").otherwise("."), e["key"]), F.concat(inside, F.lit("."), F.when(inside == "dataset.rows[]", "*").otherwise(e["key"])), e["value"]),
    )
    members = F.transform(
        F.try_variant_get(node, "$", "array<variant>"), lambda v, i: child(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), F.concat(inside, F.lit("[]")), v)
    )
    return F.when(kind == "OBJECT", fields).when(kind == "ARRAY", members)


def walk(roots: DataFrame, key: str) -> DataFrame:
    """``key, path, shape, inside, type, node`` of every value below ``roots`` (``key, path, shape, node``), roots included.

    ``inside`` is the shape that the fields of a value are looked up under. Values without an entry in the table, of
    another type than it says, or of an unknown asset kind are listed but not entered.
    """
    types = {shape: F.array(*map(F.lit, kinds)) for shape, (kinds, _, _) in FIELDS.items()}
    rows = roots.select(key, "path", "shape", F.when(F.col("shape") == ASSET, _kind(F.col("node"))).otherwise(F.col("shape")).alias("inside"), "node", F.lit(False).alias("entered"))
    for _ in range(DEPTH):
        told = rows.withColumn("type", _type(F.col("node")))
        open_ = ~F.col("entered") & F.coalesce(F.array_contains(_lookup(types, F.col("shape")), F.col("type")), F.lit(False)) & F.col("inside").isin([*FIELDS])
        own = F.struct("path", "shape", "inside", "node", F.lit(True).alias("entered"))
        below = F.when(open_, _children(F.col("path"), F.col("inside"), F.col("node"), F.col("type")))
        rows = told.select(key, F.explode(F.concat(F.array(own), F.coalesce(below, F.array().cast(_ROWS)))).alias("v")).select(key, "v.*")
    return rows.select(key, "path", "shape", "inside", _type(F.col("node")).alias("type"), "node")


_ROWS = "array<struct<path:string,shape:string,inside:string,node:variant,entered:boolean>>"


def strict_issues(roots: DataFrame, key: str) -> DataFrame:
    """Issue rows with the path of each field that is unknown, missing, empty, of a wrong type or of a value that is not allowed."""
    values = walk(roots, key)
    types = {shape: F.array(*map(F.lit, kinds)) for shape, (kinds, _, _) in FIELDS.items()}
    rules = {shape: F.lit(rule) for shape, (_, _, rule) in FIELDS.items() if rule is not None}
    known = F.col("shape").isin([*FIELDS])
    names = sorted({n for own in REQUIRED.values() for n in own})
    wanted = _lookup({shape: F.array(*map(F.lit, own)) for shape, own in REQUIRED.items()}, F.col("inside"))
    absent = F.array_compact(F.array(*[F.when(F.array_contains(wanted, n) & F.try_variant_get("node", f"$.{n}", "variant").isNull(), F.lit(n)) for n in names]))
    fits = F.coalesce(F.array_contains(_lookup(types, F.col("shape")), F.col("type")), F.lit(False))
    unknown_kind = (F.col("shape") == ASSET) & ~F.col("inside").isin(list(_KINDS))
    lawful = F.rlike(F.try_variant_get("node", "$", "string"), _lookup(rules, F.col("shape")))
    empty = F.col("shape").isin(_FILLED_LISTS) & F.try_variant_get("node", "$[0]", "variant").isNull()
    found = (
        F.when(~known, F.array(F.struct(F.lit("unknown_field").alias("code"), F.col("path"))))
        .when(~fits, F.array(F.struct(F.lit("wrong_type").alias("code"), F.col("path"))))
        .when(unknown_kind, F.array(F.struct(F.lit("unknown_kind").alias("code"), F.col("path"))))
        .when(F.col("type") == "OBJECT", F.transform(absent, lambda n: F.struct(F.lit("missing_field").alias("code"), F.concat(F.col("path"), F.when(F.col("path") == "", "").otherwise("."), n).alias("path"))))
        .when((F.col("type") == "STRING") & ~lawful, F.array(F.struct(F.lit("invalid_value").alias("code"), F.col("path"))))
        .when(empty, F.array(F.struct(F.lit("empty_list").alias("code"), F.col("path"))))
    )
    told = values.select(key, F.explode(found).alias("f")).select(key, F.col("f.code").alias("code"), F.col("f.path").alias("at"))
    return union_all([issue_rows(told, F.col("code"), F.col("at"), F.replace("code", F.lit("_"), F.lit(" ")), key=key)])
