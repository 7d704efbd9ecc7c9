"""Slide metadata files: one JSON document per slide, read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.scalars import strip
from plinth.issues import union_all
from plinth.session import set_down

# Fixed values.
MANIFEST_VERSION = "3.0"
SLIDE_CLASSES = [
    "cover", "agenda", "section", "content_text", "content_visual", "comparison", "process", "timeline",
    "metrics", "table", "chart", "quote", "profile", "closing", "other",
]
_TABLE = "struct<rows:int,columns:int,cells:array<struct<row:int,column:int,text:string>>>"
_CHART = "struct<title:string,chart_type:string,category_labels:array<string>,series_names:array<string>>"
_FIELDS = (
    "shape_id:int,name:string,type:string,box:struct<x:double,y:double,width:double,height:double>,z_order:int,"
    f"placeholder_type:string,alt_text:string,text:string,table:{_TABLE},chart:{_CHART}"
)


# An element; its children stay JSON text until their level is read, so elements may nest as deep as they like.
ELEMENT = f"struct<{_FIELDS},children:string>"

STRUCTURE = (
    "struct<structure_id:string,kind:string,rows:int,columns:int,header_rows:int,shape_ids:array<int>,content_shape_ids:array<int>,"
    "decoration_shape_ids:array<int>,cells:array<struct<row:int,column:int,shape_ids:array<int>>>,"
    "items:array<struct<index:int,fields:map<string,int>>>,fields:array<struct<field_id:string,shape_ids:array<int>>>>"
)
SCHEMA = (
    f"slide_number int, slide_id bigint, layout_name string, elements array<{ELEMENT}>, structures array<{STRUCTURE}>,"
    "theme_fonts array<string>, palette array<string>, warnings array<string>,"
    "vlm struct<status:string,classification:string,tags:array<string>,description:string,confidence:double>"
)


def read_slide_files(spark: SparkSession, path: str) -> DataFrame:
    """Metadata files below ``path``; the deck is the folder above ``slides``."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").schema(SCHEMA).json(path)
    return raw.withColumn("deck_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/slides/[^/]+/[^/]+$", 1))


def slides_of_json(texts: DataFrame) -> DataFrame:
    """The same out of ``deck_id, text`` rows."""
    return texts.select("deck_id", F.from_json("text", SCHEMA).alias("s")).select("deck_id", "s.*")


def read_slide_metadata(raw: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slides of decks with a supported manifest, annotation fields only where they are usable; and issues.

    ``manifests``: ``deck_id, schema_version``.
    """
    supported = manifests.filter(F.col("schema_version") == MANIFEST_VERSION).select("deck_id")
    ok = F.col("vlm.status") == "ok"
    known = F.col("vlm.classification").isin(SLIDE_CLASSES)
    description = F.nullif(strip(F.col("vlm.description")), F.lit(""))
    tags = F.filter(F.coalesce("vlm.tags", F.array().cast("array<string>")), lambda t: strip(t) != "")
    slides = raw.join(supported, "deck_id", "left_semi").select(
        "deck_id", "slide_number", "slide_id", "layout_name", F.when(ok & known, F.col("vlm.classification")).alias("classification"),
        F.when(ok, description).alias("description"), tags.alias("tags"), F.col("vlm.status").alias("vlm_status"), F.col("vlm.confidence").alias("confidence"),
        "theme_fonts", "palette", "warnings", "elements", "structures",
    )
    bad = manifests.filter(~F.col("schema_version").eqNullSafe(MANIFEST_VERSION)).select("deck_id", F.lit("unsupported_manifest").alias("code"))
    empty = supported.join(raw.select("deck_id").distinct(), "deck_id", "left_anti").select("deck_id", F.lit("no_slides").alias("code"))
    return slides, bad.unionByName(empty)


def shapes_of(slides: DataFrame) -> DataFrame:
    """Leaves of the nested ``elements``, depth first, with ``in_group, parent_shape_id, depth, path`` and the box.

    A round reads one level of all slides, until none has children.
    """
    keys = ["deck_id", "slide_number"]
    level = slides.select(
        *keys, F.lit(False).alias("in_group"), F.lit(None).cast("int").alias("parent_shape_id"), F.array().cast("array<int>").alias("path"), F.posexplode("elements").alias("pos", "e")
    )
    fields = [n for n in slides.schema["elements"].dataType.elementType.fieldNames() if n != "children"]
    frames = []
    while True:
        path = F.concat("path", F.array("pos"))
        frames.append(level.filter("e.type <> 'group'").select(
            *keys, *[F.col("e")[n].alias(n) for n in fields], "in_group", "parent_shape_id", F.lit(len(frames)).alias("depth"), path.alias("path")
        ))
        inside = level.filter("e.children is not null").select(
            *keys, (F.col("in_group") | (F.col("e.type") == "group")).alias("in_group"), F.col("e.shape_id").alias("parent_shape_id"), path.alias("path"),
            F.posexplode(F.from_json("e.children", f"array<{ELEMENT}>")).alias("pos", "e"),
        )
        level = set_down(inside)
        if level.isEmpty():
            return union_all(frames).select("*", "box.*").drop("box")


def members_of(slides: DataFrame) -> DataFrame:
    """Structure members in the long form of ``layout``."""
    told = slides.select("deck_id", "slide_number", F.explode("structures").alias("s"))
    base = ["deck_id", "slide_number", F.col("s.structure_id").alias("structure_id"), F.col("s.kind").alias("kind")]
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    tail = ["structure_id", "kind", "deck_id", "slide_number", "shape_id", "role", "row", "col", "field_id", "item_ix"]
    grids = told.select(*base, F.explode("s.cells").alias("c")).select("*", F.explode("c.shape_ids").alias("shape_id")).select(
        "*", F.lit("content").alias("role"), F.col("c.row").alias("row"), F.col("c.column").alias("col"), text.alias("field_id"), none.alias("item_ix")
    )
    repeats = told.select(*base, F.explode("s.items").alias("i")).select("*", F.explode("i.fields").alias("field_id", "shape_id")).select(
        "*", F.lit("content").alias("role"), none.alias("row"), none.alias("col"), F.col("i.index").alias("item_ix")
    )
    statics = told.select(*base, F.explode(F.concat(F.coalesce("s.shape_ids", F.array().cast("array<int>")))).alias("shape_id")).select(
        "*", F.lit("content").alias("role"), none.alias("row"), none.alias("col"), text.alias("field_id"), none.alias("item_ix")
    )
    trims = told.select(*base, F.explode("s.decoration_shape_ids").alias("shape_id")).select(
        "*", F.lit("decoration").alias("role"), none.alias("row"), none.alias("col"), text.alias("field_id"), none.alias("item_ix")
    )
    return grids.select(*tail).unionByName(repeats.select(*tail)).unionByName(statics.select(*tail)).unionByName(trims.select(*tail))
