"""Column expressions over whole texts. Every one works inside a row: no shuffle, no sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions.scalars import squeeze, strip

# Patterns that decide what counts as a list item, number, reference, word.
LIST_ITEM = r"(?:[-*•]|\d+[.)])[^\S\n]+"
NUMBER = (
    r"(?U)(?<![\w])[-+]?(?:\d{1,3}(?:[   ]\d{3})+|\d+)"
    r"(?:[.,]\d+)?(?:[   ]?%)?(?![\w])"
)
DATASET_REFERENCES = (
    r"(?iU)(?:из\s+)?(?:набор(?:а|е)?\s+данных|таблиц[ауы])\s+(?:id\s*)?[:=]?\s*[`\"']?([A-Za-z0-9][A-Za-z0-9_.-]*)[`\"']?",
    r"(?iU)dataset(?:\s+id)?\s*[:=]?\s*[`\"']?([A-Za-z0-9][A-Za-z0-9_.-]*)[`\"']?",
)
IMAGE_REFERENCE = (
    r"(?iU)[`\"']([^`\"'\r\n]+\.(?:png|jpe?g|webp|gif|bmp|tiff?))[`\"']|"
    r"(?<![\w.-])([\w@()+.-]+\.(?:png|jpe?g|webp|gif|bmp|tiff?))(?![\w.-])"
)
FRAGMENT_BREAK = r"(?U)(?:\n+|(?<=[.!?;])\s+)"
METRIC = r"(?U)([^.;]{0,60}?)\b([-+]?\d+(?:[.,]\d+)?)\s*(%|[A-Za-zА-Яа-яЁё]+)?"
PROFILE_BREAK = r"(?U)\s+[—-]\s+|:\s+"
DETAIL_BREAK = r"(?U)(?:[.;]|\n|\s+[—-]\s+)"
DETAIL_WORDS = r"(?iu)опыт|ответствен|experience|responsib"
LONG_WORD = r"(?U)[\w-]{3,}"
DEFAULT_ROLE = "Участник команды"
DEFAULT_METRIC = "Показатель"
CHART_WORDS = ("donut", "pie", "line", "area", "column", "bar", "scatter")
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"


def content_chunks(content: Column) -> Column:
    """Paragraphs and single list items of a text, in order.

    Lines are stripped, list items are fenced by blank lines, and what blank lines separate is a chunk.
    """
    lines = F.regexp_replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), r"(?Umd)^[^\S\n]+|[^\S\n]+$", "")
    fenced = F.regexp_replace(lines, rf"(?Umd)^({LIST_ITEM}.*)$", "\n$1\n")
    parts = F.split(fenced, r"\n{2,}")
    joined = F.transform(parts, lambda p: F.replace(F.regexp_replace(p, r"^\n+|\n+$", ""), F.lit("\n"), F.lit(" ")))
    return F.filter(joined, lambda p: p != "")


def canonical_numbers(text: Column) -> Column:
    """Numbers of a text as canonical decimal strings, in order and with repeats."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(found, canonical_decimal)


def canonical_decimal(token: Column) -> Column:
    """Equal numbers get equal strings; exact for any number of digits."""
    bare = F.replace(F.regexp_replace(token, r"[%   +]", ""), F.lit(","), F.lit("."))
    padded = F.regexp_replace(bare, r"^(-?)0+(?=\d)", "$1")
    short = F.regexp_replace(F.regexp_replace(padded, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(short == "-0", F.lit("0")).otherwise(short)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dataset_references(text: Column) -> Column:
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in DATASET_REFERENCES]
    return F.array_distinct(F.concat(*found))


def image_references(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(IMAGE_REFERENCE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda name: strip(F.regexp_replace(name, "^[`\"'](.*)[`\"']$", "$1"))))


def requested_visual(text: Column, asset_id: Column) -> Column:
    """Kind and subtype asked for near the first mention of an asset."""
    needle = F.lower(asset_id)
    lines = F.filter(F.split(text, LINE_BREAK), lambda line: F.contains(F.lower(line), needle))
    at = F.instr(F.lower(text), needle) - 1
    first = F.greatest(at - 120, F.lit(0))
    window = F.substring(text, first + 1, at + F.length(asset_id) + 120 - first)
    near = F.lower(F.when(F.coalesce(F.get(lines, F.lit(0)), F.lit("")) != "", lines[0]).otherwise(window))
    listed = F.coalesce(*[F.when(F.contains(near, F.lit(word)), F.lit(word)) for word in CHART_WORDS])
    subtype = (
        F.when(F.contains(near, F.lit("кольцев")), "donut")
        .when(F.contains(near, F.lit("кругов")), "pie")
        .when(F.contains(near, F.lit("линейн")), "line")
        .otherwise(listed)
    )
    trend = near.rlike("trend|динамик|тренд")
    chart = F.coalesce(subtype, F.when(trend, F.lit("line")), F.lit("column"))
    table = near.rlike("table|таблиц")
    return F.struct(
        F.when(table, F.lit("table")).otherwise(F.lit("chart")).alias("kind"),
        F.when(~table, chart).alias("subtype"),
    )


def long_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(LONG_WORD), F.lit(0)))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def clip_words(text: Column, limit: Column) -> Column:
    """Whole words within ``limit`` characters; a hard cut where the first word is longer."""
    value = squeeze(text)
    head = F.substring(value, F.lit(1), limit + 1)
    words = F.regexp_extract(head, r"(?s)^(.+) ", 1)
    cut = F.when(words != "", words).otherwise(rstrip(F.substring(value, F.lit(1), limit)))
    return F.when(F.coalesce(limit, F.lit(0)) == 0, value).when(F.length(value) <= limit, value).otherwise(cut)


def clip_ellipsis(text: Column, limit: Column) -> Column:
    value = squeeze(text)
    head = rstrip(F.substring(value, F.lit(1), F.greatest(limit - 1, F.lit(1))))
    return (
        F.when(F.coalesce(limit, F.lit(0)) == 0, value)
        .when(F.length(value) <= limit, value)
        .otherwise(F.concat(head, F.lit("…")))
    )


def fragments(text: Column) -> Column:
    parts = F.transform(F.split(text, FRAGMENT_BREAK), lambda p: F.regexp_replace(p, r"^[ •\t-]+|[ •\t-]+$", ""))
    return F.filter(parts, lambda p: p != "")


def metrics(text: Column, capacity: Column | None = None, max_chars: Column | None = None) -> Column:
    """``array<struct<label, value, unit>>``; a placeholder item where the text has no number."""
    labels, values, units = (F.regexp_extract_all(text, F.lit(METRIC), F.lit(g)) for g in (1, 2, 3))
    limit = F.lit(None).cast("int") if max_chars is None else max_chars
    found = F.transform(
        F.arrays_zip(labels.alias("l"), values.alias("v"), units.alias("u")),
        lambda m: F.struct(
            clip_ellipsis(
                F.coalesce(F.nullif(F.regexp_replace(m["l"], "^[ :-]+|[ :-]+$", ""), F.lit("")), F.lit(DEFAULT_METRIC)), limit
            ).alias("label"),
            F.replace(m["v"], F.lit(","), F.lit(".")).cast("double").alias("value"),
            F.nullif(m["u"], F.lit("")).alias("unit"),
        ),
    )
    size = F.lit(3) if capacity is None else F.coalesce(F.nullif(capacity, F.lit(0)), F.lit(3))
    empty = F.array(F.struct(
        F.lit(DEFAULT_METRIC).alias("label"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"),
    ))
    return F.when(F.size(found) == 0, empty).otherwise(F.slice(found, F.lit(1), size))


def profile(fragment: Column, max_chars: Column | None = None) -> Column:
    parts = F.split(fragment, PROFILE_BREAK, 2)
    limit = F.lit(None).cast("int") if max_chars is None else max_chars
    return F.struct(
        clip_ellipsis(parts[0], limit).alias("name"),
        clip_ellipsis(F.coalesce(F.get(parts, F.lit(1)), F.lit(DEFAULT_ROLE)), limit).alias("role"),
    )


def normal_tags(tags: Column) -> Column:
    slug = F.transform(
        tags, lambda t: F.regexp_replace(F.regexp_replace(F.lower(strip(t)), r"(?U)[^\w]+", "_"), "^_+|_+$", "")
    )
    return F.array_distinct(F.filter(slug, lambda t: t != ""))
