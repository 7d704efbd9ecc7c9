"""Source chunks, number grounding, references and text shaping over request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import scalars as S
from plinth.functions import textual as X
from plinth.functions.numbering import renumber
from plinth.issues import issue_rows, union_all
from plinth.session import set_down


def chunk_sources(requests: DataFrame, assets: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """``request_id, seq, source_id, kind, text``: the brief, the content chunks, assets, images.

    ``seq`` is the place within its kind. ``assets``: ``request_id, asset_ix, asset_id, json``;
    ``images``: ``request_id, image_ix, id, original_name, asset_ref``.
    """
    brief = requests.select(
        "request_id", F.lit(0).alias("seq"), F.lit("brief").alias("source_id"), F.lit("brief").alias("kind"),
        F.col("brief").alias("text"),
    )
    chunks = requests.select("request_id", F.posexplode(X.content_chunks(F.col("content_package"))).alias("pos", "text"))
    content = chunks.select(
        "request_id", (F.col("pos") + 1).alias("seq"), F.format_string("content_%03d", F.col("pos") + 1).alias("source_id"),
        F.lit("content").alias("kind"), "text",
    )
    frames = [brief, content]
    if assets is not None:
        frames.append(assets.select(
            "request_id", F.col("asset_ix").cast("int").alias("seq"), F.concat(F.lit("asset:"), "asset_id").alias("source_id"),
            F.lit("asset").alias("kind"), F.col("json").alias("text"),
        ))
    if images is not None:
        frames.append(images.select(
            "request_id", F.col("image_ix").cast("int").alias("seq"), F.col("id").alias("source_id"), F.lit("image").alias("kind"),
            F.concat(
                F.lit("Available image: "), "asset_ref", F.lit(" (original filename: "), "original_name", F.lit(")")
            ).alias("text"),
        ))
    return union_all(frames)


def extract_numbers(texts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per number found: ``keys, number_ix, number``."""
    return texts.select(*keys, F.posexplode(X.canonical_numbers(F.col("text"))).alias("number_ix", "number"))


def ground_numbers(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct numbers of a claim that none of its cited sources holds.

    ``claims``: ``request_id, path, text, source_refs``; ``sources``: ``request_id, source_id, text``.
    Both sides are exploded to distinct numbers before they meet on (request, source, number), so
    the join key is as fine as the question asked.
    """
    claimed = claims.select(
        "request_id", "path", "source_refs",
        F.explode(F.array_distinct(X.canonical_numbers(F.col("text")))).alias("number"),
    )
    known = sources.select(
        "request_id", "source_id", F.explode(F.array_distinct(X.canonical_numbers(F.col("text")))).alias("number")
    ).distinct()
    cited = claimed.withColumn("source_id", F.explode(F.array_distinct("source_refs")))
    grounded = cited.join(known, ["request_id", "source_id", "number"], "left_semi").select("request_id", "path", "number")
    return claimed.select("request_id", "path", "number").join(grounded, ["request_id", "path", "number"], "left_anti")



def missing_references(requests: DataFrame, assets: DataFrame, images: DataFrame) -> DataFrame:
    """``request_id, kind, name``: datasets and image files a request names but does not provide."""
    text = F.concat_ws("\n", "brief", "content_package")
    datasets = requests.select("request_id", F.explode(X.dataset_references(text)).alias("name"))
    known = assets.select("request_id", F.col("asset_id").alias("name"))
    lost = datasets.join(known, ["request_id", "name"], "left_anti")
    files = requests.select("request_id", F.explode(X.image_references(text)).alias("name")).withColumn(
        "base", F.lower(X.base_name(F.col("name")))
    )
    held = images.select(
        "request_id", F.explode(F.array("original_name", "asset_ref")).alias("n")
    ).select("request_id", F.lower(X.base_name(F.col("n"))).alias("base"))
    unseen = files.join(held, ["request_id", "base"], "left_anti")
    return lost.select("request_id", F.lit("dataset").alias("kind"), "name").unionByName(
        unseen.select("request_id", F.lit("image").alias("kind"), "name")
    )



def requested_visuals(requests: DataFrame, names: DataFrame) -> DataFrame:
    """``names``: ``request_id, asset_id``."""
    text = F.concat_ws("\n", "brief", "content_package")
    asked = names.join(requests.select("request_id", text.alias("text")), "request_id")
    return asked.withColumn("v", X.requested_visual(F.col("text"), F.col("asset_id"))).select(
        "request_id", "asset_id", F.col("v.kind").alias("visual_kind"), F.col("v.subtype").alias("visual_subtype")
    )


def required_images(requests: DataFrame, images: DataFrame) -> DataFrame:
    """Images whose original or stored file name occurs in the request's text."""
    text = F.lower(F.concat_ws("\n", "brief", "content_package"))
    joined = images.join(requests.select("request_id", text.alias("mentioned")), "request_id")
    named = [F.contains(F.col("mentioned"), F.lower(X.base_name(F.col(c)))) for c in ("original_name", "asset_ref")]
    return joined.filter(named[0] | named[1]).drop("mentioned")


def expand_headings(slide_refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A slide that cites a heading chunk also cites the body chunk right after it.

    ``slide_refs``: ``request_id, number, ref_ix, source_id``; ``chunks``: content rows of
    ``chunk_sources``. Returns the widened list in the same shape.
    """
    content = chunks.filter("kind = 'content'")
    heading = F.startswith(F.ltrim("text"), F.lit("#"))
    following = content.select("request_id", (F.col("seq") - 1).alias("seq"), F.col("source_id").alias("next_id"), heading.alias("next_heading"))
    bodies = (
        content.filter(heading).select("request_id", "seq", "source_id")
        .join(following.filter("not next_heading"), ["request_id", "seq"])
        .select("request_id", "source_id", "next_id")
    )
    added = slide_refs.join(bodies, ["request_id", "source_id"]).groupBy("request_id", "number", "next_id").agg(
        F.min("ref_ix").alias("ref_ix")
    )
    after = slide_refs.groupBy("request_id", "number").agg((F.max("ref_ix") + 1).alias("after"))
    added = added.join(after, ["request_id", "number"]).select("request_id", "number", (F.col("ref_ix") + F.col("after")).alias("ref_ix"), F.col("next_id").alias("source_id"))
    fresh = added.join(slide_refs, ["request_id", "number", "source_id"], "left_anti")
    return slide_refs.select("request_id", "number", "ref_ix", "source_id").unionByName(
        fresh.select("request_id", "number", "ref_ix", "source_id")
    )


def allocate_orphans(sources: DataFrame, slide_refs: DataFrame, slides: DataFrame) -> DataFrame:
    """Uncited brief and content chunks, dealt to the slides in turn: ``request_id, source_id, number``."""
    texts = sources.filter(F.col("kind").isin("brief", "content"))
    orphans = texts.join(slide_refs, ["request_id", "source_id"], "left_anti").select("request_id", "source_id", "seq")
    ranked = renumber(orphans, ["request_id"], "seq", "orphan_ix")
    counts = slides.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_slides"))
    turn = F.pmod("orphan_ix", "n_slides") + 1
    return ranked.join(counts, "request_id").select("request_id", "source_id", turn.cast("int").alias("number"))


#: Needles, or assets, that a text meets in one row.
NEEDLES, ASSETS = 512, 64


def _in_blocks(rows: DataFrame, one: Column, spread: str, size: int, out: str) -> DataFrame:
    """``request_id, out``: ``one`` of all rows of a request in arrays of about ``size`` entries, dealt over the hash of ``spread``."""
    counted = rows.select("request_id", one.alias("_one"), F.xxhash64(spread).alias("_hash"), F.count(F.lit(1)).over(Window.partitionBy("request_id")).alias("_n"))
    block = F.pmod("_hash", F.ceil(F.col("_n") / size)).alias("_block")
    return counted.groupBy("request_id", block).agg(F.collect_list("_one").alias(out)).drop("_block")


def found_inside(asked: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """``request_id, *keys, needle``: which ``needle`` stands, also inside of words, in which text of its request.

    ``asked``: distinct ``request_id, needle``; ``texts``: ``request_id, *keys, text``, one row per key. A text meets the needles
    of its request in its own row, in blocks of some ``NEEDLES``; only what it holds leaves the row, without the text.
    """
    inside = F.filter("needles", lambda n: F.contains(F.col("text"), n))
    blocks = _in_blocks(asked, F.col("needle"), "needle", NEEDLES, "needles")
    return texts.join(blocks, "request_id").select("request_id", *keys, F.explode(inside).alias("needle"))


def word_overlap_score(titles: DataFrame, slides: DataFrame) -> DataFrame:
    """``request_id, asset_id, number, overlap``: how many distinct words of an asset's title stand, also inside of words, in
    the texts that a slide cites or in its purpose; a row per asset and slide of a request.

    ``titles``: ``request_id, asset_id, title``; ``slides``: ``request_id, number, purpose, cited``. A slide meets the words of
    its request's titles in its own row, in blocks of some ``ASSETS`` assets; each distinct word of a block is looked up once.
    """
    words = F.coalesce(X.long_words(F.col("title")), F.array().cast("array<string>"))
    blocks = _in_blocks(titles, F.struct("asset_id", words.alias("words")), "asset_id", ASSETS, "assets")
    texts = slides.select("request_id", "number", F.lower(F.concat_ws("\n", "cited", "purpose")).alias("text"))
    needles = F.array_distinct(F.flatten(F.transform("assets", lambda a: a["words"])))
    met = texts.join(blocks, "request_id").withColumn("held", F.filter(needles, lambda w: F.contains(F.col("text"), w)))
    scored = F.transform("assets", lambda a: F.struct(a["asset_id"].alias("asset_id"), F.size(F.array_intersect(a["words"], F.col("held"))).alias("overlap")))
    return met.select("request_id", "number", F.inline(scored)).select("request_id", "asset_id", "number", "overlap")


def enrich_profiles(profiles: DataFrame, sources: DataFrame) -> DataFrame:
    """Details for profiles without any, taken from cited chunks or chunks that name the person (``found_inside``).

    ``profiles``: ``request_id, number, slot_id, item_ix, name, source_refs, max_chars``. Returns
    ``..., detail_ix, detail, source_id``.
    """
    keys = ["request_id", "number", "slot_id", "item_ix"]
    about = F.col("text").rlike(X.DETAIL_WORDS)
    # Four steps read these chunks, which are few of all that the requests are cut into; they are cut once.
    told = set_down(sources.filter(about).select("request_id", "source_id", "seq", "text"))
    cited = profiles.withColumn("source_id", F.explode(F.array_distinct("source_refs"))).join(told, ["request_id", "source_id"])
    uncited = profiles.join(cited.select(*keys).distinct(), keys, "left_anti")
    # Names and chunks are paired by source and name; the text joins what was found.
    lower = told.select("request_id", "source_id", "seq", F.lower("text").alias("text"))
    names = uncited.select("request_id", F.lower("name").alias("needle")).filter("needle IS NOT NULL").distinct()
    holders = found_inside(names, lower, ["source_id", "seq"])
    named = uncited.withColumn("needle", F.lower("name")).join(holders, ["request_id", "needle"]).join(told, ["request_id", "source_id", "seq"])
    columns = [*keys, "max_chars", "seq", "source_id", "text"]
    parts = cited.select(*columns).unionByName(named.select(*columns)).select(
        *keys, "max_chars", "seq", "source_id", F.posexplode(F.split("text", X.DETAIL_BREAK)).alias("part_ix", "part")
    ).filter(F.col("part").rlike(X.DETAIL_WORDS))
    place = Window.partitionBy(*keys).orderBy("seq", "source_id", "part_ix")
    detail = S.strip(F.col("part"))
    limited = F.when(F.coalesce("max_chars", F.lit(0)) > 0, F.substring(detail, F.lit(1), F.col("max_chars"))).otherwise(detail)
    return parts.withColumn("detail_ix", F.row_number().over(place)).filter("detail_ix <= 2").select(
        *keys, "detail_ix", limited.alias("detail"), "source_id"
    )


def refill_cleared_details(cleared: DataFrame, slide_refs: DataFrame, sources: DataFrame) -> DataFrame:
    """Cleared detail lists take matching chunks among the five from the slide's last cited one.

    ``cleared``: ``request_id, number, slot_id, role, max_chars`` of cleared bullet lists.
    """
    last = slide_refs.withColumn("seq", F.regexp_extract("source_id", r"^content_(\d+)$", 1).try_cast("int")).groupBy(
        "request_id", "number"
    ).agg(F.max("seq").alias("last_seq")).filter("last_seq is not null")
    lists = cleared.filter(F.lower(F.concat_ws(" ", "slot_id", "role")).rlike("detail|bullet|опыт|ответ"))
    spans = lists.join(last, ["request_id", "number"]).withColumn(
        "seq", F.explode(F.sequence(F.col("last_seq"), F.col("last_seq") + 4))
    )
    told = sources.filter("kind = 'content'").filter(F.col("text").rlike(X.DETAIL_WORDS)).select("request_id", "seq", "source_id", "text")
    item = F.when(F.coalesce("max_chars", F.lit(0)) > 0, F.substring("text", F.lit(1), F.col("max_chars"))).otherwise(F.col("text"))
    return spans.join(told, ["request_id", "seq"]).select("request_id", "number", "slot_id", "seq", "source_id", item.alias("item"))


# Icon names with the words that stand for them; the first one is the neutral icon.
ICONS = {
    "circle-help": ["unknown", "другое", "вопрос"],
    "chart-no-axes-column": ["chart", "analytics", "diagram", "график", "аналитика", "диаграмма"],
    "calendar-days": ["calendar", "date", "timeline", "календарь", "дата", "срок"],
    "user-round": ["user", "person", "profile", "пользователь", "человек", "профиль"],
}
NEUTRAL_ICON = "circle-help"


def match_icons(items: DataFrame, icons: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``icon`` and ``icon_fallback``. The icon list is a constant map, evaluated per row."""
    words = {word: name for name, aliases in (icons or ICONS).items() for word in [name, *aliases]}
    lookup = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    found = F.try_element_at(lookup, S.squeeze(F.lower(F.coalesce("icon_query", F.lit("")))))
    return items.withColumn("icon", F.coalesce(found, F.lit(NEUTRAL_ICON))).withColumn("icon_fallback", found.isNull())
