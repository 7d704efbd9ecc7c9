"""Queries over request texts, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import textual as X
from plinth.operators import gates as G
from plinth.operators import texts as O
from plinth.plans.registry import Tables, define, query

# --- checking SQL: chunks by line flags, numbers by explicit word-boundary marks -------------------

define("x_lines", r"""
SELECT request_id, i, trim(line) AS line,
  CASE WHEN trim(line) = '' THEN 'b' WHEN regexp_matches(trim(line), '^([-*•]|[0-9]+[.)])\s+') THEN 'l' ELSE 't' END AS k
FROM (SELECT request_id, unnest(string_split(content_package, chr(10))) AS line, unnest(range(len(string_split(content_package, chr(10))))) AS i FROM {requests}) s
""")
define("x_chunks", r"""
SELECT request_id, seq, 'content_' || CASE WHEN seq < 1000 THEN lpad(CAST(seq AS VARCHAR), 3, '0') ELSE CAST(seq AS VARCHAR) END AS source_id, text FROM (
  SELECT request_id, island, row_number() OVER (PARTITION BY request_id ORDER BY island) AS seq, string_agg(line, ' ' ORDER BY i) AS text FROM (
    SELECT *, sum(CASE WHEN k = 'l' OR (k = 't' AND coalesce(pk, 'b') <> 't') THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY i) AS island FROM (
      SELECT *, lag(k) OVER (PARTITION BY request_id ORDER BY i) AS pk FROM {x_lines}) flagged) numbered
  WHERE k <> 'b' GROUP BY request_id, island) agg
""")
define("x_sources", r"""
SELECT request_id, 0 AS seq, 'brief' AS source_id, 'brief' AS kind, brief AS text FROM {requests}
UNION ALL SELECT request_id, seq, source_id, 'content', text FROM {x_chunks}
UNION ALL SELECT request_id, asset_ix, 'asset:' || asset_id, 'asset', json FROM {request_assets}
UNION ALL SELECT request_id, image_ix, id, 'image', 'Available image: ' || asset_ref || ' (original filename: ' || original_name || ')' FROM {request_images}
""")


def number_list(text: str) -> str:
    """Checking SQL: canonical numbers of a text, without lookaround."""
    marked = f"chr(57344) || regexp_replace({text}, '([^\\p{{L}}\\p{{N}}_])', chr(57345) || '\\1' || chr(57344), 'g') || chr(57345)"
    pattern = (
        "chr(57344) || '(?:' || chr(57345) || '[-+]' || chr(57344) || ')?(?:\\d{1,3}(?:' || chr(57345) || '[ \\x{a0}\\x{202f}]' || chr(57344) || '\\d{3})+|\\d+)"
        "(?:' || chr(57345) || '[.,]' || chr(57344) || '\\d+)?(?:(?:' || chr(57345) || '[ \\x{a0}\\x{202f}]' || chr(57344) || ')?' || chr(57345) || '%' || chr(57344) || ')?' || chr(57345)"
    )
    bare = "replace(regexp_replace(n, '[^0-9,.-]', '', 'g'), ',', '.')"
    short = f"regexp_replace(regexp_replace(regexp_replace({bare}, '^(-?)0+([0-9])', '\\1\\2'), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
    return f"list_transform(regexp_extract_all({marked}, {pattern}, 0), lambda n: CASE WHEN {short} = '-0' THEN '0' ELSE {short} END)"


@query("chunk_sources", "SELECT request_id, seq, source_id, kind, text FROM {x_sources}")
def _(t: Tables):
    return O.chunk_sources(t("requests"), t("request_assets"), t("request_images"))


@query("default_facts", r"""
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY CASE kind WHEN 'brief' THEN 1 WHEN 'content' THEN 2 ELSE 3 END, seq) - 1 AS fact_ix,
  'source_' || row_number() OVER (PARTITION BY request_id ORDER BY CASE kind WHEN 'brief' THEN 1 WHEN 'content' THEN 2 ELSE 3 END, seq) AS fact_id, text, source_id, TRUE AS mandatory
FROM {x_sources} WHERE kind <> 'image'
""")
def _(t: Tables):
    facts = G.default_facts(O.chunk_sources(t("requests"), t("request_assets"), t("request_images")))
    return facts.withColumn("source_id", F.get("source_refs", F.lit(0))).drop("source_refs")


define("number_texts", "SELECT request_id, brief || chr(10) || content_package AS text FROM {requests}")


@query("extract_numbers", f"""
SELECT request_id, number_ix, number FROM (SELECT request_id, unnest(nums) AS number, unnest(range(len(nums))) AS number_ix
  FROM (SELECT request_id, {number_list("text")} AS nums FROM {{number_texts}}) a) b
""")
def _(t: Tables):
    return O.extract_numbers(t("number_texts"), ["request_id"])


define("claims", """
SELECT d.source AS request_id, 'claims[' || CAST(d.doc_id AS STRING) || ']' AS path, q.content_package AS text,
       'q' || CAST(d.doc_id + 20 AS STRING) AS ref_one,
       CASE WHEN d.doc_id % 3 = 0 THEN 'q' || CAST(d.doc_id AS STRING) ELSE 'q' || CAST(d.doc_id - 20 AS STRING) END AS ref_two
FROM {documents} d JOIN {requests} q ON q.doc_id = d.doc_id
""")
define("claim_sources", """
SELECT d.source AS request_id, q.request_id AS source_id, q.brief || ' ' || q.content_package AS text
FROM {documents} d JOIN {requests} q ON q.doc_id = d.doc_id
""")


@query("ground_numbers", f"""
WITH c AS (SELECT request_id, path, ref_one, ref_two, unnest(list_distinct({number_list("text")})) AS number FROM {{claims}}),
 s AS (SELECT request_id, source_id, unnest(list_distinct({number_list("text")})) AS number FROM {{claim_sources}})
SELECT request_id, path, number FROM c
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.request_id = c.request_id AND s.number = c.number AND s.source_id = c.ref_one)
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.request_id = c.request_id AND s.number = c.number AND s.source_id = c.ref_two)
""")
def _(t: Tables):
    return O.ground_numbers(t("claims").withColumn("source_refs", F.array("ref_one", "ref_two")), t("claim_sources"))


@query("missing_references", r"""
WITH texts AS (SELECT request_id, brief || chr(10) || content_package AS text FROM {requests}),
 named AS (
  SELECT request_id, unnest(regexp_extract_all(text, '(?i)(?:из\s+)?(?:набор(?:а|е)?\s+данных|таблиц[ауы])\s+(?:id\s*)?[:=]?\s*[`"'']?([A-Za-z0-9][A-Za-z0-9_.-]*)', 1)) AS name FROM texts
  UNION SELECT request_id, unnest(regexp_extract_all(text, '(?i)dataset(?:\s+id)?\s*[:=]?\s*[`"'']?([A-Za-z0-9][A-Za-z0-9_.-]*)', 1)) FROM texts),
 files AS (SELECT DISTINCT request_id, unnest(regexp_extract_all(text, '(?i)([\p{L}\p{N}_@()+.-]+\.(?:png|jpe?g|webp|gif|bmp|tiff?))', 1)) AS name FROM texts),
 held AS (SELECT request_id, lower(split_part(original_name, '/', -1)) AS base FROM {request_images} UNION SELECT request_id, lower(split_part(asset_ref, '/', -1)) FROM {request_images})
SELECT request_id, 'dataset' AS kind, name FROM named n WHERE NOT EXISTS (SELECT 1 FROM {request_assets} a WHERE a.request_id = n.request_id AND a.asset_id = n.name)
UNION ALL SELECT request_id, 'image', name FROM files f WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.request_id = f.request_id AND h.base = lower(split_part(f.name, '/', -1)))
""")
def _(t: Tables):
    return O.missing_references(t("requests"), t("request_assets"), t("request_images"))


@query("requested_visual", r"""
WITH j AS (SELECT a.request_id, a.asset_id, q.brief || chr(10) || q.content_package AS text FROM {request_assets} a JOIN {requests} q ON q.request_id = a.request_id),
 l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), asset_id))[1] AS line, instr(lower(text), asset_id) - 1 AS pos FROM j),
 w AS (SELECT request_id, asset_id, lower(coalesce(nullif(line, ''), substr(text, greatest(pos - 120, 0) + 1, pos + length(asset_id) + 120 - greatest(pos - 120, 0)))) AS w FROM l),
 s AS (SELECT *, CASE WHEN contains(w, 'кольцев') THEN 'donut' WHEN contains(w, 'кругов') THEN 'pie' WHEN contains(w, 'линейн') THEN 'line'
    WHEN contains(w, 'donut') THEN 'donut' WHEN contains(w, 'pie') THEN 'pie' WHEN contains(w, 'line') THEN 'line' WHEN contains(w, 'area') THEN 'area'
    WHEN contains(w, 'column') THEN 'column' WHEN contains(w, 'bar') THEN 'bar' WHEN contains(w, 'scatter') THEN 'scatter'
    WHEN contains(w, 'trend') OR contains(w, 'динамик') OR contains(w, 'тренд') THEN 'line' ELSE 'column' END AS sub FROM w)
SELECT request_id, asset_id, CASE WHEN contains(w, 'table') OR contains(w, 'таблиц') THEN 'table' ELSE 'chart' END AS visual_kind,
  CASE WHEN contains(w, 'table') OR contains(w, 'таблиц') THEN NULL ELSE sub END AS visual_subtype FROM s
""")
def _(t: Tables):
    return O.requested_visuals(t("requests"), t("request_assets").select("request_id", "asset_id"))


@query("required_images", r"""
SELECT i.request_id, i.id FROM {request_images} i JOIN {requests} q ON q.request_id = i.request_id
WHERE contains(lower(q.brief || chr(10) || q.content_package), lower(split_part(i.original_name, '/', -1)))
   OR contains(lower(q.brief || chr(10) || q.content_package), lower(split_part(i.asset_ref, '/', -1)))
""")
def _(t: Tables):
    return O.required_images(t("requests"), t("request_images")).select("request_id", "id")


# Outline of a request: up to eight slides; slide n cites its n-th chunk and a heading.
define("outline_slides", """
SELECT request_id, CAST(item_ix + 1 AS INT) AS number, 'Slide about ' || item || ' ' || brief AS purpose, slide_max FROM (
  SELECT request_id, brief, slide_max, @LIST('src0 report'; 'dataset'; 'team'; 'photo'; 'bar'; 'table'; 'src5'; 'closing')@ FROM {requests}) s
WHERE item_ix < slide_max - 1
""")
define("outline_refs", """
SELECT request_id, number, CAST(item_ix AS INT) AS ref_ix, item AS source_id FROM (
  SELECT request_id, number, @LIST('content_00' || CAST(number AS STRING); 'content_00' || CAST((number * 3) % 8 + 1 AS STRING); 'brief')@ FROM {outline_slides}) s
WHERE item_ix < 2 OR number % 4 = 1
""")


@query("expand_headings", r"""
WITH nx AS (SELECT request_id, source_id, text, lead(source_id) OVER w AS next_id, lead(text) OVER w AS next_text FROM {x_chunks} WINDOW w AS (PARTITION BY request_id ORDER BY seq)),
 extra AS (SELECT r.request_id, r.number, n.next_id AS source_id, min(r.ref_ix) AS ix FROM {outline_refs} r JOIN nx n ON n.request_id = r.request_id AND n.source_id = r.source_id
   WHERE starts_with(ltrim(n.text), '#') AND NOT starts_with(ltrim(n.next_text), '#') AND NOT EXISTS (
     SELECT 1 FROM {outline_refs} o WHERE o.request_id = r.request_id AND o.number = r.number AND o.source_id = n.next_id) GROUP BY ALL)
SELECT request_id, number, string_agg(source_id, '|' ORDER BY grp, ix) AS refs FROM (
  SELECT request_id, number, 0 AS grp, ref_ix AS ix, source_id FROM {outline_refs} UNION ALL SELECT request_id, number, 1, ix, source_id FROM extra) u GROUP BY ALL
""")
def _(t: Tables):
    wide = O.expand_headings(t("outline_refs"), O.chunk_sources(t("requests")))
    refs = F.array_sort(F.collect_list(F.struct("ref_ix", "source_id")))
    return wide.groupBy("request_id", "number").agg(F.array_join(F.transform(refs, lambda r: r["source_id"]), "|").alias("refs"))


@query("allocate_orphans", r"""
WITH o AS (SELECT s.request_id, s.source_id, row_number() OVER (PARTITION BY s.request_id ORDER BY s.seq) - 1 AS ix FROM {x_sources} s
  WHERE s.kind IN ('brief', 'content') AND NOT EXISTS (SELECT 1 FROM {outline_refs} r WHERE r.request_id = s.request_id AND r.source_id = s.source_id)),
 n AS (SELECT request_id, count(*) AS n FROM {outline_slides} GROUP BY ALL)
SELECT o.request_id, o.source_id, o.ix % n.n + 1 AS number FROM o JOIN n ON n.request_id = o.request_id
""")
def _(t: Tables):
    return O.allocate_orphans(O.chunk_sources(t("requests")), t("outline_refs"), t("outline_slides"))


define("x_cited", r"""
SELECT o.request_id, o.number, o.purpose, coalesce(string_agg(s.text, chr(10) ORDER BY r.ref_ix), '') AS cited FROM {outline_slides} o
LEFT JOIN {outline_refs} r ON r.request_id = o.request_id AND r.number = o.number
LEFT JOIN {x_sources} s ON s.request_id = r.request_id AND s.source_id = r.source_id GROUP BY ALL
""")


def cited_slides(t: Tables):
    sources = O.chunk_sources(t("requests")).select("request_id", "source_id", "text")
    lines = F.array_sort(F.collect_list(F.struct("ref_ix", "text")))
    cited = t("outline_refs").join(sources, ["request_id", "source_id"]).groupBy("request_id", "number").agg(
        F.array_join(F.transform(lines, lambda l: l["text"]), "\n").alias("cited")
    )
    return t("outline_slides").join(cited, ["request_id", "number"], "left").withColumn("cited", F.coalesce("cited", F.lit("")))


@query("word_overlap_score", r"""
SELECT a.request_id, a.asset_id, c.number, len(list_filter(list_distinct(regexp_extract_all(lower(a.title), '[\p{L}\p{N}_-]{3,}')),
  lambda w: contains(lower(c.cited), w) OR contains(lower(c.purpose), w))) AS overlap
FROM {request_assets} a JOIN {x_cited} c ON c.request_id = a.request_id
""")
def _(t: Tables):
    titles = t("request_assets").select("request_id", "asset_id", "title")
    return O.word_overlap_score(titles, cited_slides(t).select("request_id", "number", "purpose", "cited"))


@query("clip_text", r"""
WITH v AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS v, 20 + doc_id % 90 AS lim FROM {documents})
SELECT doc_id, lim, CASE WHEN length(v) <= lim THEN v WHEN regexp_matches(substr(v, 1, lim + 1), '^.+ ') THEN regexp_extract(substr(v, 1, lim + 1), '(?s)^(.+) ', 1)
   ELSE rtrim(substr(v, 1, lim)) END AS whole_words,
  CASE WHEN length(v) <= lim THEN v ELSE rtrim(substr(v, 1, lim - 1)) || '…' END AS ellipsis
FROM v
""")
def _(t: Tables):
    docs = t("documents").withColumn("lim", 20 + F.col("doc_id") % 90)
    lim = F.col("lim").cast("int")
    return docs.select("doc_id", "lim", X.clip_words(F.col("text"), lim).alias("whole_words"), X.clip_ellipsis(F.col("text"), lim).alias("ellipsis"))


define("x_fragments", r"""
SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?;])\s+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10)),
   lambda p: trim(p, ' -•' || chr(9))), lambda p: p <> '') AS parts FROM {documents}
""")


@query("split_fragments", "SELECT doc_id, unnest(range(len(parts))) AS ix, unnest(parts) AS fragment FROM {x_fragments}")
def _(t: Tables):
    return t("documents").select("doc_id", F.posexplode(X.fragments(F.col("text"))).alias("ix", "fragment"))


@query("extract_metrics", r"""
WITH m AS (SELECT request_id, regexp_extract_all(t, p, 1) AS l, regexp_extract_all(t, p, 2) AS v, regexp_extract_all(t, p, 3) AS u FROM (
   SELECT request_id, brief || '. ' || source || ': ' || CAST(doc_id AS VARCHAR) || ' pts; rate 7,5%' AS t,
     '([^.;]{0,60}?)\b([-+]?\d+(?:[.,]\d+)?)\s*(%|[A-Za-zА-Яа-яЁё]+)?' AS p FROM {metric_texts}) s)
SELECT request_id, i, coalesce(nullif(trim(l[i + 1], ' :-'), ''), 'Показатель') AS label, CAST(replace(v[i + 1], ',', '.') AS DOUBLE) AS value, nullif(u[i + 1], '') AS unit
FROM (SELECT *, unnest(range(least(3, len(v)))) AS i FROM m) k
""")
def _(t: Tables):
    text = F.concat("brief", F.lit(". "), "source", F.lit(": "), F.col("doc_id").cast("string"), F.lit(" pts; rate 7,5%"))
    found = t("metric_texts").select("request_id", F.posexplode(X.metrics(text)).alias("i", "m"))
    return found.select("request_id", "i", "m.label", "m.value", "m.unit")


define("metric_texts", "SELECT 'q' || CAST(doc_id AS STRING) AS request_id, doc_id, source, 'Chars ' || CAST(n_chars AS STRING) || ' in ' || lang AS brief FROM {documents}")
define("people", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || ' - ' || c_mktsegment || ': lead' WHEN 1 THEN c_name || ': ' || c_mktsegment ELSE c_name END AS line FROM {customer}
""")


@query("extract_profiles", r"""
SELECT c_custkey, CASE WHEN cut = 0 THEN line ELSE substr(line, 1, cut - 1) END AS name,
  CASE WHEN cut = 0 THEN 'Участник команды' ELSE regexp_replace(substr(line, cut), '^(\s+[—-]\s+|:\s+)', '') END AS role
FROM (SELECT *, length(regexp_extract(line, '^(.*?)(\s+[—-]\s+|:\s+)', 1)) + CASE WHEN regexp_matches(line, '\s+[—-]\s+|:\s+') THEN 1 ELSE 0 END AS cut FROM {people}) p
""")
def _(t: Tables):
    return t("people").select("c_custkey", X.profile(F.col("line")).alias("p")).select("c_custkey", "p.name", "p.role")


define("profiles", """
SELECT request_id, 1 AS number, 'people' AS slot_id, CAST(doc_id % 3 AS INT) AS item_ix, 'Anna ' || CAST((doc_id + doc_id % 2) % 7 AS STRING) AS name,
       CASE WHEN doc_id % 4 = 0 THEN 'content_001' ELSE 'brief' END AS ref, CAST(CASE WHEN doc_id % 5 = 0 THEN 15 END AS INT) AS max_chars
FROM {requests}
""")


@query("enrich_profile_details", r"""
WITH told AS (SELECT * FROM {x_sources} WHERE kind <> 'asset' AND kind <> 'image' AND regexp_matches(lower(text), 'опыт|ответствен|experience|responsib')),
 cited AS (SELECT p.*, t.seq, t.source_id, t.text FROM {profiles} p JOIN told t ON t.request_id = p.request_id AND t.source_id = p.ref),
 named AS (SELECT p.*, t.seq, t.source_id, t.text FROM {profiles} p JOIN told t ON t.request_id = p.request_id AND contains(lower(t.text), lower(p.name))
   WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.request_id = p.request_id)),
 parts AS (SELECT request_id, number, slot_id, item_ix, max_chars, seq, source_id, unnest(ps) AS part, unnest(range(len(ps))) AS ix FROM (
   SELECT *, regexp_split_to_array(text, '[.;]|\n|\s+[—-]\s+') AS ps FROM (SELECT * FROM cited UNION ALL SELECT * FROM named) u) v),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, number, slot_id, item_ix ORDER BY seq, source_id, ix) AS detail_ix FROM parts WHERE regexp_matches(lower(part), 'опыт|ответствен|experience|responsib'))
SELECT request_id, number, slot_id, item_ix, detail_ix, CASE WHEN max_chars IS NULL THEN trim(part) ELSE substr(trim(part), 1, max_chars) END AS detail, source_id
FROM ranked WHERE detail_ix <= 2
""")
def _(t: Tables):
    return O.enrich_profiles(t("profiles").withColumn("source_refs", F.array("ref")), O.chunk_sources(t("requests")))


define("cleared_lists", """
SELECT request_id, number, CASE WHEN number % 2 = 0 THEN 'details' ELSE 'notes' END AS slot_id, 'list' AS role,
       CAST(CASE WHEN number % 3 = 0 THEN 25 END AS INT) AS max_chars FROM {outline_slides}
""")


@query("refill_cleared_details", r"""
WITH last AS (SELECT request_id, number, max(CAST(substr(source_id, 9) AS INT)) AS s FROM {outline_refs} WHERE starts_with(source_id, 'content_') GROUP BY ALL)
SELECT c.request_id, c.number, c.slot_id, x.seq, x.source_id, CASE WHEN c.max_chars IS NULL THEN x.text ELSE substr(x.text, 1, c.max_chars) END AS item
FROM {cleared_lists} c JOIN last l ON l.request_id = c.request_id AND l.number = c.number
JOIN {x_chunks} x ON x.request_id = c.request_id AND x.seq BETWEEN l.s AND l.s + 4
WHERE contains(c.slot_id, 'detail') AND regexp_matches(lower(x.text), 'опыт|ответствен|experience|responsib')
""")
def _(t: Tables):
    return O.refill_cleared_details(t("cleared_lists"), t("outline_refs"), O.chunk_sources(t("requests")))


define("tag_rows", "SELECT doc_id, ' ' || upper(lang) || '! ' AS a, source || '--' || lang AS b, replace(text, chr(10), ' ') AS c, lang AS d, '***' AS e FROM {documents}")


@query("normalize_tags", r"""
WITH n AS (SELECT doc_id, list_transform([a, b, c, d, e], lambda x: trim(regexp_replace(lower(trim(x)), '[^\p{L}\p{N}_]+', '_', 'g'), '_')) AS tags FROM {tag_rows})
SELECT doc_id, array_to_string(list_filter(tags, lambda x, i: x <> '' AND list_position(tags, x) = i), '|') AS tags FROM n
""")
def _(t: Tables):
    return t("tag_rows").select("doc_id", F.array_join(X.normal_tags(F.array("a", "b", "c", "d", "e")), "|").alias("tags"))


define("icon_items", """
SELECT event_id, CASE event_type WHEN 'click' THEN ' Calendar ' WHEN 'view' THEN 'chart' WHEN 'error' THEN 'rocket' WHEN 'signup' THEN 'user-round' ELSE 'Человек' END AS icon_query FROM {events}
""")


@query("match_icons", r"""
SELECT event_id, icon_query, CASE lower(trim(icon_query)) WHEN 'calendar' THEN 'calendar-days' WHEN 'chart' THEN 'chart-no-axes-column' WHEN 'user-round' THEN 'user-round'
  WHEN 'человек' THEN 'user-round' ELSE 'circle-help' END AS icon, lower(trim(icon_query)) = 'rocket' AS icon_fallback FROM {icon_items}
""")
def _(t: Tables):
    return O.match_icons(t("icon_items"))
