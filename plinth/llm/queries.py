"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import collocations, decontamination, gated, language, licences, mixing, quality, resampling, sequences, simhash, substrings, topk, toxicity
from plinth.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def byte_bpe() -> str:
    """Path of the tokenizer file; the package is installed on driver and executors."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(table(spark, sf_dir, "documents"))


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "sequences")
    return sequences.read_documents(sequences.write_sequences(table(spark, sf_dir, "documents"), folder, byte_bpe))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).drop("times")


ORACLES["op8_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents
),
sources AS (SELECT source, sum(size)::DOUBLE AS source_size, 3 * sum(size)::DOUBLE AS cap FROM sized GROUP BY source),
weighted AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sources),
levels AS (
  SELECT *, row_number() OVER w AS k,
    ((SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)
),
water AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY k LIMIT 1),
planned AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM (SELECT *, coalesce(least((SELECT level FROM water) * weight, cap), cap) AS target FROM weighted)
),
once AS (SELECT source, digest, sum(size) AS n FROM sized GROUP BY source, digest),
ordered AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2 AS middle FROM once),
cuts AS (
  SELECT p.source, max(o.digest) FILTER (WHERE o.middle < p.target - p.whole * p.source_size) AS cut
  FROM planned p JOIN ordered o ON o.source IS NOT DISTINCT FROM p.source GROUP BY p.source
)
SELECT s.doc_id, s.size, p.source_size::BIGINT AS source_size, p.target,
  (s.size * (p.whole + (CASE WHEN s.digest <= c.cut THEN 1 ELSE 0 END)))::BIGINT AS taken
FROM sized s JOIN planned p ON p.source IS NOT DISTINCT FROM s.source JOIN cuts c ON c.source IS NOT DISTINCT FROM s.source
"""


@query
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("vector"))
    return topk.exact_top_k(vectors, vectors.filter("id % 100 = 0"), 10)


ORACLES["op9_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
WHERE rank <= 10
"""


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op11_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated.log_probabilities(table(spark, sf_dir, "documents"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS k) ks WHERE len(ws) >= k
),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:k], ' ') AS y
  FROM c, (SELECT unnest([1, 2]) AS j) js WHERE j < k
),
s AS (
  SELECT u.lang, u.k, u.phrase, u.a, u.j, l.n AS l, r.n AS r, (1000000::HUGEINT * u.a * u.a) // (l.n::HUGEINT * r.n) AS score
  FROM cuts u JOIN f l ON l.lang = u.lang AND l.k = u.j AND l.phrase = u.x JOIN f r ON r.lang = u.lang AND r.k = u.k - u.j AND r.phrase = u.y
),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
m AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) i GROUP BY ALL
),
kept AS (SELECT b.* FROM best b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE m.longer IS NULL OR 100 * m.longer < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score::BIGINT AS score
  FROM kept JOIN t ON t.lang = kept.lang
) x WHERE rank <= 2000
"""


@query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash", "n_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
