"""Queries over jobs and events, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import jobs as J
from plinth.plans.registry import Tables, define, query
from plinth.session import shared_folder
from plinth.streaming import jobstate, stored
from plinth.streaming.replay import replay, told_to


def jobs_of(t: Tables, jobs: DataFrame | None = None):
    """Warnings in the derived table avoid braces; here they become JSON."""
    raw = F.replace(F.col("raw_warnings"), F.lit("`"), F.lit('"'))
    json = F.regexp_replace(raw, r'\[("code".*?)\]', "{$1}")
    full = F.when(F.startswith(json, F.lit("{")), F.concat(F.lit("["), json, F.lit("]"))).otherwise(json)
    return (t("jobs") if jobs is None else jobs).withColumn("warnings", full).withColumn("plan_warnings", F.array("plan_warning"))


@query("latest_job_per_template", r"""
WITH j AS (SELECT * FROM {jobs} WHERE type = 'template_analysis' QUALIFY row_number() OVER (PARTITION BY template_id ORDER BY created_at DESC, id DESC) = 1)
SELECT t.id, t.status, j.id AS job_id, j.status AS job_status FROM {templates} t LEFT JOIN j ON j.template_id = t.id WHERE t.status <> 'deleted'
""")
def _(t: Tables):
    return J.latest_job_per_template(t("templates"), t("jobs")).select("id", "status", "job_id", "job_status")


@query("dedupe_templates", r"""
SELECT u.upload_ix, u.owner_id, u.sha256, t.id AS template_id,
  CASE WHEN row_number() OVER (PARTITION BY u.owner_id, u.sha256 ORDER BY upload_ix) > 1 THEN 'existing' WHEN t.id IS NULL THEN 'created' WHEN t.status = 'deleted' THEN 'reactivated' ELSE 'existing' END AS action
FROM {uploads} u LEFT JOIN {templates} t ON t.owner_id = u.owner_id AND t.sha256 = u.sha256
""")
def _(t: Tables):
    return J.dedupe_templates(t("uploads"), t("templates")).select("upload_ix", "owner_id", "sha256", "template_id", "action")


@query("list_jobs_keyset", r"""
WITH p AS (SELECT g.owner_id, g.cursor, least(greatest(page_limit, 1), 50) AS size, j.created_at AS at FROM {job_pages} g LEFT JOIN {jobs} j ON j.id = g.cursor AND j.owner_id = g.owner_id),
 r AS (SELECT j.owner_id, j.id, p.size, row_number() OVER (PARTITION BY j.owner_id ORDER BY j.created_at DESC, j.id DESC) AS place, count(*) OVER (PARTITION BY j.owner_id) AS n
   FROM {jobs} j JOIN p ON p.owner_id = j.owner_id WHERE j.type = 'generation' AND (p.at IS NULL OR (j.created_at, j.id) < (p.at, p.cursor)))
SELECT owner_id, id, place, CASE WHEN n > size THEN last(id) OVER (PARTITION BY owner_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_cursor
FROM r WHERE place <= size
""")
def _(t: Tables):
    pages = t("job_pages").withColumnRenamed("page_limit", "limit")
    return J.list_jobs_keyset(t("jobs"), pages).select("owner_id", "id", "place", "next_cursor")


@query("job_summary", r"""
SELECT id, CASE substr(id, 2)::BIGINT % 6 WHEN 0 THEN 'slow model' WHEN 2 THEN 'a' ELSE '' END AS texts,
  CASE WHEN substr(id, 2)::BIGINT % 6 = 2 THEN 1 ELSE 0 END AS n_issues,
  CASE WHEN plan_status = 'needs_review' THEN 'needs_review' ELSE 'passed' END AS quality_status,
  CASE WHEN plan_kind IN ('primary', 'fallback') THEN plan_kind WHEN lower(plan_warning) LIKE '%fallback%' OR lower(plan_warning) LIKE '%упрощ%' THEN 'fallback' ELSE 'primary' END AS result_kind,
  CASE WHEN qa_path IS NOT NULL THEN coalesce(n_previews, 0) END AS preview_count
FROM {jobs}
""")
def _(t: Tables):
    done = J.job_summary(jobs_of(t))
    return done.select("id", F.array_join("texts", "|").alias("texts"), F.size("validation_issues").alias("n_issues"), "quality_status", "result_kind", "preview_count")


define("x_state", r"""
WITH cut AS (SELECT job_id, min(id) AS cut FROM {job_events} WHERE stage = 'canceled' GROUP BY ALL),
 ok AS (SELECT e.*, CASE WHEN stage IN ('failed', 'canceled', 'resuming') THEN NULL WHEN stage = 'generating_slides' AND total IS NOT NULL THEN 42 + CAST(floor(16 * done / greatest(total, 1)) AS INT)
    WHEN stage = 'enriching_visuals' AND total IS NOT NULL THEN 60 + CAST(floor(30 * done / greatest(total, 1)) AS INT) WHEN stage = 'ready' THEN 100 ELSE progress END AS reached
   FROM {job_events} e LEFT JOIN cut ON cut.job_id = e.job_id WHERE cut IS NULL OR id <= cut)
SELECT job_id, CASE WHEN s IN ('ready', 'failed', 'canceled') THEN s WHEN s = 'resuming' THEN 'queued' ELSE 'processing' END AS status, s AS stage, coalesce(p, 0) AS progress, last_id
FROM (SELECT job_id, arg_max(stage, id) AS s, arg_max(reached, id) FILTER (reached IS NOT NULL) AS p, max(id) AS last_id FROM ok GROUP BY ALL) a
""")


@query("job_state", "SELECT job_id, status, stage, progress, last_id FROM {x_state}")
def _(t: Tables):
    return J.job_state(t("job_events"))


define("seen_events", "SELECT job_id, CASE WHEN max(id) % 3 = 0 THEN max(id) ELSE min(id) END AS last_id FROM {job_events} GROUP BY job_id")


@query("job_event_feed", r"""
SELECT s.job_id, count(e.id) AS n_new, coalesce(max(e.id), s.last_id) AS next_last_id, x.status IN ('ready', 'failed', 'canceled') AND count(e.id) = 0 AS done
FROM {seen_events} s LEFT JOIN {job_events} e ON e.job_id = s.job_id AND e.id > s.last_id LEFT JOIN {x_state} x ON x.job_id = s.job_id GROUP BY s.job_id, s.last_id, x.status
""")
def _(t: Tables):
    return J.job_event_feed(t("job_events"), t("seen_events"), J.job_state(t("job_events")))


@query("job_durations", r"""
SELECT job_id, CAST(epoch_us(max(created_at) FILTER (stage = 'ready')) - epoch_us(min(created_at)) AS DOUBLE) / 1e6 AS seconds FROM {job_events} GROUP BY ALL HAVING count(*) FILTER (stage = 'ready') > 0
""")
def _(t: Tables):
    return J.job_durations(t("job_events"))


@query("stage_durations", r"""
SELECT job_id, stage, CAST(sum(epoch_us(nx) - epoch_us(created_at)) AS DOUBLE) / 1e6 AS seconds
FROM (SELECT *, lead(created_at) OVER (PARTITION BY job_id ORDER BY id) AS nx FROM {job_events}) e WHERE nx IS NOT NULL GROUP BY job_id, stage
""")
def _(t: Tables):
    return J.stage_durations(t("job_events"))


define("active_jobs", "SELECT DISTINCT 'j' || CAST(l_orderkey AS STRING) AS job_id FROM {lineitem} WHERE l_returnflag = 'R'")


@query("recover_jobs", r"""
SELECT q.queue, j.id, CASE WHEN r >= 1 THEN CASE WHEN queue = 'template-enrichment' THEN 'ready' ELSE 'failed' END ELSE 'queued' END AS status,
  CASE WHEN r >= 1 THEN CASE WHEN queue = 'template-enrichment' THEN 'enrichment_failed' ELSE 'failed' END ELSE 'resuming' END AS stage,
  CASE WHEN r >= 1 THEN r ELSE r + 1 END AS system_resume_count
FROM (SELECT *, greatest(system_resume_count, CASE WHEN raw_warnings LIKE '%system_resume%' THEN 1 ELSE 0 END) AS r FROM {jobs}) j
JOIN (SELECT unnest(['generation', 'template-analysis', 'template-enrichment']) AS queue) q
  ON j.type = CASE WHEN queue = 'generation' THEN 'generation' ELSE 'template_analysis' END
WHERE j.status = 'processing' AND j.id NOT IN (SELECT job_id FROM {active_jobs})
  AND (queue = 'generation' OR (queue = 'template-analysis' AND stage IN ('validating', 'building_catalog')) OR (queue = 'template-enrichment' AND stage = 'enriching_visuals'))
""")
def _(t: Tables):
    jobs = jobs_of(t, t.dealt("jobs", "lineitem", orders="'j' || CAST(o_orderkey AS STRING)"))
    active = t.dealt("active_jobs", "lineitem", lineitem="'j' || CAST(l_orderkey AS STRING)")
    frames = [J.recover_jobs(jobs, active, q).withColumn("queue", F.lit(q)) for q in J.QUEUE_TYPE]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).select("queue", "id", "status", "stage", "system_resume_count")


define("killed", "SELECT job_id AS id, length(job_id) % 2 = 0 AS enrichment FROM {active_jobs}")


@query("killed_jobs", r"""
SELECT j.id, CASE WHEN k.enrichment THEN 'ready' ELSE 'failed' END AS status, CASE WHEN k.enrichment THEN 'enrichment_failed' ELSE 'failed' END AS stage,
  CASE WHEN j.type = 'template_analysis' AND NOT k.enrichment AND t.id IS NOT NULL THEN CASE WHEN t.model_path IS NOT NULL THEN 'ready' ELSE 'failed' END END AS template_status
FROM {jobs} j JOIN {killed} k ON k.id = j.id LEFT JOIN {templates} t ON t.id = j.template_id WHERE j.status IN ('queued', 'processing')
""")
def _(t: Tables):
    return J.killed_jobs(t("jobs"), t("killed"), t("templates"))


define("failed_jobs", "SELECT id, type, template_id, status = 'failed' OR length(id) % 3 = 0 AS failed, length(id) % 2 = 0 AS preserve_template FROM {jobs}")


@query("template_after_failure", r"""
SELECT f.id, f.template_id, CASE WHEN preserve_template AND t.model_path IS NOT NULL THEN 'ready' ELSE 'failed' END AS template_status
FROM {failed_jobs} f JOIN {templates} t ON t.id = f.template_id WHERE f.failed AND f.type = 'template_analysis'
""")
def _(t: Tables):
    return J.template_after_failure(t("failed_jobs").filter("failed"), t("templates").select("id", "model_path"))


@query("active_conflicts", r"""
SELECT t.id, TRUE AS blocks_delete, bool_or(j.type = 'generation' AND j.pinned_model IS NULL) AS blocks_reanalysis
FROM {templates} t JOIN {jobs} j ON j.template_id = t.id WHERE j.status IN ('queued', 'processing') GROUP BY t.id
""")
def _(t: Tables):
    return J.active_conflicts(t("templates"), t("jobs"))


define("model_versions", """
SELECT template_id, 'm/' || item AS path FROM (
  SELECT id AS template_id, @LIST('base-0'; 'base-1'; 'base-2'; 'base-3'; 'enriched-1'; 'enriched-1.work'; 'notes')@ FROM {templates}) v
""")


@query("prunable_versions", r"""
SELECT template_id, path FROM {model_versions} v WHERE (path LIKE 'm/base-%' OR path LIKE 'm/enriched-%') AND path NOT LIKE '%.work'
  AND NOT EXISTS (SELECT 1 FROM {templates} t WHERE t.id = v.template_id AND t.model_path = v.path)
  AND NOT EXISTS (SELECT 1 FROM {jobs} j WHERE j.template_id = v.template_id AND j.type = 'generation' AND j.status IN ('queued', 'processing') AND j.pinned_model = v.path)
""")
def _(t: Tables):
    return J.prunable_versions(t("model_versions"), t("templates"), t("jobs"))


define("annotated_slides", "SELECT deck_id, slide_number, CASE p_partkey % 3 WHEN 0 THEN 'disabled' WHEN 1 THEN 'ok' ELSE 'error' END AS vlm_status FROM {slides}")


@query("pending_annotations", r"""
SELECT deck_id, slide_number, n_slides, completed FROM (SELECT *, count(*) OVER d AS n_slides, count(*) FILTER (vlm_status <> 'disabled') OVER d AS completed
  FROM {annotated_slides} WINDOW d AS (PARTITION BY deck_id)) a WHERE vlm_status = 'disabled'
""")
def _(t: Tables):
    return J.pending_annotations(t("annotated_slides"))


@query("call_log_metrics", r"""
WITH c AS (SELECT regexp_extract(value, ' stage=(\S+)', 1) AS stage, regexp_extract(value, ' outcome=(\S+)', 1) AS outcome, regexp_extract(value, ' error_category=(\S+)', 1) AS error_category,
  CAST(regexp_extract(value, ' attempt=(\S+)', 1) AS INT) AS attempt, CAST(regexp_extract(value, ' latency=(\S+)', 1) AS DECIMAL(18,3)) AS latency, try_cast(regexp_extract(value, ' output_tokens=(\S+)', 1) AS BIGINT) AS tok FROM {call_log})
SELECT stage, outcome, error_category, count(*) FILTER (attempt = 1) AS calls, count(*) AS attempts, CAST(sum(latency) AS DOUBLE) AS latency_sum, CAST(max(latency) AS DOUBLE) AS latency_max,
  CAST(sum(tok) AS BIGINT) AS output_tokens FROM c GROUP BY ALL
""")
def _(t: Tables):
    return J.call_log_metrics(J.parse_call_log(t("call_log")))


@query("soak_summary", r"""
SELECT batch, count(*) AS runs, count(*) FILTER (ok) AS passed, quantile_disc(seconds, 0.95) AS p95_seconds, round(avg(seconds), 3) AS mean_seconds, max(llm_calls) AS max_llm_calls,
  count(*) FILTER (ok) = count(*) AND quantile_disc(seconds, 0.95) <= 180 AS soak_passed
FROM (SELECT *, slides_match AND llm_calls <= 30 AND seconds <= 180 AND NOT fallback AND n_errors = 0 AS ok FROM {soak_runs}) r GROUP BY batch
""")
def _(t: Tables):
    return J.soak_summary(J.soak_run_ok(t("soak_runs")), ["batch"])


define("failed_calls", """
SELECT event_id, CAST(CASE user_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 END AS INT) AS status,
       CASE event_type WHEN 'click' THEN 'ReadTimeout' WHEN 'view' THEN 'ConnectError' WHEN 'error' THEN 'ResponseIncompleteError' WHEN 'signup' THEN 'ResponseContentError' ELSE 'ValueError' END AS name FROM {events}
""")


@query("error_categories", r"""
SELECT c, c IN ('incomplete', 'empty_response', 'rate_limit', 'server', 'timeout', 'connection') AS retryable, count(*) AS n FROM (
SELECT CASE WHEN name = 'ResponseIncompleteError' THEN 'incomplete' WHEN name = 'ResponseContentError' THEN 'empty_response' WHEN status = 429 THEN 'rate_limit' WHEN status >= 500 THEN 'server'
  WHEN name = 'ReadTimeout' THEN 'timeout' WHEN name = 'ConnectError' THEN 'connection' WHEN status IS NOT NULL THEN 'http_' || CAST(status AS VARCHAR) ELSE 'client' END AS c FROM {failed_calls}) k GROUP BY ALL
""")
def _(t: Tables):
    named = t("failed_calls").select(J.error_category(F.col("status"), F.col("name")).alias("c"))
    return named.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumn("retryable", J.retryable(F.col("c")))


def event_rows(t: Tables):
    stamp = F.col("created_at").cast("timestamp")
    return t("job_events").select("job_id", "id", "stage", "progress", "done", "total", stamp.alias("created_at"))


def late_by(key: str, days: int):
    """Rows arrive up to ``days`` after their time, each by its own measure."""
    return lambda time: F.unix_seconds(time) + F.pmod(F.xxhash64(key), F.lit(days * 86_400))


@query("job_state_stream", "SELECT job_id, status, stage, progress, last_id FROM {x_state}")
def _(t: Tables):
    """Out of order by up to five days, with a watermark a week behind; jobs of these orders last for years."""
    rows = event_rows(t)
    folder = shared_folder(t.spark, "told")
    replay(rows, late_by("id", 5)(F.col("created_at")), told_to(folder, lambda events: jobstate.job_state(events, keep_days=36_500), "update"))
    return jobstate.latest_states(t.spark.read.schema(f"{jobstate.TOLD}, batch long").parquet(folder))


@query("job_event_feed_stream", "SELECT job_id, id, stage FROM {job_events}")
def _(t: Tables):
    """Every event twice, the second time up to 30 days later."""
    rows = event_rows(t)
    twice = rows.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    folder = shared_folder(t.spark, "feed")
    arrival = F.when(F.col("again") == 0, F.unix_seconds("created_at")).otherwise(late_by("id", 30)(F.col("created_at")))
    replay(twice, arrival, lambda stream, marks: stored.feed_events(stream.drop("again"), folder, marks), periods=3)
    return stored.stored_events(t.spark, folder, "job_id string, id bigint, stage string").select("job_id", "id", "stage")


@query("call_log_windows_stream", r"""
SELECT CAST(epoch_us(date_trunc('hour', ts)) / 1000000 AS BIGINT) AS window_start, regexp_extract(value, ' stage=(\S+)', 1) AS stage, count(*) AS attempts,
  CAST(sum(CAST(regexp_extract(value, ' latency=(\S+)', 1) AS DECIMAL(18,3))) AS DOUBLE) AS latency_sum FROM {call_log} GROUP BY ALL
""")
def _(t: Tables):
    """Windows of an hour, closed two hours behind the newest line; every eighth line comes up to three days late."""
    lines = t("call_log").withColumn("ts", F.col("ts").cast("timestamp"))
    windows = stored.CallWindows(t.spark, shared_folder(t.spark, "windows"), merge_every=2)
    late = F.pmod(F.xxhash64("value", "ts"), F.lit(8)) == 0
    arrival = F.when(late, late_by("value", 3)(F.col("ts"))).otherwise(F.unix_seconds("ts"))
    replay(lines, arrival, windows.start, periods=5)
    return windows.windows().select(F.unix_seconds("window_start").alias("window_start"), "stage", "attempts", "latency_sum")
