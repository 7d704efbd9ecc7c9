"""Job, template and event tables: states, listings, recovery and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.selection import value_at_rank

# Stage names, terminal states, the share of progress that slide work covers.
TERMINAL = ["ready", "failed", "canceled"]
ACTIVE = ["queued", "processing"]
QUEUE_TYPE = {"generation": "generation", "template-analysis": "template_analysis", "template-enrichment": "template_analysis"}
QUEUE_STAGES = {
    "template-analysis": [
        "validating", "analyzing_structure", "building_base_catalog", "analyzing_structure_and_vlm", "building_catalog",
    ],
    "template-enrichment": ["ready_enriching", "enriching_visuals", "rebuilding_catalog"],
}
FALLBACK_WORDS = "упрощ|fallback"


def latest_job_per_template(templates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Templates with their newest analysis job. A max aggregation, so no group is sorted."""
    order = F.struct("created_at", "id")
    newest = jobs.filter("type = 'template_analysis'").groupBy("template_id").agg(
        F.max_by(F.struct(F.col("id").alias("job_id"), F.col("status").alias("job_status"), F.col("created_at").alias("job_created_at")), order).alias("j")
    ).select(F.col("template_id").alias("id"), "j.*")
    return templates.filter("status <> 'deleted'").join(newest, "id", "left")


def dedupe_templates(uploads: DataFrame, templates: DataFrame) -> DataFrame:
    """Action per upload: ``existing``, ``reactivated`` or ``created``; one template per (owner, sha256).

    ``uploads``: ``upload_ix, owner_id, sha256, name``.
    """
    keys = ["owner_id", "sha256"]
    first = uploads.groupBy(*keys).agg(F.min("upload_ix").alias("first_ix"))
    known = templates.select(*keys, F.col("id").alias("template_id"), F.col("status").alias("known_status"))
    is_first = F.col("upload_ix") == F.col("first_ix")
    action = (
        F.when(F.col("template_id").isNull() & is_first, "created")
        .when((F.col("known_status") == "deleted") & is_first, "reactivated")
        .otherwise("existing")
    )
    return uploads.join(first, keys).join(known, keys, "left").select(
        "upload_ix", *keys, "name", "template_id", action.alias("action"),
        F.when(action == "existing", F.coalesce(F.nullif(F.col("known_status"), F.lit("deleted")), F.lit("processing")))
        .otherwise(F.lit("processing")).alias("status"),
    )


def list_jobs_keyset(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """One page of generation jobs per row of ``pages`` (``owner_id, cursor, limit``), newest first.

    Rows come strictly after the cursor's job; an unknown cursor gives the first page. ``next_cursor``
    is the last shown id where more rows follow. Ranks above the limit are cut before the shuffle.
    """
    size = F.least(F.greatest("limit", F.lit(1)), F.lit(50))
    pivots = jobs.select(F.col("id").alias("cursor"), "owner_id", F.col("created_at").alias("pivot_at"))
    asked = pages.join(pivots, ["owner_id", "cursor"], "left").select("owner_id", "cursor", size.alias("size"), "pivot_at")
    after = F.col("pivot_at").isNull() | (F.col("created_at") < F.col("pivot_at")) | (
        (F.col("created_at") == F.col("pivot_at")) & (F.col("id") < F.col("cursor"))
    )
    place = Window.partitionBy("owner_id").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = (
        jobs.filter("type = 'generation'").join(asked, "owner_id").filter(after)
        .withColumn("place", F.row_number().over(place)).filter("place <= 51").filter(F.col("place") <= F.col("size") + 1)
    )
    more = ranked.groupBy("owner_id").agg(
        F.when(F.max("place") > F.max("size"), F.max_by("id", F.when(F.col("place") <= F.col("size"), F.col("place")))).alias("next_cursor")
    )
    return ranked.filter(F.col("place") <= F.col("size")).join(more, "owner_id")


def split_warnings(warnings: Column) -> tuple[Column, Column]:
    """Text warnings and issue objects of a JSON list, without resume markers."""
    items = F.from_json(warnings, "array<string>")
    objects = F.filter(items, lambda w: F.startswith(w, F.lit("{")))
    issues = F.filter(objects, lambda w: F.coalesce(F.get_json_object(w, "$.code"), F.lit("")) != "system_resume")
    return F.filter(items, lambda w: ~F.startswith(w, F.lit("{"))), issues


def resume_markers(warnings: Column) -> Column:
    items = F.from_json(warnings, "array<string>")
    return F.size(F.filter(items, lambda w: F.startswith(w, F.lit("{")) & (F.get_json_object(w, "$.code") == "system_resume")))


def result_kind(explicit: Column, warnings: Column) -> Column:
    legacy = F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: F.lower(w).rlike(FALLBACK_WORDS))
    return F.when(explicit.isin("primary", "fallback"), explicit).when(legacy, "fallback").otherwise("primary")


def job_summary(jobs: DataFrame) -> DataFrame:
    """``jobs`` with ``warnings`` as JSON text, and the plan's ``plan_status, plan_kind, plan_warnings, n_previews``."""
    texts, issues = split_warnings(F.col("warnings"))
    kind = result_kind(F.col("plan_kind"), F.col("plan_warnings"))
    return jobs.withColumn("texts", texts).withColumn("validation_issues", issues).withColumn(
        "quality_status", F.when(F.col("plan_status") == "needs_review", "needs_review").otherwise("passed")
    ).withColumn("result_kind", kind).withColumn("degraded", F.col("result_kind") == "fallback").withColumn(
        "preview_count", F.when(F.col("qa_path").isNotNull(), F.coalesce("n_previews", F.lit(0)))
    )


def job_event_feed(events: DataFrame, seen: DataFrame, states: DataFrame) -> DataFrame:
    """Events after the last one each reader has seen; ``done`` once a job is terminal with nothing new."""
    waiting = seen.join(states.select("job_id", "status"), "job_id", "left")
    fresh = events.join(seen.select("job_id", "last_id"), "job_id").filter(F.col("id") > F.col("last_id"))
    counts = fresh.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_new"), F.max("id").alias("newest_id"))
    return waiting.join(counts, "job_id", "left").select(
        "job_id", F.coalesce("n_new", F.lit(0)).alias("n_new"), F.coalesce("newest_id", "last_id").alias("next_last_id"),
        (F.col("status").isin(TERMINAL) & F.col("n_new").isNull()).alias("done"),
    )


def event_progress(stage: Column, progress: Column, done: Column, total: Column) -> Column:
    """Progress an event reports; failures and cancellations keep what was reached before."""
    count = F.greatest(total, F.lit(1))
    return (
        F.when(stage.isin("failed", "canceled", "resuming"), F.lit(None).cast("int"))
        .when((stage == "generating_slides") & total.isNotNull(), (F.floor(done * 16 / count) + 42).cast("int"))
        .when((stage == "enriching_visuals") & total.isNotNull(), (F.floor(done * 30 / count) + 60).cast("int"))
        .when(stage == "ready", F.lit(100))
        .otherwise(progress)
    )


def stage_status(stage: Column) -> Column:
    return F.when(stage.isin(TERMINAL), stage).when(stage == "resuming", "queued").otherwise("processing")


def job_state(events: DataFrame) -> DataFrame:
    """Last accepted ``status, stage, progress`` per job; nothing counts after the first cancellation.

    ``events``: ``job_id, id, stage, progress, done, total``.
    """
    cut = events.filter("stage = 'canceled'").groupBy("job_id").agg(F.min("id").alias("cut_id"))
    accepted = events.join(cut, "job_id", "left").filter(F.col("cut_id").isNull() | (F.col("id") <= F.col("cut_id")))
    reached = event_progress(F.col("stage"), F.col("progress"), F.col("done"), F.col("total"))
    last = accepted.withColumn("reached", reached).groupBy("job_id").agg(
        F.max_by("stage", "id").alias("stage"),
        F.max_by("reached", F.when(F.col("reached").isNotNull(), F.col("id"))).alias("progress"),
        F.max("id").alias("last_id"),
    )
    return last.select("job_id", stage_status(F.col("stage")).alias("status"), "stage", F.coalesce("progress", F.lit(0)).alias("progress"), "last_id")


def template_after_failure(failed: DataFrame, templates: DataFrame) -> DataFrame:
    """``id, template_id, template_status``: a failed analysis leaves a template ready only if it had a model and was to be preserved."""
    kept = F.col("preserve_template") & F.col("model_path").isNotNull()
    return failed.filter("type = 'template_analysis'").join(templates.withColumnRenamed("id", "template_id"), "template_id").select(
        "id", "template_id", F.when(kept, "ready").otherwise("failed").alias("template_status")
    )


def job_durations(events: DataFrame) -> DataFrame:
    """Seconds from first to terminal event of each job that became ready."""
    done = F.max(F.when(F.col("stage") == "ready", F.col("created_at")))
    return events.groupBy("job_id").agg(F.min("created_at").alias("started"), done.alias("finished")).filter(
        "finished is not null"
    ).select("job_id", _seconds(F.col("started"), F.col("finished")).alias("seconds"))


def _seconds(start: Column, end: Column) -> Column:
    return F.unix_micros(end.cast("timestamp")) / 1e6 - F.unix_micros(start.cast("timestamp")) / 1e6


def stage_durations(events: DataFrame) -> DataFrame:
    """Seconds spent per job and stage: each event lasts until the job's next one.

    The walk over a job's events is split by blocks of event ids; the first event of the next block
    closes the last one of a block.
    """
    block = F.floor(F.col("id") / 1_000_000)
    marked = events.withColumn("_block", block)
    heads = marked.groupBy("job_id", "_block").agg(F.min_by("created_at", "id").alias("head"))
    following = Window.partitionBy("job_id").orderBy("_block")
    nexts = heads.select("job_id", "_block", F.lead("head").over(following).alias("_next_head"))
    inside = Window.partitionBy("job_id", "_block").orderBy("id")
    timed = marked.join(nexts, ["job_id", "_block"]).withColumn(
        "until", F.coalesce(F.lead("created_at").over(inside), F.col("_next_head"))
    )
    return timed.filter("until is not null").groupBy("job_id", "stage").agg(
        F.sum(_seconds(F.col("created_at"), F.col("until"))).alias("seconds")
    )


def recover_jobs(jobs: DataFrame, active: DataFrame, queue: str) -> DataFrame:
    """New state of stale jobs of one queue: resumed once, then failed.

    ``jobs`` also carries ``system_resume_count``; ``active``: ``job_id`` of running or queued work.
    """
    stale = jobs.filter((F.col("type") == QUEUE_TYPE[queue]) & (F.col("status") == "processing"))
    if queue in QUEUE_STAGES:
        stale = stale.filter(F.col("stage").isin(QUEUE_STAGES[queue]))
    lost = stale.join(active.select(F.col("job_id").alias("id")), "id", "left_anti")
    resumes = F.greatest(F.coalesce("system_resume_count", F.lit(0)), F.coalesce(resume_markers(F.col("warnings")), F.lit(0)))
    again = resumes >= 1
    enrichment = queue == "template-enrichment"
    return lost.withColumn("resumes", resumes).select(
        "id",
        F.when(again, F.lit("ready" if enrichment else "failed")).otherwise("queued").alias("status"),
        F.when(again, F.lit("enrichment_failed" if enrichment else "failed")).otherwise("resuming").alias("stage"),
        F.when(again, F.col("resumes")).otherwise(F.col("resumes") + 1).alias("system_resume_count"),
        "progress",
    )


def killed_jobs(jobs: DataFrame, killed: DataFrame, templates: DataFrame) -> DataFrame:
    """State after a hard kill. ``killed``: ``id, enrichment``."""
    published = templates.select(F.col("id").alias("template_id"), F.col("model_path").isNotNull().alias("published"))
    hit = jobs.filter(F.col("status").isin(ACTIVE)).join(killed, "id").join(published, "template_id", "left")
    analysis = (F.col("type") == "template_analysis") & ~F.col("enrichment") & F.col("published").isNotNull()
    return hit.select(
        "id",
        F.when(F.col("enrichment"), "ready").otherwise("failed").alias("status"),
        F.when(F.col("enrichment"), "enrichment_failed").otherwise("failed").alias("stage"),
        F.when(analysis, F.when(F.col("published"), "ready").otherwise("failed")).alias("template_status"),
    )


def active_conflicts(templates: DataFrame, jobs: DataFrame) -> DataFrame:
    """``id, blocks_delete, blocks_reanalysis``: any active job blocks deletion, an unpinned generation re-analysis."""
    unpinned = (F.col("type") == "generation") & F.col("pinned_model").isNull()
    busy = jobs.filter(F.col("status").isin(ACTIVE)).groupBy("template_id").agg(F.bool_or(unpinned).alias("blocks_reanalysis"))
    return templates.select("id").join(busy.withColumnRenamed("template_id", "id"), "id").select(
        "id", F.lit(True).alias("blocks_delete"), "blocks_reanalysis"
    )


def prunable_versions(versions: DataFrame, templates: DataFrame, jobs: DataFrame) -> DataFrame:
    """``versions``: ``template_id, path``. Unpublished base or enriched versions no active generation pins."""
    name = F.substring_index("path", "/", -1)
    finished = versions.filter(name.rlike("^(base-|enriched-)") & ~F.endswith(name, F.lit(".work")))
    published = templates.select(F.col("id").alias("template_id"), F.col("model_path").alias("path"))
    pinned = jobs.filter((F.col("type") == "generation") & F.col("status").isin(ACTIVE)).select(
        "template_id", F.col("pinned_model").alias("path")
    )
    kept = published.unionByName(pinned).filter("path is not null")
    return finished.join(kept, ["template_id", "path"], "left_anti")


def pending_annotations(slides: DataFrame) -> DataFrame:
    """Slides still to annotate, with how many of their deck are done."""
    counts = slides.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("n_slides"), F.count_if(F.col("vlm_status") != "disabled").alias("completed")
    )
    return slides.filter("vlm_status = 'disabled'").select("deck_id", "slide_number").join(counts, "deck_id")


def error_category(status: Column, name: Column) -> Column:
    """Category of a failed call from its HTTP status, or its exception name where it has none."""
    name = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(name == "responseincompleteerror", "incomplete")
        .when(name == "responsecontenterror", "empty_response")
        .when(status == 429, "rate_limit")
        .when(status >= 500, "server")
        .when(F.contains(name, F.lit("timeout")), "timeout")
        .when(name.rlike("connection|connect|network"), "connection")
        .when(status.isNotNull(), F.concat(F.lit("http_"), status.cast("string")))
        .otherwise("client")
    )


def retryable(category: Column) -> Column:
    return category.isin("incomplete", "empty_response", "rate_limit", "server", "timeout", "connection")


def parse_call_log(lines: DataFrame) -> DataFrame:
    """Fields of ``llm_call`` log lines in column ``value``; other lines are dropped."""

    def field(name: str) -> Column:
        return F.regexp_extract("value", rf"\b{name}=(\S+)", 1)

    rest = [c for c in lines.columns if c != "value"]
    return lines.filter(F.contains("value", F.lit("llm_call "))).select(
        *rest, field("job").alias("job"), field("stage").alias("stage"), field("attempt").try_cast("int").alias("attempt"),
        field("latency").try_cast("double").alias("latency"), field("output_tokens").try_cast("bigint").alias("output_tokens"),
        field("outcome").alias("outcome"), field("error_category").alias("error_category"),
    )


def call_log_metrics(calls: DataFrame) -> DataFrame:
    return calls.groupBy("stage", "outcome", "error_category").agg(
        F.count_if(F.col("attempt") == 1).alias("calls"),
        F.count(F.lit(1)).alias("attempts"),
        F.round(F.sum(F.col("latency").cast("decimal(18,3)")).cast("double"), 3).alias("latency_sum"),
        F.max("latency").alias("latency_max"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def soak_run_ok(runs: DataFrame) -> DataFrame:
    """``runs``: ``seconds, llm_calls, fallback, n_errors, slides_match``."""
    ok = F.col("slides_match") & (F.col("llm_calls") <= 30) & (F.col("seconds") <= 180) & ~F.col("fallback") & (F.col("n_errors") == 0)
    return runs.withColumn("seconds", F.round("seconds", 3)).withColumn("ok", ok)


def soak_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Passed runs, nearest-rank p95, mean and most calls per group; the p95 by exact selection, whatever the group's size."""
    told = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("ok").alias("passed"),
        F.round(F.avg("seconds"), 3).alias("mean_seconds"),
        F.max("llm_calls").alias("max_llm_calls"),
    )
    p95 = value_at_rank(runs, keys, "seconds", F.ceil(F.col("n") * 95 / 100), "p95_seconds")
    return told.join(p95, keys, "left").withColumn("soak_passed", (F.col("passed") == F.col("runs")) & (F.col("p95_seconds") <= 180))
