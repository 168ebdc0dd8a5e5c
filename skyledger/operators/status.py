"""Processing status of uploads: latest state, progress, funnel, time-outs, status records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions import text

# The processing steps in order, the final states, the polling limits.
STEPS = ("downloading", "validating", "converting", "thumbnail", "uploading", "cataloging", "done")
TERMINAL = ("complete", "error")
MAX_POLLS = 120
POLL_SECONDS = 3
TIMEOUT_MESSAGE = "Processing timed out. The image may still be processing — check back later."


def time_limit(max_polls: int = MAX_POLLS, poll_seconds: int = POLL_SECONDS) -> int:
    """Seconds until the first poll beyond the allowed number."""
    return (max_polls + 1) * poll_seconds


def step_index(step: Column) -> Column:
    """Position in the step list, −1 for no or an unknown step."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STEPS]), step), F.lit(0)).cast("int") - 1


def latest_status(events: DataFrame) -> DataFrame:
    """Last written status per upload. Works on a batch and on a stream.

    Of events at one time a final one counts, then the one of the latest step. The maximum is
    combined inside each task before the shuffle.
    """
    order = F.struct(
        "ts", F.col("status").isin(*TERMINAL).alias("final"), step_index(F.col("step")).alias("index"), "status", "step"
    )
    newest = events.groupBy("upload_id").agg(F.max(order).alias("_newest"))
    return newest.select(
        "upload_id", F.col("_newest.ts").alias("ts"), F.col("_newest.step").alias("step"),
        F.col("_newest.status").alias("status"),
    )


def step_progress(latest: DataFrame) -> DataFrame:
    """One row per upload and step: ``done``, ``active`` or ``pending``."""
    steps = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("at")) for i, s in enumerate(STEPS)])
    rows = latest.select("upload_id", step_index(F.col("step")).alias("_index"), F.inline(steps))
    state = (
        F.when(F.col("_index") > F.col("position"), "done")
        .when(F.col("_index") == F.col("position"), "active")
        .otherwise("pending")
    )
    return rows.select("upload_id", "position", F.col("at").alias("step"), state.alias("state"))


def step_funnel(latest: DataFrame) -> DataFrame:
    """Uploads done with, at and before every step; one aggregation, seven rows."""
    index = step_index(F.col("step"))
    counts = latest.agg(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(s).alias("step"),
                F.count_if(index > i).alias("done"), F.count_if(index == i).alias("active"),
                F.count_if(index < i).alias("pending"),
            ).alias(s)
            for i, s in enumerate(STEPS)
        ]
    )
    return counts.select(F.inline(F.array(*STEPS)))


def stale_uploads(events: DataFrame, as_of: Column, limit_seconds: int = time_limit()) -> DataFrame:
    """Uploads whose last status is not final and older than the limit."""
    silent = F.col("ts") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(limit_seconds))
    return latest_status(events).where(~F.col("status").isin(*TERMINAL) & silent)


def poll_timeouts(events: DataFrame, as_of: Column, limit_seconds: int = time_limit()) -> DataFrame:
    """Uploads with no final status within the limit of their first status."""
    limit = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(limit_seconds))
    spans = events.groupBy("upload_id").agg(
        F.min("ts").alias("started"), F.min(F.when(F.col("status").isin(*TERMINAL), F.col("ts"))).alias("ended")
    )
    due = F.col("started") + limit
    return spans.where((due < as_of) & (F.col("ended").isNull() | (F.col("ended") > due))).select(
        "upload_id", "started", F.lit("error").alias("status"), F.lit(TIMEOUT_MESSAGE).alias("error")
    )


def outcomes(checked: DataFrame, key: str, completed_at: str) -> DataFrame:
    """Final status of every validated upload: ``complete``, or ``error`` with the reason.

    ``checked`` comes from ``ingest.validate``. A failure of the query itself still fails it.
    """
    failed = F.col("reason").isNotNull()
    return checked.select(
        F.col(key).cast("string").alias("upload_id"),
        F.when(failed, "error").otherwise("complete").alias("status"),
        F.when(~failed, "done").alias("step"),
        F.when(~failed, completed_at).alias("completed_at"),
        F.col("reason").alias("error"),
        *([F.col("title")] if "title" in checked.columns else []),
    )


def status_record(row: DataFrame, base_url: str) -> DataFrame:
    """Status JSON per upload; which fields it has depends on the state.

    Reads ``upload_id, status, step`` and, where present, ``title``, ``completed_at`` and ``error``.
    """
    def optional(name: str) -> Column:
        return F.col(name) if name in row.columns else F.lit(None).cast("string")

    key = F.col("upload_id").cast("string")
    status = F.col("status")
    complete = F.to_json(
        F.struct(
            status, F.lit("done").alias("step"), key.alias("upload_id"),
            text.image_href(base_url, key).alias("cog_url"),
            text.thumbnail_href(base_url, key).alias("thumbnail_url"),
            F.coalesce(optional("title"), F.lit("")).alias("title"),
            optional("completed_at").alias("completed_at"),
        )
    )
    failed = F.to_json(F.struct(status, key.alias("upload_id"), optional("error").alias("error")))
    running = F.to_json(F.struct(status, key.alias("upload_id"), "step"))
    return row.select(
        "upload_id",
        F.when(status == "complete", complete).when(status == "error", failed).otherwise(running).alias("value"),
    )
