"""Status of jobs folded from their logs, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Stage, status and progress (an error keeps the progress reached).
STAGES = (
    ("segmenting", "running", 10), ("extracting", "running", 40), ("generating", "running", 70), ("exporting", "running", 90),
    ("error", "error", None), ("done", "done", 100),
)


def stage_of(line: Column) -> Column:
    """The stage whose marker comes last in a line, or null."""
    return F.nullif(F.regexp_extract(line, r"^.*STAGE:(segmenting|extracting|generating|exporting|error|done)", 1), F.lit(""))


def fold_status(lines: DataFrame, stage: Column | None = None) -> DataFrame:
    """``(job_id, status, stage, progress_pct, error_message)`` from (job_id, pos, line).

    One aggregate of maxima, so it runs unchanged on a stream in update mode
    and late lines need no order.
    """
    s = stage_of(F.col("line")) if stage is None else stage
    marked = lines.withColumn("__s", s)
    pct = F.coalesce(*[F.when(F.col("__s") == n, F.lit(p)) for n, _, p in STAGES if p is not None])
    a = marked.groupBy("job_id").agg(
        F.max_by(F.col("__s"), F.when(F.col("__s").isNotNull(), F.col("pos"))).alias("stage"), F.max(pct).alias("most"),
        F.max_by("line", "pos").alias("last"),
    )
    now = F.col("stage")
    status = F.coalesce(*[F.when(now == n, F.lit(t)) for n, t, _ in STAGES], F.lit("running"))
    at = F.when(now == "error", F.coalesce("most", F.lit(10))).otherwise(F.coalesce(*[F.when(now == n, F.lit(p)) for n, _, p in STAGES if p is not None], F.lit(10)))
    return a.select("job_id", status.alias("status"), F.coalesce(now, F.lit("segmenting")).alias("stage"), at.cast("int").alias("progress_pct"), F.when(status == "error", F.col("last")).alias("error_message"))


def known_jobs(jobs: DataFrame, status: DataFrame) -> DataFrame:
    """Every job with its status; one without a log is at 0 percent of its first stage."""
    j = jobs.select("job_id").distinct().join(status, "job_id", "left")
    none = F.col("status").isNull()
    return j.select(
        "job_id", F.coalesce("status", F.lit("running")).alias("status"), F.coalesce("stage", F.lit("segmenting")).alias("stage"),
        F.when(none, 0).otherwise(F.col("progress_pct")).alias("progress_pct"), "error_message",
    )


def output_folder(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """A job's output folder: the recorded one, else that of its case."""
    o = outputs.groupBy("case_id").agg(F.min("folder").alias("found"))
    return jobs.join(o, "case_id", "left").select("job_id", F.coalesce("folder", "found").alias("folder"))
