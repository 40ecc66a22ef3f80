"""Source health from a run log: (run_id, source, started, ok, duration)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listinglake.operators.order import earlier, parts, running, written


def source_health(runs: DataFrame) -> DataFrame:
    """Latest success and failure, failures since the last success, duration of the last success, class.

    The failures that count are those later than the source's last success: two aggregations with a map side, and no
    source's log is gathered in one task.
    """
    at = F.struct("started", "run_id")
    last = runs.groupBy("source").agg(
        F.max(F.when(F.col("ok"), at)).alias("good"), F.max(F.when(~F.col("ok"), at)).alias("bad"), F.max_by("duration", F.when(F.col("ok"), at)).alias("last_duration"), F.count(F.lit(1)).alias("runs")
    )
    since = runs.join(last.select("source", "good"), "source").where(~F.col("ok") & (F.col("good").isNull() | (at > F.col("good"))))
    failed = since.groupBy("source").agg(F.count(F.lit(1)).alias("consecutive_failures"))
    joined = last.join(failed, "source", "left").na.fill(0, ["consecutive_failures"])
    n = F.col("consecutive_failures")
    return joined.select(
        "source", F.col("good.started").alias("last_ok"), F.col("bad.started").alias("last_error"), "consecutive_failures", "last_duration", "runs",
        F.when(n >= 3, "failing").when(n > 0, "degraded").otherwise("healthy").alias("health"),
    )


def running_failures(runs: DataFrame) -> DataFrame:
    """Each run with the failures in a row that it ends.

    Runs are numbered along one order by source and time. A run's failures are the rows since the latest success, or
    since its source's first run; both are running maxima within an even part of the order, and over the parts before.
    """
    placed = parts(runs, ["source", "started", "run_id"])
    start = earlier(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")), start=F.sum("n"))
    at = placed.join(F.broadcast(start), "part").withColumn("at", F.col("at") + F.coalesce("start", F.lit(0)))  # a row for each task
    first = written(at.groupBy("source").agg(F.min("at").alias("first")))
    good = F.when(F.col("ok"), F.col("at"))
    carried = earlier(at.groupBy("part").agg(F.max(good).alias("good")), carried=F.max("good"))
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    held = at.withColumn("own", F.max(good).over(within)).join(F.broadcast(carried), "part").join(first, "source")
    floor = F.greatest("own", "carried", F.col("first") - 1)
    return held.withColumn("failures", F.col("at") - floor).select(*runs.columns, "failures")


def last_start(runs: DataFrame) -> DataFrame:
    """Latest start of any run that was not skipped, and of those that are done, failed or running. ``runs``: status."""
    return runs.agg(
        F.max(F.when(F.col("status") != "skipped", F.col("started"))).alias("last_run"), F.max(F.when(F.col("status").isin("ok", "failed", "running"), F.col("started"))).alias("last_attempt")
    )


def last_runs(runs: DataFrame, n: int = 25) -> DataFrame:
    return runs.orderBy(F.desc("started"), F.desc("run_id")).limit(n)


def paired_runs(log: DataFrame, counts: tuple[str, ...] = ()) -> DataFrame:
    """Runs from a log to which each appends a row when it starts and one when it finishes.

    ``log``: source, at, entry (orders rows of one instant), kind ("start" or "finish"), error (null: none) and counts,
    both of finish rows. Result: source, run (from 1), started, finished, seconds, status, error and counts.
    A finish belongs to the latest start before it, which is the number of starts so far of its source, and the first such
    finish counts. A start that another one follows without a finish is "interrupted", the source's last one still "running".
    Finishes before any start, and rows without source, are left out.

    The number is a running sum over even parts of one order, so a source that logs a third of all rows is spread.
    """
    known = log.where("source is not null").withColumnRenamed("at", "logged")
    numbered_ = running(known, ["source"], ["logged", "entry"], (F.col("kind") == "start").cast("long"), "run").where("run > 0")
    last = written(numbered_.groupBy("source").agg(F.max("run").alias("last_run")))
    finish = F.struct("logged", "entry", F.col("error"), *[F.col(c) for c in counts])
    runs = numbered_.groupBy("source", "run").agg(F.min(F.when(F.col("kind") == "start", F.col("logged"))).alias("started"), F.min(F.when(F.col("kind") == "finish", finish)).alias("f"))
    runs = runs.join(last, "source")
    status = F.when(F.col("f").isNull(), F.when(F.col("run") == F.col("last_run"), "running").otherwise("interrupted")).when(F.col("f.error").isNull(), "ok").otherwise("failed")
    seconds = (F.unix_micros(F.col("f.logged").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    return runs.select("source", "run", "started", F.col("f.logged").alias("finished"), seconds.alias("seconds"), status.alias("status"), F.col("f.error").alias("error"), *[F.col(f"f.{c}").alias(c) for c in counts])
