"""Orders over the whole cluster, and tables that cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """Write df to the folder that all machines share and read it again: lost executors then cost no recomputation.

    The folder is the session's checkpoint folder. Where none is set, a local session uses its warehouse, and a session
    on a cluster fails: its machines would write to disks that the others do not see. ``drop_written`` removes the tables.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/listinglake")
    path = f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    if (block := BLOCK.get()) is not None:
        block.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of this process that are still there.
WRITTEN: list[str] = []
#: Those of the innermost block of ``passing``.
BLOCK: ContextVar[list[str] | None] = ContextVar("block", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written in this block are removed at its end, so that a job needs no more disk than its widest step.

    Not those that are written by the function the block gets: they belong to the block around it, or stay. What reads a
    removed table must have been written by then.
    """
    around, own = BLOCK.get(), []
    token = BLOCK.set(own)

    def keep(df: DataFrame) -> DataFrame:
        inner = BLOCK.set(around)
        try:
            return written(df)
        finally:
            BLOCK.reset(inner)

    try:
        yield keep
    finally:
        BLOCK.reset(token)
        removed(spark, own)


def drop_written(spark: SparkSession) -> int:
    """Removes the tables that operators have written in between, once no result that reads them is needed any more; their number."""
    return removed(spark, list(WRITTEN))


def removed(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if p in WRITTEN:
            WRITTEN.remove(p)
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def parts(df: DataFrame, order: list[str]) -> DataFrame:
    """df sorted into even ranges, with ``part`` and ``at``, the place within the part; no key is held together."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return written(placed.withColumns({"part": F.shiftright("at", 33).cast("int"), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}))


def earlier(of_parts: DataFrame, **sums) -> DataFrame:
    """Of a table with a row for each part: the given aggregates over all parts before it. That table is as long as there are tasks."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return of_parts.select("part", *[f.over(before).alias(n) for n, f in sums.items()])


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with ``at``, each row's place from 0 in the given order."""
    placed = parts(df, order)
    starts = earlier(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")), start=F.sum("n"))
    # A row for each task.
    return placed.join(F.broadcast(starts), "part").withColumn("at", F.col("at") + F.coalesce("start", F.lit(0))).drop("part", "start")


def running(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of a group up to this one; group columns are not null. Even parts, so no group is held together."""
    placed = parts(df.withColumn("_value", value), [*group, *order])
    held = placed.groupBy("part", *group).agg(F.sum("_value").alias("_held"))
    earlier_parts = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = written(held.select("part", *group, F.coalesce(F.sum("_held").over(earlier_parts), F.lit(0)).alias("_before")))
    within = F.sum("_value").over(Window.partitionBy("part", *group).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_within", within).join(before, ["part", *group]).withColumn(name, F.col("_within") + F.col("_before")).drop("part", "at", "_value", "_within", "_before")
