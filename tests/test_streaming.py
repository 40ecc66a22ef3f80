import random
from contextlib import contextmanager
from datetime import datetime, timedelta

import pytest
from listinglake.operators import stats
from listinglake.streaming import jobs
from pyspark.sql import functions as F

T0 = datetime(2026, 1, 1)


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None


def test_health_equals_its_batch_twin(spark, tmp_path):
    rows = [(i, f"s{i % 3}", T0 + timedelta(minutes=i), (i * 7) % 5 < 2, 1.0) for i in range(60)]
    runs = spark.createDataFrame(rows, "run_id long, source string, started timestamp, ok boolean, duration double")
    for k in (0, 1):
        runs.where(F.col("run_id") % 60 < 30 if k == 0 else F.col("run_id") >= 30).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(runs.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(jobs.health_stream(stream.select("source", "started", "ok")), "health", "update")
    got = {r["source"]: r["f"] for r in spark.table("health").groupBy("source").agg(F.max_by("consecutive_failures", "started").alias("f")).collect()}
    assert got == {r["source"]: r["consecutive_failures"] for r in stats.source_health(runs).collect()}


def test_gate_stream_equals_batch(spark, tmp_path):
    rows = [(i % 4, T0 + timedelta(minutes=7 * i), i) for i in range(80)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    run(jobs.gate_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "user_id", 1800.0), "gate", "append")
    batch = {(r["user_id"], r["ts"]) for r in jobs.interval_gate(events, "user_id", 1800.0).collect()}
    assert {(r["key"], r["ts"]) for r in spark.table("gate").collect()} == batch


def test_ingest_keeps_the_latest(spark, tmp_path):
    schema = "source string, source_record_id string, retrieved_at timestamp, title string"
    first = [("a", "1", T0, "old"), ("a", "2", T0 + timedelta(days=2), "two")]
    later = [("a", "1", T0 + timedelta(days=1), "new"), ("a", "2", T0, "stale"), ("b", "1", T0, "b")]
    for k, rows in enumerate((first, later)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    state = {"path": None}

    def read():
        return spark.read.parquet(state["path"]) if state["path"] else None

    def write(df, epoch):
        path = str(tmp_path / f"snapshot-{epoch}")
        df.write.mode("overwrite").parquet(path)
        state["path"] = path

    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.ingest_stream(stream, read, write, str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {(r["source"], r["source_record_id"]): r["title"] for r in read().collect()} == {("a", "1"): "new", ("a", "2"): "two", ("b", "1"): "b"}


def test_windowed_counts_with_watermark(spark, tmp_path):
    rows = [(T0 + timedelta(hours=i), "x" if i % 2 else "error", float(i)) for i in range(72)]
    events = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    run(jobs.windowed_counts(jobs.event_stream(spark, str(tmp_path / "in"), events.schema), late="1 hour"), "counts", "append")
    batch = {tuple(r) for r in jobs.windowed_counts(events).collect()}
    closed = {tuple(r) for r in spark.table("counts").collect()}
    assert closed and closed <= batch


def test_statuses_flip_as_time_passes(spark, tmp_path):
    day = timedelta(days=1)
    schema = "listing_id long, ts timestamp, opens_ts timestamp, deadline_ts timestamp"
    batches = [
        [(1, T0, T0 + day, T0 + 4 * day), (2, T0, None, T0 + 2 * day), (3, T0, None, None)],
        [(9, T0 + 3 * day, None, None)],
        [(9, T0 + 5 * day, None, None), (2, T0 + 5 * day, None, T0 + 9 * day)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(jobs.status_transitions(stream), "flips", "append")
    flips = [(r["listing_id"], r["old_status"], r["new_status"]) for r in spark.table("flips").orderBy("listing_id", "at").collect()]
    assert flips == [(1, "upcoming", "open"), (1, "open", "closed"), (2, "open", "closed"), (2, "closed", "open")]


def test_late_runs_count_where_they_belong(spark, tmp_path):
    """The later half of the runs comes first."""
    rows = [(i, f"s{i % 3}", T0 + timedelta(minutes=i), (i * 7) % 11 < 3, 1.0) for i in range(90)]
    runs = spark.createDataFrame(rows, "run_id long, source string, started timestamp, ok boolean, duration double")
    for k, part in enumerate(("run_id >= 60", "run_id < 30", "run_id >= 30 and run_id < 60")):
        runs.where(part).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(runs.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(jobs.health_stream(stream.select("source", "started", "ok")).withColumn("seen", F.current_timestamp()), "late_health", "update")
    got = {r["source"]: r["f"] for r in spark.table("late_health").groupBy("source").agg(F.max_by("consecutive_failures", "seen").alias("f")).collect()}
    assert got == {r["source"]: r["consecutive_failures"] for r in stats.source_health(runs).collect()}


def test_a_source_that_fails_for_a_year_keeps_little_state(spark, tmp_path):
    """Daily batches of failures; what is kept one by one is what a late success can still precede."""
    weeks = [[(i, "s", T0 + timedelta(hours=6 * i), False, 1.0) for i in range(w * 28, w * 28 + 28)] for w in range(6)]
    weeks.append([(1000, "s", T0 + timedelta(hours=6 * 166, minutes=1), True, 1.0), (1001, "t", T0 + timedelta(days=41), False, 1.0)])
    schema = "run_id long, source string, started timestamp, ok boolean, duration double"
    for k, rows in enumerate(weeks):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.health_stream(stream).writeStream.format("memory").queryName("year").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    seen = [r["consecutive_failures"] for r in spark.table("year").where("source = 's'").collect()]
    assert sorted(seen) == [1, 28, 56, 84, 112, 140, 168]  # the late success leaves one failure
    kept = spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", "failures").load()
    assert kept.count() <= 10


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    path, schema = str(tmp_path / "snapshot"), "source string, source_record_id string, retrieved_at timestamp, title string"
    base = spark.createDataFrame([("a", str(i), T0, f"t{i}") for i in range(2000)], schema)
    assert jobs.upsert_buckets(base, path, 64) == 64
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "snapshot").rglob("*.parquet")}
    before = files()
    some = spark.createDataFrame([("a", str(i), T0 + timedelta(days=1), "new") for i in range(9)] + [("b", "1", T0, "b")], schema)
    n = jobs.upsert_buckets(some, path, 64)
    after = files()
    assert 1 <= n <= 10 and len({p.parent for p in before.items() ^ after.items() for p in [p[0]]}) == n
    assert jobs.upsert_buckets(some, path, 64) == 0 and files() == after  # a replay
    stale = spark.createDataFrame([("a", "3", T0 - timedelta(days=1), "stale")], schema)
    assert jobs.upsert_buckets(stale, path, 64) == 0
    got = {(r["source"], r["source_record_id"]): r["title"] for r in spark.read.parquet(path).collect()}
    assert got == {("a", str(i)): "new" if i < 9 else f"t{i}" for i in range(2000)} | {("b", "1"): "b"}


def test_bucketed_ingest_stream(spark, tmp_path):
    schema = "source string, source_record_id string, retrieved_at timestamp, title string"
    first = [("a", "1", T0, "old"), ("a", "2", T0 + timedelta(days=2), "two")]
    later = [("a", "1", T0 + timedelta(days=1), "new"), ("a", "2", T0, "stale"), ("b", "1", T0, "b")]
    for k, rows in enumerate((first, later)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.ingest_buckets(stream, str(tmp_path / "snapshot"), str(tmp_path / "ck"), 8)
    q.awaitTermination(120)
    assert q.exception() is None
    assert {(r["source"], r["source_record_id"]): r["title"] for r in spark.read.parquet(str(tmp_path / "snapshot")).collect()} == {("a", "1"): "new", ("a", "2"): "two", ("b", "1"): "b"}


def test_repeated_retrievals_are_dropped(spark, tmp_path):
    rows = [("a", str(i % 5), T0 + timedelta(hours=i % 10), i) for i in range(40)]
    records = spark.createDataFrame(rows, "source string, source_record_id string, retrieved_at timestamp, n long")
    records.coalesce(1).write.parquet(str(tmp_path / "in"))
    run(jobs.fresh_records(spark.readStream.schema(records.schema).parquet(str(tmp_path / "in"))), "fresh", "append")
    assert spark.table("fresh").count() == 10


def test_interval_gate_over_many_parts(spark):
    rows = [(k, T0 + timedelta(seconds=(i * i * 37 + k) % 9000 if k else i * 11), i) for k in (0, 1, 2) for i in range(300)]
    rows += [(1, T0, 999), (None, T0, 1), (3, None, 2)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long").repartition(5)
    got = {(r["user_id"], r["event_id"]) for r in jobs.interval_gate(events, "user_id", 60.0).collect()}
    want, last = set(), {}
    for k, t, e in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        if k not in last or (t - last[k]).total_seconds() >= 60:
            want.add((k, e))
            last[k] = t
    assert got == want
    assert jobs.interval_gate(events.limit(0), "user_id", 60.0).count() == 0


@contextmanager
def parts_of(spark, n):
    """So many parts, however small."""
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("gap, step", [(1, 3600.0), (700, 3600.0), (40, 60.0), (10, 10.0)])
def test_a_steady_key_is_spread_over_parts(spark, gap, step):
    """One key without a gap, far more rows than a part; from many rows an interval to one."""
    n = 6000
    events = spark.range(n).select(F.lit("k").alias("user_id"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id") * gap)).alias("ts"), F.col("id").alias("event_id")).repartition(7)
    with parts_of(spark, 16):
        got = sorted(r["event_id"] for r in jobs.interval_gate(events, "user_id", step).collect())
        placed = jobs.parts(events.select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.struct("event_id").alias("row")), ["k", "t", "row"])
        assert placed.select("part").distinct().count() == 16
    leap = -(-int(step) // gap)
    assert got == list(range(0, n, leap))


@pytest.mark.parametrize("seed", range(4))
def test_gate_of_random_keys_over_small_parts(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), T0 + timedelta(seconds=rng.choice([rng.randrange(400), rng.randrange(9000)])), i) for i in range(500)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long").repartition(3)
    with parts_of(spark, 24):
        got = {r["event_id"] for r in jobs.interval_gate(events, "user_id", 90.0).collect()}
    want, last = set(), {}
    for k, t, e in sorted(r for r in rows if r[0] is not None):
        if k not in last or (t - last[k]).total_seconds() >= 90:
            want.add(e)
            last[k] = t
    assert got == want


def test_running_failures_equal_plain_counting(spark):
    rows = [(i, f"s{i * i % 3}", T0 + timedelta(minutes=i * 7 % 50), i % 5 == 0) for i in range(200)]
    got = {r["run_id"]: r["failures"] for r in stats.running_failures(spark.createDataFrame(rows, "run_id long, source string, started timestamp, ok boolean").repartition(6)).collect()}
    want, held = {}, {}
    for i, s, _, ok in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[i] = held[s] = 0 if ok else held.get(s, 0) + 1
    assert got == want
