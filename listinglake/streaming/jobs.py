"""Structured Streaming jobs: idempotent ingest, health state, interval gate, windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from listinglake.operators.order import parts, written


def latest_records(batch: DataFrame) -> DataFrame:
    """The latest retrieval of each (source, source_record_id) in a batch."""
    others = [c for c in batch.columns if c not in ("source", "source_record_id", "retrieved_at")]
    best = batch.groupBy("source", "source_record_id").agg(F.max(F.struct("retrieved_at", *others)).alias("r"))
    return best.select("source", "source_record_id", "r.*").select(batch.columns)


def ingest_stream(stream: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Upsert every micro-batch into a snapshot table; a replayed older record never overwrites a newer one.

    ``read`` gives the current snapshot (None: there is none), ``write`` stores the next one under the batch's number,
    which makes a repeated batch harmless.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        old = read()
        rows = batch if old is None else old.unionByName(batch)
        write(latest_records(rows), epoch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("source", "source_record_id"), F.lit(buckets)).cast("int").alias("bucket")


def upsert_buckets(batch: DataFrame, path: str, buckets: int) -> int:
    """Puts a batch's latest records into the snapshot at path, of which only the buckets that it changes are read and written; their number.

    A bucket holds the records of one hash of (source, source_record_id) and is a partition of the table. The changed ones are written
    beside the table first and then take the place of the old ones by dynamic partition overwrite, so a failed
    attempt leaves the old ones and a repeated batch changes nothing. The numbers of the touched buckets, at most
    ``buckets``, come to the driver.
    """
    spark = batch.sparkSession
    new = latest_records(batch).withColumn("bucket", bucket_of(buckets))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(folder):
        old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
        rows = latest_records(old.unionByName(new).drop("bucket")).withColumn("bucket", bucket_of(buckets))
        # Buckets in which nothing is new stay as they are.
        differs = rows.join(old, rows.columns, "left_anti") if not any(isinstance(f.dataType, T.MapType) for f in rows.schema) else rows
        changed = [r["bucket"] for r in differs.select("bucket").distinct().collect()]
        new, touched = rows.where(F.col("bucket").isin(changed)), changed
    if touched:
        written(new).repartition(len(touched), "bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return len(touched)


def ingest_buckets(stream: DataFrame, path: str, checkpoint: str, buckets: int = 1024):
    """``ingest_stream`` into a Parquet table that this job keeps: a micro-batch of n records reads and writes n buckets at most."""
    return stream.writeStream.foreachBatch(lambda batch, _: upsert_buckets(batch, path, buckets) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh_records(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream's retrievals, each once: repeats of a record's retrieval within ``late`` are dropped, and state older than that is forgotten."""
    return stream.withWatermark("retrieved_at", late).dropDuplicatesWithinWatermark(["source", "source_record_id", "retrieved_at"])


HEALTH = "source string, started timestamp, consecutive_failures int"


class Health(StatefulProcessor):
    """A source's latest success, latest run and failures since then, in bounded state.

    Failures that a late success can still precede are kept one by one, in a map by their instants. Once the watermark has passed
    them, no success can come before them any more: a timer adds them to a count and forgets them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "good long, last long, settled long, settled_to long")
        self.failures = handle.getMapState("failures", "at long", "n long")

    def settle(self, watermark: int, settled: int, to: int | None) -> tuple[int, int | None]:
        done = [(at, n) for (at,), (n,) in self.failures.iterator() if at < watermark]
        for at, n in done:
            self.failures.removeKey((at,))
            settled, to = settled + n, at if to is None else max(to, at)
        return settled, to

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        good, last, settled, to = self.known.get() if self.known.exists() else (None, None, 0, None)
        for frame in rows:
            for started, ok in zip(frame["started"], frame["ok"].astype(bool), strict=True):
                at = int(started.value // 1000)
                last = at if last is None else max(last, at)
                if not ok:
                    held = self.failures.getValue((at,)) if self.failures.containsKey((at,)) else None
                    self.failures.updateValue((at,), ((held[0] if held else 0) + 1,))
                elif good is None or at > good:
                    good = at
        if good is not None:
            for (at,) in [k for k in self.failures.keys() if k[0] <= good]:
                self.failures.removeKey((at,))
            if to is not None and good >= to:
                settled, to = 0, None
        settled, to = self.settle(timerValues.getCurrentWatermarkInMs() * 1000, settled, to)
        open_ = [(at, n) for (at,), (n,) in self.failures.iterator()]
        if open_:
            self.handle.registerTimer(max(at for at, _ in open_) // 1000 + 1)
        self.known.update((good, last, settled, to))
        yield pd.DataFrame({"source": [key[0]], "started": [pd.Timestamp(last, unit="us")], "consecutive_failures": [settled + sum(n for _, n in open_)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        good, last, settled, to = self.known.get()
        self.known.update((good, last, *self.settle(timerValues.getCurrentWatermarkInMs() * 1000, settled, to)))
        return iter(())

    def close(self) -> None:
        pass


def health_stream(runs: DataFrame, late: str = "1 day") -> DataFrame:
    """After every batch each touched source's failures in a row. ``runs``: source, started, ok.

    A run that arrives up to ``late`` after its start counts where its start belongs; later ones are dropped. State is the latest
    success, a count and the failures of the last ``late``, however long a source has been failing. Needs the RocksDB state store.
    The batch form is ``operators.stats.source_health``.
    """
    rows = runs.select("source", "started", "ok").withWatermark("started", late)
    return rows.groupBy("source").transformWithStateInPandas(statefulProcessor=Health(), outputStructType=HEALTH, outputMode="Update", timeMode="EventTime")


def gate(times: list, last, seconds: float) -> tuple[list[bool], object]:
    """Which of the sorted times come at least ``seconds`` after the last one kept."""
    kept = []
    for t in times:
        passes = last is None or (t - last).total_seconds() >= seconds
        kept.append(passes)
        last = t if passes else last
    return kept, last


def gated(times: np.ndarray, last: int | None, step: int) -> np.ndarray:
    """The places of the sorted times that are kept, found by leaps of ``step``."""
    out, at = [], 0 if last is None else int(np.searchsorted(times, last + step))
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + step))
    return np.array(out, dtype=np.int64)


def leaps(times: np.ndarray, step: int) -> np.ndarray:
    """Of each of the sorted times the place of the last one kept, if the gate enters there."""
    out = np.arange(len(times))
    onward = np.searchsorted(times, times + step)
    for i in range(len(times) - 1, -1, -1):
        if onward[i] < len(times):
            out[i] = out[onward[i]]
    return out


def thinned(enter: np.ndarray, leave: np.ndarray) -> tuple[list[int], list[int]]:
    """A part's effect in its shortest form: of entries in a row that leave alike the last one says all."""
    last = np.append(leave[1:] != leave[:-1], True) if len(leave) else np.zeros(0, dtype=bool)
    return enter[last].tolist(), leave[last].tolist()


def passed_through(enter: list[int], leave: list[int], last: np.ndarray, step: int) -> np.ndarray:
    """The instants last kept behind a part, for instants last kept before it: by the first entry a step or more later, if there is one."""
    at = np.searchsorted(np.array(enter, dtype=np.int64), last + step)
    return np.append(np.array(leave, dtype=np.int64), 0)[at] if not len(last) else np.where(at < len(enter), np.append(np.array(leave, dtype=np.int64), 0)[at], last)


EFFECT = "part int, k string, n_keys int, fixed boolean, enter array<long>, leave array<long>"


def effects(placed: DataFrame, step: int) -> DataFrame:
    """What each part of one order does to the gate, as (enter, leave): an instant last kept before it leads to the first entry a step or more later, and from there to the leave beside it.

    Of a part with several keys, whose last key begins in it, the leave is fixed. Only entries within a step of a part's first row
    can be reached from before, so no more are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, keys, first = None, [], 0, None

        def effect() -> pa.RecordBatch:
            times = np.concatenate(held)
            ends = leaps(times, step)
            if keys > 1:
                enter, leave = [], [int(times[ends[0]])]
            else:
                n = int(np.searchsorted(times, times[0] + step, side="right")) + 1
                enter, leave = thinned(times[:n], times[ends[:n]])
            return pa.RecordBatch.from_pylist([{"part": part, "k": first, "n_keys": keys, "fixed": keys > 1, "enter": enter, "leave": leave}], schema=EFFECT_ARROW)

        current = None
        for b in batches:
            parts_, k, t = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
            changes = [0, *[i for i in range(1, len(k)) if k[i] != k[i - 1] or parts_[i] != parts_[i - 1]], len(k)] if k else [0]
            for x, y in zip(changes, changes[1:]):
                if parts_[x] != part:
                    if part is not None:
                        yield effect()
                    part, held, keys, first, current = int(parts_[x]), [], 0, k[x], None
                if k[x] != current:
                    held, keys, current = [], keys + 1, k[x]
                held.append(t[x:y])
        if part is not None:
            yield effect()

    return placed.select("part", F.col("k").cast("string").alias("k"), "t", "at").repartition("part").sortWithinPartitions("part", "at").drop("at").mapInArrow(run, EFFECT)


EFFECT_ARROW = pa.schema([("part", pa.int32()), ("k", pa.string()), ("n_keys", pa.int32()), ("fixed", pa.bool_()), ("enter", pa.list_(pa.int64())), ("leave", pa.list_(pa.int64()))])


def entered(placed: DataFrame, step: int) -> DataFrame:
    """(part, last): of each part whose first key began before it the instant last kept there.

    Effects of parts in a row are put behind one another in doubling distances: after k rounds a part's effect is that
    of 2^k parts, and it is fixed once these reach back to where the key began. There are as many rounds as the
    logarithm of the parts that one key fills, and in each only the parts that are not yet fixed take part.
    """
    own = written(effects(placed, step))
    line = Window.orderBy("part")  # of a row for each task
    keyed = placed.groupBy("part").agg(F.min_by("k", "at").cast("string").alias("first"), F.max_by("k", "at").cast("string").alias("last"))
    ends = written(keyed.select("part", F.lag("part").over(line).alias("before"), (F.col("first") == F.lag("last").over(line)).alias("goes_on"), F.row_number().over(line).alias("n")))
    chain = own.join(ends, "part")
    # Where the first key begins in the part, its effect is fixed: the gate enters at its first row.
    begins = ~F.coalesce("goes_on", F.lit(False))
    state = written(chain.select("n", "part", (F.col("fixed") | begins).alias("fixed"), F.when(begins & ~F.col("fixed"), F.array().cast("array<long>")).otherwise(F.col("enter")).alias("enter"),
                                 F.when(begins & ~F.col("fixed"), F.slice("leave", 1, 1)).otherwise(F.col("leave")).alias("leave")))

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["fixed_b"]:
                    leave = passed_through(r["enter"], r["leave"], np.array(r["leave_b"], dtype=np.int64), step)
                    rows.append({"n": r["n"], "part": r["part"], "fixed": True, "enter": [], "leave": leave.tolist()})
                else:
                    through = passed_through(r["enter"], r["leave"], np.array(r["leave_b"], dtype=np.int64), step)
                    beyond = [i for i, x in enumerate(r["enter"]) if not r["enter_b"] or x > r["enter_b"][-1]]
                    enter = np.array([*r["enter_b"], *[r["enter"][i] for i in beyond]], dtype=np.int64)
                    enter, leave = thinned(enter, np.array([*through.tolist(), *[r["leave"][i] for i in beyond]], dtype=np.int64))
                    rows.append({"n": r["n"], "part": r["part"], "fixed": False, "enter": enter, "leave": leave})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("n", pa.int32()), ("part", pa.int32()), ("fixed", pa.bool_()), ("enter", pa.list_(pa.int64())), ("leave", pa.list_(pa.int64()))]))

    reach = 1
    while state.where("not fixed").limit(1).count():
        open_, earlier_ = state.where("not fixed"), state.select((F.col("n") + reach).alias("n"), F.col("fixed").alias("fixed_b"), F.col("enter").alias("enter_b"), F.col("leave").alias("leave_b"))
        done = state.where("fixed").select("n", "part", "fixed", "enter", "leave")
        state = written(done.unionByName(open_.join(earlier_, "n").mapInArrow(composed, "n int, part int, fixed boolean, enter array<long>, leave array<long>")))
        reach *= 2
    known = state.select((F.col("n") + 1).alias("n"), F.element_at("leave", 1).alias("last"))
    return ends.where("goes_on").join(known, "n").select("part", "last")


def interval_gate(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """Events of a key that come ``seconds`` or more after the last one kept; greedy from the first.

    Batch form. Rows lie in even parts of one order by key and time. A part needs to know no more of the parts before than the instant
    last kept for its first key; these are found by composing the parts' effects in doubling distances (see
    ``entered``), so that a key that is busy all the time is spread over as many tasks as any other rows. A part passes as
    sorted Arrow batches. What is composed is as long as the rows of one key within ``seconds``. Rows without key or
    time are left out.
    """
    step, schema = int(seconds * 1_000_000), events.schema
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    placed = parts(rows.select(F.col(key).alias("k"), F.col("ts").alias("t"), F.struct(*events.columns).alias("row")), ["k", "t", "row"])
    before = written(entered(placed, step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, last = None, None, None
        for b in batches:
            own, k, first, t = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
            changes = [0, *[i for i in range(1, len(k)) if k[i] != k[i - 1] or own[i] != own[i - 1]], len(k)] if k else [0]
            kept = []
            for x, y in zip(changes, changes[1:]):
                if own[x] != part:
                    part, current, last = own[x], k[x], first[x]
                elif k[x] != current:
                    current, last = k[x], None
                found = gated(t[x:y], last, step)
                if len(found):
                    last = int(t[x + found[-1]])
                    kept.append(x + found)
            out = b.column(4).take(pa.array(np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays(out.flatten(), names=schema.names)

    # A row for each task.
    told = placed.join(F.broadcast(before), "part", "left").select("part", "k", "last", "t", "row", "at")
    return told.repartition("part").sortWithinPartitions("part", "at").drop("at").mapInArrow(run, schema)


def gate_stream(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """Streaming form of ``interval_gate``: (key, ts) of the kept events."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        times = sorted(pd.concat(list(frames))["ts"])
        kept, last = gate(times, last, seconds)
        state.update((int(last.value // 1000),))
        yield pd.DataFrame({"key": [k[0]] * sum(kept), "ts": [t for t, x in zip(times, kept, strict=True) if x]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(update, f"key {kind}, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, length: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts and failures for each source and tumbling window; ``late``: how long a stream waits for late events."""
    rows = events.withWatermark("ts", late) if late else events
    counts = rows.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high"))
    return counts.select(F.col("window.start").alias("window_start"), "event_type", "n", "n_high")


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


TRANSITIONS = "listing_id long, at timestamp, old_status string, new_status string"


def status_at(millis: int, opens: int | None, deadline: int | None) -> str:
    """The live status of a listing at an instant, all in milliseconds."""
    if deadline is None:
        return "unknown"
    if deadline <= millis:
        return "closed"
    return "upcoming" if opens is not None and opens > millis else "open"


def passed_flips(old: str | None, opens: int | None, deadline: int | None, now: int) -> list[tuple[int, str, str]]:
    """Instant, status before and after of what time alone has changed up to ``now``."""
    order, out = {"upcoming": 0, "open": 1, "closed": 2}, []
    for t in sorted(t for t in (opens, deadline) if t is not None and t <= now):
        new = status_at(t, opens, deadline)
        if order.get(new, -1) > order.get(old, 9):
            out.append((t, old, new))
            old = new
    return out


def status_transitions(records: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A row whenever a listing's status flips, by a new record or because event time passes its opening or deadline.

    ``records``: listing_id, ts (event time), opens_ts, deadline_ts. The state of a listing is its two instants and its
    status; a timer waits for the next flip. The batch form is ``operators.sinks.status_changes``.
    """

    def millis(t) -> int | None:
        return None if t is None or pd.isna(t) else int(pd.Timestamp(t).timestamp() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opens, deadline, old = state.get if state.exists else (None, None, None)
        latest = None if state.hasTimedOut else pd.concat(list(frames)).sort_values("ts").iloc[-1]
        now = max(state.getCurrentWatermarkMs(), -1 if latest is None else millis(latest["ts"]))
        flips = passed_flips(old, opens, deadline, now)
        old = flips[-1][2] if flips else old
        if latest is not None:
            opens, deadline = millis(latest["opens_ts"]), millis(latest["deadline_ts"])
        new = status_at(now, opens, deadline)
        state.update((opens, deadline, new))
        ahead = [t for t in (opens, deadline) if t is not None and t > now]
        if deadline is not None and ahead:
            state.setTimeoutTimestamp(min(ahead))
        if old is not None and old != new:
            flips.append((now, old, new))
        if flips:
            at, before, after = zip(*flips, strict=True)
            yield pd.DataFrame({"listing_id": key[0], "at": pd.to_datetime(at, unit="ms"), "old_status": before, "new_status": after})

    rows = records.select("listing_id", "ts", "opens_ts", "deadline_ts").withWatermark("ts", late)
    state = "opens long, deadline long, status string"
    return rows.groupBy("listing_id").applyInPandasWithState(update, TRANSITIONS, state, "append", GroupStateTimeout.EventTimeTimeout)
