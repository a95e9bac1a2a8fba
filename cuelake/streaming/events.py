"""Event logs as streams: live state, activity windows, repeated events, runs, retention.

Update streams write each micro-batch to its own folder, so a batch that runs twice after a failure
replaces its own output; the newest row per key is the current answer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuelake.operators import ordered
from cuelake.operators.ordered import arrange, running

EVENT_SCHEMA = "event_id long, project_id long, seq long, time timestamp, actor string, to_state string"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = 1, schema: str = EVENT_SCHEMA) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


@contextmanager
def few_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams started inside cut their state into two parts a core at most.

    Every part is opened, committed and reported in every batch, however few keys it holds, and each report names all
    parts: what a batch sends to the driver grows with the square of their number.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_updates(updates: DataFrame, folder: str) -> None:
    """Run an update-mode stream over what is there now, into ``folder``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    with few_partitions(updates.sparkSession):
        q = (
            updates.writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        )
        q.awaitTermination()


def newest(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """Last written row per key."""
    rows = spark.read.parquet(f"{folder}/out")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct(*values), "batch").alias("_v")
    return rows.groupBy(*keys).agg(last).select(*keys, "_v.*")


def live_state(events: DataFrame) -> DataFrame:
    last = F.max(F.struct("seq", "to_state")).alias("_n")
    return events.groupBy("project_id").agg(last, F.count(F.lit(1)).alias("transitions")).select(
        "project_id", F.col("_n")["to_state"].alias("current_state"), F.col("_n")["seq"].alias("seq"), "transitions"
    )


def activity(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events per kind in tumbling or sliding windows."""
    window = F.window("time", width, slide) if slide else F.window("time", width)
    e = events.withWatermark("time", late) if events.isStreaming else events
    g = e.groupBy(window.alias("w"), F.col("actor").alias("kind")).agg(F.count(F.lit(1)).alias("events"))
    return g.select(F.col("w.start").alias("window_start"), "kind", "events")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Events per project in sessions that end after a quiet ``gap``, each once the watermark has passed its end."""
    e = events.withWatermark("time", late)
    g = e.groupBy(F.session_window("time", gap).alias("w"), "project_id").agg(F.count(F.lit(1)).alias("events"))
    return g.select("project_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def sessions(events: DataFrame, gap: str = "30 minutes", rows_per_block: int = ordered.ROWS_PER_BLOCK) -> DataFrame:
    """The same over a table, from summaries that merge: no task holds a project.

    Events of a project within one slice of time as wide as ``gap`` are one session whatever lies between them, so a
    slice is summed up before any shuffle as its first and last time and its events. Neighbouring summaries are one
    session when no more than ``gap`` lies between them, as in ``session_window``; they are looked at in order, large projects in blocks.
    """
    kind = dict(events.dtypes)["time"]
    width = F.unix_micros(F.lit("1970-01-01 00:00:00Z").cast("timestamp") + F.expr(f"INTERVAL {gap}"))
    at = F.unix_micros(F.col("time").cast("timestamp"))
    slices = events.groupBy("project_id", F.floor(at / width).alias("_slice")).agg(
        F.min(at).alias("_first"), F.max(at).alias("_last"), F.count(F.lit(1)).alias("events")
    )
    slices, order = arrange(slices, ("project_id",), ("_slice",), rows_per_block=rows_per_block)
    slices = running(slices, order, _before=ordered.previous(F.col("_last")))
    parted = F.when(F.col("_first") - F.col("_before") <= width, 0).otherwise(1)
    slices = running(slices.withColumn("_parted", parted), order, _session=ordered.total(F.col("_parted")))
    time = lambda c: F.timestamp_micros(c).cast(kind)
    g = slices.groupBy("project_id", "_session").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("events").alias("events")
    )
    return g.select(
        "project_id", time(F.col("_first")).alias("session_start"), time(F.col("_last") + width).alias("session_end"), "events"
    )


def drop_repeats(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each ``event_id`` once; on a stream, within the watermark."""
    if events.isStreaming:
        return events.withWatermark("time", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def append_stream(rows: DataFrame, folder: str) -> None:
    """Run an append-mode stream over what is there now, into parquet files."""
    with few_partitions(rows.sparkSession):
        q = (
            rows.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        )
        q.awaitTermination()


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, as keyed state with timers asks for."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


PAIR_SCHEMA = "project_id long, cmd string, started_seq long, ended_seq long, failed boolean"


class RunPairing(StatefulProcessor):
    """Pairs one key's start and end records in the order of their times, however the batches bring them.

    Records wait in a list until the watermark has passed their time; a timer at the earliest one of a batch then hands
    all of these on in order, so that state is read and written once a key and batch and not once a record. The open run
    is one value. A run ends with the next record of its key: by an end record it is finished, by another start, or
    when ``timeout_ms`` has passed without any, it stays unfinished (-1). An end without an open run is dropped.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, start boolean, rc long")
        self.open = handle.getValueState("open", "seq long, until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        added = [(int(r["at_ms"]), r["seq"], r["kind"] == "start", r["rc"]) for r in rows]
        if added:
            self.waiting.appendList(added)
            self.handle.registerTimer(min(r[0] for r in added))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in waiting if r[0] <= passed), key=lambda r: (r[0], r[1]))
        later = [r for r in waiting if r[0] > passed]
        run = tuple(self.open.get()) if self.open.exists() else None
        before = run
        for at, seq, start, rc in ready:
            if run is not None and run[1] < at:
                yield self._closed(key, run[0], -1, False)
                run = None
            if run is not None:
                yield self._closed(key, run[0], -1 if start else seq, not start and rc != 0)
                run = None
            if start:
                run = (seq, at + self.timeout_ms)
        if run is not None and run[1] <= passed:
            yield self._closed(key, run[0], -1, False)
            run = None
        if ready and later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[0] for r in later))
        elif ready:
            self.waiting.clear()
        if run == before:
            return
        if run is None:
            self.open.clear()
        else:
            self.handle.registerTimer(run[1])
            self.open.update(run)

    @staticmethod
    def _closed(key, started: int, ended: int, failed: bool) -> Row:
        return Row(project_id=key[0], cmd=key[1], started_seq=started, ended_seq=ended, failed=failed)

    def close(self) -> None:
        pass


class _Held:
    """A key's list or value within its bucket's state, as ``RunPairing`` uses Spark's own."""

    __slots__ = ("value",)

    def __init__(self, value=None):
        self.value = value

    def exists(self) -> bool:
        return self.value is not None

    def get(self):
        return self.value

    def put(self, value) -> None:
        self.value = value

    update = put

    def appendList(self, added: list) -> None:  # noqa: N802
        self.value = [*(self.value or ()), *added]

    def clear(self) -> None:
        self.value = None


class _NoTimers:
    """Keys' own timers: their bucket's is the earliest of what waits in it."""

    def registerTimer(self, at: int) -> None:  # noqa: N802
        pass


def _whole(text: str | None) -> int | None:
    return None if text is None else int(text)


class RunBuckets(StatefulProcessor):
    """Pairs the records of all keys of a bucket, each as ``RunPairing`` does.

    What waits, and the open runs, are one value of the bucket with the earliest time at which something is due, and
    one timer. So a bucket's state is read and written once a batch, however many keys it holds: each call to the state
    is a message to another process, which costs more than pairing a hundred records.
    """

    STATE = "due long, records binary"
    #: Whole numbers that may be null come as text: pandas would make them floating.
    COLUMNS = ("project", "cmd", "at_ms", "seq_text", "kind", "bad")

    def __init__(self, timeout_ms: int):
        self.pairing = RunPairing(timeout_ms)
        self.pairing.handle = _NoTimers()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        added: dict[tuple, list[dict]] = {}
        for frame in rows:
            for *own, at, seq, kind, rc in zip(*(frame[c].tolist() for c in self.COLUMNS), strict=True):
                added.setdefault(tuple(own), []).append({"at_ms": at, "seq": _whole(seq), "kind": kind, "rc": rc})
        if added:
            keys = self._load(self.state.get() if self.state.exists() else None)
            for own, records in added.items():
                list(self._of(keys, own).handleInputRows(own, iter(records), timerValues))
            self._save(keys)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        held = self.state.get() if self.state.exists() else None
        if held is None or held[0] > passed:  # an earlier timer of this batch has done it
            return
        keys = self._load(held)
        closed: list[Row] = []
        for own in list(keys):
            if self._due(keys[own]) <= passed:
                closed.extend(self._of(keys, own).handleExpiredTimer(own, timerValues, expiredTimerInfo))
        self._save(keys)
        if closed:
            project, cmd, started, ended, failed = zip(*closed, strict=True)
            yield pd.DataFrame({
                "project_id": pd.array([_whole(p) for p in project], "Int64"), "cmd": pd.Series(cmd, dtype=object),
                "started_seq": pd.array(started, "Int64"), "ended_seq": pd.array(ended, "Int64"), "failed": failed,
            })

    def _of(self, keys: dict, own: tuple) -> RunPairing:
        self.pairing.waiting, self.pairing.open = keys.setdefault(own, (_Held(), _Held()))
        return self.pairing

    @staticmethod
    def _due(states: tuple[_Held, _Held]) -> int:
        waiting, run = (s.value for s in states)
        return min([r[0] for r in waiting or ()] + ([run[1]] if run else []))

    @staticmethod
    def _load(held: Row | None) -> dict[tuple, tuple[_Held, _Held]]:
        keys: dict[tuple, tuple[_Held, _Held]] = {}
        if held is None:
            return keys
        table = pa.ipc.open_stream(held[1]).read_all().to_pydict()
        for project, cmd, at, seq, start, rc in zip(*table.values(), strict=True):
            waiting, run = keys.setdefault((project, cmd), (_Held(), _Held()))
            if start is None:
                run.value = (seq, at)
            elif waiting.value is None:
                waiting.value = [(at, seq, start, rc)]
            else:
                waiting.value.append((at, seq, start, rc))
        return keys

    def _save(self, keys: dict[tuple, tuple[_Held, _Held]]) -> None:
        """An open run is a row without ``start``; its time is that of its timeout."""
        rows = []
        for own, (waiting, run) in keys.items():
            rows.extend((*own, *r) for r in waiting.value or ())
            if run.value is not None:
                rows.append((*own, run.value[1], run.value[0], None, None))
        if not rows:
            self.state.clear()
            return
        table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), HELD.types, strict=True)], HELD)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, HELD) as out:
            out.write_table(table)
        due = min(r[2] for r in rows)
        self.handle.registerTimer(due)
        self.state.update((due, sink.getvalue().to_pybytes()))

    def close(self) -> None:
        pass


HELD = pa.schema([
    ("project", pa.string()), ("cmd", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("start", pa.bool_()), ("rc", pa.int64()),
])


def pair_runs_stream(records: DataFrame, timeout: str = "1 day", late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """Pair ``start`` and ``end`` records per (project, cmd) on a stream; see ``RunPairing`` and ``RunBuckets``.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). A run is returned once the
    watermark, ``late`` behind the newest record of all keys, has passed its end or its timeout. buckets: into how many
    the keys are dealt; a stream keeps their number as long as its checkpoint.
    """
    timeout_ms = records.sparkSession.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {timeout})").first()[0]
    keyed = records.withColumn("time", F.date_trunc("millisecond", "time")).withWatermark("time", late)
    bucket = F.pmod(F.xxhash64("project_id", "cmd"), F.lit(buckets))
    keyed = keyed.select(
        bucket.alias("bucket"), "time", F.col("project_id").cast("string").alias("project"), "cmd", F.unix_millis("time").alias("at_ms"),
        F.col("seq").cast("string").alias("seq_text"), "kind", (~F.col("rc").eqNullSafe(0)).cast("long").alias("bad"),
    )
    return keyed.groupBy("bucket").transformWithStateInPandas(RunBuckets(timeout_ms), PAIR_SCHEMA, "append", "EventTime")


def retained(rows: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Log rows not older than ``hours`` before ``as_of``, a time of the same kind as the rows' own."""
    kind = dict(rows.dtypes)["time"]
    now = F.lit(as_of.isoformat()).cast(kind) if kind == "timestamp_ntz" else F.lit(as_of)
    return rows.filter(F.col("time") >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))
