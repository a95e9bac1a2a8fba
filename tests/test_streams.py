import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cuelake.plans import document_jobs as dj
from cuelake.sources import fixtures as fx
from cuelake.streaming import events as st

T0 = dt.datetime(2024, 1, 1)
FAR = dt.datetime(2030, 1, 1)


def write(spark, rows, schema, path):
    """Batches one after the other, each a file of its own."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(path)


RUN = "project_id long, cmd string, seq long, time timestamp, kind string, rc long"


def plain_pairs(records, timeout):
    out, keys = set(), {}
    for r in sorted(records, key=lambda r: (r[3], r[2])):
        keys.setdefault(r[:2], []).append(r)
    for key, rows in keys.items():
        for r, following in zip(rows, [*rows[1:], None], strict=True):
            if r[4] == "start":
                done = following is not None and following[4] == "end" and following[3] <= r[3] + timeout
                out.add((*key, r[2], following[2] if done else -1, bool(done and following[5])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_pairs_with_late_records_and_timeouts(spark, tmp_path, seed):
    rng = random.Random(seed)
    records = [
        (k % 3, "mux" if k % 2 else "fetch", k, T0 + dt.timedelta(minutes=10 * k + rng.choice([0, 0, -10, 300])), rng.choice(["start", "end"]), rng.randrange(2))
        for k in range(120)
    ]
    records += [(0, "fetch", 900, T0, "start", 0), (0, "fetch", 901, T0, "end", 1), (0, "fetch", 902, T0, "start", 0)]
    arriving = sorted(records, key=lambda r: r[3] + dt.timedelta(minutes=rng.randrange(40)))  # up to 40 minutes late
    batches = [arriving[k : k + 30] for k in range(0, len(arriving), 30)] + [[(-1, "end of log", 0, FAR + dt.timedelta(days=k), None, None)] for k in range(2)]
    write(spark, batches, RUN, str(tmp_path / "log"))
    stream = st.read_stream(spark, str(tmp_path / "log"), 1, RUN)
    with st.rocksdb(spark):
        st.append_stream(st.pair_runs_stream(stream, timeout="3 hours", late="1 hour"), str(tmp_path / "s"))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "s" / "out")).collect()]
    want = plain_pairs(records, dt.timedelta(hours=3))
    assert len(got) == len(want) and set(got) == want
    assert any(r[3] == -1 for r in got) and any(r[4] for r in got)


EVENT = "project_id long, time timestamp"


def plain_sessions(events, gap):
    out = []
    for p in {p for p, _ in events}:
        times = sorted(t for q, t in events if q == p)
        cuts = [0, *(k for k in range(1, len(times)) if times[k] - times[k - 1] > gap), len(times)]
        out.extend((p, times[a], times[b - 1] + gap, b - a) for a, b in zip(cuts, cuts[1:], strict=False))
    return sorted(out)


@pytest.mark.parametrize("rows_per_block", [1_000_000, 3])
def test_sessions_merge_over_slices_and_blocks(spark, tmp_path, rows_per_block):
    rng = random.Random(7)
    events = [(rng.choice([1, 1, 1, 2, 3]), T0 + dt.timedelta(seconds=rng.randrange(0, 200_000, 300))) for _ in range(200)]
    events += [(4, T0), (4, T0 + dt.timedelta(minutes=30)), (4, T0 + dt.timedelta(minutes=59, seconds=59))]
    df = spark.createDataFrame(events, EVENT)
    want = plain_sessions(events, dt.timedelta(minutes=30))
    assert sorted(tuple(r) for r in st.sessions(df, "30 minutes", rows_per_block).collect()) == want
    assert st.sessions(df.limit(0), "30 minutes").count() == 0
    if rows_per_block > 3:
        events.sort(key=lambda e: e[1])
        write(spark, [events[:100], events[100:], [(-1, FAR)]], EVENT, str(tmp_path / "log"))
        stream = st.read_stream(spark, str(tmp_path / "log"), 1, EVENT)
        st.append_stream(st.stream_sessions(stream, "30 minutes", late="1 hour"), str(tmp_path / "s"))
        assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "s" / "out")).collect()) == want


def test_a_slice_of_the_log_is_one_batch(spark, monkeypatch):
    """F2, F6 to F11: the log was a file and a batch per 200,000 records; now many files of a slice are one batch."""
    monkeypatch.setattr(dj, "LOG_ROWS", 100)
    events = fx.event_rows(spark, "/root/testdata/sf0.001")
    rows = events.count()
    seen, files = [], []
    for path in dj._event_slices(spark, "/root/testdata/sf0.001"):
        read = spark.read.schema(st.EVENT_SCHEMA).json(path)
        seen.append(read.filter("project_id >= 0").agg(F.max("time"), F.count(F.lit(1))).first())
        files.append(len(read.inputFiles()))
    assert len(seen) == 5 and files[2] > 5  # three slices, then two last records
    assert seen[0][0] < seen[1][0] < seen[2][0] and [s[1] for s in seen[2:]] == [rows] * 3
    assert len(spark.read.schema(st.EVENT_SCHEMA).json(path).filter("project_id >= 0").dropDuplicates(["event_id"]).collect()) == rows


def test_records_of_a_key_wait_in_one_list(spark):
    """state was read and written several times for each record; now once a key and batch."""
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.value = name, None

        def __getattr__(self, method):
            def call(*args):
                calls.append(f"{self.name}.{method}")
                if method in ("appendList", "put", "update"):
                    self.value = [*(self.value or []), *args[0]] if method == "appendList" else args[0]
                if method == "clear":
                    self.value = None
                return self.value is not None if method == "exists" else self.value
            return call

    pairing = st.RunPairing(1000)
    pairing.handle, pairing.waiting, pairing.open = State("handle"), State("waiting"), State("open")
    rows = [{"at_ms": k, "seq": k, "kind": "start" if k % 2 == 0 else "end", "rc": None if k == 4 else 0} for k in range(100)][::-1]
    values = type("T", (), {"getCurrentWatermarkInMs": lambda self: 97})()
    assert list(pairing.handleInputRows((1, "c"), iter(rows), values)) == []
    out = list(pairing.handleExpiredTimer((1, "c"), values, None))
    assert [(r.started_seq, r.ended_seq) for r in out] == [(k, k + 1) for k in range(0, 98, 2)]
    assert [r[0] for r in pairing.waiting.value] == [99, 98] and len(calls) < 10


def test_state_has_two_parts_a_core_and_events_are_read_once_for_all_slices(spark, tmp_path, monkeypatch):
    """F7 to F10: state was cut into all of the session's shuffle partitions, and each slice read all events."""
    monkeypatch.setattr(dj, "SLICE_ROWS", 100)
    name, parts = "spark.sql.shuffle.partitions", 2 * spark.sparkContext.defaultParallelism
    before = spark.conf.get(name)
    events = fx.event_rows(spark, "/root/testdata/sf0.001").select(F.col("seq").alias("event_id"), "project_id", "seq", "time", "actor", "to_state")
    # a null time lay in no slice
    events = events.unionByName(events.limit(1).withColumn("time", F.lit(None).cast("timestamp_ntz")))
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows, slices = events.count(), list(dj._log_slices(spark, events.mapInArrow(counting, events.schema), events.dtypes))
    assert len(slices) >= 10 and read.value <= 2 * rows  # counted, and dealt to the slices
    log = spark.read.schema(st.EVENT_SCHEMA).json(slices[-1])
    assert log.filter("project_id >= 0").count() == rows
    spark.conf.set(name, str(parts + 3))
    try:
        st.run_updates(st.live_state(st.read_stream(spark, slices[-1], None)), str(tmp_path / "s"))
        assert len(list((tmp_path / "s" / "checkpoint" / "state" / "0").glob("[0-9]*"))) == parts
        assert spark.conf.get(name) == str(parts + 3)
    finally:
        spark.conf.set(name, before)


def test_a_bucket_of_keys_is_one_state(spark):
    """every key had a state and a timer of its own; now a bucket's keys share them, with the same pairs."""
    calls = []

    class State:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = None

        def registerTimer(self, at):
            calls.append(at)

    rng = random.Random(4)
    records = [
        (rng.choice([None, 1, 2**60 + 1]), rng.choice(["mux", "fetch", None]), k, T0 + dt.timedelta(seconds=rng.randrange(3000)), rng.choice(["start", "end"]), rng.randrange(2))
        for k in range(500)
    ]
    ms = lambda t: int((t - T0).total_seconds() * 1000)
    text = lambda x: None if x is None else str(x)
    buckets, got = st.RunBuckets(60_000), set()
    buckets.handle = buckets.state = State()
    for upto in (1000, 2000, 3000, 10_000):
        come = [r for r in records if upto - 1000 <= ms(r[3]) / 1000 < upto] if upto < 10_000 else []
        frame = st.pd.DataFrame([(text(p), c, ms(t), str(k), kind, bad) for p, c, k, t, kind, bad in come], columns=st.RunBuckets.COLUMNS)
        passed = upto * 1000 - 1
        values = type("T", (), {"getCurrentWatermarkInMs": lambda self, passed=passed: passed})()
        calls.clear()
        assert list(buckets.handleInputRows((0,), iter([frame]), values)) == []
        for _ in range(2):  # two timers of a batch
            for out in buckets.handleExpiredTimer((0,), values, None):
                got |= {(None if p is st.pd.NA else int(p), *rest) for p, *rest in out.astype({"project_id": object}).itertuples(index=False)}
        assert len(calls) <= 12
    assert got == plain_pairs(records, dt.timedelta(seconds=60))
    assert buckets.state.value is None
