"""Streams against their batch forms."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from conftest import drain, stream_of, values
from pyspark.sql import functions as F

from fleetlens.catalog.fleet import SCOPE, destroy_log
from fleetlens.catalog.units import spend
from fleetlens.functions import json_values as J
from fleetlens.operators import health, objects, polling, units
from fleetlens.plans.sweep import sweep
from fleetlens.session import checkpoint_root
from fleetlens.streaming import declarative as D
from fleetlens.streaming import stateful as S
from fleetlens.streaming.sweep import start_sweep


#: A unit whose row lies far after all others, to move the watermark past them.
TICK = "_tick"


def timed(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def last_tick(spark, schema, **fixed):
    """One row of the tick unit far after all data, to move the watermark."""
    row = {f.name: None for f in schema.fields} | fixed
    return spark.createDataFrame([tuple(row[f.name] for f in schema.fields)], schema)


def far():
    import datetime

    return datetime.datetime(2040, 1, 1)


def test_unit_action_stream_equals_batch(spark, views, folder):
    marks = views.markers.groupBy("unit_key").agg(F.min("marker_ts").alias("mark"))
    marked = F.coalesce(F.col("mark") <= F.col("ts"), F.lit(False))
    probes = timed(views.probes.join(marks, "unit_key", "left").withColumn("marked", marked), "ts").select(
        "event_id", "unit_key", "ts", "raw", "marked", F.col("marked").alias("marked_again")
    )
    got = drain(D.unit_action_stream(stream_of(spark, probes, folder, "ts")), folder, "append", "actions")
    want = polling.probe_actions(views.probes, views.markers)
    assert values(got, "event_id", "action", "detail") == values(want, "event_id", "action", "detail")


def test_unit_state_stream_ends_at_batch_state(spark, views, folder):
    events = timed(views.unit_events, "ts")
    got = drain(D.unit_state_stream(stream_of(spark, events, folder, "ts")), folder, "complete", "states")
    columns = ("unit_key", "status", "instance_id", "retry_count", "failure_reason", "cost_per_hour")
    assert values(got, *columns) == values(units.current_state(views.unit_events), *columns)


def shuffled(df, last):
    """Order that spreads the rows over the micro-batches; the tick row stays the last one."""
    return F.when(F.col("event_id") == last, F.lit(2**62)).otherwise(F.xxhash64("event_id") / 4)


def test_retry_verdict_stream_equals_batch(spark, views, folder):
    events = timed(views.unit_events, "ts").withColumn("unit_key", F.col("unit_key").cast("string"))
    events = events.unionByName(last_tick(spark, events.schema, unit_key=TICK, ts=far(), event="failed", event_id=-1, reason=""))
    want = units.retry_verdicts(
        views.unit_events, classify=lambda r: F.when(r.contains("memory"), "fatal").otherwise("retry")
    )
    columns = ("event_id", "retries_before", "verdict", "failure_reason")
    in_order = S.retry_verdict_stream(stream_of(spark, events, folder + "/a", "ts"), fatal_pattern="memory")
    assert values(drain(in_order, folder + "/a", "append", "retries"), *columns) == values(want, *columns)
    mixed = S.retry_verdict_stream(stream_of(spark, events, folder + "/b", shuffled(events, -1)), fatal_pattern="memory", delay="4000 days")
    assert values(drain(mixed, folder + "/b", "append", "retries_mixed"), *columns) == values(want, *columns)


def test_a_stream_goes_on_from_the_state_of_a_batch(spark, views, folder):
    """Older losses are counted by a batch, newer ones by the stream: the verdicts are those of all events together."""
    events = timed(views.unit_events, "ts").withColumn("unit_key", F.col("unit_key").cast("string"))
    middle = events.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]
    old, new = (events.where(c) for c in (F.unix_micros("ts") <= middle, F.unix_micros("ts") > middle))
    before = old.where(F.col("event").isin("failed", "preempted")).groupBy("unit_key").agg(F.count("*").alias("retries"))
    rows = new.unionByName(last_tick(spark, events.schema, unit_key=TICK, ts=far(), event="failed", event_id=-1, reason=""))
    stream = S.retry_verdict_stream(stream_of(spark, rows, folder, shuffled(rows, -1)), delay="4000 days", bucket="2 days", initial=before)
    want = units.retry_verdicts(events).where(F.unix_micros("ts") > middle)
    columns = ("event_id", "retries_before", "verdict", "failure_reason")
    assert values(drain(stream, folder, "append", "continued"), *columns) == values(want, *columns)
    assert want.where("retries_before > 0").count() > 0


def test_a_silent_key_is_forgotten(spark, folder):
    import datetime

    at = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    rows = [("f", 1, at(0), 10), ("f", 2, at(1), 30), ("g", 3, at(40), 5), ("f", 4, at(80), 20), ("g", 5, at(81), 9), (TICK, -1, far(), 0)]
    sizes = spark.createDataFrame(rows, "file_id string, event_id long, ts timestamp, size long")
    got = drain(S.chunk_stream(stream_of(spark, sizes, folder, "ts", parts=6), forget="30 days"), folder, "append", "forgotten")
    # after thirty days of silence a file starts anew
    assert values(got, "file_id", "event_id", "chunk_index", "offset", "length") == [("f", 1, 0, 0, 10), ("f", 2, 1, 10, 20), ("f", 4, 0, 0, 20), ("g", 3, 0, 0, 5), ("g", 5, 0, 0, 9)]


def test_dead_recheck_stream_equals_batch(spark, views, folder):
    probes = timed(views.probes, "ts").withColumn("unit_key", F.col("unit_key").cast("string"))
    marks = timed(views.markers, "marker_ts").withColumn("unit_key", F.col("unit_key").cast("string"))
    probes = probes.unionByName(last_tick(spark, probes.schema, unit_key=TICK, ts=far(), raw="{}", event_id=-1))
    marks = marks.unionByName(last_tick(spark, marks.schema, unit_key=TICK, marker_ts=far(), event_id=-1))
    left = stream_of(spark, probes, folder + "/p", "ts")
    right = stream_of(spark, marks, folder + "/m", "marker_ts")
    stream = S.dead_recheck_stream(left, right, wait_seconds=43200, delay="40 days")
    got = drain(stream, folder, "append", "rechecks")
    want = polling.dead_recheck(views.probes, views.markers, wait_seconds=43200)
    assert values(got, "event_id", "action", "detail") == values(want, "event_id", "action", "detail")
    assert {r.action for r in got.select("action").distinct().collect()} == {"complete", "preempt"}


def test_stuck_unit_stream_equals_batch(spark, views, folder):
    events = timed(views.unit_events, "ts").select("event_id", F.col("unit_key").cast("string"), "ts", "event")
    events = events.unionByName(last_tick(spark, events.schema, unit_key=TICK, ts=far(), event="completed", event_id=-1))
    want = polling.stuck_units(views.unit_events, timeout_seconds=43200)
    stream = S.stuck_unit_stream(stream_of(spark, events, folder + "/a", "ts"), timeout_seconds=43200)
    got = drain(stream, folder + "/a", "append", "stuck")
    assert values(got, "event_id", "reason") == values(want, "event_id", "reason")
    assert got.count() > 20
    mixed = S.stuck_unit_stream(stream_of(spark, events, folder + "/b", shuffled(events, -1)), timeout_seconds=43200, delay="4000 days")
    assert values(drain(mixed, folder + "/b", "append", "stuck_mixed"), "event_id") == values(want, "event_id")


def test_a_timeout_longer_than_the_delay_drops_nothing(spark, views, folder):
    events = timed(views.unit_events, "ts").select("event_id", (F.col("unit_key") % 5).cast("string").alias("unit_key"), "ts", "event")
    want = polling.stuck_units(events, timeout_seconds=7200)
    events = events.unionByName(last_tick(spark, events.schema, unit_key=TICK, ts=far(), event="completed", event_id=-1))
    stream = S.stuck_unit_stream(stream_of(spark, events, folder, "ts", parts=12), timeout_seconds=7200, delay="1 second")
    assert values(drain(stream, folder, "append", "long_timeout"), "event_id") == values(want, "event_id")


def test_an_event_older_than_the_last_one_settles_a_deployment(spark, folder):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(1, "u", at(0), "deployed"), (2, "u", at(100), "deployed"), (3, "u", at(30), "running"), (4, "u", at(70), "running"), (5, "u", at(5), "running")]
    rows += [(-1, TICK, far(), "running")]
    events = spark.createDataFrame(rows, "event_id long, unit_key string, ts timestamp, event string")
    order = F.when(F.col("event_id") < 0, 99).otherwise(F.col("event_id"))
    stream = S.stuck_unit_stream(stream_of(spark, events, folder, order, parts=6), timeout_seconds=600, delay="3 hours")
    assert values(drain(stream, folder, "append", "older"), "event_id") == [(2,)]


def test_spend_monitor_stream_ends_at_batch_total(spark, views, folder):
    rows = timed(spend(views), "ts")
    got = drain(D.spend_monitor_stream(stream_of(spark, rows, folder, "ts"), 25.0), folder, "complete", "spending")
    want = polling.spend_windows(spend(views), 25.0, width="3650 days")
    assert values(got, "batch_id", "spent", "status") == values(want, "batch_id", "spent", "status")


def test_spend_window_stream_equals_batch(spark, views, folder):
    rows = timed(spend(views), "ts")
    rows = rows.unionByName(last_tick(spark, rows.schema, batch_id=TICK, ts=far(), event_id=-1, amount=0.0))
    stream = D.spend_window_stream(stream_of(spark, rows, folder, "ts"))
    got = drain(stream, folder, "append", "spend_windows").select("batch_id", F.unix_seconds("window_start").alias("w"), "spent")
    want = polling.spend_windows(spend(views), 1.0).select("batch_id", F.col("window_start").alias("w"), "spent")
    assert values(got, "batch_id", "w", "spent") == values(want, "batch_id", "w", "spent")


def test_progress_stream_counts_a_marker_once(spark, views, folder):
    """Also one that is written again long after the watermark."""
    once = timed(views.markers, "marker_ts").select("batch_id", "shard_id", "unit_key", "marker_ts", "event_id")
    twice = once.unionByName(once.withColumn("event_id", F.col("event_id") + 100000))
    twice = twice.unionByName(once.withColumns({"event_id": F.col("event_id") + 200000, "marker_ts": F.col("marker_ts") + F.expr("INTERVAL 900 DAYS")}))
    twice = twice.unionByName(last_tick(spark, twice.schema, batch_id=TICK, shard_id=-1, marker_ts=far(), unit_key=-1, event_id=-1))
    stream = D.progress_stream(stream_of(spark, twice, folder, "marker_ts"))
    got = drain(stream, folder, "append", "progress").groupBy("batch_id", "shard_id").agg(F.sum("completed").alias("completed"))
    columns = ("batch_id", "shard_id", "completed")
    assert values(got, *columns) == values(polling.marker_progress(views.markers), *columns)


def test_spend_status_stream_equals_batch(spark, views, folder):
    rows = timed(spend(views), "ts")
    rows = rows.unionByName(last_tick(spark, rows.schema, batch_id=TICK, ts=far(), event_id=-1, amount=0.0))
    got = drain(S.spend_status_stream(stream_of(spark, rows, folder, "ts"), 25.0), folder, "append", "spend_status")
    rounded = [F.round(c, 6).alias(c) for c in ("spent", "total")]
    shown = lambda df: values(df.select("batch_id", "window_start", "status", *rounded), "batch_id", "window_start", "spent", "total", "status")
    assert shown(got) == shown(polling.spend_windows(spend(views), 25.0))


def test_gpu_health_stream_reports_each_instance_once(spark, views, folder):
    rows = timed(views.gpu_telemetry, "ts")
    stream = D.gpu_health_stream(stream_of(spark, rows, folder, "ts"), delay="400 days", min_memory_mib=12000)
    got = drain(stream, folder, "append", "unhealthy")
    want = health.first_unhealthy(health.gpu_health(views.gpu_telemetry, min_memory_mib=12000))
    assert values(got, "instance_id") == values(want, "instance_id")


def test_cycle_summary_stream_equals_batch(spark, views, folder):
    actions = timed(polling.probe_actions(views.probes, views.markers), "ts").select("event_id", "unit_key", "ts", "action")
    actions = actions.unionByName(last_tick(spark, actions.schema, unit_key=-1, ts=far(), event_id=-1, action="continue"))
    got = drain(D.cycle_summary_stream(stream_of(spark, actions, folder, "ts")), folder, "append", "cycles")
    want = polling.cycle_summary(polling.probe_actions(views.probes, views.markers))
    columns = ("cycle_start", "terminal", "preempted", "any_progress")
    assert values(got, *columns) == values(want, *columns)


def test_chunk_stream_equals_batch(spark, views, folder):
    rows = timed(views.file_sizes, "ts")
    rows = rows.unionByName(last_tick(spark, rows.schema, file_id=TICK, ts=far(), event_id=-1, size=0))
    columns = ("file_id", "event_id", "chunk_index", "offset", "length")
    want = values(objects.chunk_plan(views.file_sizes), *columns)
    assert values(drain(S.chunk_stream(stream_of(spark, rows, folder + "/a", "ts")), folder + "/a", "append", "chunks"), *columns) == want
    mixed = S.chunk_stream(stream_of(spark, rows, folder + "/b", shuffled(rows, -1)), delay="4000 days")
    assert values(drain(mixed, folder + "/b", "append", "chunks_mixed"), *columns) == want


def test_sweep_stream_writes_the_report_of_each_listing(spark, views, folder):
    listing = views.instances.drop("started_at")
    stream = stream_of(spark, listing, folder, "instance_id")
    log = destroy_log(views)
    query = start_sweep(stream, lambda df: sweep(df, views.units, log, SCOPE), f"{folder}/out", checkpoint=f"{folder}/cp")
    query.awaitTermination(120)
    got = spark.read.parquet(f"{folder}/out")
    want = sweep(listing, views.units, log, SCOPE)
    assert values(got, "instance_id", "verdict", "refusal", "severity") == values(
        want, "instance_id", "verdict", "refusal", "severity"
    )
    assert got.select("run").distinct().count() >= 2


def test_sweep_stream_chooses_listings_by_their_cycle(spark, views, folder):
    listing = views.instances.drop("started_at").withColumn("cycle", F.col("instance_id").cast("bigint") % 3)
    stream = stream_of(spark, listing, folder, "instance_id")
    query = start_sweep(stream, lambda df: df.select("instance_id"), f"{folder}/out", only=F.col("cycle") == 1, checkpoint=f"{folder}/cp")
    query.awaitTermination(120)
    assert values(spark.read.parquet(f"{folder}/out"), "instance_id") == values(listing.where("cycle = 1"), "instance_id")


def test_a_stream_needs_a_checkpoint_folder():
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(RuntimeError, match="checkpoint"):
        checkpoint_root(unset)


def test_probe_parse_matches_snapshot_defaults(spark):
    probe = J.parse(F.lit("[1]"))
    row = spark.range(1).select(polling.snapshot(probe).alias("s")).first().s
    assert (row.complete, row.worker_dead, row.log_tail) == (False, False, "")


class _States:
    """Map and value states in memory, with their calls counted."""

    def __init__(self):
        self.maps, self.value, self.timers, self.calls = {"waiting": {}, "parts": {}}, None, set(), 0

    def getMapState(self, name, *_):  # noqa: N802
        held, calls = self.maps[name], self
        count = lambda f: lambda *a: (setattr(calls, "calls", calls.calls + 1), f(*a))[1]
        return SimpleNamespace(
            getValue=count(held.get), containsKey=count(held.__contains__), updateValue=count(held.__setitem__), removeKey=count(held.pop),
            iterator=count(lambda: iter(list(held.items()))), keys=count(lambda: iter(list(held))),
        )

    def getValueState(self, *_):  # noqa: N802
        return SimpleNamespace(get=lambda: self.value, exists=lambda: self.value is not None, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)


def _counted(batches, *, hour=3_600_000, keep_ms=10**12):
    """Rows folded by a stream of one key over ``(watermark, times in microseconds)``, in their order, and the state calls."""
    handle = _States()

    def fold(key, rows, state):
        seen = state.get("seen", 0) + np.arange(1, len(rows) + 1)
        return pd.DataFrame({"event_id": rows["event_id"], "at": rows["at"], "seen": seen}), {"seen": int(seen[-1])}

    folder = S._Folder({"event_id": "bigint", "at": "bigint"}, ["event_id", "at", "seen"], "seen long", fold, hour, keep_ms)
    folder.init(handle)
    out, number = [], 0
    for watermark, times in batches:
        at = np.array(times, np.int64)
        rows = pd.DataFrame({"event_id": number + np.arange(len(at)), "at": at})
        number += len(at)
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w)
        if len(at):
            list(folder.handleInputRows(("k",), iter([rows]), now))
        while due := [t for t in sorted(handle.timers) if t <= watermark]:
            handle.timers.remove(due[0])
            out += list(folder.handleExpiredTimer(("k",), now, SimpleNamespace(getExpiryTimeInMs=lambda t=due[0]: t)))
    return [r for frame in out for r in frame.itertuples(index=False)], handle


@pytest.mark.parametrize("rows", [300, 5000])
def test_the_state_calls_of_a_key_follow_its_batches_and_not_its_rows(rows):
    times = np.random.default_rng(1).integers(0, 400 * 86_400_000_000, rows)
    cuts = [0, 100 * 86_400_000, 101 * 86_400_000, 250 * 86_400_000, 500 * 86_400_000]
    got, handle = _counted(list(zip(cuts, [times, [], [], [], []])))
    assert [r.at for r in got] == sorted(times.tolist()) and [r.seen for r in got] == list(range(1, rows + 1))
    assert not any(handle.maps.values()) and handle.calls < 400


def test_rows_of_overlapping_cells_are_folded_in_event_order():
    rng = np.random.default_rng(2)
    batches = [(day * 86_400_000, rng.integers(day * 86_400_000_000 + 1, (day + 40) * 86_400_000_000, 150)) for day in range(60)]
    got, handle = _counted([*batches, (10**12, [])])
    assert [r.at for r in got] == sorted(int(t) for _, times in batches for t in times)
    assert [r.seen for r in got] == list(range(1, 60 * 150 + 1)) and not any(handle.maps.values())


def test_silence_ends_a_state_inside_of_what_is_folded_at_once():
    day = 86_400_000_000
    got, handle = _counted([(0, [day, 2 * day, 40 * day, 41 * day, 90 * day]), (200 * 86_400_000, [])], keep_ms=30 * 86_400_000)
    assert [r.seen for r in got] == [1, 2, 1, 2, 1] and handle.value is None


def test_a_table_is_replayed_in_few_micro_batches_whatever_its_files_are(spark):
    from fleetlens.streaming import replay

    rows = spark.range(4000, numPartitions=24).select("id", F.timestamp_seconds(F.col("id")).alias("ts"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        stream, _ = replay.source(rows, "ts", tick={"id": -1})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    seen = []
    query = stream.writeStream.foreachBatch(lambda df, n: seen.append(df.count())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sum(seen) == 4001
    assert len([n for n in seen if n]) <= 5
