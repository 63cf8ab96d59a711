"""Queries over probes, markers and events; streams run over them to their end, beside their batch forms."""

from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.catalog.units import spend
from fleetlens.functions import json_values as J
from fleetlens.operators import polling as P
from fleetlens.operators import units as U
from fleetlens.plans.poll import poll_cycle
from fleetlens.streaming import declarative, replay, stateful
from fleetlens.streaming.replay import TICK

SNAP = """j AS (SELECT *, raw::JSON AS d FROM v_probes),
 b AS (SELECT *, json_type(d) = 'OBJECT' AND coalesce(CASE json_type(d, '$.complete') WHEN 'BOOLEAN' THEN CAST(json_extract(d, '$.complete') AS BOOLEAN) WHEN 'VARCHAR' THEN json_extract_string(d, '$.complete') <> '' WHEN 'DOUBLE' THEN CAST(json_extract(d, '$.complete') AS DOUBLE) <> 0 END, false) AS complete,
  json_type(d) = 'OBJECT' AND coalesce(CASE json_type(d, '$.worker_dead') WHEN 'BOOLEAN' THEN CAST(json_extract(d, '$.worker_dead') AS BOOLEAN) WHEN 'UBIGINT' THEN json_extract_string(d, '$.worker_dead') <> '0' WHEN 'OBJECT' THEN true WHEN 'ARRAY' THEN json_array_length(d, '$.worker_dead') > 0 END, false) AS worker_dead,
  CASE WHEN json_type(d, '$.log_tail') = 'VARCHAR' THEN json_extract_string(d, '$.log_tail') ELSE '' END AS log_tail FROM j),
 m AS (SELECT unit_key, min(marker_ts) AS mark FROM v_markers GROUP BY unit_key)"""
ACTION = """CASE WHEN mark <= ts OR complete THEN 'complete' WHEN worker_dead THEN CASE WHEN mark <= ts + INTERVAL {wait} SECOND THEN 'complete' ELSE 'preempt' END ELSE 'continue' END"""


@query("progress_snapshot", "probes", oracle=f", {SNAP} SELECT event_id, complete, worker_dead, log_tail FROM b")
def progress_snapshot(v):
    return v.probes.select("event_id", P.snapshot(J.parse(F.col("raw"))).alias("s")).select("event_id", "s.*")


@query("unit_action_stream", "probes", "markers", oracle=f""", {SNAP}, a AS (SELECT b.*, {ACTION.format(wait=3600)} AS action FROM b LEFT JOIN m USING (unit_key))
SELECT event_id, unit_key, ts, action, CASE WHEN action = 'preempt' THEN 'worker_died' END AS cause, CASE WHEN action = 'preempt' THEN log_tail END AS detail FROM a""")
def unit_action_stream(v):
    first = v.markers.groupBy("unit_key").agg(F.min("marker_ts").alias("mark"))
    again = F.col("ts") + F.make_interval(secs=F.lit(3600))
    read = v.probes.join(first, "unit_key", "left").withColumns(
        {"marked": F.coalesce(F.col("mark") <= F.col("ts"), F.lit(False)), "marked_again": F.coalesce(F.col("mark") <= again, F.lit(False))}
    )
    return declarative.unit_action_stream(read)


@query("unit_actions", "probes", "markers", oracle=f""", {SNAP}, l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY unit_key ORDER BY ts DESC, event_id DESC) = 1),
 a AS (SELECT l.*, {ACTION.format(wait=3600)} AS action FROM l LEFT JOIN m USING (unit_key))
SELECT unit_key, ts, action, CASE WHEN action = 'preempt' THEN 'worker_died' END AS cause, CASE WHEN action = 'preempt' THEN log_tail END AS detail FROM a""")
def unit_actions(v):
    return P.unit_actions(v.probes, v.markers, recheck_seconds=3600)


DEAD_RECHECK_STREAM = f""", {SNAP},
 f AS (SELECT b.*, EXISTS (FROM v_markers k WHERE k.unit_key = b.unit_key AND k.marker_ts BETWEEN b.ts AND b.ts + INTERVAL 43200 SECOND) AS found FROM b WHERE worker_dead AND NOT complete)
SELECT event_id, unit_key, ts, CASE WHEN found THEN 'complete' ELSE 'preempt' END AS action, CASE WHEN NOT found THEN log_tail END AS detail FROM f"""


@query("dead_recheck", "probes", "markers", oracle=DEAD_RECHECK_STREAM)
def dead_recheck(v):
    return P.dead_recheck(v.probes, v.markers, wait_seconds=43200)


@query("dead_recheck_stream", "probes", "markers", oracle=DEAD_RECHECK_STREAM)
def dead_recheck_stream(v):
    """Markers arrive beside the probes; both bring a row that moves the watermark."""
    probes, marks = (df.withColumn("unit_key", F.col("unit_key").cast("string")) for df in (v.probes, v.markers))
    left, _ = replay.source(probes, "ts", tick={"unit_key": TICK, "raw": "{}", "event_id": -1})
    right, _ = replay.source(marks, "marker_ts", tick={"unit_key": TICK, "event_id": -1})
    found = replay.to_table(stateful.dead_recheck_stream(left, right, wait_seconds=43200, delay="400 days", bucket="1 day"))
    return replay.as_before(found, v.probes, "unit_key", "ts")


STUCK_UNIT_STREAM = """
SELECT event_id, unit_key, ts, 'timed out after 43200 seconds' AS reason FROM v_unit_events e WHERE event = 'deployed' AND NOT EXISTS (FROM v_unit_events n WHERE n.unit_key = e.unit_key AND n.ts > e.ts AND n.ts <= e.ts + INTERVAL 43200 SECOND)"""


@query("stuck_units", "unit_events", oracle=STUCK_UNIT_STREAM)
def stuck_units(v):
    return P.stuck_units(v.unit_events, timeout_seconds=43200)


@query("stuck_unit_stream", "unit_events", oracle=STUCK_UNIT_STREAM)
def stuck_unit_stream(v):
    events = v.unit_events.select("event_id", F.col("unit_key").cast("string").alias("unit_key"), "ts", "event")
    rows, delay = replay.source(events, "ts", tick={"unit_key": TICK, "event": "completed", "event_id": -1})
    return replay.as_before(replay.to_table(stateful.stuck_unit_stream(rows, timeout_seconds=43200, delay=delay, bucket="1 day")), v.unit_events, "unit_key", "ts")


SPEND_MONITOR_STREAM = """
, w AS (SELECT 'b' || unit_key % 9 AS batch_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS window_start, sum(CAST(cost_per_hour AS DECIMAL(18,6))) AS s FROM v_unit_events GROUP BY ALL),
 t AS (SELECT *, CAST(sum(s) OVER (PARTITION BY batch_id ORDER BY window_start) AS DOUBLE) AS total FROM w)
SELECT batch_id, window_start, CAST(s AS DOUBLE) AS spent, total, CASE WHEN total >= 250 THEN 'exceeded' WHEN total >= 200 THEN 'warning' ELSE 'ok' END AS status FROM t"""


@query("spend_windows", "unit_events", oracle=SPEND_MONITOR_STREAM)
def spend_windows(v):
    return P.spend_windows(spend(v), 250.0)


@query("spend_monitor_stream", "unit_events", oracle=SPEND_MONITOR_STREAM)
def spend_monitor_stream(v):
    rows, delay = replay.source(spend(v), "ts", tick={"batch_id": TICK, "event_id": -1, "amount": 0.0})
    return replay.to_table(stateful.spend_status_stream(rows, 250.0, delay=delay))


PROGRESS_STREAM = "SELECT batch_id, shard_id, count(DISTINCT unit_key) AS completed FROM v_markers GROUP BY batch_id, shard_id"


@query("marker_progress", "markers", oracle=PROGRESS_STREAM)
def marker_progress(v):
    return P.marker_progress(v.markers)


@query("progress_stream", "markers", oracle=PROGRESS_STREAM)
def progress_stream(v):
    marks, delay = replay.source(v.markers, "marker_ts", tick={"batch_id": TICK, "shard_id": -1, "unit_key": -1, "event_id": -1})
    per_window = replay.to_table(declarative.progress_stream(marks, delay=delay))
    return per_window.groupBy("batch_id", "shard_id").agg(F.sum("completed").alias("completed"))


CYCLE_SUMMARY_STREAM = f""", {SNAP}, a AS (SELECT b.*, {ACTION.format(wait=0)} AS action FROM b LEFT JOIN m USING (unit_key))
SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS cycle_start, count(*) FILTER (action = 'complete') AS terminal, count(*) FILTER (action = 'preempt') AS preempted, count(*) FILTER (action <> 'continue') > 0 AS any_progress FROM a GROUP BY 1"""


@query("cycle_summary", "probes", "markers", oracle=CYCLE_SUMMARY_STREAM)
def cycle_summary(v):
    return P.cycle_summary(P.probe_actions(v.probes, v.markers))


@query("cycle_summary_stream", "probes", "markers", oracle=CYCLE_SUMMARY_STREAM)
def cycle_summary_stream(v):
    actions = P.probe_actions(v.probes, v.markers).select("event_id", "unit_key", "ts", "action")
    rows, delay = replay.source(actions, "ts", tick={"unit_key": -1, "event_id": -1, "action": "continue"})
    return replay.to_table(declarative.cycle_summary_stream(rows, delay=delay))


@query("unit_verdict", "probes", "markers", oracle=f""", {SNAP}, a AS (SELECT b.*, {ACTION.format(wait=0)} AS action FROM b LEFT JOIN m USING (unit_key))
SELECT event_id, CASE action WHEN 'continue' THEN 'running' WHEN 'preempt' THEN 'preempted' ELSE CASE WHEN unit_key % 7 = 0 THEN 'failed' ELSE 'completed' END END AS verdict FROM a""")
def unit_verdict(v):
    collected = F.when(F.col("unit_key") % 14 == 0, F.lit(None).cast("boolean")).otherwise(F.col("unit_key") % 7 != 0)
    return P.probe_actions(v.probes, v.markers).select("event_id", U.unit_verdict(F.col("action"), collected).alias("verdict"))


@query("log_tail", "log_lines", oracle="""
SELECT unit_key, string_agg(line, chr(10) ORDER BY line_no) AS log_tail FROM (SELECT * FROM v_log_lines QUALIFY row_number() OVER (PARTITION BY unit_key ORDER BY line_no DESC) <= 3) GROUP BY unit_key""")
def log_tail(v):
    return P.log_tail(v.log_lines)


@query("poll_cycle", "probes", "markers", "units", oracle=f""", {SNAP}, l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY unit_key ORDER BY ts DESC, event_id DESC) = 1),
 a AS (SELECT CAST(l.unit_key AS VARCHAR) AS unit_key, {ACTION.format(wait=0)} AS action FROM l LEFT JOIN m USING (unit_key)),
 pc AS (SELECT u.*, CASE WHEN u.status IN ('deployed', 'running') THEN CASE a.action WHEN 'continue' THEN 'running' WHEN 'preempt' THEN 'preempted' WHEN 'complete' THEN CASE WHEN u.shard_id % 10 < 7 THEN 'completed' ELSE 'failed' END END END AS verdict FROM v_units u LEFT JOIN a USING (unit_key))
SELECT unit_key, verdict, CASE WHEN verdict = 'completed' THEN 'downloaded' WHEN verdict = 'failed' OR (verdict = 'preempted' AND retry_count >= 2) THEN 'failed' WHEN verdict = 'preempted' THEN 'pending' ELSE status END AS status,
 CASE WHEN verdict = 'preempted' AND retry_count < 2 THEN '' ELSE instance_id END AS instance_id, retry_count + CASE WHEN verdict IN ('failed', 'preempted') THEN 1 ELSE 0 END AS retry_count,
 CASE WHEN verdict = 'failed' THEN 'results are incomplete' WHEN verdict = 'preempted' AND retry_count >= 2 THEN 'worker died silently (retries exhausted)' ELSE '' END AS failure_reason FROM pc""")
def poll_cycle_query(v):
    probes = v.probes.withColumn("unit_key", F.col("unit_key").cast("string"))
    markers = v.markers.withColumn("unit_key", F.col("unit_key").cast("string"))
    cycle = poll_cycle(v.units, probes, markers, v.units.where("shard_id % 10 < 7"))
    return cycle.select("unit_key", "verdict", "status", "instance_id", "retry_count", "failure_reason")
