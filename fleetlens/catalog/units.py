"""Queries over shards, jobs and their events."""

from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.operators import units as U
from fleetlens.operators.ordered import positions
from fleetlens.session import scratch_folder
from fleetlens.sources import writers
from fleetlens.streaming import declarative

MARKED = "m AS (SELECT batch_id, unit_key FROM v_units WHERE shard_id % 3 = 0)"
COST = """t AS (SELECT *, CASE WHEN submit_time = '' THEN 0 ELSE epoch_us(CASE WHEN complete_time = '' THEN TIMESTAMPTZ '2003-01-01 00:00:00+00' ELSE CAST(complete_time AS TIMESTAMPTZ) END) - epoch_us(CAST(submit_time AS TIMESTAMPTZ)) END AS us
 FROM (SELECT * REPLACE (CASE WHEN submit_time = '' THEN '' ELSE submit_time END AS submit_time) FROM v_jobs))"""
ZONED = "CAST(CASE WHEN length({c}) = 19 THEN {c} || '+00:00' ELSE nullif({c}, '') END AS TIMESTAMPTZ)"
for _column in ("submit_time", "complete_time"):
    COST = COST.replace(f"CAST({_column} AS TIMESTAMPTZ)", ZONED.format(c=_column))
MICROS = "CAST(cost_per_hour AS DECIMAL(12,6)) * CAST(us AS DECIMAL(24,0))"


def as_of():
    return F.lit("2003-01-01T00:00:00+00:00")


def markers(v):
    return v.units.where("shard_id % 3 = 0").select("batch_id", "unit_key")


@query("unit_status_class", "units", "jobs", oracle="""
SELECT 'shard' AS kind, status, CASE WHEN status IN ('deployed', 'running') THEN 'active' WHEN status IN ('downloaded', 'destroyed') THEN 'done' ELSE status END AS class, count(*) AS n FROM v_units GROUP BY ALL
UNION ALL SELECT 'job', status, CASE WHEN status IN ('deploying', 'running') THEN 'active' WHEN status = 'downloaded' THEN 'done' ELSE status END, count(*) FROM v_jobs GROUP BY ALL""")
def unit_status_class(v):
    both = U.all_units(v.units, v.jobs)
    return both.groupBy("kind", "status", U.status_class(F.col("kind"), F.col("status")).alias("class")).agg(F.count("*").alias("n"))


@query("all_units", "units", "jobs", oracle="""
SELECT batch_id, kind, unit_key, status, shard_id, CAST(NULL AS VARCHAR) AS machine_id FROM v_units UNION ALL SELECT batch_id, kind, unit_key, status, NULL, machine_id FROM v_jobs""")
def all_units(v):
    return U.all_units(v.units, v.jobs).select("batch_id", "kind", "unit_key", "status", "shard_id", "machine_id")


@query("units_with_marker", "units", oracle=f", {MARKED} SELECT batch_id, unit_key, (batch_id, unit_key) IN (SELECT (batch_id, unit_key) FROM m) AS done FROM v_units")
def units_with_marker(v):
    return U.with_marker(v.units, markers(v)).select("batch_id", "unit_key", "done")


@query("deployable_units", "units", oracle=f", {MARKED} SELECT batch_id, unit_key FROM v_units u WHERE status = 'pending' AND NOT EXISTS (FROM m WHERE m.batch_id = u.batch_id AND m.unit_key = u.unit_key)")
def deployable_units(v):
    return U.deployable(v.units, markers(v)).select("batch_id", "unit_key")


@query("recoverable_units", "units", oracle=f", {MARKED} SELECT batch_id, unit_key FROM v_units u WHERE status = 'failed' AND EXISTS (FROM m WHERE m.batch_id = u.batch_id AND m.unit_key = u.unit_key)")
def recoverable_units(v):
    return U.recoverable(v.units, markers(v)).select("batch_id", "unit_key")


@query("remaining_items", "items", oracle="SELECT batch_id, item_id FROM v_items EXCEPT SELECT batch_id, item_id FROM v_items WHERE length(item_id) = 3")
def remaining_items(v):
    return U.remaining_items(v.items, v.items.where(F.length("item_id") == 3))


@query("resume_plan", "units", "instances", oracle="""
SELECT u.unit_key, u.instance_id, CASE WHEN u.instance_id = '' THEN 'skip' WHEN EXISTS (FROM v_instances i WHERE i.instance_id = u.instance_id AND i.state = 'running') THEN 'reconnect' ELSE 'preempt' END AS action
FROM (SELECT unit_key, status, CASE WHEN shard_id % 5 = 0 THEN '' ELSE instance_id END AS instance_id FROM v_units) u WHERE status IN ('deployed', 'running')""")
def resume_plan(v):
    lost = F.when(F.col("shard_id") % 5 == 0, "").otherwise(F.col("instance_id"))
    live = v.instances.where("state = 'running'")
    return U.resume_plan(v.units.withColumn("instance_id", lost), live).select("unit_key", "instance_id", "action")


@query("job_cost", "jobs", oracle=f", {COST} SELECT unit_key, us / CAST(3.6e9 AS DOUBLE) AS hours, CAST({MICROS} AS DOUBLE) / CAST(3.6e9 AS DOUBLE) AS cost_usd FROM t")
def job_cost(v):
    return U.job_cost(v.jobs, as_of()).select("unit_key", "hours", "cost_usd")


@query("batch_cost", "jobs", oracle=f", {COST} SELECT batch_id, CAST(sum({MICROS}) AS DOUBLE) / CAST(3.6e9 AS DOUBLE) AS cost_usd, count(*) AS jobs FROM t GROUP BY batch_id")
def batch_cost(v):
    return U.batch_cost(v.jobs, as_of())


SPEND = """s AS (SELECT batch_id, CAST(sum(CAST(cost_per_hour AS DECIMAL(12,6)) * CAST(epoch_us(TIMESTAMP '2003-01-01') - epoch_us(start_ts) AS DECIMAL(24,0))) AS DOUBLE) / CAST(3.6e9 AS DOUBLE) AS spent FROM v_units WHERE status IN ('deployed', 'running') GROUP BY batch_id)"""


@query("current_spend", "units", oracle=f", {SPEND} SELECT * FROM s")
def current_spend(v):
    return U.current_spend(v.units, as_of())


@query("budget_status", "units", oracle=f""", {SPEND}, c AS (SELECT *, CAST(CAST(substr(batch_id, 2) AS INT) * 150000 AS DOUBLE) AS ceiling FROM s)
SELECT batch_id, ceiling, CASE WHEN ceiling = 0 THEN 'unlimited' WHEN spent >= ceiling THEN 'exceeded' WHEN spent >= ceiling * 0.8 THEN 'warning' ELSE 'ok' END AS status FROM c""")
def budget_status(v):
    ceiling = (F.substr("batch_id", F.lit(2)).cast("int") * 150000).cast("double")
    rows = U.current_spend(v.units, as_of()).withColumn("ceiling", ceiling)
    return rows.select("batch_id", "ceiling", U.budget_status(F.col("spent"), F.col("ceiling")).alias("status"))


@query("status_counts", "settled_units", oracle="SELECT batch_id, status, count(*) AS units FROM v_settled_units GROUP BY ALL")
def status_counts(v):
    return U.status_counts(v.settled_units)


DONE = """d AS (SELECT batch_id, kind, count(*) AS units FROM v_settled_units GROUP BY ALL
 HAVING count(*) FILTER (status IS NULL OR NOT ((kind = 'job' AND status IN ('completed', 'downloaded', 'failed')) OR (kind = 'shard' AND status IN ('downloaded', 'destroyed', 'failed')))) = 0)"""


@query("archivable_batches", "settled_units", oracle=f", {DONE} SELECT * FROM d")
def archivable_batches(v):
    return U.archivable(v.settled_units)


@query("archive_terminal", "settled_units", oracle=f""", {DONE}
SELECT u.batch_id, u.unit_key, CASE WHEN d.units IS NOT NULL THEN kind || '_' || u.batch_id || '_20030101_000000.json' END AS archive_name FROM v_settled_units u LEFT JOIN d USING (batch_id, kind)""")
def archive_terminal(v):
    kept, archived = U.split_archived(U.archive_terminal(v.settled_units, as_of()))
    folder = scratch_folder(v.spark, "archive")
    writers.write_archive(archived, folder)
    gone = writers.read_archive(v.spark, folder).select("batch_id", "unit_key", "archive_name")
    return gone.unionByName(kept.select("batch_id", "unit_key", F.lit(None).cast("string").alias("archive_name")))


STATE = """
SELECT unit_key, CASE arg_max(event, (ts, event_id)) WHEN 'deployed' THEN 'deployed' WHEN 'failed' THEN 'failed' WHEN 'completed' THEN 'downloaded' ELSE 'pending' END AS status,
 coalesce(arg_max(CASE WHEN event = 'deployed' THEN instance_id ELSE '' END, (ts, event_id)) FILTER (event IN ('deployed', 'preempted')), '') AS instance_id,
 coalesce(arg_max(cost_per_hour, (ts, event_id)) FILTER (event = 'deployed'), 0) AS cost_per_hour, coalesce(arg_max(reason, (ts, event_id)) FILTER (event = 'failed'), '') AS failure_reason,
 count(*) FILTER (event IN ('failed', 'preempted')) AS retry_count FROM v_unit_events GROUP BY unit_key"""


@query("unit_current_state", "unit_events", oracle=STATE)
def unit_current_state(v):
    return U.current_state(v.unit_events)


@query("unit_state_stream", "unit_events", oracle=STATE)
def unit_state_stream(v):
    return declarative.unit_state_stream(v.unit_events)


RETRIES = """r AS (SELECT *, coalesce(sum(CASE WHEN event IN ('failed', 'preempted') THEN 1 ELSE 0 END) OVER (PARTITION BY unit_key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM v_unit_events)"""


@query("retry_verdict", "unit_events", oracle=f""", {RETRIES}
SELECT event_id, unit_key, CAST(n AS BIGINT) AS retries_before, CASE WHEN n >= 2 THEN 'failed' ELSE 'preempted' END AS verdict, CASE WHEN n >= 2 THEN reason || ' (retries exhausted)' ELSE '' END AS failure_reason FROM r WHERE event = 'preempted'""")
def retry_verdict(v):
    return U.retry_verdicts(v.unit_events).drop("ts")


@query("classify_failure", "unit_events", oracle=f""", {RETRIES}
SELECT event_id, CASE WHEN n >= 5 OR contains(reason, 'memory') THEN 'failed' ELSE 'preempted' END AS verdict, CASE WHEN n >= 5 THEN reason || ' (retries exhausted)' WHEN contains(reason, 'memory') THEN reason || ' (fatal)' ELSE '' END AS failure_reason FROM r WHERE event = 'preempted'""")
def classify_failure(v):
    fatal_on_memory = lambda reason: F.when(reason.contains("memory"), "fatal").otherwise("retry")
    return U.retry_verdicts(v.unit_events, max_retries=5, classify=fatal_on_memory).select("event_id", "verdict", "failure_reason")


def spend(v):
    batch = F.concat(F.lit("b"), (F.col("unit_key") % 9).cast("string"))
    return v.unit_events.select(batch.alias("batch_id"), "ts", "event_id", F.col("cost_per_hour").alias("amount"))


@query("spend_crossings", "unit_events", oracle="""
, c AS (SELECT 'b' || unit_key % 9 AS batch_id, ts, sum(CAST(cost_per_hour AS DECIMAL(18,6))) OVER (PARTITION BY unit_key % 9 ORDER BY ts, event_id) AS run FROM v_unit_events)
SELECT batch_id, CAST(max(run) AS DOUBLE) AS spent, min(ts) FILTER (run >= 200) AS warning_at, min(ts) FILTER (run >= 250) AS exceeded_at FROM c GROUP BY batch_id""")
def spend_crossings(v):
    return U.spend_crossings(spend(v), 250.0)


GATE = """g AS (SELECT *, CASE WHEN NOT boot_ok THEN 'Boot timeout' WHEN NOT gpu_ok THEN 'GPU verification failed' WHEN NOT files_ok THEN 'File deploy failed' WHEN NOT env_ok THEN 'Environment setup failed' WHEN NOT launch_ok THEN 'Worker launch failed' END AS t FROM v_deploy_attempts),
 e AS (SELECT *, coalesce(t || ' (attempt ' || (attempt + 1) || ')', '') AS error FROM g)"""


@query("deploy_gate", "deploy_attempts", oracle=f", {GATE} SELECT unit_key, attempt, error FROM e")
def deploy_gate(v):
    return U.deploy_gate(v.deploy_attempts).select("unit_key", "attempt", "error")


@query("deploy_outcome", "deploy_attempts", "units", oracle=f""", {GATE}, f AS (SELECT unit_key, min(attempt) FILTER (error = '') AS success_attempt, arg_min(machine_id, attempt) FILTER (error = '') AS machine_id, arg_max(error, attempt) AS last FROM e GROUP BY unit_key)
SELECT u.shard_id AS unit_key, success_attempt IS NOT NULL AS success, success_attempt, machine_id, CASE WHEN success_attempt IS NOT NULL THEN '' ELSE coalesce(last, 'No GPU offers available') END AS error FROM v_units u LEFT JOIN f ON f.unit_key = u.shard_id""")
def deploy_outcome(v):
    return U.deploy_outcome(v.deploy_attempts, v.units.select(F.col("shard_id").alias("unit_key")))


NAMES = "n AS (SELECT shard_id, regexp_extract(rel_path, '[^/]*$') AS name FROM v_outputs), x AS (SELECT shard_id, name FROM v_required_files EXCEPT SELECT shard_id, name FROM n)"


@query("file_set_difference", "outputs", "required_files", oracle=f", {NAMES} SELECT * FROM x")
def file_set_difference(v):
    return U.missing_files(v.required_files, v.outputs)


@query("critical_files", "outputs", "required_files", oracle=f""", {NAMES}
SELECT shard_id, coalesce(c, 0) AS files, coalesce(m, 0) AS missing, CASE WHEN m > 0 THEN 0 ELSE c END AS accepted_files
FROM (SELECT shard_id, count(*) AS c FROM n GROUP BY shard_id) z FULL JOIN (SELECT shard_id, count(*) AS m FROM x GROUP BY shard_id) y USING (shard_id)""")
def critical_files(v):
    return U.critical_files(v.required_files, v.outputs)


@query("sorted_lists", "units", oracle="SELECT batch_id, shard_id, row_number() OVER (PARTITION BY batch_id ORDER BY shard_id) AS position FROM v_units WHERE status = 'downloaded'")
def sorted_lists(v):
    return positions(v.units.where("status = 'downloaded'").select("batch_id", "shard_id"), ["batch_id"], "shard_id")


@query("unit_hooks", "jobs", oracle="""
SELECT batch_id, 'k/' || unit_key AS unit_key, batch_id || ' ' || machine_id AS unit_label, CASE WHEN status = 'pending' AND retry_count > 2 THEN 'hopeless' WHEN status = 'pending' THEN 'pending' WHEN instance_id <> '' THEN 'active' ELSE 'other' END AS class FROM v_jobs""")
def unit_hooks(v):
    waiting = F.col("status") == "pending"
    hooked = U.with_hooks(
        v.jobs,
        key=F.concat(F.lit("k/"), "unit_key"),
        label=F.concat_ws(" ", "batch_id", "machine_id"),
        classes={"hopeless": waiting & (F.col("retry_count") > 2), "pending": waiting, "active": F.col("instance_id") != ""},
    )
    return hooked.select("batch_id", "unit_key", "unit_label", "class")
