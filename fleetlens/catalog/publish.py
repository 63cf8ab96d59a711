"""Queries over upload evidence."""

from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.operators import publish

MISSING = """e AS (SELECT DISTINCT batch_id, shard_id, split_part(rel_path, '/', 1) AS entry, contains(rel_path, '/') AS dir FROM v_outputs),
 mp AS (SELECT batch_id, shard_id, entry FROM e WHERE dir AND NOT EXISTS (FROM v_completions c WHERE c.batch_id = e.batch_id AND c.shard_id = e.shard_id AND c.prediction = e.entry)
  UNION ALL SELECT batch_id, shard_id, 'FLAT:' || entry FROM e WHERE NOT dir AND NOT EXISTS (FROM v_shard_markers m WHERE m.batch_id = e.batch_id AND m.shard_id = e.shard_id))"""


@query("missing_predictions", "outputs", "completions", "shard_markers", oracle=f", {MISSING} SELECT * FROM mp")
def missing_predictions(v):
    return publish.missing_predictions(v.outputs, v.completions, v.shard_markers)


@query("upload_unresolved", "outputs", "completions", "shard_markers", "upload_failures", "units", oracle=f""", {MISSING},
 s AS (SELECT DISTINCT batch_id, shard_id FROM v_outputs UNION SELECT batch_id, shard_id FROM v_units)
SELECT batch_id, shard_id, CASE WHEN (batch_id, shard_id) IN (SELECT (batch_id, shard_id) FROM v_upload_failures) THEN true WHEN (batch_id, shard_id) NOT IN (SELECT (batch_id, shard_id) FROM v_outputs) THEN false
 WHEN (batch_id, shard_id) IN (SELECT (batch_id, shard_id) FROM v_shard_markers) THEN false ELSE (batch_id, shard_id) IN (SELECT (batch_id, shard_id) FROM mp) END AS unresolved FROM s""")
def upload_unresolved(v):
    shards = v.outputs.select("batch_id", "shard_id").union(v.units.select("batch_id", "shard_id")).distinct()
    return publish.upload_unresolved(shards, v.outputs, v.upload_failures, v.completions, v.shard_markers)


@query("publish_gate", "shard_evidence", oracle="""
SELECT shard_id, kind, CASE WHEN kind = 'job' AND files_failed THEN 3 WHEN has_failure_rows OR (kind = 'shard' AND has_outputs AND NOT shard_marker AND predictions_missing) THEN 4 WHEN NOT exitcode_ok THEN 1 WHEN NOT done_put_ok THEN 2 ELSE 0 END AS done_code,
 CASE WHEN files_failed THEN 3 WHEN kind = 'shard' AND NOT marker_written THEN 5 WHEN has_failure_rows THEN 4 WHEN NOT exitcode_ok THEN 1 WHEN NOT done_put_ok THEN 2 ELSE 0 END AS full_code FROM v_shard_evidence""")
def publish_gate(v):
    done = publish.publish_code(v.shard_evidence, full=False).withColumnRenamed("code", "done_code")
    return publish.publish_code(done, full=True).select("shard_id", "kind", "done_code", F.col("code").alias("full_code"))


STATUS = """s AS (SELECT batch_id, shard_id, prediction, CASE arg_max(outcome, (ts, event_id)) WHEN 'uploaded' THEN 'ok' WHEN 'absent' THEN 'absent' ELSE 'failed' END AS status, arg_max(files_uploaded, (ts, event_id)) AS uploaded,
 arg_max(outcome, (ts, event_id)) FILTER (outcome <> 'absent') IN ('file_failed', 'marker_failed') AS open_failures FROM v_upload_log GROUP BY ALL)"""


@query("prediction_status", "upload_log", oracle=f", {STATUS} SELECT batch_id, shard_id, prediction, status, uploaded, coalesce(open_failures, false) AS open_failures FROM s")
def prediction_status(v):
    return publish.prediction_status(v.upload_log)


@query("open_failure_rows", "upload_log", "upload_failures", oracle=f", {STATUS} SELECT f.* FROM v_upload_failures f WHERE name = 'SENTINEL_WRITE_FAILED' OR NOT EXISTS (FROM s WHERE s.batch_id = f.batch_id AND s.shard_id = f.shard_id AND s.prediction = f.name AND status = 'ok' AND NOT open_failures)")
def open_failure_rows(v):
    return publish.open_failure_rows(v.upload_failures, publish.prediction_status(v.upload_log))
