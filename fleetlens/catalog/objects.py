"""Queries over object inventories."""

from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.functions.keys import safe_path
from fleetlens.operators import objects as O
from fleetlens.session import scratch_folder
from fleetlens.sources import writers
from fleetlens.streaming import replay, stateful

ROOT = "project/batches"
PARSED = r"""p0 AS (SELECT *, substr(key, length('project/batches/') + 1) AS rel FROM v_objects WHERE starts_with(key, 'project/batches/')),
 p1 AS (SELECT *, split_part(rel, '/', 1) AS batch_id, split_part(rel, '/', 2) AS unit, regexp_extract(rel, '^[^/]+/[^/]+/(.*)$', 1) AS rest FROM p0),
 p AS (SELECT *, TRY_CAST(nullif(regexp_extract(unit, '^shard_([0-9]+)$', 1), '') AS BIGINT) AS shard_id,
   CASE WHEN unit = 'global_markers' THEN CASE WHEN rest LIKE '%.done' THEN 'global_marker' ELSE 'other' END WHEN rest = 'DONE' THEN 'done' WHEN rest = 'worker.exitcode' THEN 'exitcode' WHEN regexp_full_match(rest, 'markers/.*\.done') THEN 'marker'
   WHEN regexp_full_match(rest, 'outputs/.+') THEN 'output' WHEN regexp_matches(rest, '_chunk_[0-9]+[^/]*$') THEN 'chunk' ELSE 'other' END AS area FROM p1)"""


@query("list_objects", "objects", oracle="SELECT key, size, regexp_replace(key, '^project/batches/b1/', '') AS rel_path FROM v_objects WHERE key LIKE 'project/batches/b1/%' AND key <> 'project/batches/b1/'")
def list_objects(v):
    return O.list_objects(v.objects, "project/batches/b1/").select("key", "size", "rel_path")


@query("object_key_parse", "objects", oracle=rf"""
, {PARSED} SELECT key, batch_id, unit, shard_id, area, CASE area WHEN 'global_marker' THEN regexp_replace(rest, '\.done$', '') WHEN 'marker' THEN regexp_extract(rest, '^markers/(.*)\.done$', 1) WHEN 'output' THEN substr(rest, 9) ELSE rest END AS name FROM p""")
def object_key_parse(v):
    return O.parsed(v.objects, ROOT).select("key", "batch_id", "unit", "shard_id", "area", "name")


@query("shard_progress", "objects", oracle=f", {PARSED} SELECT bucket, batch_id, shard_id, count(*) AS completed FROM p WHERE area = 'marker' AND shard_id IS NOT NULL GROUP BY ALL")
def shard_progress(v):
    return O.shard_progress(v.objects, ROOT)


@query("batch_progress", "objects", oracle=f", {PARSED} SELECT bucket, batch_id, count(*) AS completed FROM p WHERE area = 'global_marker' GROUP BY ALL")
def batch_progress(v):
    return O.batch_progress(v.objects, ROOT)


@query("done_shards", "objects", oracle=f", {PARSED} SELECT bucket, batch_id, shard_id, row_number() OVER (PARTITION BY bucket, batch_id ORDER BY shard_id) AS position FROM (SELECT DISTINCT bucket, batch_id, shard_id FROM p WHERE area = 'done' AND shard_id IS NOT NULL)")
def done_shards(v):
    return O.done_shards(v.objects, ROOT)


@query("batch_cleanup_manifest", "objects", oracle=f", {PARSED} SELECT bucket, batch_id, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM p GROUP BY ALL")
def batch_cleanup_manifest(v):
    return O.batch_manifest(v.objects, ROOT)


@query("mark_done", "markers", oracle="SELECT unit_key, max(marker_ts) AS marker_ts, arg_max(worker_id, (marker_ts, event_id)) AS worker_id, count(*) AS writes FROM v_markers GROUP BY unit_key")
def mark_done(v):
    """Markers appended in two writes, read back and folded."""
    folder = scratch_folder(v.spark, "markers")
    for half in (0, 1):
        writers.write_markers(v.markers.where(F.col("event_id") % 2 == half), folder)
    return O.latest_markers(v.spark.read.schema(v.markers.schema).parquet(folder))


EXPIRING = "x AS (SELECT o.bucket, o.key, o.size, r.id AS rule_id, r.pos, r.days FROM v_bucket_objects o JOIN v_rules r ON r.bucket = o.bucket AND starts_with(o.key, r.prefix) AND r.status = 'Enabled' AND o.age_days >= r.days)"


@query("expiring_objects", "bucket_objects", "rules", oracle=f", {EXPIRING} SELECT * FROM x")
def expiring_objects(v):
    return O.expiring_objects(v.bucket_objects, v.rules).select("bucket", "key", "size", "rule_id", "pos", "days")


@query("expiring_summary", "bucket_objects", "rules", oracle=f", {EXPIRING}, f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY days, pos) = 1) SELECT bucket, rule_id, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY ALL")
def expiring_summary(v):
    return O.expiring_summary(v.bucket_objects, v.rules)


@query("chunk_order", "objects", oracle=f""", {PARSED}, k AS (SELECT bucket, key, regexp_replace(key, '_chunk_[0-9]+[^/]*$', '') AS file, CAST(regexp_extract(rest, '_chunk_([0-9]+)', 1) AS BIGINT) AS chunk_index FROM p WHERE area = 'chunk')
SELECT file, key, chunk_index, row_number() OVER (PARTITION BY bucket, file ORDER BY chunk_index, key) AS position FROM k""")
def chunk_order(v):
    return O.chunk_order(v.objects, ROOT).select("file", "key", "chunk_index", "position")


PLAN = """
, g AS (SELECT *, coalesce(max(size) OVER (PARTITION BY file_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM v_file_sizes)
SELECT file_id, event_id, row_number() OVER (PARTITION BY file_id ORDER BY ts, event_id) - 1 AS chunk_index, seen AS "offset", size - seen AS length FROM g WHERE size > seen"""


@query("chunk_plan", "file_sizes", oracle=PLAN)
def chunk_plan(v):
    return O.chunk_plan(v.file_sizes)


@query("chunk_stream", "file_sizes", oracle=PLAN)
def chunk_stream(v):
    rows, delay = replay.source(v.file_sizes, "ts", tick={"file_id": replay.TICK, "event_id": -1, "size": 0})
    return replay.to_table(stateful.chunk_stream(rows, delay=delay, bucket="1 day"))


def chunks(v):
    return v.log_lines.selectExpr("unit_key AS file_id", "line_no AS chunk_index", "encode(line, 'UTF-8') AS content")


@query("consolidate_chunks", "log_lines", oracle="""
SELECT unit_key AS file_id, line_no AS chunk_index, CAST(octet_length(encode(line)) AS INT) AS length, CAST(coalesce(sum(octet_length(encode(line))) OVER (PARTITION BY unit_key ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", md5(line) AS digest FROM v_log_lines""")
def consolidate_chunks(v):
    return O.consolidate(chunks(v)).select("file_id", "chunk_index", "length", "offset", F.md5("content").alias("digest"))


@query("consolidated_files", "log_lines", oracle="SELECT unit_key AS file_id, count(*) AS chunks, CAST(sum(octet_length(encode(line))) AS BIGINT) AS bytes, max(line_no) AS last_chunk FROM v_log_lines GROUP BY unit_key")
def consolidated_files(v):
    return O.consolidated_files(chunks(v))


@query("path_safety", "paths", oracle="SELECT doc_id, path <> '' AND NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..') AS safe FROM v_paths")
def path_safety(v):
    return v.paths.select("doc_id", safe_path(F.col("path")).alias("safe"))


@query("duplicate_payload_names", "paths", oracle="SELECT payload_id, regexp_extract(path, '[^/]*$') AS name, count(*) AS copies FROM v_paths WHERE path <> '' GROUP BY ALL HAVING count(*) > 1")
def duplicate_payload_names(v):
    return O.duplicate_names(v.paths)
