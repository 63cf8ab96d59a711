"""Queries over telemetry, timings, diagnostics and workloads."""

from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.operators import health
from fleetlens.operators.workload import run_workload
from fleetlens.session import scratch_folder
from fleetlens.sources import readers, writers
from fleetlens.sources.versions import Conflict
from fleetlens.streaming import declarative, replay

READ = r"""c AS (SELECT *, string_split(trim(csv_line), ',') AS p FROM v_gpu_telemetry),
 t AS (SELECT *, CASE WHEN len(p) >= 2 THEN coalesce(TRY_CAST(CASE WHEN regexp_full_match(trim(p[1]), '\d+') THEN trim(p[1]) END AS BIGINT), 0) END AS temp_c,
  CASE WHEN len(p) >= 3 THEN coalesce(TRY_CAST(CASE WHEN regexp_full_match(trim(p[2]), '\d+') THEN trim(p[2]) END AS BIGINT), 0) WHEN len(p) = 2 THEN 0 END AS mem_mib, trim(CASE WHEN len(p) >= 3 THEN p[3] WHEN len(p) = 2 THEN p[2] END) AS ecc FROM c),
 h AS (SELECT *, CASE WHEN temp_c > 90 THEN 'temp' WHEN mem_mib < 12000 THEN 'memory' WHEN coalesce(TRY_CAST(ecc AS BIGINT), 0) > 0 THEN 'ecc' END AS breach FROM t)"""


@query("read_gpu_telemetry", "gpu_telemetry", oracle=f", {READ} SELECT event_id, temp_c, mem_mib, ecc FROM t")
def read_gpu_telemetry(v):
    return readers.parse_telemetry(v.gpu_telemetry, min_memory_mib=12000).select("event_id", "temp_c", "mem_mib", "ecc")


@query("gpu_health", "gpu_telemetry", oracle=f", {READ} SELECT event_id, breach, breach IS NULL AS healthy FROM h")
def gpu_health(v):
    return health.gpu_health(v.gpu_telemetry, min_memory_mib=12000).select("event_id", "breach", "healthy")


FIRST = f", {READ} SELECT instance_id, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(breach, (ts, event_id)) AS breach FROM h WHERE breach IS NOT NULL GROUP BY instance_id"


@query("first_unhealthy", "gpu_telemetry", oracle=FIRST)
def first_unhealthy(v):
    return health.first_unhealthy(health.gpu_health(v.gpu_telemetry, min_memory_mib=12000))


@query("gpu_health_stream", "gpu_telemetry", oracle=FIRST)
def gpu_health_stream(v):
    readings, _ = replay.source(v.gpu_telemetry, "ts")
    found = replay.to_latest(declarative.first_unhealthy_stream(readings, min_memory_mib=12000), "instance_id")
    return replay.as_before(found, v.gpu_telemetry, "ts")


@query("vram_gate", "vram", oracle="""
, p AS (SELECT event_id, string_split(split_part(raw, chr(10), 1), ',') AS p FROM v_vram), t AS (SELECT event_id, CASE WHEN TRY_CAST(trim(p[1]) AS BIGINT) IS NOT NULL THEN TRY_CAST(trim(p[2]) AS BIGINT) END AS total_mib FROM p)
SELECT event_id, total_mib, CASE WHEN total_mib IS NULL THEN 'unreadable' WHEN total_mib >= 20000 THEN 'ok' ELSE 'too low' END AS gate FROM t""")
def vram_gate(v):
    return health.vram_gate(v.vram).select("event_id", "total_mib", "gate")


@query("load_calibration", "timing_lines", oracle="""
SELECT event_id, CAST(json_extract(line, '$.runtime_sec') AS DOUBLE) AS runtime_sec FROM v_timing_lines WHERE starts_with(line, '{"') AND json_extract_string(CASE WHEN starts_with(line, '{"') THEN line ELSE 'null' END, '$.workload') = 'click'""")
def load_calibration(v):
    runtime = F.try_variant_get("record", "$.runtime_sec", "double").alias("runtime_sec")
    return readers.parse_calibration(v.timing_lines, "click", "line").select("event_id", runtime)


@query("append_timing", "unit_events", oracle="""
SELECT event_id, '{"workload":"' || event || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","event_id":' || event_id || '}' AS line FROM v_unit_events""")
def append_timing(v):
    """Timings appended twice, a half each, and read back."""
    rows = v.unit_events.select("event_id", "ts", F.col("event").alias("workload"))
    folder = scratch_folder(v.spark, "timings")
    for half in (0, 1):
        writers.append_timing(rows.where(F.col("event_id") % 2 == half), folder, F.col("ts"), "event_id")
    lines = v.spark.read.text(folder).select(F.col("value").alias("line"))
    return lines.select(F.get_json_object("line", "$.event_id").cast("bigint").alias("event_id"), "line")


@query("write_batch_state", "units", oracle="""
SELECT batch_id, unit_key, status, '2024-01-01T00:00:00.000000Z' AS updated_at, CAST(7 AS BIGINT) AS version FROM v_units""")
def write_batch_state(v):
    as_of = F.lit("2024-01-01T00:00:00+00:00")
    units = v.units.select("batch_id", "unit_key", "status")
    folder = scratch_folder(v.spark, "state")
    for version, rows in ((6, units.where("status = 'pending'")), (7, units)):
        writers.write_state(rows, rows.select("batch_id").distinct(), folder, version, as_of)
    return writers.read_state(v.spark, folder)[0]


@query("concurrent_state_writers", "units", oracle="""
SELECT batch_id, unit_key, CASE WHEN status = 'pending' THEN 'running' ELSE status END || CASE WHEN CAST(substr(batch_id, 2) AS INT) % 3 = 0 THEN '+a' ELSE '' END
   || CASE WHEN CAST(substr(batch_id, 2) AS INT) % 4 = 0 THEN '+b' ELSE '' END || CASE WHEN CAST(substr(batch_id, 2) AS INT) % 3 = 1 AND CAST(substr(batch_id, 2) AS INT) % 4 = 1 THEN '+c' ELSE '' END AS status,
 CAST(CASE WHEN CAST(substr(batch_id, 2) AS INT) % 4 = 0 THEN 4 WHEN CAST(substr(batch_id, 2) AS INT) % 3 = 1 AND CAST(substr(batch_id, 2) AS INT) % 4 = 1 THEN 3 WHEN CAST(substr(batch_id, 2) AS INT) % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM v_units""")
def concurrent_state_writers(v):
    """Three writers of one version: the second meets no batch of the first, the third does and has to read again."""
    number = F.substring("batch_id", 2, 9).cast("int")
    store = writers.state_store(v.spark, scratch_folder(v.spark, "state"), "batch_id string, unit_key string, status string", settle=0.05)
    started = F.when(F.col("status") == "pending", "running").otherwise(F.col("status"))
    store.update(lambda _: v.units.select("batch_id", "unit_key", started.alias("status")))

    def marked(rows, mine, mark):
        return rows.where(mine).withColumn("status", F.concat("status", F.lit(mark))).drop("version")

    mine = {"+a": number % 3 == 0, "+c": (number % 3 == 1) & (number % 4 == 1), "+b": number % 4 == 0}
    seen = store.read(1)
    attempts = {mark: store.propose(marked(seen, which, mark)) for mark, which in mine.items()}
    for mark, attempt in attempts.items():
        try:
            store.commit(attempt, 1)
        except Conflict:
            store.update(lambda rows, mark=mark: marked(rows, mine[mark], mark))
    return store.read()


@query("read_diagnostics", "diagnostics", oracle=r"""
, s AS (SELECT path, raw, regexp_extract_all(raw, '## ([^#]+) ##\n((?:[^#]|\n)*?)(?:\n\n|\n$|$)', 1) AS t FROM v_diagnostics)
SELECT path, regexp_extract(raw, '^# preempt diagnostics for (shard [0-9]+)', 1) AS unit, regexp_extract(raw, '# instance_id: (i[0-9]+)', 1) AS instance_id, '20240101T000000Z' AS captured_at, CAST(i AS INT) AS pos,
 CASE i WHEN 0 THEN 'worker.log (full)' WHEN 1 THEN 'worker.exitcode' ELSE 'dmesg tail' END AS section,
 CASE i WHEN 0 THEN regexp_extract(raw, '\(full\) ##\n(step [0-9]+\n[^\n]*)', 1) WHEN 1 THEN regexp_extract(raw, 'exitcode ##\n([^\n]*)', 1) ELSE regexp_extract(raw, 'tail ##\n([^\n]*)', 1) END AS body FROM (SELECT *, unnest(range(3)) AS i FROM s)""")
def read_diagnostics(v):
    return readers.parse_diagnostics(v.diagnostics)


@query("collect_outputs", "outputs", oracle="SELECT batch_id, CAST(sum(octet_length(encode(rel_path)) + 1) AS BIGINT) AS bytes, count(*) AS lines FROM v_outputs GROUP BY batch_id")
def collect_outputs(v):
    """The outputs as many small files of a folder tree, collected with their content."""
    folder = scratch_folder(v.spark, "outputs")
    shard = F.crc32(F.col("rel_path").cast("binary")) % 25
    v.outputs.select(F.col("rel_path").alias("value"), "batch_id", shard.alias("shard")).repartition("batch_id").write.partitionBy("batch_id", "shard").text(folder)
    files = readers.collect_outputs(v.spark, folder, "*.txt")
    batch = F.regexp_extract("rel_path", r"\Abatch_id=([^/]*)/", 1).alias("batch_id")
    lines = F.regexp_count(F.decode("content", "UTF-8"), F.lit("\n"))
    return files.groupBy(batch).agg(F.sum("size").alias("bytes"), F.sum(lines).alias("lines"))


@query("collect_output_lines", "outputs", oracle="SELECT batch_id, rel_path AS line FROM v_outputs")
def collect_output_lines(v):
    """Lines of output files, one file per batch, that are read in ranges."""
    folder = scratch_folder(v.spark, "outputs")
    v.outputs.select(F.col("rel_path").alias("value"), "batch_id").repartition("batch_id").write.partitionBy("batch_id").text(folder)
    return readers.collect_lines(v.spark, folder, "*.txt").select(F.regexp_extract("rel_path", r"\Abatch_id=([^/]*)/", 1).alias("batch_id"), "line")


@query("run_workload", "items", oracle="""
, s AS (SELECT batch_id, CAST(substr(item_id, 2) AS BIGINT) % 8 AS shard_id, item_id FROM v_items)
SELECT batch_id, shard_id, CASE WHEN shard_id = 3 THEN 1 WHEN shard_id = 5 THEN 3 WHEN bool_or(item_id = 'p17') THEN 1 WHEN bool_or(item_id = 'p23') THEN -9 ELSE 0 END AS exit_code, CASE WHEN shard_id IN (3, 5) THEN 0 ELSE count(*) END AS items,
 CASE WHEN shard_id = 3 THEN 'GPU unhealthy' WHEN shard_id = 5 THEN 'preflight gate closed' WHEN bool_or(item_id = 'p17') THEN 'ValueError: poisoned item' ELSE '' END AS error, shard_id NOT IN (3, 5) AND NOT bool_or(item_id IN ('p17', 'p23')) AS completed FROM s GROUP BY batch_id, shard_id""")
def run_workload_query(v):
    items = v.items.withColumn("shard_id", F.substr("item_id", F.lit(2)).cast("bigint") % 8)
    shards = items.select("batch_id", "shard_id").distinct()

    def work(block):
        if (block["item_id"] == "p17").any():
            raise ValueError("poisoned item")
        return -9 if (block["item_id"] == "p23").any() else 0

    return run_workload(
        items,
        work,
        health=shards.withColumn("healthy", F.col("shard_id") != 3),
        gates=shards.withColumn("open", F.col("shard_id") != 5),
        block_rows=5_000,
    )
