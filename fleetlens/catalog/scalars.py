"""Queries over the scalar functions."""

from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.functions import fmt, gpu, image, json_values, keys, prefixes, scope
from fleetlens.operators import planning

# The public grammar of image references.
LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
PORT = ":(?:[1-9][0-9]{0,3}|[1-5][0-9]{4}|6[0-4][0-9]{3})"
PART = "[a-z0-9]+(?:(?:[._]|__|-+)[a-z0-9]+)*"
REPO = rf"(?:(?:localhost(?:{PORT})?|{LABEL}(?:\.{LABEL})+(?:{PORT})?|{LABEL}{PORT}|\[::1\](?:{PORT})?)/)?{PART}(?:/{PART})*"


def repository_cte(src: str, column: str) -> str:
    """CTE chain ending in ``rp`` that adds ``repository`` to the rows of ``src``."""
    return rf"""im AS (SELECT *, trim({column}) AS r, regexp_extract(trim({column}), '^([^@]*?)(?::([^/:@]*))?(?:@([^@]*))?$', ['repo', 'tag', 'digest']) AS g FROM {src}),
 rp AS (SELECT *, CASE WHEN r <> '' AND NOT regexp_matches(r, '\s') AND length(r) - length(replace(r, '@', '')) <= 1 AND regexp_full_match(g.repo, '{REPO}')
   AND (regexp_full_match(g.tag, '[A-Za-z0-9_][A-Za-z0-9_.-]{{0,127}}') OR (g.tag = '' AND substr(r, length(g.repo) + 1, 1) <> ':'))
   AND (NOT contains(r, '@') OR CASE WHEN starts_with(g.digest, 'sha256:') THEN regexp_full_match(g.digest, 'sha256:[0-9a-f]{{64}}')
     ELSE regexp_full_match(g.digest, '[a-z0-9]+(?:[+._-][a-z0-9]+)*:[A-Za-z0-9=_-]+') END)
   THEN g.repo ELSE '' END AS repository FROM im)"""


@query("image_repository", "images", oracle=f", {repository_cte('v_images', 'image')} SELECT row_id, repository FROM rp")
def image_repository(v):
    return v.images.select("row_id", image.image_repository(F.col("image")).alias("repository"))


@query("canonical_prefix", "raw_prefixes", oracle="""
SELECT page_id, CASE WHEN trim(raw_prefix) IN ('', '/', '//') THEN NULL ELSE regexp_replace(ltrim(regexp_replace(trim(raw_prefix), '/+', '/', 'g'), '/'), '/?$', '/') END AS prefix,
  CASE trim(raw_prefix) WHEN '' THEN 'prefix must not be empty' WHEN '/' THEN 'bucket-wide rules are not supported' WHEN '//' THEN 'prefix has no segment' ELSE '' END AS error FROM v_raw_prefixes""")
def canonical_prefix(v):
    raw = F.col("raw_prefix")
    error = F.coalesce(prefixes.prefix_error(raw), F.lit(""))
    return v.raw_prefixes.select("page_id", prefixes.canonical_prefix(raw).alias("prefix"), error.alias("error"))


@query("managed_rule_id", "raw_prefixes", oracle="""
SELECT page_id, 'fleetlens-expire-' || substr(sha256(bucket || chr(0) || trim(raw_prefix)), 1, 12) AS rule_id FROM v_raw_prefixes""")
def managed_rule_id(v):
    return v.raw_prefixes.select("page_id", prefixes.managed_rule_id(F.col("bucket"), F.trim("raw_prefix")).alias("rule_id"))


@query("label_scope_checks", "scopes", oracle="""
SELECT row_id, requested <> '' AND requested = trim(requested) AS prefix_ok, coalesce(scope LIKE requested || '-%' AND regexp_full_match(substr(scope, length(requested) + 2), '[0-9a-f]{12}'), false) AS scope_ok,
  coalesce(regexp_matches(scope, '(^|-)[0-9a-f]{12}$'), false) AS cleanup_ok FROM v_scopes""")
def label_scope_checks(v):
    requested, text = F.col("requested"), F.col("scope")
    return v.scopes.select(
        "row_id",
        scope.valid_label_prefix(requested).alias("prefix_ok"),
        scope.valid_scope(text, requested).alias("scope_ok"),
        scope.valid_cleanup_scope(text).alias("cleanup_ok"),
    )


@query("recover_prefix", "scopes", oracle="SELECT row_id, regexp_replace(scope, '-[0-9a-f]{12}$', '') AS prefix FROM v_scopes")
def recover_prefix(v):
    return v.scopes.select("row_id", scope.recover_prefix(F.col("scope")).alias("prefix"))


@query("resolve_scope", "scopes", oracle="""
, e AS (SELECT *, substr(md5(CAST(row_id AS VARCHAR)), 1, 12) AS fresh, requested <> '' AND requested = trim(requested) AS ok,
  scope IS NULL AND stored IS NULL AS is_new FROM v_scopes),
 r AS (SELECT *, CASE WHEN is_new THEN CASE WHEN NOT ok THEN 'invalid label prefix' ELSE '' END WHEN scope IS NULL OR stored IS NULL THEN 'partial label identity' WHEN NOT ok THEN 'invalid label prefix'
  WHEN stored <> requested THEN 'prefix mismatch' WHEN NOT (starts_with(scope, stored || '-') AND regexp_full_match(substr(scope, length(stored) + 2), '[0-9a-f]{12}')) THEN 'malformed scope' ELSE '' END AS error FROM e)
SELECT row_id, CASE WHEN error <> '' THEN 'error' WHEN is_new THEN 'new' ELSE 'reuse' END AS action, CASE WHEN error <> '' THEN NULL WHEN is_new THEN requested || '-' || fresh ELSE scope END AS scope, error FROM r""")
def resolve_scope(v):
    suffix = F.substring(F.md5(F.col("row_id").cast("string")), 1, 12)
    resolved = scope.resolve_scope(F.col("requested"), F.col("scope"), F.col("stored"), suffix)
    return v.scopes.select("row_id", resolved.alias("r")).select("row_id", "r.action", "r.scope", "r.error")


@query("format_hours", "workloads", oracle="""
SELECT workload_id, CASE WHEN work_hours >= 1 THEN CAST(CAST(floor(work_hours) AS INT) AS VARCHAR) || 'h ' || lpad(CAST(CAST(floor((work_hours - floor(work_hours)) * 60) AS INT) AS VARCHAR), 2, '0') || 'm'
  ELSE CAST(CAST(floor(work_hours * 60) AS INT) AS VARCHAR) || 'm' END AS text FROM (SELECT workload_id, work_hours / (1 + workload_id % 15) AS work_hours FROM v_workloads)""")
def format_hours(v):
    return v.workloads.select("workload_id", fmt.hours_text(F.col("work_hours") / (1 + F.col("workload_id") % 15)).alias("text"))


@query("cost_display", "workloads", oracle="""
SELECT workload_id, CASE WHEN cloud_gpus = 0 THEN '$0.00' WHEN total_items % 3 = 0 THEN '$' || CAST(total_items AS VARCHAR) || '.00' ELSE '$' || CAST(total_items AS VARCHAR) || '.00-$' || CAST(total_items + total_items % 3 AS VARCHAR) || '.00' END AS text FROM v_workloads""")
def cost_display(v):
    low = F.col("total_items").cast("double")
    return v.workloads.select("workload_id", fmt.cost_text(F.col("cloud_gpus"), low, low + F.col("total_items") % 3).alias("text"))


@query("json_coercions", "instances_raw", oracle="""
, j AS (SELECT row_id, CASE WHEN json_valid(raw_json) THEN raw_json::JSON END AS j FROM v_instances_raw)
SELECT row_id, CASE WHEN json_type(j, '$.label') = 'VARCHAR' THEN json_extract_string(j, '$.label') ELSE '' END AS label,
  CASE WHEN json_type(j, '$.dph_total') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(json_extract_string(j, '$.dph_total') AS DOUBLE) ELSE 0 END AS dph FROM j""")
def json_coercions(v):
    record = json_values.parse(F.col("raw_json"))
    return v.instances_raw.select(
        "row_id",
        json_values.string_or_empty(json_values.field(record, "label")).alias("label"),
        json_values.float_or_zero(json_values.field(record, "dph_total")).alias("dph"),
    )


@query("telemetry_numbers", "gpu_telemetry", oracle=r"""
SELECT event_id, CASE WHEN regexp_full_match(trim(split_part(csv_line, ',', 1)), '\d+') THEN CAST(trim(split_part(csv_line, ',', 1)) AS BIGINT) ELSE 0 END AS temp,
  CASE WHEN regexp_full_match(trim(split_part(csv_line, ',', 3)), '\d+') THEN CAST(trim(split_part(csv_line, ',', 3)) AS BIGINT) ELSE 0 END AS ecc FROM v_gpu_telemetry""")
def telemetry_numbers(v):
    parts = F.split("csv_line", ",")
    return v.gpu_telemetry.select(
        "event_id",
        gpu.safe_int(F.get(parts, F.lit(0))).alias("temp"),
        gpu.ecc_count(F.coalesce(F.get(parts, F.lit(2)), F.lit(""))).alias("ecc"),
    )


@query("object_keys", "units", oracle="""
SELECT unit_key, 'project/batches/' || batch_id || '/shard_' || shard_id || '/' AS shard, 'project/batches/' || batch_id || '/job' || shard_id || '/' AS job, 'project/batches/' || batch_id || '/shard_' || shard_id || '/markers/p' || unit_key || '.done' AS marker,
  'project/batches/' || batch_id || '/global_markers/p' || unit_key || '.done' AS global_marker, 'x/traj_chunk_' || CASE WHEN shard_id < 1000 THEN lpad(CAST(shard_id AS VARCHAR), 3, '0') ELSE CAST(shard_id AS VARCHAR) END || '.xtc' AS chunk FROM v_units""")
def object_keys(v):
    root, batch, shard = F.lit("project/batches"), F.col("batch_id"), F.col("shard_id")
    item = F.concat(F.lit("p"), F.col("unit_key"))
    return v.units.select(
        "unit_key",
        keys.shard_prefix(root, batch, shard).alias("shard"),
        keys.job_prefix(root, batch, F.concat(F.lit("job"), shard.cast("string"))).alias("job"),
        keys.marker_key(root, batch, shard, item).alias("marker"),
        keys.global_marker_key(root, batch, item).alias("global_marker"),
        keys.chunk_key(F.lit("x/"), shard, stem="traj", ext=".xtc").alias("chunk"),
    )


@query("owned_images_from_flag", "images", oracle="""
SELECT row_id, CASE WHEN row_id % 7 = 0 THEN NULL ELSE array_to_string(list_filter([trim(image), 'x', trim('  ')], lambda x: x <> ''), '|') END AS owned FROM v_images""")
def owned_images_from_flag(v):
    flag = F.when(F.col("row_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat("image", F.lit(", x ,  ")))
    return v.images.select("row_id", F.array_join(image.images_from_flag(flag), "|").alias("owned"))


@query("prefixes_overlap", "rules", oracle="SELECT bucket, pos, starts_with(prefix, 'project/batches') OR starts_with('project/batches', prefix) AS overlaps FROM v_rules")
def prefixes_overlap(v):
    overlap = prefixes.prefixes_overlap(F.col("prefix"), F.lit("project/batches"))
    return v.rules.select("bucket", "pos", overlap.alias("overlaps"))


@query("runtime_hours", "jobs", oracle="""
, t AS (SELECT *, CASE WHEN submit_time <> '' THEN epoch_us(CAST(submit_time || CASE WHEN length(submit_time) = 19 THEN '+00:00' ELSE '' END AS TIMESTAMPTZ)) END AS s, CASE WHEN complete_time <> '' THEN epoch_us(CAST(complete_time AS TIMESTAMPTZ)) ELSE epoch_us(TIMESTAMPTZ '2003-01-01 00:00:00+00') END AS e FROM v_jobs)
SELECT batch_id, unit_key, CASE WHEN submit_time = '' THEN 0 ELSE (e - s) / CAST(3.6e9 AS DOUBLE) END AS hours FROM t""")
def runtime_hours(v):
    hours = fmt.runtime_hours(F.col("submit_time"), F.col("complete_time"), F.lit("2003-01-01T00:00:00+00:00"))
    return v.jobs.select("batch_id", "unit_key", hours.alias("hours"))


@query("foreign_rule_warning", "rules", oracle="""
SELECT bucket, pos, 'rule ''' || id || ''' of prefix ''' || prefix || ''' overlaps and may expire objects first' AS warning FROM v_rules""")
def foreign_rule_warning(v):
    return v.rules.select("bucket", "pos", prefixes.foreign_rule_warning(F.col("id"), F.col("prefix")).alias("warning"))


@query("explode_shard_sizes", "workloads", oracle="""
SELECT workload_id, CAST(i AS INT) AS shard, CAST(total_items // (cloud_gpus + 1) + CASE WHEN i < total_items % (cloud_gpus + 1) THEN 1 ELSE 0 END AS INT) AS size
FROM (SELECT *, unnest(range(cloud_gpus + 1)) AS i FROM v_workloads)""")
def explode_shard_sizes(v):
    sizes = planning.shard_sizes(F.col("total_items"), F.col("cloud_gpus") + 1)
    return v.workloads.select("workload_id", F.posexplode(sizes).alias("shard", "size"))


@query("time_stamps", "unit_events", oracle="""
SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS suffix, epoch_us(ts) // 1000 AS millis, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso FROM v_unit_events""")
def time_stamps(v):
    ts = F.col("ts")
    return v.unit_events.select(
        "event_id",
        fmt.archive_suffix(ts).alias("suffix"),
        fmt.epoch_millis(ts).alias("millis"),
        fmt.iso_text(ts).alias("iso"),
    )


@query("destroy_description", "outcomes", oracle="""
SELECT row_id, 'verdict=' || coalesce(verdict, 'none') || ', refusal=' || coalesce(refusal, 'none') || ', attempts=' || attempts || ', last_status_code=none, verify_error=' || CASE WHEN error = '' THEN 'none' ELSE error END || ', stop_error=none' AS text FROM v_outcomes""")
def destroy_description(v):
    none = F.lit(None).cast("string")
    text = fmt.destroy_text(
        F.col("verdict"), F.col("refusal"), F.col("attempts"), none, F.nullif("error", F.lit("")), none
    )
    return v.outcomes.select("row_id", text.alias("text"))
