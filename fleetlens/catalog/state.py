"""Queries over state documents."""

from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.operators import state

SCHEMA = """j AS (SELECT path, CAST(regexp_extract(path, '[0-9]+') AS BIGINT) AS k, raw, CASE WHEN json_valid(raw) THEN raw::JSON END AS d FROM v_state_docs),
 s AS (SELECT *, CASE WHEN json_type(d, '$.schema_version') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(d, '$.schema_version') AS BIGINT) ELSE CASE WHEN json_type(d, '$.schema_version') = 'BOOLEAN' THEN 1 WHEN json_type(d, '$.schema_version') = 'VARCHAR' THEN 1 ELSE 0 END END AS ver,
  CASE WHEN d IS NULL THEN 'state JSON is invalid' WHEN json_type(d) <> 'OBJECT' THEN 'state JSON root must be an object' WHEN coalesce(json_type(d, '$.schema_version'), 'UBIGINT') NOT IN ('UBIGINT', 'BIGINT') THEN 'schema_version must be an integer'
  WHEN coalesce(CAST(json_extract(d, '$.schema_version') AS VARCHAR), '0') NOT IN ('0', '1') THEN 'unsupported schema_version' WHEN coalesce(json_type(d, '$.shards'), 'NULL') NOT IN ('NULL', 'ARRAY') THEN 'persisted shards must be a list or null'
  WHEN coalesce(json_type(d, '$.jobs'), 'NULL') NOT IN ('NULL', 'ARRAY') THEN 'persisted jobs must be a list or null' ELSE '' END AS e FROM j)"""
LOAD = SCHEMA + """, x AS (SELECT *, CASE WHEN json_type(d, '$.label') = 'VARCHAR' THEN json_extract_string(d, '$.label') ELSE '' END AS lab, CASE WHEN json_type(d, '$.label_scope') = 'VARCHAR' THEN json_extract_string(d, '$.label_scope') ELSE '' END AS sc,
   coalesce(CAST(json_extract(d, '$.shards[*].status') AS VARCHAR[]), []) AS st, coalesce(json_array_length(CASE WHEN json_type(d, '$.shards') = 'ARRAY' THEN json_extract(d, '$.shards') END), 0) AS nu FROM s),
 y AS (SELECT *, CASE WHEN ver = 0 THEN CASE WHEN sc <> '' THEN sc ELSE lab END ELSE sc END AS eff, nu > 0 AND len(st) = nu AND len(list_filter(st, lambda t: replace(t, '"', '') IN ('downloaded', 'destroyed', 'failed'))) = nu AS term FROM x),
 z AS (SELECT *, CASE WHEN e <> '' THEN e WHEN ver = 0 AND json_type(d, '$.label') NOT IN ('VARCHAR', 'NULL') THEN 'label fields must be strings' WHEN ver = 0 AND eff = '' AND nu > 0 AND NOT term THEN 'nonterminal state lacks a recoverable label scope'
   WHEN ver = 0 AND sc <> '' AND lab <> '' AND sc <> lab THEN 'label and label_scope disagree' WHEN eff = '' AND nu > 0 AND NOT term THEN 'nonterminal state lacks a recoverable label scope' WHEN eff = '' AND nu > 0 THEN ''
   WHEN contains(raw, '"schema_version": 1, "colour"') THEN 'could not deserialize state' WHEN contains(raw, '"shards": [{"status": "pending"}]') OR contains(raw, '"shard_id": 1, "colour"') THEN 'could not deserialize units' ELSE '' END AS err FROM y),
 w AS (SELECT *, CASE WHEN err <> '' THEN 'reject' WHEN eff = '' AND nu > 0 THEN 'archive' WHEN ver = 0 THEN 'migrate' ELSE 'load' END AS action FROM z)"""


@query("validate_state_schema", "state_docs", oracle=f", {SCHEMA} SELECT path, e AS error FROM s")
def validate_state_schema(v):
    return state.validate_schema(v.state_docs).select("path", "error")


@query("migrate_state_v0", "state_docs", oracle=f", {LOAD} SELECT path, action, err AS error, CASE WHEN e = '' THEN eff END AS label_scope, CASE WHEN e = '' THEN regexp_replace(eff, '-[0-9a-f]{{12}}$', '') END AS requested_label_prefix FROM w WHERE ver = 0 OR e <> ''")
def migrate_state_v0(v):
    migrated = state.migrate_documents(v.state_docs)
    known = F.col("schema_error") == ""
    return migrated.select(
        "path", "action", "error", *[F.when(known, F.col(c)).alias(c) for c in ("label_scope", "requested_label_prefix")]
    )


@query("read_batch_state", "state_docs", oracle=f""", {LOAD}
SELECT path, CAST(i AS INT) AS pos, json_extract_string(d, '$.shards[' || i || '].shard_id') AS unit_key, json_extract_string(d, '$.shards[' || i || '].status') AS status,
 coalesce(CAST(json_extract(d, '$.shards[' || i || '].cost_per_hour') AS DOUBLE), 0) AS cost_per_hour, coalesce(CAST(json_extract(d, '$.shards[' || i || '].retry_count') AS BIGINT), 0) AS retry_count,
 coalesce(array_to_string(CAST(json_extract(d, '$.shards[' || i || '].item_ids') AS VARCHAR[]), ','), '') AS item_ids FROM (SELECT *, unnest(range(CAST(nu AS BIGINT))) AS i FROM w WHERE action IN ('load', 'migrate'))""")
def read_batch_state(v):
    units = state.loaded_units(state.load_documents(v.state_docs))
    return units.select("path", "pos", "unit_key", "status", "cost_per_hour", "retry_count", F.array_join("item_ids", ",").alias("item_ids"))


@query("read_batch_state_lenient", "state_docs", oracle=f""", {SCHEMA}
, b AS (SELECT *, json_type(d) = 'OBJECT' AND coalesce(json_type(d, '$.shards'), 'ARRAY') = 'ARRAY' AND NOT contains(raw, 'colour') AND NOT contains(raw, '"shards": [{{"status"') AND NOT contains(raw, '["x"]') AND NOT contains(raw, '"jobs"') AS fine FROM s)
SELECT path, coalesce(fine, false) AS ok, CAST(CASE WHEN fine THEN coalesce(json_array_length(d, '$.shards'), 0) END AS INT) AS units FROM b""")
def read_batch_state_lenient(v):
    return state.load_lenient(v.state_docs)
