"""Queries over retention rules."""

from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.operators import lifecycle as L
from fleetlens.session import scratch_folder
from fleetlens.sources.writers import rule_store, rule_writes

WANTED = """w AS (SELECT bucket, 'project/batches/' AS canonical_prefix, 'fleetlens-expire-' || substr(sha256(bucket || chr(0) || 'project/batches/'), 1, 12) AS rule_id, CAST(days_json AS INT) AS days FROM v_policies)"""
TEXT = "CAST(to_json({'id': id, 'status': status, 'prefix': prefix, 'days': CAST(days AS BIGINT), 'extra': extra}) AS VARCHAR)"


def prints(src, name="fp"):
    hashed = f"sha256(concat_ws('|', CAST(pos AS VARCHAR), {TEXT}))"
    sums = ", ".join(f"sum(CAST(('0x' || substr({hashed}, {1 + 15 * i}, 15)) AS BIGINT)) AS p{i}" for i in range(4))
    return f"""{name} AS (SELECT bucket, rules, substr(sha256(concat_ws('|', rules, p0, p1, p2, p3)), 1, 16) AS fingerprint FROM (SELECT bucket, count(*) AS rules, {sums} FROM {src} GROUP BY bucket))"""


OVERLAP = """ov AS (SELECT w.bucket, w.canonical_prefix, r.pos, r.id AS foreign_id, r.prefix AS foreign_prefix FROM w JOIN v_rules r USING (bucket)
 WHERE r.prefix <> '' AND NOT starts_with(r.id, 'fleetlens-') AND (starts_with(r.prefix, 'project/batches') OR starts_with('project/batches', r.prefix)))"""
AFTER = """af0 AS (SELECT r.bucket, r.pos, r.id, r.status, r.prefix, r.days, r.extra FROM v_rules r WHERE NOT EXISTS (FROM w WHERE w.bucket = r.bucket AND w.rule_id = r.id) {new}),
 af AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY bucket ORDER BY pos, id) - 1 AS INT) AS pos) FROM af0)"""
APPLY = AFTER.format(new="UNION ALL SELECT bucket, 99, rule_id, 'Enabled', canonical_prefix, days, '{}' FROM w")
REMOVE = AFTER.format(new="")
DIFF = f"""df AS (SELECT bucket, pos, b.t AS before_rule, a.t AS after_rule, CASE WHEN b.t IS NULL THEN 'added' WHEN a.t IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM (SELECT bucket, pos, {TEXT} AS t FROM v_rules) b FULL JOIN (SELECT bucket, pos, {TEXT} AS t FROM af) a USING (bucket, pos) WHERE b.t IS DISTINCT FROM a.t)"""


def policies(v):
    return v.policies.withColumn("days", F.col("days_json").cast("int"))


@query("read_lifecycle_rules", "rule_docs", oracle="""
, r AS (SELECT bucket, CAST(i AS INT) AS pos, json_extract(raw, '$.Rules[' || i || ']') AS r FROM (SELECT *, unnest(range(CAST(coalesce(json_array_length(CASE WHEN json_type(raw) = 'OBJECT' THEN json_extract(raw, '$.Rules') END), 0) AS BIGINT))) AS i FROM v_rule_docs))
SELECT bucket, pos, coalesce(json_extract_string(r, '$.ID'), '') AS id, json_extract_string(r, '$.Status') AS status, coalesce(CASE WHEN json_type(r, '$.Filter') = 'OBJECT' THEN json_extract_string(r, '$.Filter.Prefix') END, '') AS prefix,
 TRY_CAST(CASE WHEN json_type(r, '$.Expiration.Days') IN ('UBIGINT', 'BIGINT') THEN json_extract_string(r, '$.Expiration.Days') END AS BIGINT) AS days,
 '{' || array_to_string(list_sort(list_concat(
  list_transform(list_filter(json_keys(r), lambda k: NOT ((k IN ('ID', 'Status') AND json_type(r, '$.' || k) = 'VARCHAR') OR (k IN ('Filter', 'Expiration') AND json_type(r, '$.' || k) = 'OBJECT'))), lambda k: '"' || k || '":' || CAST(json_extract(r, '$.' || k) AS VARCHAR)),
  CASE WHEN json_type(r, '$.Expiration') = 'OBJECT' AND len(list_filter(json_keys(r, '$.Expiration'), lambda k: k <> 'Days')) > 0 THEN ['"Expiration":{' || array_to_string(list_transform(list_filter(json_keys(r, '$.Expiration'), lambda k: k <> 'Days'), lambda k: '"' || k || '":' || CAST(json_extract(r, '$.Expiration.' || k) AS VARCHAR)), ',') || '}'] ELSE [] END)), ',') || '}' AS extra FROM r""")
def read_lifecycle_rules(v):
    return L.parse_rules(v.rule_docs)


@query("rules_fingerprint", "rules", oracle=f", {prints('v_rules')} SELECT * FROM fp")
def rules_fingerprint(v):
    return L.fingerprints(v.rules)


@query("overlapping_rules", "rules", "policies", oracle=f""", {WANTED}, {OVERLAP} SELECT *, 'rule ''' || foreign_id || ''' of prefix ''' || foreign_prefix || ''' overlaps and may expire objects first' AS warning FROM ov""")
def overlapping_rules(v):
    return L.overlapping_rules(v.rules, policies(v))


@query("lifecycle_collisions", "rules", "policies", oracle=f", {WANTED} SELECT bucket, rule_id, r.pos, r.prefix, CASE WHEN r.days IS NULL THEN 'no Expiration.Days' ELSE 'bound to another prefix' END AS collision FROM w JOIN v_rules r USING (bucket) WHERE r.id = rule_id AND (r.days IS NULL OR r.prefix <> canonical_prefix)")
def lifecycle_collisions(v):
    return L.collisions(v.rules, policies(v))


PLAN = """SELECT w.bucket, w.canonical_prefix, w.rule_id, '{op}' AS operation, coalesce(fp.rules, 0) AS before_rules, (SELECT count(*) FROM af WHERE af.bucket = w.bucket) AS after_rules,
 NOT EXISTS (FROM df WHERE df.bucket = w.bucket) AS no_op, coalesce(fp.fingerprint, substr(sha256('0'), 1, 16)) AS source_fingerprint, {warn} AS warnings,
 EXISTS (FROM v_rules r WHERE r.bucket = w.bucket AND r.id = w.rule_id AND (r.days IS NULL OR r.prefix <> w.canonical_prefix)) AS collision FROM w LEFT JOIN fp ON fp.bucket = w.bucket"""


@query("lifecycle_plan", "rules", "policies", oracle=f", {WANTED}, {OVERLAP}, {APPLY}, {DIFF}, {prints('v_rules')} " + PLAN.format(op="apply", warn="(SELECT count(*) FROM ov WHERE ov.bucket = w.bucket)"))
def lifecycle_plan(v):
    return L.lifecycle_plan(v.rules, policies(v))


@query("lifecycle_plan_remove", "rules", "policies", oracle=f", {WANTED}, {REMOVE}, {DIFF}, {prints('v_rules')} " + PLAN.format(op="remove", warn="CAST(0 AS BIGINT)"))
def lifecycle_plan_remove(v):
    return L.lifecycle_plan(v.rules, policies(v), operation="remove")


@query("rules_after", "rules", "policies", oracle=f", {WANTED}, {APPLY} SELECT * FROM af")
def rules_after(v):
    return L.rules_after(v.rules, policies(v))


@query("write_lifecycle_rules", "rules", "policies", oracle=f", {WANTED}, {REMOVE} SELECT bucket, (SELECT count(*) FROM af WHERE af.bucket = b.bucket) AS rules, CASE WHEN NOT EXISTS (FROM af WHERE af.bucket = b.bucket) THEN 'delete' ELSE 'put' END AS action FROM (SELECT DISTINCT bucket FROM v_rules) b")
def write_lifecycle_rules(v):
    """Rule sets before and after as two versions of one store, and what is read back."""
    store = rule_store(v.spark, scratch_folder(v.spark, "rules"), settle=0.05)
    first = store.commit(store.propose(v.rules.select(*L.RULE)), 0)
    before = store.read(first).drop("version")
    after = L.rules_after(before, policies(v), operation="remove")
    second = store.commit(store.propose(after, v.rules.select("bucket")), first)
    return rule_writes(store.read(first), store.read(second))


@query("lifecycle_plan_diff", "rules", "policies", oracle=f", {WANTED}, {APPLY}, {DIFF} SELECT * FROM df")
def lifecycle_plan_diff(v):
    return L.plan_diff(v.rules, L.rules_after(v.rules, policies(v)))


@query("rules_equal", "rules", "policies", oracle=f", {WANTED}, {APPLY}, {DIFF} SELECT DISTINCT bucket, bucket NOT IN (SELECT bucket FROM df) AS equal FROM v_rules")
def rules_equal(v):
    return L.rules_equal(v.rules, L.rules_after(v.rules, policies(v)))


@query("lifecycle_policy_check", "policy_inputs", oracle="""
SELECT row_id, CASE WHEN trim(bucket) = '' THEN 'bucket must be a non-empty string' WHEN NOT regexp_full_match(days_json, '-?[0-9]+') THEN 'expire_after_days must be an integer' WHEN CAST(days_json AS INT) < 1 THEN 'expire_after_days must be >= 1' ELSE '' END AS error
FROM (SELECT row_id, bucket, CASE WHEN regexp_full_match(days_json, '-?[0-9]+') THEN days_json ELSE 'x' END AS days_json FROM v_policy_inputs) WHERE true""".replace("CAST(days_json AS INT)", "TRY_CAST(days_json AS INT)"))
def lifecycle_policy_check(v):
    return v.policy_inputs.select("row_id", L.policy_error(F.col("bucket"), F.col("days_json")).alias("error"))


@query("plan_freshness", "rules_then", "rules_now", "policies", oracle=f""", {prints('v_rules_then', 'a')}, {prints('v_rules_now', 'b')}
SELECT a.bucket, b.fingerprint IS NOT NULL AND a.fingerprint = b.fingerprint AS fresh FROM a LEFT JOIN b USING (bucket) WHERE bucket IN (SELECT bucket FROM v_policies)""")
def plan_freshness(v):
    plans = L.lifecycle_plan(v.rules_then, policies(v))
    return L.plan_freshness(plans, v.rules_now).select("bucket", "fresh")


@query("post_write_check", "rules_then", "rules_now", oracle=f"""
SELECT bucket, count(*) FILTER (x.t IS DISTINCT FROM y.t) = 0 AS verified FROM (SELECT bucket, pos, {TEXT} AS t FROM v_rules_then) x FULL JOIN (SELECT bucket, pos, {TEXT} AS t FROM v_rules_now) y USING (bucket, pos) GROUP BY bucket""")
def post_write_check(v):
    return L.post_write_check(v.rules_then, v.rules_now)


@query("managed_rule_lookup", "rules", "policies", oracle=f""", {WANTED}, {prints('v_rules')}
SELECT w.bucket, canonical_prefix, w.rule_id, CASE WHEN r.id IS NULL THEN 'not configured' ELSE 'configured' END AS status, r.status AS rule_status, r.days, coalesce(fp.rules, 0) AS rules, coalesce(fp.fingerprint, substr(sha256('0'), 1, 16)) AS fingerprint
FROM w LEFT JOIN v_rules r ON r.bucket = w.bucket AND r.id = w.rule_id LEFT JOIN fp ON fp.bucket = w.bucket""")
def managed_rule_lookup(v):
    return L.managed_rule_lookup(v.rules, policies(v))
