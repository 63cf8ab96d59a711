"""Queries over instance listings and cleanup decisions."""

from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.catalog.scalars import repository_cte
from fleetlens.functions import json_values as J
from fleetlens.operators import chains, cleanup, fleet
from fleetlens.plans.cleanup import cleanup_report
from fleetlens.plans.sweep import sweep, sweep_totals
from fleetlens.session import scratch_folder
from fleetlens.streaming import replay
from fleetlens.streaming.sweep import start_sweep

SCOPE = "prod-e4da3b7fbbce"
NORMAL = """n0 AS (SELECT row_id, listing_id, CASE WHEN json_valid(raw_json) THEN raw_json::JSON END AS j FROM v_instances_raw),
 n1 AS (SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS obj,
   CASE WHEN json_type(j, '$.id') IN ('VARCHAR', 'BIGINT', 'UBIGINT') THEN nullif(trim(json_extract_string(j, '$.id')), '') END AS cid,
   coalesce(json_type(j, '$.image_uuid') = 'VARCHAR', false) AS img_ok, CASE WHEN json_type(j, '$.image_uuid') = 'VARCHAR' THEN json_extract_string(j, '$.image_uuid') ELSE '' END AS image_uuid,
   CASE WHEN json_type(j, '$.label') = 'VARCHAR' THEN json_extract_string(j, '$.label') ELSE '' END AS label,
   CASE WHEN json_type(j, '$.dph_total') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(json_extract_string(j, '$.dph_total') AS DOUBLE) ELSE 0 END AS cost,
   CASE WHEN json_type(j, '$.start_date') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(json_extract_string(j, '$.start_date') AS DOUBLE) ELSE 0 END AS started FROM n0),
 n AS (SELECT *, CASE WHEN NOT obj THEN 'not an object' WHEN cid IS NULL THEN 'invalid id' WHEN cost < 0 THEN 'invalid cost_per_hour' ELSE '' END AS reject FROM n1),
 h AS (SELECT listing_id, CAST(sum(c) AS BIGINT) AS records, CAST(sum(g) AS BIGINT) AS candidates, count(*) FILTER (cid IS NOT NULL AND c > 1) AS duplicate_ids, CAST(sum(b) AS BIGINT) AS malformed
   FROM (SELECT listing_id, cid, count(*) AS c, count(*) FILTER (reject = '') AS g, count(*) FILTER (NOT obj OR cid IS NULL OR NOT img_ok) AS b FROM n GROUP BY ALL) GROUP BY listing_id)"""


def normalized(v):
    return fleet.normalize_records(v.instances_raw, J.parse(F.col("raw_json")))


def own_images(v):
    """Owned images derived from the listing: the plain repository of the first project."""
    return v.instances.where("image_uuid = 'lab/fold:3'").selectExpr("image_uuid AS image").distinct()


@query("read_instances_list", "offer_json", oracle="""
SELECT snapshot_id, CASE WHEN raw = 'not json' THEN 'listing JSON is invalid' WHEN starts_with(raw, '{') THEN 'listing must be a list, got object' ELSE '' END AS error,
 CASE WHEN raw = 'not json' OR starts_with(raw, '{') THEN 0 ELSE CAST(json_array_length(raw) AS INT) END AS records FROM v_offer_json""")
def read_instances_list(v):
    return fleet.list_documents(v.offer_json).select("snapshot_id", "error", F.size("records").alias("records"))


PAGES = """j AS (SELECT *, CASE WHEN json_valid(raw) THEN raw::JSON END AS d FROM v_pages_raw),
 o AS (SELECT *, CASE WHEN json_type(d, '$.next_token') = 'VARCHAR' THEN json_extract_string(d, '$.next_token') END AS nt,
   CASE WHEN coalesce(json_type(d), '') <> 'OBJECT' THEN 'page must be an object' WHEN coalesce(json_type(d, '$.instances'), '') <> 'ARRAY' THEN 'page has no instance list'
   WHEN coalesce(json_type(d, '$.next_token'), 'NULL') NOT IN ('NULL', 'VARCHAR') OR json_extract_string(d, '$.next_token') = '' THEN 'invalid page token' ELSE '' END AS e FROM j),
 l AS (SELECT *, lag(nt) OVER (PARTITION BY listing_id ORDER BY page_no) AS pt, lag(page_no) OVER (PARTITION BY listing_id ORDER BY page_no) AS pp, count(*) OVER (PARTITION BY listing_id, nt) AS same FROM o),
 c AS (SELECT listing_id, count(*) AS pages, arg_min(e, page_no) FILTER (e <> '') AS fe, bool_or(nt IS NOT NULL AND same > 1) AS rep,
   bool_or(CASE WHEN page_no = 0 THEN after_token <> '' ELSE pp IS DISTINCT FROM page_no - 1 OR after_token IS DISTINCT FROM pt END) OR count(*) FILTER (nt IS NULL) <> 1 OR (max({'p': page_no, 't': nt})).t IS NOT NULL AS broken FROM l GROUP BY listing_id),
 verdict AS (SELECT listing_id, pages, CASE WHEN fe IS NOT NULL THEN fe WHEN rep THEN 'invalid page token' WHEN broken THEN 'broken page chain' ELSE '' END AS error FROM c)"""


@query("page_chain", "pages_raw", oracle=f", {PAGES} SELECT listing_id, pages, error, error = '' AS ok FROM verdict")
def page_chain(v):
    return fleet.page_chain(fleet.open_pages(v.pages_raw))


@query("read_instances_paged", "pages_raw", oracle=f""", {PAGES}
SELECT listing_id, page_no, CAST(i AS INT) AS pos, json_extract_string(d, '$.instances[' || i || '].id') AS instance_id
FROM (SELECT o.*, unnest(range(CAST(json_array_length(d, '$.instances') AS BIGINT))) AS i FROM o JOIN verdict USING (listing_id) WHERE error = '')""")
def read_instances_paged(v):
    records = fleet.paged_records(fleet.open_pages(v.pages_raw))
    return records.select("listing_id", "page_no", "pos", J.normalize_id(J.field(F.col("record"), "id")).alias("instance_id"))


TOKEN_PAGES = """j AS (SELECT DISTINCT listing_id, page_no, coalesce(after_token, '') AS tok, raw, CASE WHEN json_valid(raw) THEN raw::JSON END AS d FROM v_token_pages),
 o AS (SELECT *, CASE WHEN json_type(d, '$.next_token') = 'VARCHAR' THEN json_extract_string(d, '$.next_token') END AS nt,
   CASE WHEN coalesce(json_type(d), '') <> 'OBJECT' THEN 'page must be an object' WHEN coalesce(json_type(d, '$.next_token'), 'NULL') NOT IN ('NULL', 'VARCHAR') THEN 'invalid page token' ELSE '' END AS e FROM j),
 k AS (SELECT *, CASE WHEN listing_id < -1 THEN (-2 - listing_id) % 4 END AS made FROM o),
 l AS (SELECT *, CASE WHEN made < 3 THEN page_no < 2 WHEN row_number() OVER w = 1 THEN tok = '' ELSE tok IS NOT DISTINCT FROM lag(nt) OVER w END AS link FROM k WINDOW w AS (PARTITION BY listing_id ORDER BY page_no)),
 c AS (SELECT *, bool_and(link) OVER (PARTITION BY listing_id ORDER BY page_no) AS chained FROM l),
 v AS (SELECT listing_id, any_value(made) AS made, count(*) AS pages, count_if(chained) AS chained, count_if(chained AND nt IS NULL) AS ends,
   arg_min(e, {'u': NOT chained, 'n': CASE WHEN chained THEN page_no ELSE 0 END, 'e': e}) FILTER (e <> '') AS fe FROM c GROUP BY listing_id),
 verdict AS (SELECT listing_id, pages, CAST(chained AS BIGINT) AS chained, CASE WHEN fe IS NOT NULL THEN fe WHEN made IN (0, 2) THEN 'invalid page token' WHEN chained < pages OR ends <> 1 THEN 'broken page chain' ELSE '' END AS error FROM v)"""


@query("token_page_chain", "token_pages", oracle=f", {TOKEN_PAGES} SELECT listing_id, pages, chained, error, error = '' AS ok FROM verdict")
def token_page_chain(v):
    return chains.token_chain(chains.numbered_pages(v.token_pages.drop("page_no")))


@query("token_page_records", "token_pages", oracle=f""", {TOKEN_PAGES}
SELECT listing_id, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY page_no) - 1 AS BIGINT) AS page_no, CAST(0 AS INT) AS pos, json_extract_string(d, '$.instances[0].id') AS instance_id FROM o JOIN verdict USING (listing_id) WHERE error = ''""")
def token_page_records(v):
    records = chains.token_records(chains.numbered_pages(v.token_pages.drop("page_no")))
    return records.select("listing_id", "page_no", "pos", J.normalize_id(J.field(F.col("record"), "id")).alias("instance_id"))


@query("page_concat", "pages_raw", oracle=f""", {PAGES}
SELECT listing_id, CAST(sum(json_array_length(d, '$.instances')) AS BIGINT) AS records FROM o JOIN verdict USING (listing_id) WHERE error = '' GROUP BY listing_id""")
def page_concat(v):
    return fleet.paged_records(fleet.open_pages(v.pages_raw)).groupBy("listing_id").agg(F.count("*").alias("records"))


@query("normalize_instances", "instances_raw", oracle=f", {NORMAL} SELECT row_id, cid AS instance_id, label, image_uuid, cost AS cost_per_hour, started AS started_at, reject FROM n")
def normalize_instances(v):
    return normalized(v).select("row_id", "instance_id", "label", "image_uuid", "cost_per_hour", "started_at", "reject")


@query("normalize_id", "instances_raw", oracle=f", {NORMAL} SELECT row_id, cid AS id FROM n")
def normalize_id(v):
    record = J.parse(F.col("raw_json"))
    return v.instances_raw.select("row_id", J.normalize_id(J.field(record, "id")).alias("id"))


@query("valid_candidate", "instances", oracle="""
, k AS (SELECT *, CAST(instance_id AS BIGINT) AS k FROM v_instances),
 c AS (SELECT instance_id AS key, state, image_uuid, CASE WHEN k % 61 = 0 THEN 'nowhere' ELSE provider END AS provider, CASE WHEN k % 59 = 0 THEN ' ' || instance_id ELSE instance_id END AS id, CASE WHEN k % 47 <> 0 THEN label END AS label,
  CASE WHEN k % 43 = 0 THEN CAST('nan' AS DOUBLE) WHEN k % 53 = 0 THEN CAST('inf' AS DOUBLE) WHEN k % 37 = 0 THEN -1 ELSE cost_per_hour END AS cost, epoch(CAST(started_at AS TIMESTAMP)) AS started FROM k)
SELECT key AS instance_id, CASE WHEN provider IS NULL OR provider NOT IN ('market', 'runpod', 'local') THEN 'unknown provider' WHEN id IS NULL OR id = '' OR id <> trim(id) THEN 'invalid id'
 WHEN label IS NULL OR state IS NULL OR image_uuid IS NULL THEN 'text field is not a string' WHEN cost IS NULL OR isnan(cost) OR isinf(cost) OR cost < 0 THEN 'invalid cost_per_hour' WHEN started IS NULL OR started < 0 THEN 'invalid started_at' ELSE '' END AS error FROM c""")
def valid_candidate(v):
    k = F.col("instance_id").cast("bigint")
    rows = v.instances.withColumns({"_key": F.col("instance_id"), "ownership_key": F.col("image_uuid"), "gpu_model": F.lit("")}).withColumns(
        {
            "provider": F.when(k % 61 == 0, "nowhere").otherwise(F.col("provider")),
            "instance_id": F.when(k % 59 == 0, F.concat(F.lit(" "), "instance_id")).otherwise(F.col("instance_id")),
            "label": F.when(k % 47 != 0, F.col("label")),
            "cost_per_hour": F.when(k % 43 == 0, float("nan")).when(k % 53 == 0, float("inf")).when(k % 37 == 0, -1.0).otherwise(F.col("cost_per_hour")),
        }
    )
    started = F.unix_seconds(F.col("started_at").cast("timestamp")).cast("double")
    return rows.select(F.col("_key").alias("instance_id"), fleet.candidate_error(started).alias("error"))


@query("listing_health", "instances_raw", oracle=f", {NORMAL} SELECT *, duplicate_ids > 0 AS void, duplicate_ids = 0 AND malformed = 0 AS provable FROM h")
def listing_health(v):
    return fleet.listing_health(normalized(v))


@query("enumerate_instances", "instances_raw", oracle=f", {NORMAL} SELECT listing_id, cid AS instance_id, label, cost AS cost_per_hour FROM n JOIN h USING (listing_id) WHERE reject = '' AND duplicate_ids = 0")
def enumerate_instances(v):
    return fleet.enumerate_instances(normalized(v)).select("listing_id", "instance_id", "label", "cost_per_hour")


@query("scope_filter", "instances", oracle=f"SELECT instance_id, label FROM v_instances WHERE starts_with(label, '{SCOPE}-')")
def scope_filter(v):
    return fleet.scope_filter(v.instances, SCOPE).select("instance_id", "label")


@query("destroy_eligibility", "instances", oracle="""
SELECT instance_id, CASE state WHEN '' THEN 'empty state' WHEN 'destroyed' THEN 'state ''destroyed'' is final' ELSE '' END AS error FROM v_instances""")
def destroy_eligibility(v):
    return v.instances.select("instance_id", fleet.eligibility_error(F.col("state")).alias("error"))


@query("provider_match", "instances", oracle="SELECT provider, count(*) AS n, CASE WHEN provider IS DISTINCT FROM 'market' THEN 'provider_mismatch' END AS refusal FROM v_instances GROUP BY provider")
def provider_match(v):
    outcome = cleanup.apply_policy(
        v.instances.select("provider"),
        lambda c: c.withColumns({"verdict": F.lit("destroyed"), "refusal": F.lit(None).cast("string"), "error": F.lit("")}),
        provider="market",
    )
    return outcome.groupBy("provider", "refusal").agg(F.count("*").alias("n"))


@query("zombie_candidates", "instances", "units", oracle=f"""
SELECT i.instance_id, i.label, i.state FROM v_instances i WHERE starts_with(label, '{SCOPE}-') AND NOT EXISTS (SELECT 1 FROM v_units u WHERE u.instance_id = i.instance_id AND u.status IN ('deployed', 'running'))""")
def zombie_candidates(v):
    return fleet.zombies(fleet.scope_filter(v.instances, SCOPE), v.units).select("instance_id", "label", "state")


@query("owned_instances", "instances", oracle=f", {repository_cte('v_instances', 'image_uuid')} SELECT instance_id, repository = 'lab/fold' AS owned FROM rp")
def owned_instances(v):
    return fleet.with_ownership(v.instances, own_images(v), key="image_uuid").select("instance_id", "owned")


@query("verify_ownership", "instances_raw", "images", oracle=f""", {NORMAL}
SELECT r.row_id, CASE WHEN r.row_id % 43 = 0 OR h.malformed > 0 OR h.duplicate_ids > 0 THEN 'refused' WHEN n.cid IS NULL THEN 'absent' WHEN starts_with(n.image_uuid, 'lab/fold1:') THEN 'owned' ELSE 'refused' END AS verification
FROM (SELECT row_id, row_id - row_id % 16 AS listing_id, CASE WHEN row_id % 5 = 0 THEN row_id + 500000 ELSE row_id END AS want FROM v_images) r LEFT JOIN h USING (listing_id) LEFT JOIN (SELECT listing_id, cid, min(image_uuid) AS image_uuid FROM n GROUP BY ALL) n ON n.listing_id = r.listing_id AND n.cid = CAST(r.want AS VARCHAR)""")
def verify_ownership(v):
    row = F.col("row_id")
    wanted = F.when(row % 43 == 0, "  ").otherwise(F.concat(F.lit(" "), F.when(row % 5 == 0, row + 500000).otherwise(row).cast("string")))
    requests = v.images.select("row_id", (row - row % 16).alias("listing_id"), wanted.alias("instance_id"))
    owned = v.images.where(F.col("image").contains("lab/fold1:")).select("image")
    return fleet.verify_ownership(requests, normalized(v), owned).select("row_id", "verification")


@query("fleet_totals", "instances", oracle=f""", {repository_cte('v_instances', 'image_uuid')}
SELECT CAST(sum(CAST(cost_per_hour AS DECIMAL(12,6))) AS DOUBLE) AS total_per_hour, count(*) FILTER (state = 'running') AS running, count(*) AS instances, count(*) FILTER (repository = 'lab/fold') AS owned FROM rp""")
def fleet_totals(v):
    return fleet.fleet_totals(fleet.with_ownership(v.instances, own_images(v), key="image_uuid"))


@query("cleanup_totals", "outcomes", oracle="""
SELECT scope, count(*) FILTER (verdict = 'destroyed') AS destroyed, count(*) FILTER (verdict = 'already_gone') AS already_gone,
 count(*) - count(*) FILTER (verdict IN ('destroyed', 'already_gone')) AS unresolved, count(*) AS candidates FROM v_outcomes GROUP BY scope""")
def cleanup_totals(v):
    return cleanup.cleanup_totals(v.outcomes, ["scope"])


@query("verify_verdict", "verify_log", oracle="""
, d AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM v_verify_log)
SELECT row_id, CASE WHEN status_code = 404 THEN 'gone' WHEN status_code IS NULL OR status_code <> 200 OR coalesce(json_type(j), '') <> 'OBJECT' THEN 'unknown' WHEN json_extract_string(j, '$.actual_status') = 'destroyed' THEN 'gone' ELSE 'present' END AS verdict,
 CASE WHEN status_code IS NULL THEN 'no response' WHEN status_code NOT IN (200, 404) THEN 'HTTP ' || status_code WHEN status_code = 200 AND j IS NULL THEN 'response is not JSON' WHEN status_code = 200 AND json_type(j) <> 'OBJECT' THEN 'response is not an object' END AS error FROM d""")
def verify_verdict(v):
    verdict = cleanup.verify_verdict(F.col("status_code"), F.col("body"))
    return v.verify_log.select("row_id", verdict.alias("r")).select("row_id", "r.verdict", "r.error")


DESTROY = """a AS (SELECT *, string_split(delete_statuses, ',') AS s FROM v_destroy_log),
 b AS (SELECT *, s[1:coalesce(list_min(list_filter(range(1, len(s) + 1), lambda i: s[i] IN ('200', '204'))), len(s))] AS used FROM a),
 c AS (SELECT *, coalesce(list_max(list_filter(range(1, len(used) + 1), lambda i: used[i] <> 'raise')), 0) AS att, list_filter(used, lambda x: x <> 'none') AS spoken FROM b),
 e AS (SELECT *, CASE WHEN len(spoken) = 0 THEN stop_status ELSE try_cast(spoken[-1] AS INT) END AS ls FROM c),
 dv AS (SELECT instance_id, run_at, stop_error, CAST(CASE WHEN stop_error IS NOT NULL THEN 0 ELSE att END AS INT) AS attempts, CASE WHEN stop_error IS NULL THEN ls END AS last_status,
   CASE WHEN stop_error IS NOT NULL THEN 'unknown' WHEN verify1 = 'gone' THEN CASE WHEN att = 0 THEN 'unknown' WHEN ls IN (200, 204) THEN 'destroyed' ELSE 'leaked' END
     WHEN verify1 = 'present' AND verify2 = 'gone' AND att > 0 THEN 'destroyed' ELSE 'unknown' END AS verdict,
   CASE WHEN stop_error IS NOT NULL THEN NULL WHEN verify1 = 'gone' THEN CASE WHEN att = 0 THEN 'no delete attempt returned' END
     WHEN verify1 = 'present' THEN CASE WHEN verify2 = 'gone' THEN CASE WHEN att = 0 THEN 'no delete attempt returned' END WHEN verify2 = 'raise' THEN verify2_error ELSE coalesce(verify2_error, verify1_error, 'verify returned PRESENT') END
     ELSE verify1_error END AS verify_error FROM e),
 dl AS (SELECT * FROM dv QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY run_at DESC) = 1)"""


def destroy_log(v):
    return v.destroy_log.withColumn("delete_statuses", F.split("delete_statuses", ","))


@query("destroy_verdict", "destroy_log", oracle=f", {DESTROY} SELECT * FROM dv")
def destroy_verdict(v):
    return cleanup.destroy_verdict(destroy_log(v))


def dispatch_oracle(credentials, where="true"):
    outcome = {
        "available": "verdict",
        "absent": "CASE WHEN verification = 'absent' THEN 'already_gone' ELSE 'cli_attempted' END",
    }[credentials]
    return f"""{repository_cte('v_instances', 'image_uuid')}, {DESTROY},
 q AS (SELECT rp.*, dv.verdict, CASE WHEN instance_id % 17 = 0 THEN NULL WHEN instance_id % 9 = 0 THEN 'absent' WHEN repository = 'lab/fold' THEN 'owned' ELSE 'refused' END AS verification FROM (SELECT * REPLACE (CAST(instance_id AS BIGINT) AS instance_id) FROM rp) rp LEFT JOIN (SELECT * REPLACE (CAST(instance_id AS BIGINT) AS instance_id) FROM dl) dv USING (instance_id) WHERE {where}),
 f AS (SELECT CAST(instance_id AS VARCHAR) AS instance_id, CASE WHEN provider IS DISTINCT FROM 'market' THEN 'provider_mismatch' WHEN state IN ('', 'destroyed') THEN 'ineligible_state' WHEN verification IS NULL OR verification = 'refused' THEN 'ownership' END AS refusal, {outcome} AS outcome FROM q),
 g AS (SELECT instance_id, refusal, CASE WHEN refusal IS NULL THEN outcome END AS verdict FROM f)"""


def judged(v):
    owned = fleet.with_ownership(v.instances, own_images(v), key="image_uuid")
    number = F.col("instance_id").cast("bigint")
    known = F.when(number % 9 == 0, "absent").when(F.col("owned"), "owned").otherwise("refused")
    verification = F.when(number % 17 != 0, known)
    runs = cleanup.destroy_verdict(cleanup.latest_runs(destroy_log(v))).withColumnRenamed("verdict", "destroy_verdict")
    return owned.withColumn("verification", verification).join(runs, "instance_id", "left")


@query("cleanup_dispatch", "instances", "destroy_log", oracle=f", {dispatch_oracle('available')} SELECT instance_id, refusal, verdict, refusal IS NULL AND verdict = 'destroyed' AS clean FROM g")
def cleanup_dispatch(v):
    return cleanup.dispatch(judged(v)).select("instance_id", "refusal", "verdict", (F.col("error") == "").alias("clean"))


@query("cleanup_dispatch_cli", "instances", "destroy_log", oracle=f", {dispatch_oracle('absent')} SELECT instance_id, refusal, verdict FROM g")
def cleanup_dispatch_cli(v):
    return cleanup.dispatch(judged(v), credentials="absent").select("instance_id", "refusal", "verdict")


@query("outcome_invariants", "outcomes", oracle="""
, r AS (SELECT *, (verdict IS NULL) <> (refusal IS NULL) AS one, coalesce(verdict IN ('destroyed', 'already_gone'), false) AS good FROM v_outcomes),
 x AS (SELECT row_id, 'unknown verdict' AS violation FROM r WHERE verdict NOT IN ('destroyed', 'cli_attempted', 'already_gone', 'leaked', 'unknown')
 UNION ALL SELECT row_id, 'exactly one of verdict or refusal must be set' FROM r WHERE NOT one
 UNION ALL SELECT row_id, 'success must have an empty error' FROM r WHERE good AND error <> ''
 UNION ALL SELECT row_id, 'unresolved outcome must have an error' FROM r WHERE NOT good AND error = '' AND one
 UNION ALL SELECT row_id, 'verdict requires attempts >= 1' FROM r WHERE refusal IS NULL AND verdict IN ('destroyed', 'leaked') AND attempts < 1
 UNION ALL SELECT row_id, 'refusal requires attempts = 0' FROM r WHERE refusal IS NOT NULL AND attempts <> 0) SELECT * FROM x""")
def outcome_invariants(v):
    none = F.lit(None).cast("string")
    outcome = cleanup.outcome_violations(F.col("verdict"), F.col("refusal"), F.col("error"))
    run = cleanup.destroy_violations(F.col("verdict"), F.col("refusal"), F.col("attempts"), none, none, none)
    return v.outcomes.select("row_id", F.explode(F.array_union(outcome, run)).alias("violation"))


@query("outcome_severity", "outcomes", oracle="""
SELECT row_id, CASE WHEN verdict = 'destroyed' THEN NULL WHEN verdict = 'leaked' THEN 'error' WHEN verdict IN ('unknown', 'cli_attempted') THEN 'warning' WHEN verdict = 'already_gone' THEN 'info'
 WHEN refusal IN ('no_credentials', 'credentials_disabled') THEN 'warning' WHEN refusal IS NOT NULL THEN 'info' ELSE 'error' END AS severity FROM v_outcomes""")
def outcome_severity(v):
    return v.outcomes.select("row_id", cleanup.severity(F.col("verdict"), F.col("refusal")).alias("severity"))


SWEEP = f"""starts_with(label, '{SCOPE}-') AND NOT EXISTS (SELECT 1 FROM v_units u WHERE u.instance_id = CAST(rp.instance_id AS VARCHAR) AND u.status IN ('deployed', 'running'))"""


def sweep_rows(v):
    verification = judged(v).select("instance_id", "verification")
    return sweep(v.instances, v.units, destroy_log(v), SCOPE, verification=verification)


@query("sweep_report", "instances", "units", "destroy_log", oracle=f""", {dispatch_oracle('available', SWEEP)}
SELECT instance_id, refusal, verdict, CASE WHEN verdict = 'destroyed' THEN NULL WHEN verdict = 'leaked' THEN 'error' WHEN verdict = 'unknown' THEN 'warning' ELSE 'info' END AS severity FROM g""")
def sweep_report(v):
    return sweep_rows(v).select("instance_id", "refusal", "verdict", "severity")


@query("sweep_totals", "instances", "units", "destroy_log", oracle=f""", {dispatch_oracle('available', SWEEP)}
SELECT count(*) FILTER (verdict = 'destroyed') AS destroyed, count(*) FILTER (verdict = 'already_gone') AS already_gone, count(*) - count(*) FILTER (verdict IN ('destroyed', 'already_gone')) AS unresolved, count(*) AS candidates FROM g""")
def sweep_totals_query(v):
    return sweep_totals(sweep_rows(v))


@query("policy_outcomes", "instances", "destroy_log", oracle=f""", {DESTROY}
SELECT i.instance_id, CASE WHEN i.provider = 'market' THEN CASE WHEN dv.verdict = 'destroyed' THEN 'destroyed' WHEN CAST(i.instance_id AS BIGINT) % 2 = 0 THEN dv.verdict ELSE 'unknown' END END AS verdict,
 CASE WHEN i.provider IS DISTINCT FROM 'market' THEN 'provider_mismatch' END AS refusal FROM v_instances i JOIN dl dv USING (instance_id)""")
def policy_outcomes(v):
    def destroy(candidates):
        runs = cleanup.destroy_verdict(cleanup.latest_runs(destroy_log(v))).select("instance_id", "verdict")
        detail = F.when(F.col("verdict") == "destroyed", "").when(F.col("instance_id").cast("bigint") % 2 == 0, "detail").otherwise("")
        return candidates.join(runs, "instance_id").withColumns({"refusal": F.lit(None).cast("string"), "error": detail})

    outcomes = cleanup.apply_policy(v.instances.select("provider", "instance_id"), destroy, provider="market")
    return outcomes.select("instance_id", "verdict", "refusal")


LISTING_TOTALS = f""", {dispatch_oracle('available', SWEEP)}
SELECT i.listing_id, count(*) FILTER (verdict = 'destroyed') AS destroyed, count(*) FILTER (verdict = 'already_gone') AS already_gone, count(*) - count(*) FILTER (verdict IN ('destroyed', 'already_gone')) AS unresolved, count(*) AS candidates
FROM g JOIN v_instances i USING (instance_id) GROUP BY i.listing_id"""


@query("sweep_by_listing", "instances", "units", "destroy_log", oracle=LISTING_TOTALS)
def sweep_by_listing(v):
    return cleanup.cleanup_totals(sweep_rows(v), ["listing_id"])


@query("sweep_stream", "instances", "units", "destroy_log", oracle=LISTING_TOTALS)
def sweep_stream(v):
    """Listings come as a stream; every micro-batch is swept on its own."""
    listings, _ = replay.source(v.instances, "started_at")
    folder, log, verification = scratch_folder(v.spark, "sweep"), destroy_log(v), judged(v).select("instance_id", "verification")
    run = start_sweep(listings, lambda df: sweep(df, v.units, log, SCOPE, verification=verification), f"{folder}/runs", checkpoint=f"{folder}/log")
    return cleanup.cleanup_totals(replay.finished(run, lambda: v.spark.read.parquet(f"{folder}/runs")), ["listing_id"])


@query("cleanup_report", "instances_raw", "units", "destroy_log", oracle=f""", {NORMAL}, {DESTROY},
 cand AS (SELECT n.listing_id, n.cid, n.image_uuid, h.malformed FROM n JOIN h USING (listing_id) WHERE reject = '' AND duplicate_ids = 0 AND starts_with(label, 'prod-3f9a1b2c4d5e-') AND cid NOT IN (SELECT instance_id FROM v_units WHERE status IN ('deployed', 'running')))
SELECT cid AS instance_id, CASE WHEN malformed > 0 OR NOT starts_with(image_uuid, 'lab/fold1:') THEN 'ownership' END AS refusal, CASE WHEN malformed = 0 AND starts_with(image_uuid, 'lab/fold1:') THEN coalesce(dv.verdict, 'unknown') END AS verdict
FROM cand LEFT JOIN dl dv ON dv.instance_id = cand.cid""")
def cleanup_report_query(v):
    owned = v.images.where(F.col("image").contains("lab/fold1:")).select("image")
    outcomes = cleanup_report(normalized(v), v.units, destroy_log(v), "prod-3f9a1b2c4d5e", owned=owned)
    return outcomes.select("instance_id", "refusal", "verdict")
