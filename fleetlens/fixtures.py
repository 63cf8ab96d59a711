"""Domain tables as views over the driver's star schema.

One SQL text per view, in the dialect both Spark and DuckDB read. A view names
its base tables in braces; Spark gets a Parquet path there, DuckDB the table.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetlens.operators.ordered import followed

VIEWS: dict[str, str] = {}

VIEWS["v_offers"] = """
SELECT DISTINCT l_orderkey*10+l_linenumber AS offer_id,
  CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE concat('m', CAST(l_suppkey AS STRING)) END AS machine_id,
  CASE l_partkey % 3 WHEN 0 THEN 'RTX 3090' WHEN 1 THEN 'RTX 4090' ELSE 'RTX 5090' END AS gpu_name,
  CASE WHEN l_quantity<=45 THEN 1 ELSE 2 END AS num_gpus, l_returnflag<>'R' AS rentable,
  CAST(CASE l_orderkey % 4 WHEN 0 THEN 118 WHEN 1 THEN 122 WHEN 2 THEN 124 ELSE 128 END AS DOUBLE)/10 AS cuda_max_good,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE CAST((l_partkey*7919+l_suppkey*31) % 6000 AS DOUBLE)/10000 END AS dph_total,
  l_quantity*40 AS inet_down, CAST(1 AS DOUBLE) - l_discount/10 AS reliability
FROM {lineitem}"""

VIEWS["v_offer_json"] = """
SELECT o_orderkey AS snapshot_id, CASE o_orderkey % 17 WHEN 0 THEN 'not json' WHEN 1 THEN '{"offers": 1}' WHEN 2 THEN '[]'
  ELSE concat('[{"id": ', CAST(o_orderkey AS STRING), ', "machine_id": ', CAST(o_custkey AS STRING),
  ', "gpu_name": "RTX 4090", "num_gpus": 1, "rentable": true, "dph_total": 0.', CAST(10+o_orderkey % 80 AS STRING),
  '}, {"id": ', CAST(o_orderkey+1000000 AS STRING), ', "machine_id": null, "gpu_name": "RTX 3090", "num_gpus": 2, "rentable": false, "dph_total": null}]') END AS raw
FROM {orders}"""

VIEWS["v_images"] = """
SELECT o_orderkey AS row_id, CASE o_orderkey % 24
  WHEN 0 THEN 'solver' WHEN 1 THEN 'library/solver:stable' WHEN 2 THEN concat('solver@sha256:', md5(CAST(o_orderkey AS STRING)), md5(CAST(o_custkey AS STRING)))
  WHEN 3 THEN concat('solver@sha256:', md5(CAST(o_orderkey AS STRING))) WHEN 4 THEN 'hub.internal:8443/lab/fold:3'
  WHEN 5 THEN 'docker.io/library/solver' WHEN 6 THEN '[::1]:8443/lab/fold:3' WHEN 7 THEN 'localhost/team/render:7'
  WHEN 8 THEN 'team/ray__tracer:7' WHEN 9 THEN 'te.am/ray_v3.1-rc:7' WHEN 10 THEN '' WHEN 11 THEN '   '
  WHEN 12 THEN 'worse?name' WHEN 13 THEN 'solver:worse?tag' WHEN 14 THEN 'hub:x1y/team/render' WHEN 15 THEN 'hub:70000/team/render'
  WHEN 16 THEN 'hub..broken/team/render' WHEN 17 THEN '_under/team/render' WHEN 18 THEN 'Team/render'
  WHEN 19 THEN 'team/render@one@sha256:00' WHEN 20 THEN concat('  lab/fold', CAST(o_custkey % 9 AS STRING), ':2  ')
  WHEN 21 THEN 'solver@SHA512:00' WHEN 22 THEN concat('org/app', CAST(o_custkey AS STRING), '@blake3+b64:Zz-9_=') ELSE 'team//render' END AS image
FROM {orders}"""

VIEWS["v_docker_images"] = """
SELECT o_orderkey AS row_id, CASE o_orderkey % 5 WHEN 0 THEN concat('nvidia/cuda:1', CAST(o_custkey % 4 AS STRING), '.', CAST(o_orderkey % 9 AS STRING), '.1-devel')
  WHEN 1 THEN 'pytorch/pytorch:2.1-cuda-12.1' WHEN 2 THEN 'org/app:1.0' WHEN 3 THEN 'org/cuda-11.8-base' ELSE 'cuda:latest' END AS image
FROM {orders}"""

VIEWS["v_instances_raw"] = """
SELECT o_orderkey AS row_id, o_orderkey - o_orderkey % 16 AS listing_id, concat('{"id": ',
  CASE o_orderkey % 29 WHEN 0 THEN 'null' WHEN 1 THEN 'true' WHEN 2 THEN '"  "'
    WHEN 3 THEN concat('" ',CAST(o_orderkey AS STRING),' "') WHEN 4 THEN concat(CAST(o_orderkey AS STRING),'.0')
    WHEN 5 THEN '{"id": 1}' WHEN 6 THEN CAST(o_orderkey - o_orderkey % 16 + 9 AS STRING)
    ELSE CAST(o_orderkey AS STRING) END,
  ', "image_uuid": ', CASE o_orderkey % 23 WHEN 0 THEN 'null' WHEN 1 THEN '7' ELSE concat('"lab/fold', CAST(o_custkey % 3 AS STRING), ':1"') END,
  ', "gpu_name": "RTX 4090", "label": ', CASE o_orderkey % 13 WHEN 0 THEN 'null' ELSE '"prod-3f9a1b2c4d5e-1"' END,
  ', "actual_status": "running", "dph_total": ', CASE o_orderkey % 17 WHEN 0 THEN 'true' WHEN 1 THEN '-1' WHEN 2 THEN '"x"' ELSE '0.25' END,
  ', "start_date": ', CASE o_orderkey % 19 WHEN 0 THEN 'null' ELSE CAST(o_orderkey * 100 AS STRING) END, '}') AS raw_json
FROM {orders} WHERE o_orderkey % 37 <> 0
UNION ALL SELECT o_orderkey, o_orderkey - o_orderkey % 16, CASE o_orderkey % 3 WHEN 0 THEN '"bad"' WHEN 1 THEN '["also","bad"]' ELSE '{broken' END
FROM {orders} WHERE o_orderkey % 37 = 0"""

VIEWS["v_pages_raw"] = """
SELECT o_orderkey - o_orderkey % 5 AS listing_id, CAST(o_orderkey % 5 AS INT) AS page_no,
  CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 331 = 7 THEN 'elsewhere' ELSE concat('t', CAST(o_orderkey - 1 AS STRING)) END AS after_token,
  CASE WHEN o_orderkey % 211 = 3 THEN '[1, 2]' WHEN o_orderkey % 223 = 4 THEN '{"instances": {}, "next_token": null}'
    WHEN o_orderkey % 227 = 5 THEN '{"next_token": "x"' ELSE
  concat('{"instances": [{"id": ', CAST(o_orderkey * 2 AS STRING), '}, {"id": ', CAST(o_orderkey * 2 + 1 AS STRING), '}], "next_token": ',
  CASE WHEN o_orderkey % 5 = 4 THEN 'null' WHEN o_orderkey % 229 = 6 THEN '""' WHEN o_orderkey % 233 = 8 THEN '17'
    WHEN o_orderkey % 239 = 1 THEN 'null' ELSE concat('"t', CAST(o_orderkey AS STRING), '"') END, '}') END AS raw
FROM {orders}
UNION ALL SELECT -1 - o_orderkey % 1, CAST(o_orderkey AS INT), CASE WHEN o_orderkey = 0 THEN '' ELSE concat('t', CAST(o_orderkey - 1 AS STRING)) END,
  concat('{"instances": [{"id": ', CAST(o_orderkey AS STRING), '}], "next_token": ', CASE WHEN o_orderkey = 1199 THEN 'null' ELSE concat('"t', CAST(o_orderkey AS STRING), '"') END, '}')
FROM {orders} WHERE o_orderkey < 1200"""

# Pages that are known by their tokens; page_no is for the oracle only. One listing has all orders; others have a circle, a fork, a doubled token.
VIEWS["v_token_pages"] = """
SELECT o_orderkey - o_orderkey % 5 AS listing_id, CAST(o_orderkey % 5 AS INT) AS page_no,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 331 = 7 THEN 'elsewhere' ELSE concat('t', CAST(o_orderkey - 1 AS STRING)) END AS after_token,
  CASE WHEN o_orderkey % 211 = 3 THEN '[1, 2]' WHEN o_orderkey % 227 = 5 THEN '{"next_token": "x"' ELSE
  concat('{"instances": [{"id": ', CAST(o_orderkey * 2 AS STRING), '}], "next_token": ',
  CASE WHEN o_orderkey % 5 = 4 THEN 'null' WHEN o_orderkey % 233 = 8 THEN '17' ELSE concat('"t', CAST(o_orderkey AS STRING), '"') END, '}') END AS raw
FROM {orders}
UNION ALL SELECT -1, CAST(o_orderkey AS INT), CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM {orders}) THEN '' ELSE concat('t', CAST(o_orderkey AS STRING)) END,
  concat('{"instances": [{"id": ', CAST(o_orderkey AS STRING), '}], "next_token": ', CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM {orders}) THEN 'null' ELSE concat('"t', CAST(lead(o_orderkey) OVER (ORDER BY o_orderkey) AS STRING), '"') END, '}')
FROM {orders}
UNION ALL SELECT -2 - s_suppkey, CAST(p AS INT), CASE p WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE CASE s_suppkey % 4 WHEN 1 THEN 'b' ELSE 'c' END END,
  concat('{"instances": [{"id": ', CAST(p AS STRING), '}], "next_token": ', CASE p WHEN 0 THEN '"a"' WHEN 1 THEN '"b"'
    WHEN 2 THEN CASE s_suppkey % 4 WHEN 0 THEN '"b"' WHEN 1 THEN 'null' ELSE '"c"' END ELSE CASE s_suppkey % 4 WHEN 2 THEN '"b"' ELSE 'null' END END, '}')
FROM {supplier} CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS numbers
UNION ALL SELECT -2 - s_suppkey, 0, '', '{"instances": [{"id": 0}], "next_token": "a"}' FROM {supplier} WHERE s_suppkey % 4 = 3"""

VIEWS["v_instances"] = """
SELECT o_orderkey - o_orderkey % 64 AS listing_id, CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 'runpod' ELSE 'market' END AS provider, CAST(o_orderkey AS STRING) AS instance_id,
  concat(substr('prodstagdevx',CAST(1+4*(o_custkey%3) AS INT),4),'-',substr(md5(CAST(o_custkey%10 AS STRING)),1,12),'-',substr(md5(CAST(o_orderkey AS STRING)),1,12)) AS label,
  CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderstatus = 'P' THEN 'loading' ELSE 'destroyed' END AS state,
  CASE o_orderkey%6 WHEN 0 THEN 'lab/fold:3' WHEN 1 THEN 'lab/fold' WHEN 2 THEN 'mirror.lan:9443/lab/fold:3'
    WHEN 3 THEN 'lab/fold:rc+1' WHEN 4 THEN ''
    ELSE concat('lab/fold@sha256:',md5(CAST(o_orderkey AS STRING)),md5(CAST(o_custkey AS STRING))) END AS image_uuid,
  CAST(o_orderkey*37%500 AS DOUBLE)/1000 AS cost_per_hour, o_orderdate AS started_at
FROM {orders}"""

VIEWS["v_units"] = """
SELECT concat('b',CAST(o_custkey%20 AS STRING)) AS batch_id, 'shard' AS kind, CAST(o_orderkey AS STRING) AS unit_key, o_orderkey AS shard_id,
  CASE o_orderkey%7 WHEN 0 THEN 'pending' WHEN 1 THEN 'deployed' WHEN 2 THEN 'running' WHEN 3 THEN 'downloaded'
    WHEN 4 THEN 'destroyed' WHEN 5 THEN 'failed' ELSE 'running' END AS status,
  CASE WHEN o_orderkey%7 <> 0 THEN CAST(o_orderkey AS STRING) ELSE '' END AS instance_id,
  o_orderkey%4 AS retry_count, CAST(o_orderkey*37%500 AS DOUBLE)/1000 AS cost_per_hour, o_orderdate AS start_ts
FROM {orders}"""

VIEWS["v_jobs"] = """
SELECT concat('j',CAST(o_custkey%50 AS STRING)) AS batch_id, 'job' AS kind, concat('job', CAST(o_orderkey AS STRING)) AS unit_key,
  CASE o_orderkey%6 WHEN 0 THEN 'pending' WHEN 1 THEN 'deploying' WHEN 2 THEN 'running' WHEN 3 THEN 'completed' WHEN 4 THEN 'downloaded' ELSE 'failed' END AS status,
  CASE WHEN o_orderkey%6 IN (1,2) THEN CAST(o_orderkey AS STRING) ELSE '' END AS instance_id, o_orderkey%4 AS retry_count,
  CAST(o_orderkey*37%500 AS DOUBLE)/1000 AS cost_per_hour, concat('m', CAST(o_custkey AS STRING)) AS machine_id,
  CASE WHEN o_orderkey%6 = 0 THEN '' ELSE concat(substr(CAST(o_orderdate AS STRING),1,10),'T08:00:00',
    CASE o_orderkey%3 WHEN 0 THEN '+00:00' WHEN 1 THEN '+02:00' ELSE '' END) END AS submit_time,
  CASE WHEN o_orderkey%6 IN (3,4) THEN concat(substr(CAST(o_orderdate AS STRING),1,10),'T1',CAST(o_orderkey%9 AS STRING),':30:00+00:00') ELSE '' END AS complete_time
FROM {orders}"""

VIEWS["v_settled_units"] = """
SELECT concat('s',CAST(o_custkey AS STRING)) AS batch_id, CASE o_custkey%2 WHEN 0 THEN 'shard' ELSE 'job' END AS kind, CAST(o_orderkey AS STRING) AS unit_key,
  CASE WHEN o_custkey%5 = 0 THEN CASE o_orderkey%4 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'failed' WHEN 2 THEN 'destroyed' ELSE 'completed' END
    WHEN o_custkey%5 = 1 THEN 'downloaded' WHEN o_orderkey%50 = 0 THEN NULL WHEN o_orderkey%50 = 1 THEN 'paused' WHEN o_orderkey%3 = 0 THEN 'running' ELSE 'failed' END AS status
FROM {orders}"""

VIEWS["v_unit_events"] = """
SELECT event_id, user_id AS unit_key, ts,
  CASE event_type WHEN 'view' THEN 'deployed' WHEN 'click' THEN 'deployed' WHEN 'signup' THEN 'completed'
    WHEN 'purchase' THEN 'preempted' ELSE 'failed' END AS event,
  concat('i', CAST(event_id AS STRING)) AS instance_id, CASE event_id%9 WHEN 0 THEN 'CUDA out of memory' ELSE 'worker died silently' END AS reason,
  CAST(event_id%50 AS DOUBLE)/100 AS cost_per_hour
FROM {events}"""

VIEWS["v_probes"] = """
SELECT event_id, user_id AS unit_key, ts, concat('i', CAST(event_id%70 AS STRING)) AS instance_id,
  CASE event_id%19 WHEN 0 THEN 'null' WHEN 1 THEN '"text"' WHEN 2 THEN '[1]' WHEN 3 THEN '{"complete": "yes", "worker_dead": 1, "log_tail": 5}'
    WHEN 4 THEN '{"complete": "", "worker_dead": [], "log_tail": "quiet"}' WHEN 5 THEN '{"complete": 0.0, "worker_dead": {"a": 1}}' ELSE
  concat('{"complete": ', CASE WHEN event_type='purchase' THEN 'true' ELSE 'false' END, ', "worker_dead": ',
    CASE WHEN event_type='error' THEN 'true' ELSE 'false' END, ', "log_tail": "line ', CAST(event_id AS STRING), '"}') END AS raw
FROM {events} WHERE event_type<>'signup'"""

VIEWS["v_markers"] = """
SELECT event_id, user_id AS unit_key, ts AS marker_ts, concat('w', CAST(event_id%5 AS STRING)) AS worker_id, concat('b', CAST(user_id%3 AS STRING)) AS batch_id, user_id%17 AS shard_id FROM {events} WHERE event_type='signup'"""

VIEWS["v_objects"] = """
SELECT 'bkt' AS bucket, doc_id, CASE WHEN doc_id%67=0 THEN concat('project/batches/b',CAST(doc_id%20 AS STRING),'/shard_x/DONE')
  ELSE concat('project/batches/b',CAST(doc_id%20 AS STRING),'/',CASE doc_id%13 WHEN 0 THEN 'global_markers/p' WHEN 1 THEN concat('job', CAST(doc_id%50 AS STRING), '/') ELSE concat('shard_',CAST(doc_id%50 AS STRING),'/') END,
  CASE WHEN doc_id%13=0 THEN concat(CAST(doc_id AS STRING), '.done') WHEN doc_id%5=0 THEN 'DONE' WHEN doc_id%5=1 THEN concat('markers/p',CAST(doc_id AS STRING),'.done')
    WHEN doc_id%5=2 THEN 'worker.exitcode' WHEN doc_id%5=3 THEN concat('traj_chunk_', lpad(CAST(doc_id AS STRING),3,'0'), '.xtc')
    ELSE concat('outputs/p',CAST(doc_id AS STRING),'/out.txt') END) END AS key, n_chars AS size, doc_id%60 AS age_days
FROM {documents}"""

VIEWS["v_bucket_objects"] = """
SELECT concat('bkt', CAST(doc_id - doc_id%8 AS STRING)) AS bucket, doc_id, concat('project/batches/b',CAST(doc_id%20 AS STRING),'/shard_',CAST(doc_id%50 AS STRING),
  '/outputs/p',CAST(doc_id AS STRING),'/out.txt') AS key, n_chars AS size, doc_id%60 AS age_days
FROM {documents}"""

VIEWS["v_rules"] = """
SELECT concat('bkt', CAST(p_partkey - p_partkey%8 AS STRING)) AS bucket, CAST(p_partkey%8 AS INT) AS pos,
  CASE WHEN p_partkey%8=3 THEN concat('fleetlens-expire-', substr({sha256:concat('bkt', CAST(p_partkey - p_partkey%8 AS STRING), chr(0), 'project/batches/'):sha256},1,12))
    WHEN p_partkey%8=7 THEN concat('fleetlens-expire-other', CAST(p_partkey AS STRING)) WHEN p_partkey%8=5 THEN concat('a|b', CAST(p_partkey AS STRING)) ELSE concat('foreign', CAST(p_partkey AS STRING)) END AS id,
  CASE WHEN p_partkey%5=0 THEN 'Disabled' WHEN p_partkey%23=0 THEN NULL ELSE 'Enabled' END AS status,
  CASE p_partkey%8 WHEN 0 THEN 'project/' WHEN 1 THEN concat('project/batches/b',CAST(p_size%20 AS STRING),'/') WHEN 2 THEN 'project/bat'
    WHEN 3 THEN CASE WHEN p_partkey%3=0 THEN 'project/batches/' WHEN p_partkey%3=1 THEN 'project/elsewhere/' ELSE 'project/batches/' END
    WHEN 4 THEN 'archive/' WHEN 5 THEN '' WHEN 6 THEN concat('project/batches/b1/shard_',CAST(p_size AS STRING)) ELSE 'project/batches/own/' END AS prefix,
  CASE WHEN p_partkey%8=3 AND p_partkey%11=0 THEN NULL ELSE p_size END AS days,
  CASE WHEN p_partkey%7=0 THEN '{"Transition":{"Days":3}}' ELSE '{}' END AS extra
FROM {part}"""

VIEWS["v_policies"] = """
SELECT concat('bkt', CAST(p_partkey AS STRING)) AS bucket, 'project//batches' AS raw_prefix, CAST(p_size AS STRING) AS days_json
FROM {part} WHERE p_partkey%8=0"""

VIEWS["v_policy_inputs"] = """
SELECT p_partkey AS row_id, CASE p_partkey%7 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE p_name END AS bucket,
  CASE p_partkey%9 WHEN 0 THEN '0' WHEN 1 THEN '-1' WHEN 2 THEN '1.5' WHEN 3 THEN '"30"' WHEN 4 THEN 'true' WHEN 5 THEN 'null' ELSE CAST(p_size AS STRING) END AS days_json
FROM {part}"""

VIEWS["v_raw_prefixes"] = """
SELECT page_id, concat('bkt', CAST(page_id%7 AS STRING)) AS bucket,
  CASE page_id%11 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN ' // ' ELSE
  concat(CASE page_id%4 WHEN 0 THEN '/' WHEN 1 THEN ' ' WHEN 2 THEN 'a//' ELSE '' END, substr(url,9), CASE page_id%3 WHEN 0 THEN '///' ELSE '  ' END) END AS raw_prefix FROM {pages}"""

VIEWS["v_items"] = """
SELECT DISTINCT concat('b',CAST(l_suppkey%20 AS STRING)) AS batch_id, concat('p',CAST(l_partkey AS STRING)) AS item_id FROM {lineitem}"""

VIEWS["v_workloads"] = """
SELECT p_partkey AS workload_id, p_retailprice/100 AS work_hours, p_size AS total_items, CAST(p_partkey%9 AS INT) AS cloud_gpus,
  CASE p_partkey % 4 WHEN 0 THEN 'RTX_3090' WHEN 1 THEN 'RTX_4090' WHEN 2 THEN 'RTX_5090' ELSE 'A100' END AS cloud_gpu_type,
  CASE p_partkey % 5 WHEN 0 THEN 'L' WHEN 1 THEN 'C' WHEN 2 THEN 'H' ELSE '' END AS mode
FROM {part}"""

VIEWS["v_timing_lines"] = """
SELECT event_id, CASE WHEN event_id%37=0 THEN '{bad' WHEN event_id%41=0 THEN '' WHEN event_id%43=0 THEN '[1]' WHEN event_id%47=0 THEN '   '
  ELSE concat('{"workload": "',event_type,'", "runtime_sec": ',CAST(event_id%500 AS STRING),'}') END AS line
FROM {events}"""

VIEWS["v_gpu_telemetry"] = """
SELECT event_id, concat('i', CAST(user_id AS STRING)) AS instance_id, ts, CASE WHEN event_id%53=0 THEN 'garbage' WHEN event_id%59=0 THEN '91,0' ELSE concat(CAST(60+event_id%40 AS STRING),', ',CAST(8000+1000*(event_id%20) AS STRING),', ',
  CASE event_id%11 WHEN 0 THEN 'N/A' WHEN 1 THEN '3' WHEN 2 THEN '[N/A]' WHEN 3 THEN 'odd' ELSE '0' END) END AS csv_line
FROM {events}"""

VIEWS["v_vram"] = """
SELECT event_id, CASE WHEN event_id%13=0 THEN 'no gpu' WHEN event_id%17=0 THEN '12' ELSE concat(CAST(event_id%9000 AS STRING), ', ', CAST(15000+500*(event_id%25) AS STRING), chr(10), '1, 1') END AS raw
FROM {events}"""

VIEWS["v_log_lines"] = """
SELECT conv_id AS unit_key, turn AS line_no, text AS line FROM {conversations}"""

VIEWS["v_file_sizes"] = """
SELECT event_id, concat('f', CAST(user_id AS STRING)) AS file_id, ts, (event_id*17)%1000 + event_id AS size FROM {events}"""

VIEWS["v_deploy_attempts"] = """
SELECT l_orderkey AS unit_key, l_linenumber-1 AS attempt, min(l_suppkey) AS machine_id, min(l_quantity)>5 AS boot_ok, min(l_quantity)>8 AS gpu_ok,
  max(l_discount)<0.09 AS files_ok, max(l_returnflag)<>'R' AS env_ok, min(l_linestatus)='F' AS launch_ok
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

VIEWS["v_destroy_log"] = """
SELECT CAST(o_orderkey AS STRING) AS instance_id, 1 AS run_at, CASE o_orderkey%9 WHEN 0 THEN NULL ELSE 200 END AS stop_status,
  CASE WHEN o_orderkey%13=0 THEN 'ConnectionError: reset' END AS stop_error,
  CASE o_orderkey%7 WHEN 0 THEN '200' WHEN 1 THEN '503,503,200' WHEN 2 THEN CASE WHEN o_orderkey%2=0 THEN '503,503,503,200' ELSE '503,503,503' END WHEN 3 THEN 'raise,raise,204'
    WHEN 4 THEN 'raise,raise,raise' WHEN 5 THEN '503,raise,none' ELSE 'none,none,none' END AS delete_statuses,
  CASE o_orderkey%5 WHEN 0 THEN 'gone' WHEN 1 THEN 'present' WHEN 2 THEN 'unknown' WHEN 3 THEN 'raise' ELSE 'present' END AS verify1,
  CASE o_orderkey%5 WHEN 2 THEN 'HTTP 500' WHEN 3 THEN 'Timeout: slow' END AS verify1_error,
  CASE o_orderkey%4 WHEN 0 THEN 'gone' WHEN 1 THEN 'present' WHEN 2 THEN 'raise' ELSE 'unknown' END AS verify2,
  CASE o_orderkey%4 WHEN 2 THEN 'Timeout: slower' WHEN 3 THEN 'HTTP 502' END AS verify2_error
FROM {orders}
UNION ALL SELECT CAST(o_orderkey AS STRING), 2, 200, NULL, '503,raise,503,503,204', 'gone', NULL, 'gone', NULL FROM {orders} WHERE o_orderkey%6=0"""

VIEWS["v_verify_log"] = """
SELECT o_orderkey AS row_id, CASE o_orderkey%6 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN NULL ELSE 200 END AS status_code,
  CASE o_orderkey%5 WHEN 0 THEN '{"actual_status": "destroyed"}' WHEN 1 THEN '{"actual_status": "running"}' WHEN 2 THEN '{}' WHEN 3 THEN '[1]' ELSE 'html' END AS body
FROM {orders}"""

VIEWS["v_shard_evidence"] = """
SELECT o_orderkey AS shard_id, CASE o_orderkey%4 WHEN 0 THEN 'job' ELSE 'shard' END AS kind, o_orderkey%3=0 AS files_failed, o_orderkey%5=0 AS has_failure_rows,
  o_orderkey%8<>0 AS has_outputs, o_orderkey%2=0 AS shard_marker, o_orderkey%9=0 AS predictions_missing, o_orderkey%17<>0 AS marker_written,
  o_orderkey%7<>0 AS exitcode_ok, o_orderkey%11<>0 AS done_put_ok
FROM {orders}"""

VIEWS["v_outputs"] = """
SELECT concat('b', CAST(l_suppkey%20 AS STRING)) AS batch_id, l_orderkey AS shard_id,
  CASE WHEN l_linenumber=7 THEN concat('flat', CAST(l_partkey AS STRING), '.txt') ELSE concat('p', CAST(l_partkey AS STRING), '/part-', CAST(l_linenumber AS STRING), '.bin') END AS rel_path
FROM {lineitem}"""

VIEWS["v_completions"] = """
SELECT DISTINCT concat('b', CAST(l_suppkey%20 AS STRING)) AS batch_id, l_orderkey AS shard_id, concat('p', CAST(l_partkey AS STRING)) AS prediction
FROM {lineitem} WHERE l_orderkey%3<>0 OR l_linenumber>2"""

VIEWS["v_shard_markers"] = """
SELECT DISTINCT concat('b', CAST(l_suppkey%20 AS STRING)) AS batch_id, l_orderkey AS shard_id FROM {lineitem} WHERE l_orderkey%5=0"""

VIEWS["v_upload_failures"] = """
SELECT concat('b', CAST(l_suppkey%20 AS STRING)) AS batch_id, l_orderkey AS shard_id, CASE WHEN l_partkey%4=0 THEN 'SENTINEL_WRITE_FAILED' ELSE concat('p', CAST(l_partkey AS STRING)) END AS name,
  CASE WHEN l_partkey%4=0 THEN concat('p', CAST(l_partkey AS STRING)) ELSE 'out.bin' END AS path
FROM {lineitem} WHERE l_orderkey%19=0"""

VIEWS["v_upload_log"] = """
SELECT event_id, concat('b', CAST(user_id%9 AS STRING)) AS batch_id, user_id AS shard_id, concat('p', CAST(event_id%31 AS STRING)) AS prediction, ts,
  CASE event_type WHEN 'view' THEN 'uploaded' WHEN 'click' THEN 'uploaded' WHEN 'error' THEN 'file_failed' WHEN 'purchase' THEN 'marker_failed' ELSE 'absent' END AS outcome,
  CASE event_type WHEN 'signup' THEN 0 ELSE event_id%6 END AS files_uploaded
FROM {events}"""

VIEWS["v_required_files"] = """
SELECT DISTINCT l_orderkey AS shard_id, CASE l_linenumber WHEN 1 THEN 'part-1.bin' WHEN 2 THEN 'part-2.bin' ELSE 'summary.json' END AS name
FROM {lineitem} WHERE l_linenumber<=2 OR l_orderkey%10=0
UNION ALL SELECT o_orderkey + 100000000, 'summary.json' FROM {orders} WHERE o_orderkey%29=0"""

VIEWS["v_state_docs"] = """
SELECT concat('state/', CAST(o_orderkey AS STRING), '.json') AS path, 'shard' AS kind, CASE o_orderkey%31
  WHEN 0 THEN '{bad' WHEN 1 THEN '[1]' WHEN 2 THEN '{"batch_id": "x", "schema_version": 2}' WHEN 3 THEN '{"schema_version": true}'
  WHEN 4 THEN '{"schema_version": 1, "shards": {"a": 1}}' WHEN 5 THEN '{"schema_version": 1, "label_scope": "p-3f9a1b2c4d5e", "shards": null}'
  WHEN 6 THEN '{"schema_version": 1, "label_scope": "p-3f9a1b2c4d5e", "shards": [{"status": "pending"}]}'
  WHEN 7 THEN '{"schema_version": 1, "label_scope": "p-3f9a1b2c4d5e", "shards": [{"shard_id": 1, "colour": "red"}]}'
  WHEN 8 THEN '{"schema_version": 1, "colour": "red"}' WHEN 9 THEN '{"label": "a", "label_scope": "b", "shards": []}'
  WHEN 10 THEN '{"label": 5}' WHEN 11 THEN '{"shards": ["x"]}' WHEN 12 THEN '{"jobs": {"a": 1}}' WHEN 13 THEN '{"schema_version": "1"}' ELSE
  concat('{"batch_id": "b', CAST(o_custkey AS STRING), '", ', CASE WHEN o_orderkey%3=0 THEN '"schema_version": 1, ' ELSE '' END,
    CASE o_orderkey%4 WHEN 0 THEN concat('"label": "prod-', substr(md5(CAST(o_custkey AS STRING)),1,12), '", ') WHEN 1 THEN concat('"label_scope": "stage-x-', substr(md5(CAST(o_custkey AS STRING)),1,12), '", ')
      WHEN 2 THEN '"label": "plain", ' ELSE '' END,
    '"num_gpus": 2, "shards": [{"shard_id": ', CAST(o_orderkey AS STRING), ', "status": "', CASE WHEN o_orderkey%5<3 THEN 'downloaded' ELSE 'running' END,
    '", "cost_per_hour": 0.5, "retry_count": ', CAST(o_orderkey%3 AS STRING), '}, {"shard_id": ', CAST(o_orderkey+1 AS STRING), ', "status": "failed", "item_ids": ["a", "b"]}]}') END AS raw
FROM {orders}"""

VIEWS["v_scopes"] = """
SELECT c_custkey AS row_id, CASE c_custkey%5 WHEN 0 THEN 'prod' WHEN 1 THEN 'prod ' WHEN 2 THEN '' ELSE 'stage' END AS requested,
  CASE c_custkey%7 WHEN 0 THEN NULL WHEN 1 THEN concat('prod-', substr(md5(c_name),1,12)) WHEN 2 THEN concat('prod-', upper(substr(md5(c_name),1,12)))
    WHEN 3 THEN concat('stage-', substr(md5(c_name),1,11)) WHEN 4 THEN concat('stage-', substr(md5(c_name),1,12)) WHEN 5 THEN 'bare' ELSE concat('prod-eu-', substr(md5(c_name),1,12)) END AS scope,
  CASE c_custkey%3 WHEN 0 THEN NULL WHEN 1 THEN 'prod' ELSE 'stage' END AS stored
FROM {customer}"""

VIEWS["v_outcomes"] = """
SELECT o_orderkey AS row_id, CAST(o_orderkey AS STRING) AS instance_id, concat('prod-', substr(md5(CAST(o_custkey%10 AS STRING)),1,12)) AS scope,
  CASE o_orderkey%8 WHEN 0 THEN 'destroyed' WHEN 1 THEN 'already_gone' WHEN 2 THEN 'leaked' WHEN 3 THEN 'unknown' WHEN 4 THEN 'cli_attempted' WHEN 5 THEN 'odd' END AS verdict,
  CASE o_orderkey%8 WHEN 6 THEN CASE o_orderkey%5 WHEN 0 THEN 'ownership' WHEN 1 THEN 'no_credentials' WHEN 2 THEN 'credentials_disabled' WHEN 3 THEN 'ineligible_state' ELSE 'provider_mismatch' END
    WHEN 5 THEN CASE WHEN o_orderkey%3=0 THEN 'ownership' END END AS refusal,
  CASE WHEN o_orderkey%8 IN (0,1) AND o_orderkey%7<>0 THEN '' WHEN o_orderkey%11=0 THEN '' ELSE 'detail' END AS error, o_orderkey%3 AS attempts
FROM {orders}"""

VIEWS["v_paths"] = """
SELECT doc_id, CASE doc_id%7 WHEN 0 THEN '' WHEN 1 THEN concat('/abs/', CAST(doc_id AS STRING)) WHEN 2 THEN concat('a/../', CAST(doc_id AS STRING)) WHEN 3 THEN '..'
  WHEN 4 THEN concat('dir/f', CAST(doc_id%40 AS STRING), '.sh') WHEN 5 THEN concat('f', CAST(doc_id%40 AS STRING), '.sh') ELSE 'a..b/c' END AS path, concat('u', CAST(doc_id%25 AS STRING)) AS payload_id
FROM {documents}"""

VIEWS["v_diagnostics"] = """
SELECT concat('shard_', CAST(event_id%40 AS STRING), '_i', CAST(event_id AS STRING), '.log') AS path,
  concat('# preempt diagnostics for shard ', CAST(event_id%40 AS STRING), chr(10), '# instance_id: i', CAST(event_id AS STRING), chr(10), '# captured_at: 20240101T000000Z', chr(10), chr(10),
  '## worker.log (full) ##', chr(10), 'step ', CAST(event_id%9 AS STRING), chr(10), props, chr(10), chr(10), '## worker.exitcode ##', chr(10), CASE event_id%3 WHEN 0 THEN '[ssh rc=1] gone' ELSE '1' END, chr(10), chr(10),
  '## dmesg tail ##', chr(10), event_type, chr(10)) AS raw
FROM {events} WHERE event_type IN ('error', 'purchase')"""

VIEWS["v_rule_docs"] = """
SELECT concat('bkt', CAST(p_partkey AS STRING)) AS bucket, CASE p_partkey%11 WHEN 0 THEN '{}' WHEN 1 THEN '{"Rules": []}' WHEN 2 THEN '[]' ELSE
  concat('{"Rules": [{"ID": "r', CAST(p_partkey AS STRING), '", "Status": "Enabled", "Filter": {"Prefix": "a/', CAST(p_size AS STRING), '/"}, "Expiration": {"Days": ', CAST(p_size AS STRING), '}}, ',
  CASE p_partkey%3 WHEN 0 THEN '{"ID": "s", "Filter": "odd", "Transition": {"Days": 3}}' WHEN 1 THEN '{"ID": "s", "Status": "Disabled", "Filter": {}, "Expiration": {"Date": "2030"}}' ELSE '{"Status": "Enabled"}' END, ']}') END AS raw
FROM {part}"""

VIEWS["v_rules_now"] = """
SELECT concat('bkt', CAST(p_partkey - p_partkey%8 AS STRING)) AS bucket, CAST(p_partkey%8 AS INT) AS pos,
  concat('foreign', CAST(p_partkey AS STRING), CASE WHEN p_partkey%90=20 THEN '|b' ELSE '' END) AS id,
  CASE WHEN p_partkey%90=40 THEN '' ELSE 'Enabled' END AS status, concat('p', CAST(p_partkey%8 AS STRING), '/') AS prefix,
  CASE WHEN p_partkey%100 = 50 THEN p_size + 1 ELSE p_size END AS days, '{}' AS extra
FROM {part} WHERE p_partkey%130 <> 64"""

VIEWS["v_rules_then"] = """
SELECT concat('bkt', CAST(p_partkey - p_partkey%8 AS STRING)) AS bucket, CAST(p_partkey%8 AS INT) AS pos, concat('foreign', CAST(p_partkey AS STRING)) AS id,
  CASE WHEN p_partkey%90=20 THEN 'b|Enabled' WHEN p_partkey%90=40 THEN NULL ELSE 'Enabled' END AS status, concat('p', CAST(p_partkey%8 AS STRING), '/') AS prefix, p_size AS days, '{}' AS extra
FROM {part}"""

_BASE = re.compile(r"\{(region|nation|customer|supplier|part|orders|lineitem|events|documents|pages|conversations)\}")


def _spark_text(name: str, sf_dir: str) -> str:
    text = _BASE.sub(lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", VIEWS[name])
    return text.replace("{sha256:", "sha2(").replace(":sha256}", ", 256)")


def _duckdb_text(name: str) -> str:
    text = _BASE.sub(lambda m: m.group(1), VIEWS[name])
    return text.replace("{sha256:", "sha256(").replace(":sha256}", ")")


class Views:
    """The fixture views of one data directory, as attributes: ``views.offers``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        key = f"v_{name}"
        if key not in VIEWS:
            raise AttributeError(name)
        return self.spark.sql(_spark_text(key, self.sf_dir))

    @property
    def token_pages(self) -> DataFrame:
        """The rows of ``v_token_pages``; the order after each comes from slices, where the text has a window over all orders in one task."""
        orders = f"parquet.`{self.sf_dir}/orders.parquet`"
        ahead, window, rest = _spark_text("v_token_pages", self.sf_dir).partition("lead(o_orderkey) OVER (ORDER BY o_orderkey)")
        if not window:
            raise ValueError("v_token_pages has another window")
        named = f"followed_orders_{uuid.uuid4().hex}"
        followed(self.spark.table(orders).select("o_orderkey"), "o_orderkey", "_next").createOrReplaceTempView(named)
        pages = self.spark.sql(f"{ahead}_next{rest.replace(orders, named, 1)}")
        self.spark.catalog.dropTempView(named)
        return pages


def with_views(body: str, *names: str) -> str:
    """Return ``body`` for DuckDB with the named views as leading CTEs."""
    ctes = ",\n".join(f"v_{n} AS ({_duckdb_text(f'v_{n}')})" for n in names)
    return f"WITH {ctes}\n{body}"
