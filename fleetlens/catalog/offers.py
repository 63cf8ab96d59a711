"""Queries over marketplace offers."""

from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.functions import gpu
from fleetlens.operators import offers as market

PASSING = """gpu_name IN ('RTX 3090', 'RTX 4090', 'RTX 5090') AND num_gpus = 1 AND rentable AND cuda_max_good >= 12.4
  AND dph_total <= 0.45 AND inet_down >= 800 AND reliability >= 0.995"""
CANON = "CASE gpu_name WHEN 'RTX 3090' THEN 'RTX_3090' WHEN 'RTX 4090' THEN 'RTX_4090' ELSE 'RTX_5090' END"
WANTED = "wanted(ord, gpu_type, fb) AS (VALUES (0, 'RTX_3090', 0.15), (1, 'RTX_4090', 0.32), (2, 'RTX_5090', 0.60), (3, 'A100', 0.30))"
TYPES = ("RTX_3090", "RTX_4090", "RTX_5090", "A100")
SUMMARY = """SELECT w.ord, w.gpu_type, count(p.dph_total) AS available_count, coalesce(min(p.dph_total), CAST(w.fb AS DOUBLE)) AS min_price_hr,
  coalesce(max(p.dph_total), CAST(w.fb AS DOUBLE)) AS max_price_hr, coalesce(median(p.dph_total), CAST(w.fb AS DOUBLE)) AS median_price_hr
FROM wanted w LEFT JOIN {src} p ON p.gpu_type = w.gpu_type AND p.dph_total <> 0 GROUP BY w.ord, w.gpu_type, w.fb"""


@query("read_offers", "offer_json", oracle="""
SELECT snapshot_id, CAST(json_extract(o, '$.id') AS BIGINT) AS offer_id, coalesce(json_extract_string(o, '$.machine_id'), '') AS machine_id,
  json_extract_string(o, '$.gpu_name') AS gpu_name, CAST(json_extract(o, '$.num_gpus') AS INT) AS num_gpus,
  CAST(json_extract(o, '$.rentable') AS BOOLEAN) AS rentable, CAST(json_extract_string(o, '$.dph_total') AS DOUBLE) AS dph_total
FROM (SELECT snapshot_id, unnest(CASE WHEN json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END) = 'ARRAY'
  THEN json_extract(raw, '$[*]') ELSE [] END) AS o FROM v_offer_json)""")
def read_offers(v):
    return market.parse_offers(v.offer_json).select(
        "snapshot_id", "offer_id", "machine_id", "gpu_name", "num_gpus", "rentable", "dph_total"
    )


@query("offer_quality_filter", "offers", oracle=f"SELECT *, {CANON} AS gpu_type FROM v_offers WHERE {PASSING}")
def offer_quality_filter(v):
    return market.quality_filter(v.offers)


@query("offers_for_image", "offers", oracle=f"SELECT *, {CANON} AS gpu_type FROM v_offers WHERE {PASSING} AND cuda_max_good >= 12.8")
def offers_for_image(v):
    return market.quality_filter(v.offers, image="team/trainer:2.3-cuda-12.8")


@query("gpu_name_map", "workloads", oracle="""SELECT cloud_gpu_type, replace(cloud_gpu_type, 'RTX_', 'RTX ') AS market_name, count(*) AS n
FROM v_workloads GROUP BY cloud_gpu_type""")
def gpu_name_map(v):
    named = v.workloads.groupBy("cloud_gpu_type").agg(F.count("*").alias("n"))
    return named.withColumn("market_name", gpu.market_name(F.col("cloud_gpu_type")))


@query("cuda_from_image", "docker_images", oracle=r"""SELECT row_id, c AS cuda, split_part(c, '.', 1)::INT > 12 OR (split_part(c, '.', 1)::INT = 12 AND split_part(c, '.', 2)::INT >= 1) AS at_least
FROM (SELECT row_id, coalesce(nullif(regexp_extract(image, 'cuda[:-](\d+\.\d+)', 1), ''), '12.4') AS c FROM v_docker_images)""")
def cuda_from_image(v):
    cuda = gpu.cuda_version(F.col("image"))
    return v.docker_images.select(
        "row_id", cuda.alias("cuda"), gpu.version_at_least(cuda, F.lit("12.1")).alias("at_least")
    )


@query("price_summary", "offers", oracle=f""", {WANTED}, p AS (SELECT {CANON} AS gpu_type, dph_total FROM v_offers WHERE {PASSING})
""" + SUMMARY.format(src="p"))
def price_summary(v):
    return market.price_summary(v.offers, TYPES)


@query("price_with_fallback", "workloads", "offers", oracle=f""", live AS (SELECT {CANON} AS gpu_type, count(*) AS available_count, min(dph_total) AS lo, max(dph_total) AS hi, median(dph_total) AS mid
  FROM v_offers WHERE {PASSING} AND dph_total <> 0 GROUP BY ALL)
SELECT workload_id, w.cloud_gpu_type AS gpu_type, coalesce(available_count, 0) AS available_count, coalesce(lo, f) AS min_price_hr, coalesce(hi, f) AS max_price_hr, coalesce(mid, f) AS median_price_hr
FROM (SELECT *, CAST(CASE cloud_gpu_type WHEN 'RTX_3090' THEN 0.15 WHEN 'RTX_4090' THEN 0.32 WHEN 'RTX_5090' THEN 0.60 ELSE 0.30 END AS DOUBLE) AS f FROM v_workloads) w
LEFT JOIN live ON live.gpu_type = w.cloud_gpu_type""")
def price_with_fallback(v):
    live = market.price_summary(v.offers).where("available_count > 0").drop("ord")
    return market.with_fallback(v.workloads.selectExpr("workload_id", "cloud_gpu_type AS gpu_type"), live)


@query("speed_lookup", "workloads", oracle="""SELECT workload_id, CAST(CASE cloud_gpu_type WHEN 'RTX_3090' THEN 0.77 WHEN 'RTX_5090' THEN 1.43 ELSE 1 END AS DOUBLE) AS speed FROM v_workloads""")
def speed_lookup(v):
    return v.workloads.select("workload_id", gpu.speed(F.col("cloud_gpu_type")).alias("speed"))


@query("cheapest_gpu", "offers", oracle=f""", {WANTED}, p AS (SELECT {CANON} AS gpu_type, dph_total FROM v_offers WHERE {PASSING}), s AS ({SUMMARY.format(src="p")})
SELECT gpu_type FROM s ORDER BY median_price_hr, ord LIMIT 1""")
def cheapest_gpu(v):
    return market.cheapest_type(market.price_summary(v.offers, TYPES))


@query("top_offers", "offers", oracle=f"""SELECT *, {CANON} AS gpu_type, CAST(row_number() OVER (PARTITION BY gpu_name ORDER BY dph_total, offer_id, machine_id) AS INT) AS rank
FROM v_offers WHERE {PASSING} QUALIFY rank <= 20""")
def top_offers(v):
    return market.cheapest_per_type(market.quality_filter(v.offers))


@query("top_k_offers", "offers", oracle=f"""SELECT *, {CANON} AS gpu_type FROM v_offers WHERE {PASSING} ORDER BY dph_total, offer_id, machine_id LIMIT 20""")
def top_k_offers(v):
    return market.cheapest_overall(market.quality_filter(v.offers))


@query("assign_offers", "offers", "units", oracle=f""", u AS (SELECT unit_key, CASE shard_id % 4 WHEN 0 THEN 'RTX_3090' WHEN 1 THEN 'RTX_4090' WHEN 2 THEN 'RTX_5090' ELSE 'A100' END AS gpu_type FROM v_units WHERE status = 'pending'),
 un AS (SELECT *, row_number() OVER (PARTITION BY gpu_type ORDER BY unit_key) AS r FROM u),
 o AS (SELECT {CANON} AS gpu_type, offer_id, machine_id, row_number() OVER (PARTITION BY gpu_name ORDER BY dph_total, offer_id, machine_id) AS rank FROM v_offers WHERE {PASSING}),
 d AS (SELECT *, min(rank) FILTER (machine_id = '') OVER (PARTITION BY gpu_type) AS open_rank FROM o QUALIFY row_number() OVER (PARTITION BY gpu_type, machine_id ORDER BY rank) = 1),
 s AS (SELECT *, row_number() OVER (PARTITION BY gpu_type ORDER BY rank) AS slot FROM d WHERE open_rank IS NULL OR rank <= open_rank)
SELECT un.unit_key, un.gpu_type, s.offer_id, s.machine_id, CASE WHEN s.offer_id IS NOT NULL THEN '' WHEN un.gpu_type NOT IN (SELECT gpu_type FROM o) THEN 'No GPU offers available' ELSE 'no unclaimed offer' END AS error
FROM un LEFT JOIN s ON s.gpu_type = un.gpu_type AND (s.slot = un.r OR (s.rank = s.open_rank AND un.r > s.slot))""")
def assign_offers(v):
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("shard_id") % 4 + 1).cast("int"))
    units = v.units.where("status = 'pending'").select("unit_key", kind.alias("gpu_type"))
    return market.assign(units, market.quality_filter(v.offers))
