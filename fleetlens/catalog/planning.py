"""Queries over workloads."""

from pyspark.sql import functions as F

from fleetlens.catalog.offers import CANON, PASSING
from fleetlens.catalog.registry import query
from fleetlens.operators import offers as market
from fleetlens.operators import planning
from fleetlens.plans.estimate import estimate

PRICES = f"""p AS (SELECT {CANON} AS gpu_type, min(dph_total) AS lo, max(dph_total) AS hi, median(dph_total) AS mid, count(*) AS cnt FROM v_offers WHERE {PASSING} AND dph_total <> 0 GROUP BY ALL)"""
SPEED = "CAST(CASE {c} WHEN 'RTX_3090' THEN 0.77 WHEN 'RTX_5090' THEN 1.43 ELSE 1 END AS DOUBLE)"
STATIC = "CAST(CASE {c} WHEN 'RTX_3090' THEN 0.15 WHEN 'RTX_4090' THEN 0.32 WHEN 'RTX_5090' THEN 0.60 ELSE 0.30 END AS DOUBLE)"
SCALE = f""", w AS (SELECT workload_id, work_hours, {{kind}} AS t, unnest([0, 2, 4, 8, 16]) AS n FROM v_workloads),
 c AS (SELECT w.*, work_hours / (CAST(1 AS DOUBLE) + n * {SPEED.format(c="t")}) AS wall, coalesce(lo, {STATIC.format(c="t")}) AS lo, coalesce(hi, {STATIC.format(c="t")}) AS hi FROM w LEFT JOIN p ON p.gpu_type = t)"""
SCALE_ROWS = """SELECT workload_id, n AS cloud_gpus, CASE WHEN n > 0 THEN t ELSE 'RTX_4090' END AS cloud_gpu_type, wall AS wall_time_hours,
  wall * n * lo * {a} AS cloud_cost_min, wall * n * hi * {b} AS cloud_cost_max, CASE WHEN n = 0 THEN 'local only' ELSE '' END AS notes, true AS feasible FROM c"""


@query("scaling_table", "workloads", "offers", oracle=f", {PRICES}" + SCALE.format(kind="cloud_gpu_type") + SCALE_ROWS.format(a="CAST(0.83 AS DOUBLE)", b="CAST(1.26 AS DOUBLE)"))
def scaling_table(v):
    prices = market.price_summary(v.offers)
    return planning.scaling_table(v.workloads, prices, cost_band=(0.83, 1.26))


@query("estimate", "workloads", "offers", oracle=f""", {PRICES}, best AS (SELECT gpu_type FROM p ORDER BY mid, gpu_type LIMIT 1)"""
    + SCALE.format(kind="CASE WHEN cloud_gpu_type = 'A100' THEN (SELECT gpu_type FROM best) ELSE cloud_gpu_type END") + SCALE_ROWS.format(a="1", b="1"))
def estimate_query(v):
    asked = F.nullif("cloud_gpu_type", F.lit("A100")).alias("cloud_gpu_type")
    return estimate(v.offers, v.workloads.select("workload_id", "work_hours", asked))


def places(value, n):
    return f"CAST(round(CAST({value} AS DECIMAL(28,12)), {n}) AS DECIMAL(18,{n}))"


PRICING = f"""q AS (SELECT string_agg(concat_ws(':', w.gpu_type, coalesce(cnt, 0), {places("coalesce(lo, CAST(fb AS DOUBLE))", 3)}, {places("coalesce(hi, CAST(fb AS DOUBLE))", 3)}, {places("coalesce(mid, CAST(fb AS DOUBLE))", 3)}), ',' ORDER BY ord) AS pricing
 FROM (VALUES (0, 'RTX_3090', 0.15), (1, 'RTX_4090', 0.32), (2, 'RTX_5090', 0.60)) w(ord, gpu_type, fb) LEFT JOIN p ON p.gpu_type = w.gpu_type)"""
LOW, HIGH = places("wall * n * lo", 2), places("wall * n * hi", 2)


@query("estimate_report", "workloads", "offers", oracle=f", {PRICES}" + SCALE.format(kind="cloud_gpu_type") + f""", {PRICING}
SELECT workload_id, n AS cloud_gpus, CASE WHEN n > 0 THEN t ELSE 'RTX_4090' END AS cloud_gpu_type, CAST({places("wall", 3)} AS DOUBLE) AS wall_time_hours, CAST({LOW} AS DOUBLE) AS cloud_cost_min, CAST({HIGH} AS DOUBLE) AS cloud_cost_max,
 CASE WHEN n = 0 THEN '$0.00' WHEN abs(wall * n * lo - wall * n * hi) < 0.01 THEN '$' || {LOW} ELSE '$' || {LOW} || '-$' || {HIGH} END AS cost_display, pricing FROM c, q""")
def estimate_report(v):
    """The documents, read back: one row per scaling row with the prices as text."""
    schema = """pricing array<struct<gpu_type: string, available_count: bigint, min_price_hr: double, max_price_hr: double, median_price_hr: double>>,
     scaling_table array<struct<cloud_gpus: int, cloud_gpu_type: string, wall_time_hours: double, cloud_cost_min: double, cloud_cost_max: double, cost_display: string>>"""
    doc = report_documents(v).withColumn("d", F.from_json("document", schema))

    def price(p):
        shown = [p[c].cast("decimal(18,3)").cast("string") for c in ("min_price_hr", "max_price_hr", "median_price_hr")]
        return F.concat_ws(":", p["gpu_type"], p["available_count"].cast("string"), *shown)

    pricing = F.array_join(F.transform("d.pricing", price), ",").alias("pricing")
    return doc.select("workload_id", pricing, F.inline("d.scaling_table"))


def report_documents(v):
    prices = market.price_summary(v.offers)
    return planning.estimate_report(v.workloads, prices, as_of="2024-01-01T00:00:00+00:00")


@query("estimate_report_rows", "workloads", "offers", oracle=f", {PRICES}" + SCALE.format(kind="cloud_gpu_type") + """
SELECT workload_id, n AS cloud_gpus, CASE WHEN n > 0 THEN t ELSE 'RTX_4090' END AS cloud_gpu_type, CASE WHEN n = 0 THEN 'local only' ELSE '' END AS notes, CAST((SELECT count(*) FROM p) AS INT) AS prices,
 CASE WHEN wall >= 1 THEN CAST(CAST(floor(wall) AS INT) AS VARCHAR) || 'h ' || lpad(CAST(CAST(floor((wall - floor(wall)) * 60) AS INT) AS VARCHAR), 2, '0') || 'm' ELSE CAST(CAST(floor(wall * 60) AS INT) AS VARCHAR) || 'm' END AS wall_time_human FROM c""")
def estimate_report_rows(v):
    schema = "pricing array<struct<gpu_type: string>>, scaling_table array<struct<cloud_gpus: int, cloud_gpu_type: string, wall_time_human: string, notes: string>>"
    doc = report_documents(v).withColumn("d", F.from_json("document", schema))
    rows = doc.select("workload_id", F.size("d.pricing").alias("prices"), F.explode("d.scaling_table").alias("r"))
    return rows.select("workload_id", "prices", "r.*")


@query("hybrid_split", "workloads", oracle=f""", a AS (SELECT *, CASE WHEN cloud_gpus = 0 OR mode = 'L' THEN 'L' WHEN mode = '' THEN 'H' ELSE mode END AS m,
   CAST(ceil(total_items * (CAST(1 AS DOUBLE) / (1 + cloud_gpus * {SPEED.format(c="cloud_gpu_type")}))) AS INT) AS cut FROM v_workloads),
 b AS (SELECT *, CASE m WHEN 'L' THEN total_items WHEN 'C' THEN 0 ELSE CASE WHEN cut = total_items AND total_items > 1 THEN total_items - 1 ELSE cut END END AS li FROM a)
SELECT workload_id, m AS mode, li AS local_items, total_items - li AS cloud_items, CASE WHEN m = 'L' THEN 0 ELSE cloud_gpus END AS cloud_gpus,
  CASE WHEN m = 'L' THEN '' ELSE array_to_string(list_transform(range(cloud_gpus), lambda i: (total_items - li) // cloud_gpus + CASE WHEN i < (total_items - li) % cloud_gpus THEN 1 ELSE 0 END), ',') END AS sizes FROM b""")
def hybrid_split(v):
    split = planning.hybrid_split(v.workloads)
    sizes = F.array_join(F.transform("items_per_shard", lambda x: x.cast("string")), ",")
    return split.select("workload_id", "mode", "local_items", "cloud_items", "cloud_gpus", sizes.alias("sizes"))


@query("assign_items_to_shards", "items", oracle="""SELECT batch_id, item_id, CAST(ntile(7) OVER (PARTITION BY batch_id ORDER BY substr(md5(item_id), 1, 3), item_id) - 1 AS INT) AS shard_id FROM v_items""")
def assign_items_to_shards(v):
    return planning.assign_items(v.items, 7)
