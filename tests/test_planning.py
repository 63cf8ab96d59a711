"""Prices, scaling and splits."""

import random
import statistics

from conftest import values
from pyspark.sql import functions as F

from fleetlens.operators import offers as market
from fleetlens.operators import planning
from fleetlens.operators.ordered import exact_median

OFFERS = "offer_id long, machine_id string, gpu_name string, num_gpus int, rentable boolean, cuda_max_good double, dph_total double, inet_down double, reliability double"


def offer(i, price, name="RTX 4090", machine=None, **changes):
    row = dict(offer_id=i, machine_id=f"m{i}" if machine is None else machine, gpu_name=name, num_gpus=1, rentable=True,
               cuda_max_good=12.8, dph_total=price, inet_down=900.0, reliability=0.999)
    return tuple((row | changes).values())


def test_quality_filter_bounds_are_inclusive(spark):
    rows = [
        offer(1, 0.45), offer(2, 0.4501), offer(3, 0.2, inet_down=800.0), offer(4, 0.2, inet_down=799.9), offer(5, 0.2, reliability=0.995),
        offer(6, 0.2, reliability=0.9949), offer(7, 0.2, num_gpus=2), offer(8, 0.2, rentable=False), offer(9, 0.2, cuda_max_good=12.3),
        offer(10, 0.2, name="A100"), offer(11, None),
    ]
    kept = market.quality_filter(spark.createDataFrame(rows, OFFERS))
    assert values(kept, "offer_id") == [(1,), (3,), (5,)]


def test_price_summary_uses_the_exact_median_and_falls_back(spark):
    rng = random.Random(1)
    prices = [round(rng.uniform(0.05, 0.45), 4) for _ in range(501)] + [0.0, None]
    rows = [offer(i, p) for i, p in enumerate(prices)]
    got = {r.gpu_type: r for r in market.price_summary(spark.createDataFrame(rows, OFFERS), ["RTX_4090", "RTX_5090", "H200"]).collect()}
    real = [p for p in prices if p]
    assert got["RTX_4090"][2:] == (501, min(real), max(real), statistics.median(real))
    assert got["RTX_5090"][2:] == (0, 0.6, 0.6, 0.6)
    assert got["H200"][2:] == (0, 0.3, 0.3, 0.3)


def test_the_image_sets_the_cuda_version(spark):
    from fleetlens.plans.estimate import estimate

    rows = [offer(1, 0.2), offer(2, 0.1)]
    market_rows = spark.createDataFrame(rows, OFFERS).withColumn("cuda_max_good", F.when(F.col("offer_id") == 1, 12.8).otherwise(12.4))
    work = spark.createDataFrame([(1, 10.0, "RTX_4090")], "workload_id long, work_hours double, cloud_gpu_type string")
    cost = lambda **kw: estimate(market_rows, work, [1], **kw).first().cloud_cost_min
    assert (cost(), cost(image="a/b:cuda-12.8"), cost(image="a/b:1")) == (0.5, 1.0, 0.5)


def test_exact_median_with_a_hot_key_and_ties(spark):
    rng = random.Random(5)
    rows = [("hot", rng.choice([1.0, 2.0, 2.5])) for _ in range(3000)] + [(f"k{rng.randint(0, 40)}", rng.uniform(-5, 5)) for _ in range(900)]
    got = {r.k: (r["count"], r["min"], r["max"], r["median"]) for r in exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    assert got == {k: (len(v), min(v), max(v), statistics.median(v)) for k, v in groups.items()}


def test_cheapest_type_takes_the_first_on_ties_and_has_a_default(spark):
    prices = spark.createDataFrame([(0, "A", 0.2), (1, "B", 0.1), (2, "C", 0.1)], "ord int, gpu_type string, median_price_hr double")
    assert market.cheapest_type(prices).first().gpu_type == "B"
    assert market.cheapest_type(prices.where("false")).first().gpu_type == "RTX_4090"


def test_scaling_table(spark):
    work = spark.createDataFrame([(1, 10.0, "RTX_4090")], "workload_id long, work_hours double, cloud_gpu_type string")
    prices = spark.createDataFrame([("RTX_4090", 0.2, 0.4)], "gpu_type string, min_price_hr double, max_price_hr double")
    rows = planning.scaling_table(work, prices, [0, 4], cost_band=(0.5, 2.0)).orderBy("cloud_gpus").collect()
    assert (rows[0].wall_time_hours, rows[0].cloud_cost_max, rows[0].notes) == (10.0, 0.0, "local only")
    assert (rows[1].wall_time_hours, rows[1].cloud_cost_min, rows[1].cloud_cost_max) == (2.0, 8 * 0.2 * 0.5, 8 * 0.4 * 2.0)


def test_hybrid_split_cases(spark):
    rows = [(100, 4, "RTX_3090", ""), (100, 4, "RTX_4090", ""), (10, 3, "RTX_4090", "C"), (1, 4, "RTX_4090", "H"), (50, 0, "RTX_4090", ""), (50, 4, "RTX_4090", "L"), (2, 1, "none", "H")]
    frame = spark.createDataFrame(rows, "total_items int, cloud_gpus int, cloud_gpu_type string, mode string")
    got = [(r.mode, r.local_items, r.cloud_items, r.cloud_gpus, r.items_per_shard) for r in planning.hybrid_split(frame).collect()]
    assert got == [
        ("H", 25, 75, 4, [19, 19, 19, 18]), ("H", 20, 80, 4, [20] * 4), ("C", 0, 10, 3, [4, 3, 3]), ("H", 1, 0, 4, [0] * 4),
        ("L", 50, 0, 0, []), ("L", 50, 0, 0, []), ("H", 1, 1, 1, [1]),
    ]


def test_hybrid_split_conserves_items(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 500), rng.randint(0, 12), rng.choice(["RTX_3090", "RTX_5090", "x"]), rng.choice(["", "C", "H", "L"])) for _ in range(500)]
    frame = spark.createDataFrame(rows, "total_items int, cloud_gpus int, cloud_gpu_type string, mode string")
    for r in planning.hybrid_split(frame).collect():
        assert r.local_items + r.cloud_items == r.total_items
        assert sum(r.items_per_shard) == r.cloud_items
        assert r.items_per_shard == sorted(r.items_per_shard, reverse=True)
        assert not r.items_per_shard or r.items_per_shard[0] - r.items_per_shard[-1] <= 1
        if r.mode == "H" and r.total_items > 1:
            assert r.cloud_items >= 1


def test_assign_items_gives_even_shards_for_a_hot_batch(spark):
    items = spark.range(10_003).select(F.when(F.col("id") < 9_000, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 5)).alias("batch_id"), F.col("id").cast("string").alias("item_id"))
    placed = planning.assign_items(items, 7)
    sizes = {}
    for r in placed.groupBy("batch_id", "shard_id").count().collect():
        sizes.setdefault(r.batch_id, {})[r.shard_id] = r["count"]
    for batch, total in [(r.batch_id, r["count"]) for r in items.groupBy("batch_id").count().collect()]:
        want = [total // 7 + (1 if i < total % 7 else 0) for i in range(7)]
        assert [sizes[batch].get(i, 0) for i in range(7)] == want


def test_fewer_items_than_shards(spark):
    items = spark.createDataFrame([("b", "x"), ("b", "y")], "batch_id string, item_id string")
    assert sorted(r.shard_id for r in planning.assign_items(items, 7).collect()) == [0, 1]


def assign(spark, offers, n_units, **kwargs):
    frame = spark.createDataFrame(offers, OFFERS).withColumn("gpu_type", F.lit("RTX_4090"))
    units = spark.createDataFrame([(f"u{i:03d}", "RTX_4090") for i in range(n_units)], "unit_key string, gpu_type string")
    return [(r.unit_key, r.offer_id, r.error) for r in market.assign(units, frame, **kwargs).orderBy("unit_key").collect()]


def brute_force_assign(offers, n_units):
    ordered = sorted(offers, key=lambda o: (o[6], o[0], o[1]))
    taken, out = set(), []
    for i in range(n_units):
        got = next((o for o in ordered if not o[1] or o[1] not in taken), None)
        if got is not None and got[1]:
            taken.add(got[1])
        out.append((f"u{i:03d}", got[0] if got else None, "" if got else "no unclaimed offer"))
    return out


def test_assign_equals_one_unit_after_the_other(spark):
    rng = random.Random(11)
    for trial in range(6):
        offers = [offer(i, rng.choice([0.1, 0.2, 0.3]), machine=rng.choice(["a", "b", "c", "d", "" if trial % 2 else "e"])) for i in range(12)]
        assert assign(spark, offers, 9) == brute_force_assign(offers, 9)


def test_assign_uses_every_machine(spark):
    offers = [offer(i, 0.1 + 0.001 * (i % 40), machine=f"m{i}") for i in range(300)]
    got = assign(spark, offers, 250)
    assert got == brute_force_assign(offers, 250) and not any(error for _, _, error in got)


def test_assign_without_offers_of_the_type(spark):
    frame = spark.createDataFrame([offer(1, 0.1)], OFFERS).withColumn("gpu_type", F.lit("RTX_4090"))
    units = spark.createDataFrame([("u", "H200")], "unit_key string, gpu_type string")
    assert market.assign(units, frame).first().error == "No GPU offers available"


def test_offers_from_market_answers(spark):
    raw = ['[{"id": 1, "machine_id": 9, "dph_total": 0.5, "new_field": [1]}, {"id": 2}]', "not json", '{"a": 1}', "null", "[]"]
    rows = market.parse_offers(spark.createDataFrame([(r,) for r in raw], "raw string"))
    assert values(rows, "offer_id", "machine_id", "dph_total") == [(1, "9", 0.5), (2, "", None)]
