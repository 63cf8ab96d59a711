"""Ordered helpers against pandas, with one key holding most of the rows."""

import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from fleetlens.operators import ordered
from fleetlens.operators.ordered import Running, exact_median, hashed_rank, positions, running, sliced


def events(spark, n=4000):
    rng = random.Random(2)
    rows = [
        ("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 20)}", pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=rng.randint(0, 400_000)), i, rng.randint(-5, 50))
        for i in range(n)
    ]
    frame = pd.DataFrame(rows, columns=["k", "ts", "id", "v"])
    return frame, spark.createDataFrame(frame)


def test_running_sum_and_max_match_pandas(spark):
    frame, df = events(spark)
    specs = [
        Running("total", "sum", F.col("v")), Running("before", "sum", F.col("v"), include_current=False),
        Running("peak", "max", F.col("v")), Running("peak_before", "max", F.col("v"), include_current=False),
    ]
    got = running(df, ["k"], "ts", ["id"], specs, slice_seconds=9_000).toPandas().sort_values("id").reset_index(drop=True)
    want = frame.sort_values(["k", "ts", "id"]).copy()
    by = want.groupby("k")["v"]
    want["total"], want["peak"] = by.cumsum(), by.cummax()
    want["before"] = want["total"] - want["v"]
    want["peak_before"] = want.groupby("k")["peak"].shift()
    want = want.sort_values("id").reset_index(drop=True)
    for column in ("total", "before", "peak"):
        assert (got[column] == want[column]).all()
    assert got["peak_before"].isna().equals(want["peak_before"].isna())
    assert (got["peak_before"].fillna(-99) == want["peak_before"].fillna(-99)).all()


def test_the_hot_key_is_cut_into_many_window_groups(spark):
    _, df = events(spark)
    groups = df.groupBy("k", F.floor(F.unix_seconds("ts") / 9_000)).count()
    assert groups.agg(F.max("count")).first()[0] < df.where("k = 'hot'").count() / 10


def test_hashed_rank_counts_each_key_without_gaps(spark):
    _, df = events(spark)
    ranked = hashed_rank(df.select("k", "id"), ["k"], "id")
    check = ranked.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.max("group_size").alias("size"))
    for r in check.collect():
        assert (r.lo, r.hi, r.d, r["size"]) == (1, r.n, r.n, r.n)


def burst(spark, n=3000):
    """All events of one key inside one second, a third of them at one instant."""
    rng = random.Random(7)
    rows = [("hot", pd.Timestamp("2024-01-01") + pd.Timedelta(microseconds=rng.choice([5, rng.randint(0, 999_999)])), i, rng.randint(0, 9)) for i in range(n)]
    rows += [("cold", pd.Timestamp("2024-01-01"), n + i, 1) for i in range(10)]
    frame = pd.DataFrame(rows, columns=["k", "ts", "id", "v"])
    return frame, spark.createDataFrame(frame)


def test_a_burst_is_cut_into_small_window_groups(spark):
    frame, df = burst(spark)
    cut = sliced(df.withColumn("_slice", F.lit(0)), ["k"], ["ts", "id"], [F.sum("v").alias("s")], rows=100)
    sizes = cut.rows.groupBy("_group").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    assert sizes.agg(F.max("n")).first()[0] < 400 and sizes.where("_group.k = 'cold'").count() == 1
    assert sorted(map(tuple, sizes.select("_group", "n", "s").collect())) == sorted(map(tuple, cut.totals.select("_group", "_rows", "s").collect()))
    got = running(df, ["k"], "ts", ["id"], [Running("total", "sum", F.col("v"))], heavy_rows=100).toPandas().sort_values("id").reset_index(drop=True)
    want = frame.sort_values(["k", "ts", "id"]).copy()
    want["total"] = want.groupby("k")["v"].cumsum()
    assert (got["total"] == want.sort_values("id").reset_index(drop=True)["total"]).all()


def test_heavy_slices_keep_ranks_and_crossings(spark, monkeypatch):
    from fleetlens.operators import units

    frame, df = burst(spark)
    spend = df.selectExpr("k AS batch_id", "ts", "id AS event_id", "CAST(v AS DOUBLE) AS amount")
    want = units.spend_crossings(spend, 5000.0).orderBy("batch_id").collect()
    ranks = hashed_rank(df, ["k"], "id").select("id", "rank").orderBy("id").collect()
    monkeypatch.setattr(ordered, "HEAVY_ROWS", 50)
    assert units.spend_crossings(spend, 5000.0).orderBy("batch_id").collect() == want
    assert hashed_rank(df, ["k"], "id").select("id", "rank").orderBy("id").collect() == ranks


def test_positions_follow_the_number(spark):
    rng = random.Random(3)
    rows = [("a" if rng.random() < 0.8 else "b", rng.choice([5, -3, 10**6, i]), i) for i in range(500)]
    got = {r.id: r.position for r in positions(spark.createDataFrame(rows, "k string, n long, id long"), ["k"], "n", ties=["id"]).collect()}
    for key in "ab":
        own = sorted((n, i) for k, n, i in rows if k == key)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))


def test_median_with_outliers_reads_few_values_in_order(spark):
    rng = random.Random(1)
    rows = [("k", rng.uniform(0, 1)) for _ in range(2001)] + [("k", 1e300), ("k", float("inf")), ("k", -1e300), ("one", 4.0), ("two", 1.0), ("two", 2.0)]
    got = {r.k: r.median for r in exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    values = sorted(v for k, v in rows if k == "k")
    assert got == {"k": (values[1001] + values[1002]) / 2 if len(values) % 2 == 0 else values[len(values) // 2], "one": 4.0, "two": 1.5}


def test_null_keys_idents_and_times_keep_their_rows(spark):
    rows = [("a", "x"), ("a", None), (None, "y"), ("a", "z"), (None, None), (None, None)]
    ranked = hashed_rank(spark.createDataFrame(rows, "k string, id string"), ["k"], "id").collect()
    assert sorted((r.k or "-", r.id or "-") for r in ranked) == sorted((k or "-", i or "-") for k, i in rows)
    assert sorted((r.k or "-", r.rank, r.group_size) for r in ranked) == [(k, i, 3) for k in "-a" for i in (1, 2, 3)]
    assert {r.rank for r in ranked if r.k == "a" and r.id is None} == {1}
    day = datetime.datetime(2024, 1, 1)
    events = [(None, day, 1, 3), (None, day + datetime.timedelta(days=3), 2, 4), (None, None, 3, 10), ("k", day, 4, None), ("k", day, 5, 1)]
    df = spark.createDataFrame(events, "k string, ts timestamp, id int, v int")
    total = [Running("total", "sum", F.col("v"))]
    for heavy in (None, 1):
        got = {r.id: r.total for r in running(df, ["k"], "ts", ["id"], total, heavy_rows=heavy).collect()}
        assert got == {3: 10, 1: 13, 2: 17, 4: 0, 5: 1}


def test_a_burst_of_one_equal_row_is_counted_and_not_collected(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HEAVY_ROWS", 40)
    day = datetime.datetime(2024, 1, 1)
    rows = [("hot", day, 7, 1)] * 2000 + [("hot", day + datetime.timedelta(seconds=i), i, 1) for i in range(1, 300)] + [(None, day, 0, 5)] * 90
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, v int")
    cut = sliced(df.withColumn("_slice", F.lit(0)), ["k"], ["ts", "id"], [])
    sizes = sorted(r["count"] for r in cut.rows.groupBy("_group").count().collect())
    assert sizes[-1] <= 2050 and sum(sizes) == len(rows) and len(sizes) > 5
    got = running(df, ["k"], "ts", ["id"], [Running("total", "sum", F.col("v"))]).collect()
    assert sorted(r.total for r in got if r.k == "hot") == list(range(1, 2300))
    assert sorted(r.total for r in got if r.k is None) == [5 * i for i in range(1, 91)]


def test_running_reads_its_input_once_for_totals_and_once_for_rows(spark, folder):
    _, df = events(spark)
    df.write.parquet(f"{folder}/events")
    got = running(spark.read.parquet(f"{folder}/events"), ["k"], "ts", ["id"], [Running("total", "sum", F.col("v"))])
    scans = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert sum(f"{folder}/events" in s for s in scans) == 1 and len(scans) == 2
