"""Places where results differ on purpose from the behaviour this engine follows."""

import json

from conftest import evaluate, values
from pyspark.sql import functions as F

from fleetlens.functions import fmt
from fleetlens.functions import json_values as J
from fleetlens.operators import cleanup, objects, units
from fleetlens.operators import offers as market
from fleetlens.sources import readers

DESTROY = "instance_id string, stop_status int, stop_error string, delete_statuses array<string>, verify1 string, verify1_error string, verify2 string, verify2_error string"


def test_deviation_budget_sees_real_spend(views):
    spent = units.current_spend(views.units, F.lit("2003-01-01T00:00:00+00:00"))
    status = spent.select(units.budget_status(F.col("spent"), F.lit(0.01)).alias("s")).distinct().collect()
    assert [r.s for r in status] == ["exceeded"]


def test_deviation_uncredited_deletes_are_unknown_not_an_error(spark):
    rows = [("a", 200, None, ["raise"] * 3, "gone", None, "gone", None), ("b", 200, None, ["raise"] * 3, "present", None, "gone", None)]
    got = cleanup.destroy_verdict(spark.createDataFrame(rows, DESTROY))
    assert values(got, "instance_id", "verdict", "attempts", "verify_error") == [
        ("a", "unknown", 0, "no delete attempt returned"), ("b", "unknown", 0, "no delete attempt returned"),
    ]


def test_deviation_chunks_sort_by_number(spark):
    chunks = spark.createDataFrame([("f", i, bytes([i % 7])) for i in (999, 1000, 1001, 2)], "file_id string, chunk_index long, content binary")
    assert [r.chunk_index for r in objects.consolidate(chunks).orderBy("offset").collect()] == [2, 999, 1000, 1001]


def test_deviation_json_line_that_is_no_object_is_dropped(spark):
    lines = spark.createDataFrame([("[1]",), ("5",), ('"md"',), (json.dumps({"workload": "md"}),)], "value string")
    assert readers.parse_calibration(lines, "md").count() == 1


def test_deviation_unreadable_shard_directory_is_ignored(spark):
    keys = [("b", f"r/x/shard_{s}/DONE", 1) for s in ("7", "seven", "1_0")]
    frame = spark.createDataFrame(keys, "bucket string, key string, size long")
    assert values(objects.done_shards(frame, "r"), "shard_id") == [(7,)]


def test_deviation_unit_without_claim_has_an_error_text(spark):
    offers = spark.createDataFrame([(1, "m", "RTX_4090", 0.1)], "offer_id long, machine_id string, gpu_type string, dph_total double")
    rows = spark.createDataFrame([("a", "RTX_4090"), ("b", "RTX_4090")], "unit_key string, gpu_type string")
    assert values(market.assign(rows, offers), "unit_key", "error") == [("a", ""), ("b", "no unclaimed offer")]


def test_deviation_naive_time_is_utc(spark):
    texts = ["2024-01-01T10:00:00", "2024-01-01T12:00:00+02:00", "2024-01-01 10:00:00", "2024-01-01T10:00:00Z", "2024-01-01", "", "soon"]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = evaluate(spark, texts, lambda x: F.unix_seconds(fmt.instant(x)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1704103200] * 4 + [1704067200, None, None]


def test_deviation_duplicate_keys_and_nan_are_malformed(spark):
    assert evaluate(spark, ['{"id": 1, "id": 2}', '{"id": NaN}'], lambda x: J.is_object(J.parse(x))) == [False, False]
