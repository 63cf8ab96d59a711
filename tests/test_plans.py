"""Plan shapes that must hold at scale."""

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from fleetlens.catalog import QUERIES
from fleetlens.operators import fleet, objects, units
from fleetlens.operators import offers as market

PYTHON = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def explain(df, mode="formatted"):
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_everything_or_leaves_the_jvm(spark, name):
    text = explain(QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text
    if name != "run_workload":
        assert not any(p in text for p in PYTHON)


@pytest.fixture(scope="module")
def market_files(spark, views, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("offers"))
    views.offers.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_offer_filter_reaches_the_scan(market_files):
    text = explain(market.quality_filter(market_files).select("offer_id", "dph_total"))
    scan = text[text.index("PushedFilters") :]
    for part in ("In(gpu_name", "EqualTo(num_gpus,1)", "EqualTo(rentable,true)", "LessThanOrEqual(dph_total,0.45)", "GreaterThanOrEqual(reliability"):
        assert part in scan
    assert "machine_id" not in scan[scan.index("ReadSchema") :].splitlines()[0]


def test_cheapest_per_type_is_cut_before_the_shuffle(market_files):
    text = explain(market.cheapest_per_type(market.quality_filter(market_files)), "simple")
    assert text.count("WindowGroupLimit") == 2
    assert text.rindex("WindowGroupLimit") > text.index("Exchange hashpartitioning")


def test_top_k_needs_no_full_sort(market_files):
    assert "TakeOrderedAndProject" in explain(market.cheapest_overall(market.quality_filter(market_files)))


def test_state_fold_combines_before_the_shuffle(views):
    text = explain(units.current_state(views.unit_events), "simple")
    assert "partial_max_by" in text and "Window" not in text


def test_listing_totals_are_partial(views):
    text = explain(fleet.fleet_totals(views.instances.withColumn("owned", F.lit(True))), "simple")
    assert "partial_sum" in text


def test_expiring_objects_join_on_equality(spark, views):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = explain(objects.expiring_objects(views.bucket_objects, views.rules), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "NestedLoop" not in text


def test_median_reads_its_input_once(spark, market_files):
    df = market.price_summary(market_files)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


def test_zombies_use_an_anti_join(views):
    assert "LeftAnti" in explain(fleet.zombies(views.instances, views.units), "simple")
