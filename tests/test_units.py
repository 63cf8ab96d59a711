"""Units, state documents, polling and workloads."""

import datetime
import json

import pandas as pd
import pytest
from conftest import evaluate, values
from pyspark.sql import functions as F

from fleetlens.functions import json_values as J
from fleetlens.operators import polling, state, units
from fleetlens.operators.workload import run_workload

UNIT = "batch_id string, kind string, unit_key string, status string, instance_id string"


def test_status_classes(spark):
    known = ("pending", "deployed", "deploying", "running", "completed", "downloaded", "destroyed", "failed")
    rows = [("shard", s) for s in known] + [("job", s) for s in known] + [("job", "odd")]
    got = spark.createDataFrame(rows, "k string, s string").select(units.status_class(F.col("k"), F.col("s")).alias("c")).collect()
    assert [r.c for r in got] == [
        "pending", "active", "other", "active", "other", "done", "done", "failed",
        "pending", "other", "active", "active", "completed", "done", "other", "failed", "other",
    ]


def test_archivable_needs_units_and_no_unknown_status(spark):
    rows = [("a", "shard", "downloaded"), ("a", "shard", "failed"), ("b", "shard", "completed"), ("c", "job", "completed"), ("d", "shard", None),
            ("e", "shard", "running"), ("f", "job", "destroyed")]
    frame = spark.createDataFrame(rows, "batch_id string, kind string, status string")
    assert values(units.archivable(frame), "batch_id") == [("a",), ("c",)]


def jobs(spark, *rows):
    return spark.createDataFrame(rows, "batch_id string, submit_time string, complete_time string, cost_per_hour double")


def test_job_costs(spark):
    frame = jobs(spark, ("b", "2024-01-01T10:00:00+00:00", "2024-01-01T12:00:00+00:00", 0.30), ("b", "2024-01-01T11:00:00+00:00", "", 0.30), ("b", "", "", 5.0))
    as_of = F.lit("2024-01-01T12:00:00+00:00")
    assert [r.cost_usd for r in units.job_cost(frame, as_of).collect()] == [0.6, 0.3, 0.0]
    assert units.batch_cost(frame, as_of).first().cost_usd == pytest.approx(0.9, abs=1e-12)


@pytest.mark.parametrize(("spent", "ceiling", "want"), [(0, 0, "unlimited"), (5, -1, "unlimited"), (7.99, 10, "ok"), (8, 10, "warning"), (10, 10, "exceeded"), (11, 10, "exceeded")])
def test_budget_status(spark, spent, ceiling, want):
    got = spark.range(1).select(units.budget_status(F.lit(float(spent)), F.lit(float(ceiling))).alias("s")).first().s
    assert got == want


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


EVENT = "event_id long, unit_key string, ts timestamp, event string, reason string, instance_id string, cost_per_hour double"


def events(spark, *rows):
    return spark.createDataFrame([(i, u, at(m), e, "lost", f"i{i}", 0.5) for i, (u, m, e) in enumerate(rows)], EVENT)


def test_state_fold(spark):
    frame = events(spark, ("a", 0, "deployed"), ("a", 1, "preempted"), ("a", 2, "deployed"), ("a", 3, "completed"), ("b", 0, "deployed"), ("b", 1, "preempted"), ("c", 0, "deployed"), ("c", 0, "failed"))
    assert values(units.current_state(frame), "unit_key", "status", "instance_id", "retry_count", "failure_reason") == [
        ("a", "downloaded", "i2", 1, ""), ("b", "pending", "", 1, ""), ("c", "failed", "i6", 1, "lost"),
    ]


def test_retry_count_excludes_the_event_itself(spark):
    frame = events(spark, ("a", 0, "preempted"), ("a", 1, "preempted"), ("a", 2, "preempted"), ("b", 0, "failed"), ("b", 1, "preempted"))
    got = values(units.retry_verdicts(frame), "event_id", "retries_before", "verdict", "failure_reason")
    assert got == [(0, 0, "preempted", ""), (1, 1, "preempted", ""), (2, 2, "failed", "lost (retries exhausted)"), (4, 1, "preempted", "")]
    fatal = units.retry_verdicts(frame, classify=lambda r: F.lit("fatal"))
    assert values(fatal, "event_id", "failure_reason")[0] == (0, "lost (fatal)")


def test_classifier_may_be_a_pandas_function(spark):
    @F.pandas_udf("string")
    def classify(reason: pd.Series) -> pd.Series:
        return reason.map(lambda r: "fatal" if "lost" in r else "retry")

    got = units.retry_verdicts(events(spark, ("a", 0, "preempted")), classify=classify)
    assert got.first().verdict == "failed"


def test_deploy_attempts(spark):
    rows = [("a", 0, "m1", True, True, False, True, True), ("a", 1, "m2", True, True, True, True, True), ("a", 2, "m3", False, True, True, True, True),
            ("b", 0, "m1", True, False, False, True, True), ("b", 1, "m2", True, True, True, True, None), ("d", 0, "m1", False, False, False, False, False), ("d", 3, "m9", True, True, True, True, True)]
    frame = spark.createDataFrame(rows, "unit_key string, attempt int, machine_id string, boot_ok boolean, gpu_ok boolean, files_ok boolean, env_ok boolean, launch_ok boolean")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "unit_key string")
    assert values(units.deploy_outcome(frame, asked), "unit_key", "success", "success_attempt", "machine_id", "error") == [
        ("a", True, 1, "m2", ""), ("b", False, None, None, "Worker launch failed (attempt 2)"), ("c", False, None, None, "No GPU offers available"), ("d", True, 3, "m9", ""),
    ]


def test_one_missing_file_voids_the_unit(spark):
    required = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (4, "a")], "shard_id long, name string")
    collected = spark.createDataFrame([(1, "x/a"), (1, "y/c"), (2, "deep/er/a"), (3, "z")], "shard_id long, rel_path string")
    assert values(units.missing_files(required, collected), "shard_id", "name") == [(1, "b"), (4, "a")]
    assert values(units.critical_files(required, collected), "shard_id", "files", "missing", "accepted_files") == [(1, 2, 1, 0), (2, 1, 0, 1), (3, 1, 0, 1), (4, 0, 1, 0)]


# (first marker read, probe, second marker read) -> action; None is a failed read or probe
DECISIONS = [
    (True, "{}", False, "complete"), (True, None, None, "complete"), (None, '{"complete": true}', None, "complete"), (None, "{}", None, "continue"),
    (False, None, False, "continue"), (False, '{"complete": true, "worker_dead": true}', False, "complete"), (False, '{"worker_dead": true, "log_tail": "x"}', False, "preempt"),
    (False, '{"worker_dead": true}', True, "complete"), (False, '{"worker_dead": true}', None, "continue"), (False, '{"log_tail": "busy"}', False, "continue"),
    (False, '"text"', False, "continue"), (None, '{"worker_dead": 1}', False, "preempt"),
]


def test_unit_action_decisions(spark):
    frame = spark.createDataFrame([d[:3] for d in DECISIONS], "m boolean, raw string, again boolean")
    probe = F.when(F.col("raw").isNotNull(), polling.snapshot(J.parse(F.col("raw"))))
    got = frame.withColumn("p", probe).select(polling.unit_action(F.col("m"), F.col("p"), F.col("again")).alias("a")).collect()
    assert [r.a.action for r in got] == [d[3] for d in DECISIONS]
    assert [(r.a.cause, r.a.detail) for r in got if r.a.action == "preempt"] == [("worker_died", "x"), ("worker_died", "")]


def test_snapshot_of_odd_answers(spark):
    raw = ["null", '"s"', "5", "[1]", '{"complete": "yes", "worker_dead": 1}', '{"complete": "", "worker_dead": 0, "log_tail": 7}', "{bad"]
    got = evaluate(spark, raw, lambda x: polling.snapshot(J.parse(x)))
    assert [tuple(g) for g in got] == [(False, False, "")] * 4 + [(True, True, ""), (False, False, ""), (False, False, "")]


def test_follows_within_equals_trying_all_pairs(spark):
    import random

    rng = random.Random(4)
    left = [(i, "hot" if rng.random() < 0.5 else f"k{i % 7}", at(rng.randint(0, 3000))) for i in range(400)]
    right = [("hot" if rng.random() < 0.3 else f"k{rng.randint(0, 7)}", at(rng.randint(0, 3000))) for _ in range(120)]
    a = spark.createDataFrame(left, "i int, k string, ts timestamp")
    b = spark.createDataFrame(right, "k string, mark timestamp")
    for strict in (False, True):
        got = {r.i: r.followed for r in polling.follows_within(a, b, "k", "ts", "mark", 1800, strict=strict).collect()}
        wait = datetime.timedelta(seconds=1800)
        want = {i: any(rk == k and (ts < m if strict else ts <= m) and m <= ts + wait for rk, m in right) for i, k, ts in left}
        assert got == want


def test_unit_verdicts(spark):
    rows = [("continue", True), ("preempt", True), ("complete", True), ("complete", False), ("complete", None)]
    got = spark.createDataFrame(rows, "a string, c boolean").select(units.unit_verdict(F.col("a"), F.col("c")).alias("v")).collect()
    assert [r.v for r in got] == ["running", "preempted", "completed", "failed", "failed"]


SCOPE = "prod-3f9a1b2c4d5e"
DONE = {"shard_id": 1, "status": "downloaded"}
LIVE = {"shard_id": 2, "status": "running"}
DOCUMENTS = {
    "not json": ("reject", "state JSON is invalid"),
    "[]": ("reject", "state JSON root must be an object"),
    '{"schema_version": "1"}': ("reject", "schema_version must be an integer"),
    '{"schema_version": true}': ("reject", "schema_version must be an integer"),
    '{"schema_version": null}': ("reject", "schema_version must be an integer"),
    '{"schema_version": 1.0}': ("reject", "schema_version must be an integer"),
    '{"schema_version": 2}': ("reject", "unsupported schema_version"),
    '{"schema_version": 1, "shards": "x"}': ("reject", "persisted shards must be a list or null"),
    '{"schema_version": 1, "jobs": {}}': ("reject", "persisted jobs must be a list or null"),
    json.dumps({"label": SCOPE, "shards": [DONE, LIVE]}): ("migrate", ""),
    json.dumps({"label": "plain", "shards": [LIVE]}): ("migrate", ""),
    json.dumps({"label": SCOPE, "label_scope": SCOPE, "shards": []}): ("migrate", ""),
    json.dumps({"label": SCOPE, "label_scope": "x", "shards": []}): ("reject", "label and label_scope disagree"),
    json.dumps({"label": 5, "shards": []}): ("reject", "label fields must be strings"),
    json.dumps({"label": 0, "shards": [DONE]}): ("archive", ""),
    json.dumps({"shards": [DONE]}): ("archive", ""),
    json.dumps({"shards": [DONE, LIVE]}): ("reject", "nonterminal state lacks a recoverable label scope"),
    json.dumps({"shards": ["x"]}): ("reject", "nonterminal state lacks a recoverable label scope"),
    "{}": ("migrate", ""),
    json.dumps({"schema_version": 1, "label_scope": SCOPE, "requested_label_prefix": "prod", "shards": [LIVE]}): ("load", ""),
    json.dumps({"schema_version": 1, "shards": [LIVE]}): ("reject", "nonterminal state lacks a recoverable label scope"),
    json.dumps({"schema_version": 1, "shards": [DONE]}): ("archive", ""),
    json.dumps({"schema_version": 1, "label_scope": SCOPE, "extra": 1}): ("reject", "could not deserialize state"),
    json.dumps({"schema_version": 1, "label_scope": SCOPE, "jobs": []}): ("reject", "could not deserialize state"),
    json.dumps({"schema_version": 1, "label_scope": SCOPE, "shards": [{"status": "x"}]}): ("reject", "could not deserialize units"),
    json.dumps({"schema_version": 1, "label_scope": SCOPE, "shards": [{"shard_id": 1, "hue": 2}]}): ("reject", "could not deserialize units"),
    json.dumps({"schema_version": 1, "label_scope": SCOPE, "shards": ["x"]}): ("reject", "could not deserialize units"),
    json.dumps({"schema_version": 1, "label_scope": SCOPE, "label": "old", "shards": None}): ("load", ""),
}


def documents(spark, raws, kind="shard"):
    return spark.createDataFrame([(str(i), kind, r) for i, r in enumerate(raws)], "path string, kind string, raw string")


def test_strict_state_loading(spark):
    got = state.load_documents(documents(spark, DOCUMENTS)).collect()
    table = {int(r.path): (r.action, r.error) for r in got}
    assert [table[i] for i in range(len(DOCUMENTS))] == list(DOCUMENTS.values())


def test_job_documents_have_their_own_fields_and_terminal_set(spark):
    raws = [
        json.dumps({"schema_version": 1, "label_scope": SCOPE, "jobs": [{"job_name": "a"}]}),
        json.dumps({"schema_version": 1, "label_scope": SCOPE, "label": "x", "jobs": []}),
        json.dumps({"schema_version": 1, "label_scope": SCOPE, "jobs": [{"shard_id": 1}]}),
        json.dumps({"jobs": [{"job_name": "a", "status": "completed"}]}),
        json.dumps({"label": SCOPE, "jobs": [{"job_name": "a", "status": "completed"}]}),
    ]
    got = sorted((r.path, r.action) for r in state.load_documents(documents(spark, raws, "job")).collect())
    assert [a for _, a in got] == ["load", "reject", "reject", "archive", "migrate"]


def test_loaded_units_have_defaults(spark):
    raw = json.dumps({"label": SCOPE, "batch_id": "b", "shards": [{"shard_id": 7, "item_ids": ["x", "y"], "cost_per_hour": 0.5}, {"shard_id": 8, "status": "failed"}]})
    loaded = state.load_documents(documents(spark, [raw]))
    assert values(loaded, "label_scope", "requested_label_prefix") == [(SCOPE, "prod")]
    rows = state.loaded_units(loaded).orderBy("pos").collect()
    assert [(r.unit_key, r.status, r.cost_per_hour, r.item_ids, r.batch_id) for r in rows] == [
        ("7", "pending", 0.5, ["x", "y"], "b"), ("8", "failed", 0.0, [], "b"),
    ]


def test_lenient_loading_skips_corrupt_documents(spark):
    raws = ["{bad", "[]", '"x"', '{"shards": null}', '{"shards": {}}', '{"shards": {"a": 1}}', "{}", '{"shards": [{"shard_id": 1}]}', '{"shards": [{}]}', '{"colour": 1}', '{"schema_version": 9}', '{"shards": ""}', '{"shards": 5}']
    got = sorted((int(r.path), r.ok) for r in state.load_lenient(documents(spark, raws)).collect())
    assert [ok for _, ok in got] == [False, False, False, False, True, False, True, True, False, False, True, True, False]


def test_any_code_of_a_block_fails_the_shard(spark):
    items = spark.createDataFrame([("b", 0, f"i{n}") for n in range(600)], "batch_id string, shard_id long, item_id string")

    def work(block):
        if "i7" in set(block["item_id"]):
            raise ValueError("seven")
        if "i11" in set(block["item_id"]):
            raise ValueError("eleven")
        return -9 if "i5" in set(block["item_id"]) else 0

    got = run_workload(items, work, block_rows=2).first()
    assert (got.items, got.error, got.completed) == (600, "ValueError: eleven; ValueError: seven", False) and got.exit_code in (1, -9)
    assert run_workload(items, lambda b: -9 if "i5" in set(b["item_id"]) else 0, block_rows=50).first().exit_code == -9


def test_statuses_are_counted_whatever_they_are(spark):
    rows = spark.createDataFrame([("b", "paused"), ("b", "paused"), ("b", None), ("b", "failed")], "batch_id string, status string")
    assert values(units.status_counts(rows), "status", "units") == [("failed", 1), ("paused", 2), (None, 1)]


def test_migration_returns_refused_shapes_but_no_current_rejects(spark):
    raws = ["{bad", '{"schema_version": 2}', json.dumps({"schema_version": 1, "label_scope": SCOPE, "extra": 1}), json.dumps({"label": SCOPE})]
    got = state.migrate_documents(documents(spark, raws))
    assert values(got, "path", "action") == [("0", "reject"), ("1", "reject"), ("3", "migrate")]


def test_workload_codes_and_block_size(spark):
    items = spark.createDataFrame([("b", s, f"i{n}") for s, size in ((0, 900), (1, 5), (2, 5), (3, 5), (4, 5)) for n in range(size)], "batch_id string, shard_id long, item_id string")
    health = spark.createDataFrame([("b", 2, False)], "batch_id string, shard_id long, healthy boolean")
    gates = spark.createDataFrame([("b", 3, True), ("b", 3, False), ("b", 2, False)], "batch_id string, shard_id long, open boolean")

    def work(block):
        assert len(block) < 400, "a block must stay small"
        if block["shard_id"].iloc[0] == 4:
            raise RuntimeError("no")
        return 7 if block["shard_id"].iloc[0] == 1 else None

    got = run_workload(items, work, health=health, gates=gates, block_rows=100)
    assert values(got, "shard_id", "exit_code", "items", "error", "completed") == [
        (0, 0, 900, "", True), (1, 7, 5, "", False), (2, 1, 0, "GPU unhealthy", False), (3, 3, 0, "preflight gate closed", False), (4, 1, 5, "RuntimeError: no", False),
    ]


def test_an_archive_has_files_by_its_rows_and_not_by_its_names(spark, folder):
    from pathlib import Path

    from fleetlens.sources import writers

    rows = spark.range(3000).select(F.concat(F.lit("b"), F.col("id") % 1000).alias("batch_id"), F.col("id").cast("string").alias("unit_key"), F.concat(F.lit("shard_b"), F.col("id") % 1000).alias("archive_name"))
    for half in (0, 1):
        writers.write_archive(rows.where(F.col("unit_key").cast("int") % 2 == half), folder + "/archive")
    assert values(writers.read_archive(spark, folder + "/archive"), *rows.columns) == values(rows, *rows.columns)
    assert len(list(Path(folder).rglob("*.parquet"))) < 100
    writers.write_archive(rows.limit(0), folder + "/none")
    assert writers.read_archive(spark, folder + "/none").count() == 0
