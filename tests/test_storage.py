"""Objects, publishing, retention rules and sources."""

import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import values
from pyspark.sql import functions as F

from fleetlens.operators import lifecycle as L
from fleetlens.operators import objects, planning, publish
from fleetlens.sources import readers, writers
from fleetlens.sources.versions import Conflict

RULE = "bucket string, pos int, id string, status string, prefix string, days int, extra string"
POLICY = "bucket string, raw_prefix string, days int"


def managed_id(spark, bucket, prefix):
    return L.with_identity(spark.createDataFrame([(bucket, prefix, 1)], POLICY)).first().rule_id


def test_expiring_objects_equal_trying_every_rule(spark):
    rules = [("b", 0, "r0", "Enabled", "p/", 5, "{}"), ("b", 1, "r1", "Enabled", "p/q", 2, "{}"), ("b", 2, "r2", "Disabled", "p/", 1, "{}"), ("b", 3, "r3", "Enabled", "", 9, "{}"),
             ("c", 0, "r4", "Enabled", "p/q/r/s/t/long", 1, "{}"), ("b", 4, "r5", "Enabled", "p/", None, "{}"), ("b", 5, "r6", "Enabled", "p_", 1, "{}")]
    keys = [(b, k, 10, a) for b in "bcd" for k in ("p/x", "p/q", "p/qq/z", "p", "other", "p_x", "p/q/r/s/t/longer") for a in (1, 2, 5, 9)]
    frame = spark.createDataFrame(keys, "bucket string, key string, size long, age_days int")
    got = objects.expiring_objects(frame, spark.createDataFrame(rules, RULE))
    want = sorted((b, k, a, r[2]) for b, k, _, a in keys for r in rules if r[0] == b and r[3] == "Enabled" and r[5] and k.startswith(r[4]) and a >= r[5])
    assert sorted(map(tuple, got.select("bucket", "key", "age_days", "rule_id").collect())) == want


def test_an_object_counts_for_its_earliest_rule(spark):
    rules = spark.createDataFrame([("b", 0, "late", "Enabled", "p/", 5, "{}"), ("b", 1, "early", "Enabled", "p/q", 2, "{}")], RULE)
    frame = spark.createDataFrame([("b", "p/q", 10, 9), ("b", "p/z", 7, 9)], "bucket string, key string, size long, age_days int")
    assert values(objects.expiring_summary(frame, rules), "rule_id", "objects", "bytes") == [("early", 1, 10), ("late", 1, 7)]


def test_missing_predictions_and_unresolved_uploads(spark):
    outputs = spark.createDataFrame([("b", 1, "p1/a"), ("b", 1, "p2/a"), ("b", 1, "flat"), ("b", 2, "p1/a"), ("b", 3, "p1/x/y"), ("b", 5, "flat")], "batch_id string, shard_id long, rel_path string")
    completions = spark.createDataFrame([("b", 1, "p1"), ("b", 3, "p1")], "batch_id string, shard_id long, prediction string")
    markers = spark.createDataFrame([("b", 5)], "batch_id string, shard_id long")
    failures = spark.createDataFrame([("b", 4), ("b", 5)], "batch_id string, shard_id long")
    assert values(publish.missing_predictions(outputs, completions, markers), "shard_id", "entry") == [(1, "FLAT:flat"), (1, "p2"), (2, "p1")]
    shards = spark.createDataFrame([("b", i) for i in range(1, 7)], "batch_id string, shard_id long")
    got = publish.upload_unresolved(shards, outputs, failures, completions, markers)
    assert values(got, "shard_id", "unresolved") == [(1, True), (2, True), (3, False), (4, True), (5, True), (6, False)]


def brute_force_code(e, full):
    job = e["kind"] == "job"
    if job or full:
        if e["files_failed"]:
            return 3
        if not job and not e["marker_written"]:
            return 5
        unresolved = e["has_failure_rows"]
    else:
        unresolved = e["has_failure_rows"] or (e["has_outputs"] and not e["shard_marker"] and e["predictions_missing"])
    return 4 if unresolved else 1 if not e["exitcode_ok"] else 2 if not e["done_put_ok"] else 0


def test_publish_codes_over_all_evidence(spark):
    flags = ["files_failed", "has_failure_rows", "has_outputs", "shard_marker", "predictions_missing", "marker_written", "exitcode_ok", "done_put_ok"]
    rows = [(k, *[bool(n >> i & 1) for i in range(8)]) for k in ("job", "shard") for n in range(256)]
    frame = spark.createDataFrame(rows, "kind string, " + ", ".join(f"{f} boolean" for f in flags))
    for full in (False, True):
        for r in publish.publish_code(frame, full=full).collect():
            assert r.code == brute_force_code(r.asDict(), full)


def test_success_clears_failures_but_never_the_sentinel(spark):
    import datetime

    t = [datetime.datetime(2024, 1, 1, i) for i in range(5)]
    log = spark.createDataFrame(
        [("b", 1, "p", t[0], 1, "file_failed", 2), ("b", 1, "p", t[1], 2, "uploaded", 5), ("b", 1, "q", t[0], 3, "uploaded", 5), ("b", 1, "q", t[1], 4, "marker_failed", 3),
         ("b", 1, "q", t[2], 5, "absent", 0), ("b", 1, "r", t[0], 6, "absent", 0)],
        "batch_id string, shard_id long, prediction string, ts timestamp, event_id long, outcome string, files_uploaded int",
    )
    status = publish.prediction_status(log)
    assert values(status, "prediction", "status", "uploaded", "open_failures") == [("p", "ok", 5, False), ("q", "absent", 0, True), ("r", "absent", 0, False)]
    failures = spark.createDataFrame([("b", 1, "p", "x"), ("b", 1, "q", "x"), ("b", 1, "SENTINEL_WRITE_FAILED", "p")], "batch_id string, shard_id long, name string, path string")
    assert values(publish.open_failure_rows(failures, status), "name", "path") == [("SENTINEL_WRITE_FAILED", "p"), ("q", "x")]


def rules(spark, *rows):
    return spark.createDataFrame(rows, RULE)


def plan(spark, rows, prefix="p", days=30, operation="apply"):
    return L.lifecycle_plan(rules(spark, *rows), spark.createDataFrame([("b", prefix, days)], POLICY), operation=operation).first()


def test_plan_of_an_empty_bucket(spark):
    got = plan(spark, [])
    assert (got.before_rules, got.after_rules, got.no_op, got.warnings) == (0, 1, False, 0)
    assert plan(spark, [], operation="remove").no_op


def test_plan_no_op_needs_the_same_rule_in_last_place(spark):
    mid = managed_id(spark, "b", "p")
    same, foreign = (mid, "Enabled", "p/", 30, "{}"), ("f", "Enabled", "z/", 1, "{}")
    assert plan(spark, [("b", 0, *foreign), ("b", 1, *same)]).no_op
    assert not plan(spark, [("b", 0, *same), ("b", 1, *foreign)]).no_op
    assert not plan(spark, [("b", 0, *same), ("b", 1, *same)]).no_op
    for other in (("Disabled", "p/", 30, "{}"), ("Enabled", "q/", 30, "{}"), ("Enabled", "p/", 31, "{}"), ("Enabled", "p/", 30, '{"a":1}')):
        assert not plan(spark, [("b", 0, mid, *other)]).no_op
    assert not plan(spark, [("b", 0, *same)], operation="remove").no_op


def test_plan_no_op_agrees_with_the_rule_diff(spark):
    mid = managed_id(spark, "b", "p")
    same, foreign = (mid, "Enabled", "p/", 30, "{}"), ("f", "Enabled", "z/", 1, "{}")
    policy = spark.createDataFrame([("b", "p", 30)], POLICY)
    for rows in ([], [("b", 0, *same)], [("b", 0, *foreign), ("b", 1, *same)], [("b", 0, *same), ("b", 1, *foreign)], [("b", 3, *same), ("b", 4, *same)]):
        for operation in ("apply", "remove"):
            before = rules(spark, *rows)
            after = L.rules_after(before, policy, operation=operation)
            equal = L.plan_diff(L.renumbered(before), after).count() == 0
            got = L.lifecycle_plan(before, policy, operation=operation).first()
            assert (got.no_op, got.after_rules) == (equal, after.count())


def test_overlap_warnings_equal_trying_every_pair(spark):
    own = managed_id(spark, "b", "a/b")
    prefixes = ["a/", "a/b", "a/b/", "a/bc/", "a/b/c/", "a", "x/", "", "a/c/"]
    rows = [("b", i, f"f{i}", "Enabled", p, 1, "{}") for i, p in enumerate(prefixes)] + [("b", 90, own, "Enabled", "a/b/", 1, "{}"), ("b", 91, "fleetlens-expire-other", "Enabled", "a/", 1, "{}"), ("c", 0, "f", "Enabled", "a/", 1, "{}")]
    got = L.overlapping_rules(rules(spark, *rows), spark.createDataFrame([("b", "a/b", 1)], POLICY))
    assert values(got, "foreign_prefix") == sorted((p,) for p in prefixes if p and (p.startswith("a/b") or "a/b".startswith(p)))
    assert got.count() == got.select("pos").distinct().count()


def test_collisions(spark):
    mid = managed_id(spark, "b", "p")
    rows = [("b", 0, mid, "Enabled", "p/", None, "{}"), ("b", 1, mid, "Enabled", "q/", 3, "{}"), ("b", 2, mid, "Enabled", "p/", 3, "{}"), ("b", 3, "f", "Enabled", "p/", None, "{}")]
    got = L.collisions(rules(spark, *rows), spark.createDataFrame([("b", "p", 1)], POLICY))
    assert values(got, "pos", "collision") == [(0, "no Expiration.Days"), (1, "bound to another prefix")]


def test_fingerprint_depends_on_order_and_content(spark):
    a, b = ("x", "Enabled", "p/", 1, "{}"), ("y", "Enabled", "q/", 1, "{}")
    prints = [
        L.fingerprints(rules(spark, *r)).first().fingerprint
        for r in ([("b", 0, *a), ("b", 1, *b)], [("b", 1, *b), ("b", 0, *a)], [("b", 0, *b), ("b", 1, *a)], [("b", 0, *a)], [("b", 0, *a), ("b", 1, "y", "Enabled", "q/", 2, "{}")])
    ]
    assert prints[0] == prints[1] and len(set(prints)) == 4 and all(len(p) == 16 for p in prints)


def test_stale_plans(spark):
    before = rules(spark, ("b", 0, "x", "Enabled", "p/", 1, "{}"), ("c", 0, "x", "Enabled", "p/", 1, "{}"))
    plans = L.lifecycle_plan(before, spark.createDataFrame([("b", "p", 1), ("c", "p", 1), ("d", "p", 1)], POLICY))
    now = rules(spark, ("b", 0, "x", "Enabled", "p/", 1, "{}"), ("d", 0, "x", "Enabled", "p/", 1, "{}"))
    assert values(L.plan_freshness(plans, now), "bucket", "fresh") == [("b", True), ("c", False), ("d", False)]


@pytest.mark.parametrize(("days", "error"), [("30", ""), ("1", ""), ("0", "expire_after_days must be >= 1"), ("-1", "expire_after_days must be >= 1"), ("1.5", "expire_after_days must be an integer"), ('"30"', "expire_after_days must be an integer"), ("true", "expire_after_days must be an integer"), ("null", "expire_after_days must be an integer"), ("99999999999999999999", "")])
def test_policy_days(spark, days, error):
    assert spark.range(1).select(L.policy_error(F.lit("b"), F.lit(days)).alias("e")).first().e == error


def test_chunks_join_to_the_file_in_numeric_order(spark, folder):
    body = os.urandom(20_000)
    cuts = sorted({0, len(body), *[(i * 7919) % len(body) for i in range(1, 1200)]})
    pieces = [("f", i, body[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert len(pieces) > 1000
    chunks = spark.createDataFrame(pieces, "file_id string, chunk_index long, content binary").repartition(5)
    joined = objects.consolidate(chunks)
    rows = joined.orderBy("offset").collect()
    assert b"".join(bytes(r.content) for r in rows) == body
    assert [r.offset for r in rows] == cuts[:-1]
    objects.ordered_segments(joined, 4).write.parquet(f"{folder}/out")
    parts = spark.read.parquet(f"{folder}/out").withColumn("part", F.input_file_name()).orderBy("part", "offset").collect()
    assert b"".join(bytes(r.content) for r in parts) == body
    assert tuple(objects.consolidated_files(chunks).first()) == ("f", len(pieces), len(body), len(pieces) - 1)


def test_chunk_plan_rebuilds_the_growing_file(spark):
    import datetime

    sizes = [0, 10, 10, 5, 30, 29, 31, 31, 100]
    rows = [("f", i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=7 * i), s) for i, s in enumerate(sizes)]
    got = objects.chunk_plan(spark.createDataFrame(rows, "file_id string, event_id long, ts timestamp, size long"))
    assert values(got, "chunk_index", "offset", "length") == [(0, 0, 10), (1, 10, 20), (2, 30, 1), (3, 31, 69)]


def test_timings_append_and_load(spark, folder):
    path = f"{folder}/timings"
    assert readers.load_calibration(spark, path, "md").count() == 0
    frame = spark.createDataFrame([("md", 1.5, 3), ("fold", 2.5, 4), ("md", 3.5, 5)], "workload string, runtime_sec double, atoms int")
    for _ in range(2):
        writers.append_timing(frame, path, F.lit("2024-01-01T00:00:00+00:00"), "runtime_sec", "atoms")
    loaded = readers.load_calibration(spark, path, "md")
    runtime = F.try_variant_get("record", "$.runtime_sec", "double")
    assert sorted(r.x for r in loaded.select(runtime.alias("x")).collect()) == [1.5, 1.5, 3.5, 3.5]


def test_hand_written_timings(spark, folder):
    lines = ['{"workload": "md", "a": 1}', "", "   ", "{bad", "[1]", "5", '{"workload": 7}', '  {"workload": "md"}  ', '{"a": 1}']
    with open(f"{folder}/t.jsonl", "w") as out:
        out.write("\n".join(lines))
    assert readers.load_calibration(spark, f"{folder}/t.jsonl", "md").count() == 2


def test_state_versions(spark, folder):
    units = spark.createDataFrame([("b", "u1", "running")], "batch_id string, unit_key string, status string")
    batches = spark.createDataFrame([("b", "prod")], "batch_id string, label_scope string")
    as_of = F.lit("2024-01-01T00:00:00+00:00")
    writers.write_state(units, batches, folder, 1, as_of)
    writers.write_state(units.withColumn("status", F.lit("failed")), batches, folder, 2, as_of)
    writers.state_snapshot(units, 3, as_of).write.parquet(f"{folder}/units/v=3")
    got, _ = writers.read_state(spark, folder)
    assert [(r.status, r.version, r.updated_at) for r in got.collect()] == [("failed", 2, "2024-01-01T00:00:00.000000Z")]


def test_rules_are_replaced_by_bucket(spark, folder):
    before = rules(spark, ("a", 0, "x", "Enabled", "p/", 1, "{}"), ("b", 0, "x", "Enabled", "p/", 1, "{}"), ("c", 0, "x", "Enabled", "p/", 1, "{}"))
    empty = before.where("false")
    writers.write_rules(empty, before, folder + "/r")
    touched = before.where("bucket <> 'c'")
    writers.write_rules(touched, before.where("bucket = 'a'").withColumn("days", F.lit(9)), folder + "/r")
    got = writers.read_rules(spark, folder + "/r")
    assert values(got, "bucket", "days") == [("a", 9), ("c", 1)]


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as out:
        out.write(text)


def test_file_readers(spark, folder):
    write(folder, "offers/a.json", json.dumps([{"id": 1, "machine_id": 5, "dph_total": 0.2}, {"id": 2}]))
    write(folder, "offers/b.json", "oops")
    assert readers.read_offers(spark, f"{folder}/offers").count() == 2

    write(folder, "lists/a.json", json.dumps([{"id": 1}, "x"]))
    write(folder, "lists/b.json", "{}")
    assert values(readers.read_instance_lists(spark, f"{folder}/lists"), "reject") == [("",), ("not an object",)]

    write(folder, "lines/a.jsonl", '{"id": 1, "machine_id": 9, "dph_total": 0.5}\n{"id": 2}\nnot json\n')
    assert values(readers.read_offer_lines(spark, f"{folder}/lines"), "offer_id", "machine_id") == [(1, "9"), (2, "")]
    write(folder, "records/a.jsonl", '{"listing_id": "L", "record": {"id": 7}}\n{"listing_id": "L", "record": "x"}\n[1]\n')
    assert values(readers.read_instance_lines(spark, f"{folder}/records"), "listing_id", "instance_id", "reject") == [("L", "7", ""), ("L", None, "not an object")]

    pages = [{"listing_id": "L", "page_no": 0, "after_token": "", "raw": json.dumps({"instances": [{"id": 1}], "next_token": "a"})}, {"listing_id": "L", "page_no": 1, "after_token": "a", "raw": json.dumps({"instances": [{"id": 2}], "next_token": None})}]
    write(folder, "pages/p.jsonl", "\n".join(json.dumps(p) for p in pages))
    assert values(readers.read_instance_pages(spark, f"{folder}/pages"), "instance_id") == [("1",), ("2",)]

    scope = "prod-3f9a1b2c4d5e"
    write(folder, "state/a.json", json.dumps({"label": scope, "batch_id": "b", "shards": [{"shard_id": 1}]}))
    write(folder, "state/b.json", "{bad")
    good, bad = readers.read_batch_state(spark, f"{folder}/state", "shard")
    assert (good.count(), bad.first().error) == (1, "state JSON is invalid")
    assert values(readers.read_batch_state_lenient(spark, f"{folder}/state", "shard"), "ok") == [(False,), (True,)]

    write(folder, "rules/bkt.json", json.dumps({"Rules": [{"ID": "r", "Filter": {"Prefix": "p/"}, "Expiration": {"Days": 3}, "X": 1}]}))
    row = readers.read_lifecycle_rules(spark, f"{folder}/rules").first()
    assert (row.bucket, row.id, row.prefix, row.days, row.extra) == ("bkt", "r", "p/", 3, '{"X":1}')


def test_rules_from_reading_to_writing(spark, folder):
    raw = [{"ID": "a|b", "Status": "c", "Filter": {"Prefix": "x/", "Tag": {"k": "v"}}, "Expiration": {"Days": 3, "Z": [1]}}, {"ID": 7, "Filter": "odd", "Expiration": {"Days": 1.5}}]
    write(folder, "in/bkt.json", json.dumps({"Rules": raw}))
    rules = readers.read_lifecycle_rules(spark, f"{folder}/in")
    assert values(rules, "pos", "id", "days", "extra") == [
        (0, "a|b", 3, '{"Expiration":{"Z":[1]},"Filter":{"Tag":{"k":"v"}}}'),
        (1, "7", None, '{"Expiration":{"Days":1.5},"Filter":"odd","ID":7}'),
    ]
    policies = spark.createDataFrame([("bkt", "p/q", 9)], "bucket string, raw_prefix string, days int")
    after = L.rules_after(rules, policies)
    writers.write_rules(rules, after, f"{folder}/out")
    stored = writers.read_rules(spark, f"{folder}/out")
    assert stored.count() == 3
    assert L.post_write_check(after, stored).first().verified
    assert L.plan_freshness(L.lifecycle_plan(stored, policies), stored).first().fresh
    assert L.lifecycle_plan(stored, policies).first().no_op


def test_different_rules_never_compare_equal(spark):
    schema = "bucket string, pos int, id string, status string, prefix string, days int, extra string"
    pairs = [(("a|b", "c"), ("a", "b|c")), (("a", None), ("a", "")), (('a","status":"b', "c"), ("a", "b"))]
    for left, right in pairs:
        one, two = (spark.createDataFrame([("b", 0, *r, "p/", 1, "{}")], schema) for r in (left, right))
        assert not L.rules_equal(one, two).first().equal
        assert L.fingerprints(one).first().fingerprint != L.fingerprints(two).first().fingerprint


def test_inventory_and_outputs(spark, folder):
    write(folder, "tree/x/a.bin", "12345")
    write(folder, "tree/y/z/b.txt", "1")
    assert values(readers.list_files(spark, f"{folder}/tree"), "key", "size") == [("x/a.bin", 5), ("y/z/b.txt", 1)]
    assert values(readers.collect_outputs(spark, f"{folder}/tree", "*.bin"), "rel_path", "size") == [("x/a.bin", 5)]


def test_diagnostics(spark, folder):
    text = "# preempt diagnostics for shard 3\n# instance_id: i9\n# captured_at: T\n\n## worker.log (full) ##\nline 1\n# not a header\nline 2\n\n## worker.exitcode ##\n1\n\n## dmesg tail ##\n\n"
    write(folder, "d/u.log", text)
    rows = readers.read_diagnostics(spark, f"{folder}/d").orderBy("pos").collect()
    assert [(r.unit, r.instance_id, r.captured_at, r.section, r.body) for r in rows] == [
        ("shard 3", "i9", "T", "worker.log (full)", "line 1\n# not a header\nline 2"), ("shard 3", "i9", "T", "worker.exitcode", "1"), ("shard 3", "i9", "T", "dmesg tail", ""),
    ]


def test_estimate_report_document(spark, folder):
    work = spark.createDataFrame([(1, 10.0, "RTX_4090")], "workload_id long, work_hours double, cloud_gpu_type string")
    prices = spark.createDataFrame([(0, "RTX_4090", 3, 0.2004, 0.4, 0.3)], "ord int, gpu_type string, available_count long, min_price_hr double, max_price_hr double, median_price_hr double")
    docs = planning.estimate_report(work, prices, [4, 0], as_of="2024")
    writers.write_documents(docs, f"{folder}/report")
    doc = json.loads(spark.read.text(f"{folder}/report").first().value)
    assert doc["pricing"] == [{"gpu_type": "RTX_4090", "available_count": 3, "min_price_hr": 0.2, "max_price_hr": 0.4, "median_price_hr": 0.3}]
    assert [(r["cloud_gpus"], r["wall_time_human"], r["cost_display"], r["notes"]) for r in doc["scaling_table"]] == [(0, "10h 00m", "$0.00", "local only"), (4, "2h 00m", "$1.60-$3.20", "")]


COUNTS = "batch_id string, unit_key string, n int"


def store_of(spark, folder, settle=0.05):
    return writers.state_store(spark, f"{folder}/store", COUNTS, settle=settle)


def content(store, version=None):
    return sorted(((r.batch_id, r.unit_key, r.n, r.version) for r in store.read(version).collect()), key=repr)


def test_of_two_writers_of_one_version_the_second_gets_a_conflict(spark, folder):
    store = store_of(spark, folder)
    rows = lambda *r: spark.createDataFrame(list(r), COUNTS)
    assert store.head() == 0 and content(store) == []
    assert store.commit(store.propose(rows(("a", "1", 0), ("a", "2", 0), ("b", "1", 0), (None, "1", 5))), 0) == 1
    # interleaved: both read version 1, both write, then both commit
    first, second, third = store.propose(rows(("a", "1", 1))), store.propose(rows(("a", "2", 7))), store.propose(rows(("b", "1", 9)))
    assert content(store) == content(store, 1)  # proposals are invisible
    assert store.commit(first, 1) == 2
    with pytest.raises(Conflict):
        store.commit(second, 1)
    assert store.commit(third, 1) == 3  # other keys are no conflict
    assert sorted(content(store), key=repr) == sorted([("a", "1", 1, 2), ("b", "1", 9, 3), (None, "1", 5, 1)], key=repr)
    assert store.update(lambda r: (r.where("batch_id = 'b'").withColumn("n", F.col("n") + 1), rows((None, "", 0)))) == 4
    assert content(store) == [("a", "1", 1, 2), ("b", "1", 10, 4)]  # the NULL batch was left without rows
    assert len(content(store, 1)) == 4  # old versions stay


def test_a_writer_that_died_after_its_claim_is_finished_by_the_next(spark, folder):
    store = store_of(spark, folder)
    rows = lambda *r: spark.createDataFrame(list(r), COUNTS)
    dead = store.propose(rows(("a", "1", 1)))
    store.claim(dead, 0)
    assert store.head() == 0
    with pytest.raises(Conflict):
        store.commit(store.propose(rows(("a", "1", 2))), 0)
    assert content(store) == [("a", "1", 1, 1)]
    assert store.commit(dead, 0) == 1  # repeating a commit changes nothing
    assert store.head() == 1


def test_parallel_updates_lose_nothing(spark, folder):
    store = store_of(spark, folder, settle=0.3)
    store.update(lambda _: spark.createDataFrame([("a", "1", 0)], COUNTS))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: store.update(lambda r: r.withColumn("n", F.col("n") + 1), tries=30), range(4)))
    assert content(store) == [("a", "1", 4, 5)]


def test_a_committed_state_version_is_not_overwritten(spark, folder, views):
    units, as_of = views.units.limit(5), F.lit("2024-01-01T00:00:00+00:00")
    batches = units.select("batch_id").distinct()
    writers.write_state(units, batches, folder, 1, as_of)
    with pytest.raises(writers.AlreadyCommitted):
        writers.write_state(units.limit(1), batches, folder, 1, as_of)
    assert writers.read_state(spark, folder)[0].count() == 5
