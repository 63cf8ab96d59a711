"""Listings, ownership and cleanup decisions."""

import json
import random

import pytest
from conftest import values
from pyspark.sql import functions as F

from fleetlens.functions import json_values as J
from fleetlens.operators import cleanup, fleet
from fleetlens.plans.sweep import sweep, sweep_totals


def normalized(spark, listings):
    """``{listing_id: [raw records]}`` as normalised records."""
    rows = [(name, r if isinstance(r, str) else json.dumps(r)) for name, records in listings.items() for r in records]
    frame = spark.createDataFrame(rows, "listing_id string, raw string")
    return fleet.normalize_records(frame, J.parse(F.col("raw")))


def record(i, image="lab/fold:1", **fields):
    return {"id": i, "image_uuid": image, "label": "prod-1", "actual_status": "running", "dph_total": 0.5} | fields


def test_bad_records_are_skipped(spark):
    bad = ['"bad"', '["also", "bad"]', "42", record(None), record(True), record(""), record("  "), record([1]), record({"id": 1}), record(5.0)]
    kept = fleet.enumerate_instances(normalized(spark, {"L": [record("123"), record(456), record(" 789 "), *bad]}))
    assert values(kept, "instance_id") == [("123",), ("456",), ("789",)]


def test_a_duplicate_id_voids_the_whole_listing_only(spark):
    got = fleet.enumerate_instances(normalized(spark, {"A": [record(1), record(2), record(" 1 ")], "B": [record(1)]}))
    assert values(got, "listing_id", "instance_id") == [("B", "1")]


def test_a_duplicate_counts_even_when_one_copy_is_invalid(spark):
    got = fleet.enumerate_instances(normalized(spark, {"A": [record(1, dph_total=-1), record(1), record(2)]}))
    assert values(got, "instance_id") == []


def test_null_texts_become_empty_and_bad_numbers_zero(spark):
    row = fleet.enumerate_instances(
        normalized(spark, {"A": [record(1, image=None, label=None, actual_status=7, gpu_name=[], dph_total=True, start_date="x")]})
    ).first()
    assert (row.image_uuid, row.label, row.state, row.gpu_model, row.cost_per_hour, row.started_at) == ("", "", "", "", 0.0, 0.0)


def test_negative_and_infinite_numbers_drop_the_record(spark):
    records = [record(1, dph_total=-0.1), record(2, start_date=-1), '{"id": 3, "dph_total": 1e999}', record(4, dph_total=0)]
    assert values(fleet.enumerate_instances(normalized(spark, {"A": records})), "instance_id") == [("4",)]


def page(instances=(), token=None):
    return json.dumps({"instances": list(instances), "next_token": token})


@pytest.mark.parametrize(
    ("pages", "error"),
    [
        ([("", page([{"id": 1}], "a")), ("a", page([{"id": 2}]))], ""),
        ([("", page())], ""),
        ([("", '{"instances": []}')], ""),
        ([("", "[]")], "page must be an object"),
        ([("", "{oops")], "page must be an object"),
        ([("", '{"instances": {}}')], "page has no instance list"),
        ([("", '{"next_token": null}')], "page has no instance list"),
        ([("", page([], ""))], "invalid page token"),
        ([("", page([], 5))], "invalid page token"),
        ([("", page([], "a")), ("a", page([], "a")), ("a", page())], "invalid page token"),
        ([("", page([], "a")), ("b", page())], "broken page chain"),
        ([("", page([], "a"))], "broken page chain"),
        ([("", page()), ("", page())], "broken page chain"),
        ([("", page([{"id": 1}], "t0")), *((f"t{i}", page([], f"t{i + 1}")) for i in range(1100)), ("t1100", page())], ""),
    ],
)
def test_page_chain(spark, pages, error):
    rows = [("L", n, after, raw) for n, (after, raw) in enumerate(pages)]
    opened = fleet.open_pages(spark.createDataFrame(rows, "listing_id string, page_no int, after_token string, raw string"))
    got = fleet.page_chain(opened).first()
    assert (got.error, got.ok) == (error, error == "")
    assert (fleet.paged_records(opened).count() > 0) == (error == "" and "id" in pages[0][1])


def test_listing_root_must_be_a_list(spark):
    docs = spark.createDataFrame([("a", "[1, {}]"), ("b", "{}"), ("c", "x")], "listing_id string, raw string")
    assert values(fleet.list_documents(docs), "listing_id", "error") == [
        ("a", ""), ("b", "listing must be a list, got object"), ("c", "listing JSON is invalid"),
    ]


def owned(spark, *images):
    return spark.createDataFrame([(i,) for i in images], "image string")


PINNED = "lab/fold@sha256:" + "5e" * 32
IMAGES = ["lab/fold:3", "lab/fold", PINNED, "mirror.lan:9443/lab/fold:3", "lab/fold:rc+1", " ", "lab/folder:3"]


@pytest.mark.parametrize(
    ("policy", "want"),
    [
        (["lab/fold:2024.2"], [True, True, True, False, False, False, False]),
        ([PINNED], [True, True, True, False, False, False, False]),
        (["mirror.lan:9443/lab/fold"], [False, False, False, True, False, False, False]),
        (["lab/fold:rc+1", " "], [False] * 7),
        ([], [False] * 7),
        (None, [True] * 7),
        ([f"farm{i}.lan/lab/fold:{i}" for i in range(300)] + ["lab/folder"], [False] * 6 + [True]),
    ],
)
def test_ownership(spark, policy, want):
    rows = spark.createDataFrame(list(enumerate(IMAGES)), "i int, ownership_key string")
    got = fleet.with_ownership(rows, None if policy is None else owned(spark, *policy))
    assert [r.owned for r in got.orderBy("i").collect()] == want


def test_verification(spark):
    listings = {
        "ok": [record(1), record(" 2 ", image="other/x:1")],
        "image": [record(1), record(2, image=None)],
        "shape": [record(1), '"x"'],
        "ident": [record(1), record(None)],
        "twice": [record(1), record("1")],
    }
    asks = [(name, i) for name in [*listings, "empty"] for i in (" 1", "2", "3", "  ")]
    requests = spark.createDataFrame(asks, "listing_id string, instance_id string")
    got = fleet.verify_ownership(requests, normalized(spark, listings), owned(spark, "lab/fold"))
    table = {}
    for r in got.collect():
        table.setdefault(r.listing_id, {})[r.instance_id.strip()] = r.verification
    assert table.pop("ok") == {"1": "owned", "2": "refused", "3": "absent", "": "refused"}
    assert table.pop("empty") == {"1": "absent", "2": "absent", "3": "absent", "": "refused"}
    assert all(set(answers.values()) == {"refused"} for answers in table.values())
    off = fleet.verify_ownership(requests, normalized(spark, listings), None)
    assert off.select("verification").distinct().collect() == [("disabled",)]


def test_judged_instances_agree_with_enumerating_and_verifying(spark):
    listings = {
        "ok": [record(1), record(2, image="other/x:1"), record(3, dph_total=-1)], "image": [record(1), record(2, image=None)],
        "shape": [record(1), '"x"'], "twice": [record(1), record("1"), record(2)],
    }
    rows, policy = normalized(spark, listings), owned(spark, "lab/fold")
    listed = fleet.enumerate_instances(rows)
    for chosen in (policy, None):
        want = fleet.verify_ownership(listed.select("listing_id", "instance_id"), rows, chosen)
        got = fleet.judged_instances(rows, chosen)
        assert values(got, "listing_id", "instance_id", "verification") == values(want, "listing_id", "instance_id", "verification")


def test_unset_instance_ids_track_nothing(spark):
    instances = spark.createDataFrame([("1",), ("",), ("2",)], "instance_id string")
    units = spark.createDataFrame([("", "running"), (None, "running"), ("2", "running")], "instance_id string, status string").withColumn("kind", F.lit("shard"))
    assert values(fleet.zombies(instances, units), "instance_id") == [("",), ("1",)]


def test_finished_units_track_nothing(spark):
    instances = spark.createDataFrame([("market", str(i)) for i in range(6)], "provider string, instance_id string")
    states = ["running", "downloaded", "failed", "destroyed", "pending", "deployed"]
    units = spark.createDataFrame([("shard", str(i), s) for i, s in enumerate(states)], "kind string, instance_id string, status string")
    assert values(fleet.zombies(instances, units), "instance_id") == [("1",), ("2",), ("3",), ("4",)]
    elsewhere = units.withColumn("provider", F.when(F.col("instance_id") == "0", "runpod").otherwise("market"))
    assert values(fleet.zombies(instances, elsewhere), "instance_id") == [("0",), ("1",), ("2",), ("3",), ("4",)]


DESTROY = "instance_id string, stop_status int, stop_error string, delete_statuses array<string>, verify1 string, verify1_error string, verify2 string, verify2_error string"


def brute_force_destroy(stop_status, stop_error, deletes, v1, e1, v2, e2):
    """The protocol step by step."""
    if stop_error:
        return ("unknown", 0, None, None)
    attempts, last = 0, stop_status
    for n, status in enumerate(deletes, 1):
        if status == "raise":
            last = None
            continue
        attempts = n
        if status != "none":
            last = int(status)
        if status in ("200", "204"):
            break
    if v1 == "gone":
        if attempts == 0:
            return ("unknown", 0, last, "no delete attempt returned")
        return ("destroyed" if last in (200, 204) else "leaked", attempts, last, None)
    if v1 != "present":
        return ("unknown", attempts, last, e1)
    if v2 == "gone":
        return ("unknown", 0, last, "no delete attempt returned") if attempts == 0 else ("destroyed", attempts, last, None)
    if v2 == "raise":
        return ("unknown", attempts, last, e2)
    return ("unknown", attempts, last, e2 or e1 or "verify returned PRESENT")


def test_destroy_verdict_equals_the_protocol_step_by_step(spark):
    scripts = [["200"], ["204"], ["503"], ["503", "503", "200"], ["raise"] * 3, ["raise", "raise", "200"], ["none"] * 3, ["200", "503"],
               ["503", "raise", "none"], ["none", "raise", "503"], ["503"] * 4 + ["200"], [], ["raise", "none", "raise"]]
    rows = []
    for stop in ((200, None), (None, None), (None, "Timeout: x")):
        for deletes in scripts:
            for v1, e1 in (("gone", None), ("present", None), ("unknown", "HTTP 500"), ("raise", "Boom: 1")):
                for v2, e2 in (("gone", None), ("present", None), ("unknown", "HTTP 502"), ("raise", "Boom: 2")):
                    rows.append((str(len(rows)), stop[0], stop[1], deletes, v1, e1, v2, e2))
    got = {r.instance_id: (r.verdict, r.attempts, r.last_status, r.verify_error) for r in cleanup.destroy_verdict(spark.createDataFrame(rows, DESTROY)).collect()}
    assert got == {r[0]: brute_force_destroy(*r[1:]) for r in rows}


def test_verify_without_a_second_look(spark):
    rows = [("1", 200, None, ["200"], "present", None, "gone", None)]
    got = cleanup.destroy_verdict(spark.createDataFrame(rows, DESTROY), verify_after_resurrection=False).first()
    assert (got.verdict, got.verify_error) == ("unknown", "verify returned PRESENT")


def candidates(spark, rows):
    schema = "provider string, instance_id string, state string, verification string, destroy_verdict string, attempts int, last_status int, verify_error string, stop_error string"
    return spark.createDataFrame([(*r, 1, 503, None, None) for r in rows], schema)


CASES = [
    ("runpod", "1", "running", "owned", "destroyed"), ("market", "2", "", "owned", "destroyed"), ("market", "3", "destroyed", "owned", "destroyed"),
    ("market", "4", "running", "refused", "destroyed"), ("market", "5", "running", "owned", "destroyed"), ("market", "6", "running", "absent", "leaked"),
    ("market", "7", "running", "disabled", "unknown"), ("market", "8", "running", "owned", None),
    (None, "9a", "running", "owned", "destroyed"), ("market", "9b", "running", None, "destroyed"), ("market", "9c", "running", "odd", "destroyed"),
]


@pytest.mark.parametrize(
    ("credentials", "want"),
    [
        ("available", ["provider_mismatch", "ineligible_state", "ineligible_state", "ownership", "destroyed", "leaked", "unknown", "unknown", "provider_mismatch", "ownership", "ownership"]),
        ("absent", ["provider_mismatch", "ineligible_state", "ineligible_state", "ownership", "cli_attempted", "already_gone", "cli_attempted", "cli_attempted", "provider_mismatch", "ownership", "ownership"]),
        ("disabled", ["provider_mismatch", "ineligible_state", "ineligible_state"] + ["credentials_disabled"] * 5 + ["provider_mismatch"] + ["credentials_disabled"] * 2),
    ],
)
def test_dispatch(spark, credentials, want):
    got = cleanup.dispatch(candidates(spark, CASES), credentials=credentials)
    rows = got.orderBy("instance_id").collect()
    assert [r.verdict or r.refusal for r in rows] == want
    broken = got.select(cleanup.outcome_violations(F.col("verdict"), F.col("refusal"), F.col("error")).alias("v")).where(F.size("v") > 0)
    assert broken.count() == 0


def test_sweep_counts_a_gone_instance_apart(spark):
    instances = spark.createDataFrame(
        [("market", str(i), "prod-3f9a1b2c4d5e-x" if i < 4 else "prodevil-1", "running", "lab/fold") for i in range(6)],
        "provider string, instance_id string, label string, state string, ownership_key string",
    )
    units = spark.createDataFrame([("shard", "0", "running")], "kind string, instance_id string, status string")
    log = spark.createDataFrame([], DESTROY)
    answers = spark.createDataFrame([("1", "absent"), ("2", "owned")], "instance_id string, verification string")
    outcomes = sweep(instances, units, log, "prod-3f9a1b2c4d5e", verification=answers, credentials="absent")
    assert values(outcomes, "instance_id", "verdict", "refusal", "severity") == [
        ("1", "already_gone", None, "info"), ("2", "cli_attempted", None, "warning"), ("3", None, "ownership", "info"),
    ]
    assert tuple(sweep_totals(outcomes).first()) == (0, 1, 2, 3)


def test_sweep_takes_the_last_run_of_an_instance(spark):
    instances = spark.createDataFrame([("market", "1", "prod-3f9a1b2c4d5e-x", "running", "a")], "provider string, instance_id string, label string, state string, ownership_key string")
    units = spark.createDataFrame([], "kind string, instance_id string, status string")
    runs = [("1", 200, None, ["503"], "unknown", "HTTP 500", "unknown", None, 1), ("1", 200, None, ["503"] * 3 + ["200"], "gone", None, "gone", None, 2)]
    outcomes = sweep(instances, units, spark.createDataFrame(runs, DESTROY + ", run_at int"), "prod-3f9a1b2c4d5e")
    assert values(outcomes, "instance_id", "verdict", "attempts") == [("1", "destroyed", 4)]


def test_policy_function_results_are_checked(spark):
    frame = spark.createDataFrame([("market", str(i)) for i in range(4)] + [("runpod", "9"), (None, "99")], "provider string, instance_id string")

    def destroy(c):
        n = F.col("instance_id").cast("int")
        return c.withColumns(
            {
                "verdict": F.when(n == 0, "destroyed").when(n == 1, "leaked").when(n == 2, "vanished"),
                "refusal": F.when(n == 2, "ownership"),
                "error": F.when(n == 1, "still there").otherwise(""),
            }
        )

    got = cleanup.apply_policy(frame, destroy, provider="market")
    assert values(got, "instance_id", "verdict", "refusal") == [
        ("0", "destroyed", None), ("1", "leaked", None), ("2", "unknown", None), ("3", "unknown", None), ("9", None, "provider_mismatch"), ("99", None, "provider_mismatch"),
    ]


def test_severity_of_every_outcome(spark):
    rows = [("leaked", None), ("unknown", None), ("cli_attempted", None), ("already_gone", None), ("destroyed", None), (None, "ownership"),
            (None, "credentials_disabled"), (None, "no_credentials"), (None, "odd"), (None, None), ("odd", None)]
    got = spark.createDataFrame(rows, "v string, r string").select(cleanup.severity(F.col("v"), F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == ["error", "warning", "warning", "info", None, "info", "warning", "warning", "error", "error", "error"]


def walked(pages):
    """Page by page from the start, as a client would ask: numbers of the (token, next) pages, by plain Python."""
    by_token, named = {}, {}
    for token, after in set(pages):
        by_token.setdefault(token, []).append(after)
        if after is not None:
            named[after] = named.get(after, 0) + 1
    out, token, n = {}, "", 0
    while token is not None and len(by_token.get(token, [])) == 1 and named.get(token, 0) == (0 if n == 0 else 1):
        out[token] = n
        token, n = by_token[token][0], n + 1
    return out


def test_pages_are_ranked_by_their_tokens_alone(spark):
    from fleetlens.operators import chains

    rng = random.Random(4)
    listings = {}
    for k in range(60):
        n = rng.choice([1, 2, 3, 9, 40])
        tokens = ["", *(f"t{i}" for i in range(1, n)), None]
        pages = list(zip(tokens, tokens[1:]))
        for _ in range(rng.choice([0, 0, 1, 2])):  # a fork, a circle, a doubled or a lost token
            pages[rng.randrange(len(pages))] = (rng.choice(tokens[:-1]), rng.choice(tokens[1:]))
        if rng.random() < 0.2:
            pages.append(rng.choice(pages))
        listings[k] = pages
    rows = [(k, t, a) for k, pages in listings.items() for t, a in pages]
    rng.shuffle(rows)
    got = {}
    for r in chains.rank(spark.createDataFrame(rows, "k int, own string, ahead string"), "k", "own", "ahead").collect():
        got.setdefault(r.k, {})[r.own] = (r.rank, r.place)
    for k, pages in listings.items():
        want = walked(pages)
        assert set(got[k]) == {t for t, _ in pages}
        assert {t: rank for t, (rank, place) in got[k].items() if place == "chain"} == want
        assert all((rank is None) == (place != "chain") for rank, place in got[k].values())


def test_a_long_shuffled_listing_is_ranked_in_few_rounds(spark):
    from fleetlens.operators import chains

    n = 100_000
    links = spark.range(n).select(
        F.lit("one").alias("k"), F.when(F.col("id") == 0, "").otherwise(F.md5(F.col("id").cast("string"))).alias("own"),
        F.when(F.col("id") < n - 1, F.md5((F.col("id") + 1).cast("string"))).alias("ahead"), "id",
    ).orderBy(F.hash("id"))
    ranked = chains.rank(links, "k", "own", "ahead")
    assert ranked.join(links, ["k", "own"]).where("rank = id AND place = 'chain'").count() == n


def test_circles_and_what_hangs_on_them(spark):
    from fleetlens.operators import chains

    rows = [(1, "", "a"), (1, "a", None), (1, "x", "y"), (1, "y", "z"), (1, "z", "x"), (2, "a", "b"), (2, "b", None), (3, "", None), (3, "", None)]
    got = {(r.k, r.own): r.place for r in chains.rank(spark.createDataFrame(rows, "k int, own string, ahead string"), "k", "own", "ahead").collect()}
    assert got == {(1, ""): "chain", (1, "a"): "chain", (1, "x"): "circle", (1, "y"): "circle", (1, "z"): "circle", (2, "a"): "loose", (2, "b"): "loose", (3, ""): "chain"}
    assert chains.token_chain(chains.numbered_pages(spark.createDataFrame([], "listing_id long, after_token string, raw string"))).count() == 0


def links_written(spark, monkeypatch, n):
    """Rows written while one shuffled list of ``n`` links is ranked, and how many of them got the right rank."""
    from fleetlens.operators import chains

    written = []

    def counted(df, label, write=chains.stored):
        out = write(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(chains, "stored", counted)
    links = spark.range(n).select(
        F.lit("one").alias("k"), F.when(F.col("id") == 0, "").otherwise(F.md5(F.col("id").cast("string"))).alias("own"),
        F.when(F.col("id") < n - 1, F.md5((F.col("id") + 1).cast("string"))).alias("ahead"), "id",
    ).orderBy(F.hash("id"))
    right = chains.rank(links, "k", "own", "ahead").join(links, ["k", "own"]).where("rank = id AND place = 'chain'").count()
    return sum(written), right


def test_ranking_moves_a_few_times_the_links_however_long_the_list(spark, monkeypatch):
    from fleetlens.operators import chains

    written, right = links_written(spark, monkeypatch, 20_000)
    assert right == 20_000
    assert written <= 4 * 20_000
    monkeypatch.setattr(chains, "TASK_LINKS", 300)
    written, right = links_written(spark, monkeypatch, 20_000)
    assert right == 20_000
    assert written <= 8 * 20_000


def test_lists_too_long_for_a_task_are_ranked_like_short_ones(spark, monkeypatch):
    from fleetlens.operators import chains

    rng = random.Random(7)
    rows = []
    for k in (None, 0, 1, 2, 3):
        tokens = ["", *(f"t{i}" for i in range(1, 400)), None]
        pages = list(zip(tokens, tokens[1:]))
        for _ in range(k or 0):  # what follows is cut off
            at = rng.randrange(len(pages))
            pages[at] = (pages[at][0], rng.choice(tokens[1:-1]))
        circles = [(f"c{k}-{i}", f"c{k}-{i + 1 if (i + 1) % 9 else i - 8}") for i in range(90)]
        pages += [*circles, ("self", "self"), ("x", "y"), ("y", "z"), ("z", None), ("x", "y2"), ("y2", None)]
        rows += [(k, own, ahead) for own, ahead in pages]
    rng.shuffle(rows)
    links = spark.createDataFrame(rows, "k int, own string, ahead string")
    short = sorted(chains.rank(links, "k", "own", "ahead").collect(), key=repr)
    monkeypatch.setattr(chains, "TASK_LINKS", 40)
    assert sorted(chains.rank(links, "k", "own", "ahead").collect(), key=repr) == short
    assert len(short) == len({(k, own) for k, own, _ in rows})
    places = {(r.k, r.own): (r.place, r.rank) for r in short}
    for k in (None, 0, 1, 2, 3):
        want = walked([(own, ahead) for of, own, ahead in rows if of == k])
        assert {own: r for (of, own), (place, r) in places.items() if of == k and place == "chain"} == want
        assert places[k, "self"] == ("circle", None) and places[k, f"c{k}-4"] == ("circle", None)
        assert [places[k, own][0] for own in ("x", "y", "z", "y2")] == ["fork", "loose", "loose", "loose"]


def test_pages_that_share_a_token(spark):
    from fleetlens.operators import chains

    def page(records, following):
        return f'{{"instances": {records}, "next_token": {following}}}'

    rows = [
        (1, None, page("[1]", '"a"')), (1, "", page("[1]", '"a"')), (1, "", page("[ 1]", '"a"')), (1, "a", page("[2]", "null")),  # one page, written twice
        (2, "", page("[1]", '"a"')), (2, "", page("[3]", '"a"')), (2, "a", page("[2]", "null")),  # other records
        (3, "", page("[1]", '"a"')), (3, "", page("[1]", '"b"')), (3, "a", page("[2]", "null")),  # another token
        (4, "", page("[1]", "null")), (None, "", page("[1]", "null")),
    ]
    pages = chains.numbered_pages(spark.createDataFrame(rows, "listing_id long, after_token string, raw string"))
    got = sorted((r.listing_id, r.after_token, r.page_no, r.place) for r in pages.select("listing_id", "after_token", F.coalesce("page_no", F.lit(-1)).alias("page_no"), "place").collect())
    assert got == [
        (1, "", 0, "chain"), (1, "", 0, "chain"), (1, "a", 1, "chain"),
        (2, "", -1, "fork"), (2, "", -1, "fork"), (2, "a", 1, "chain"),
        (3, "", -1, "fork"), (3, "", -1, "fork"), (3, "a", -1, "loose"), (4, "", 0, "chain"),
    ]


def test_token_pages_are_those_of_the_text_without_a_window_over_all_orders(spark, folder):
    from fleetlens import fixtures
    from fleetlens.operators.ordered import followed

    spark.range(500).selectExpr("CASE WHEN id % 50 = 49 THEN NULL WHEN id % 7 = 3 THEN 70 ELSE id * id END AS o_orderkey").write.parquet(f"{folder}/orders.parquet")
    spark.range(5).selectExpr("id AS s_suppkey").write.parquet(f"{folder}/supplier.parquet")
    pages = fixtures.Views(spark, folder).token_pages
    assert sorted(pages.collect(), key=repr) == sorted(spark.sql(fixtures._spark_text("v_token_pages", folder)).collect(), key=repr)
    keys = spark.createDataFrame([(x,) for x in [None, None, 5, 5, 6, -9, 10**18]], "x long")
    assert sorted(map(tuple, followed(keys, "x", "y").collect()), key=repr) == sorted([(None, None), (None, -9), (-9, 5), (5, 5), (5, 6), (6, 10**18), (10**18, None)], key=repr)
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_group" in plan and "windowspecdefinition(o_orderkey" not in plan
