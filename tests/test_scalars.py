"""Scalar functions against tables of cases and the Python standard library."""

import hashlib
import ipaddress
import random

import pytest
from conftest import evaluate
from pyspark.sql import functions as F

from fleetlens.functions import fmt, gpu, image, json_values, keys, prefixes, scope, text

HEX64, HEX128 = "5" * 64, "5" * 128
VALID_IMAGES = {
    "solver": "solver",
    "team/solver": "team/solver",
    "solver:2024.06": "solver",
    "team/solver:nightly": "team/solver",
    f"solver@sha256:{HEX64}": "solver",
    f"solver@sha512:{HEX128}": "solver",
    f"solver@blake2:{HEX64}": "solver",
    f"solver:9@sha256:{HEX64}": "solver",
    "solver@mine+b64.v2:Xy9_=-": "solver",
    "hub.internal:8443/team/render:7": "hub.internal:8443/team/render",
    "docker.io/team/solver": "docker.io/team/solver",
    "[fe80::2]:8443/team/render:7": "[fe80::2]:8443/team/render",
    "[fe80::2%en1]/render": "[fe80::2%en1]/render",
    "localhost/team/render": "localhost/team/render",
    "localhost:9/render:7": "localhost:9/render",
    "team/ray__tracer:7": "team/ray__tracer",
    "te.am/ray_v3.1-rc:7": "te.am/ray_v3.1-rc",
    "team/ray_tracer": "team/ray_tracer",
    "x----y/z": "x----y/z",
    "\t solver:3 \n": "solver",
    "solver:8443": "solver",
    "192.168.7.9:00443/render": "192.168.7.9:00443/render",
}
BAD_IMAGES = [
    "", "\t", "worse?name", "solver:worse?tag", "solver:" + "t" * 129, "solver@" + "5" * 64, "solver@sha256:" + "5" * 63,
    "solver@sha256:" + "Y" * 64, f"solver@SHA256:{HEX64}", f"solver@sHa512:{HEX128}", "solver@sha256:" + "5" * 65,
    "hub:x1y/team/render", "hub:70000/team/render", "hub:0/render", "hub..broken/team/render",
    "-dash/team/render", "_under/team/render", "Team/render", "solver@" + "q" * 70, "team/render@one@sha256:00", "two words",
    "team//render", "/render", "render/", "[fe80::2]y/render", "[fe80::2/render", "[7:8]/render", "solver:", "h.k:3:4/render",
    "h" * 64 + ".k/render", "solver\n:3", "@sha256:" + HEX64, "h_.k/render", ("h." * 130) + "k/render",
]


def test_image_repository_of_valid_references(spark):
    assert evaluate(spark, list(VALID_IMAGES), image.image_repository) == list(VALID_IMAGES.values())


def test_image_repository_of_malformed_references(spark):
    got = evaluate(spark, BAD_IMAGES, image.image_repository)
    assert {ref: out for ref, out in zip(BAD_IMAGES, got) if out != ""} == {}


def test_image_repository_is_idempotent(spark):
    once = evaluate(spark, list(VALID_IMAGES), image.image_repository)
    assert evaluate(spark, once, image.image_repository) == once


def test_longest_host_and_label_limits(spark):
    label = "a" * 63
    host = ".".join([label] * 3 + ["a" * 61])
    assert len(host) == 253
    assert evaluate(spark, [f"{host}/app", f"{host}a/app"], image.image_repository) == [f"{host}/app", ""]


def _ipv6_samples(n):
    rng = random.Random(7)
    out = ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "::ffff:1.2.3.4",
           "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "::01.2.3.4", ":::", "1:::2", "1::2::3", ":1", "1:", "12345::", "g::", "", "1.2.3.4", "fe80::1%a", "fe80::1%", "fe80::1%a%b"]
    for _ in range(n):
        groups = [rng.choice(["", "0", "1", "ab", "FFFF", "12345", "1.2.3.4"]) for _ in range(rng.randint(1, 9))]
        out.append(":".join(groups))
    return out


def test_ipv6_pattern_agrees_with_the_standard_library(spark):
    samples = _ipv6_samples(600)

    def valid(x):
        try:
            ipaddress.IPv6Address(x)
        except ValueError:
            return False
        return True

    got = evaluate(spark, samples, lambda x: text.full_match(x, image.IPV6))
    assert [s for s, g in zip(samples, got) if g != valid(s)] == []


def test_strip_follows_python(spark):
    samples = ["", " ", "\t a b \n", "\x1c\x1da\x1f", " x　", "x\n\n", "​x", "a\xa0"]
    assert evaluate(spark, samples, text.strip) == [s.strip() for s in samples]


def test_full_match_refuses_a_trailing_newline(spark):
    assert evaluate(spark, ["ab", "ab\n", "xab"], lambda x: text.full_match(x, "ab")) == [True, False, False]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("  project/batches  ", "project/batches/"), ("/project/batches/", "project/batches/"), ("a//b///c/", "a/b/c/"),
        ("a", "a/"), (" a / ", "a /"), ("", None), ("/", None), (" // ", None), (None, None),
    ],
)
def test_canonical_prefix(spark, raw, want):
    assert evaluate(spark, [raw], prefixes.canonical_prefix) == [want]


def test_canonical_prefix_is_idempotent(spark):
    rng = random.Random(3)
    raw = ["".join(rng.choice("ab/ ") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    once = [p for p in evaluate(spark, raw, prefixes.canonical_prefix) if p is not None]
    assert evaluate(spark, once, prefixes.canonical_prefix) == [
        None if not p.strip().strip("/") else p.strip().lstrip("/") if p.startswith(" ") or p.startswith("/") else p for p in once
    ]


def test_managed_rule_id_is_the_digest_of_bucket_and_prefix(spark):
    row = spark.range(1).select(prefixes.managed_rule_id(F.lit("bkt"), F.lit("project/")).alias("x")).first()
    assert row.x == "fleetlens-expire-" + hashlib.sha256(b"bkt\x00project/").hexdigest()[:12]


def test_scopes(spark):
    good = "prod-3f9a1b2c4d5e"
    cases = [good, "prod", "prod-3F9A1B2C4D5E", "prod-3f9a1b2c4d5", good + "X", "", " ", "3f9a1b2c4d5e", " " + good, good + "\n"]
    assert evaluate(spark, cases, scope.valid_cleanup_scope) == [True] + [False] * 6 + [True, False, False]
    assert evaluate(spark, [good, "a-b-" + good[5:], "plain", "-" + good[5:]], scope.recover_prefix) == ["prod", "a-b", "plain", ""]


def test_scope_compare_is_delimited(spark):
    labels = ["prod-abcdef012345-1", "prodevil-abcdef012345", "prod", "pro_-x"]
    assert evaluate(spark, labels, lambda x: scope.in_scope(x, F.lit("prod"))) == [True, False, False, False]
    assert evaluate(spark, labels, lambda x: scope.in_scope(x, F.lit("prod"), adjacent=True)) == [True, True, True, False]
    assert evaluate(spark, labels, lambda x: scope.in_scope(x, F.lit("pro_"))) == [False, False, False, True]


def test_new_scope_has_a_fresh_suffix(spark):
    none = F.lit(None).cast("string")
    rows = spark.range(2).select(scope.resolve_scope(F.lit("prod"), none, none).alias("r")).collect()
    made = [r.r.scope for r in rows]
    assert made[0] != made[1] and all(len(m) == 17 and m.startswith("prod-") for m in made)


IDS = {
    '{"id": "123"}': "123", '{"id": 456}': "456", '{"id": " 123 "}': "123", '{"id": -7}': "-7", '{"id": 123456789012345678901}': "123456789012345678901",
    '{"id": null}': None, '{"id": true}': None, '{"id": false}': None, '{"id": ""}': None, '{"id": "   "}': None, '{"id": [1,2]}': None,
    '{"id": {"id":1}}': None, '{"id": 5.0}': None, '{"id": 5e0}': None, "{}": None, '"bad"': None, '["also","bad"]': None, "42": None, "{bad": None,
}


def test_normalize_id(spark):
    got = evaluate(spark, list(IDS), lambda x: json_values.normalize_id(json_values.field(json_values.parse(x), "id")))
    assert got == list(IDS.values())


def test_json_coercions(spark):
    raw = ['"abc"', '""', "null", "123", "1.5", "true", "false", "[]", "{}", "-0.25", "1e3"]
    assert evaluate(spark, raw, lambda x: json_values.string_or_empty(json_values.parse(x))) == ["abc"] + [""] * 10
    assert evaluate(spark, raw, lambda x: json_values.float_or_zero(json_values.parse(x))) == [0, 0, 0, 123, 1.5, 0, 0, 0, 0, -0.25, 1000]
    assert evaluate(spark, raw + ['[0]', '{"a":1}', "0", "0.0", '"x"'], lambda x: json_values.truthy(json_values.parse(x))) == [
        True, False, False, True, True, True, False, False, False, True, True, True, True, False, False, True,
    ]


def test_gpu_readings(spark):
    lines = ["65, 0", "95, 0", "60, 5", "70, N/A", "90, 0", "garbage", " 91 ,0\n", "x, y", "60, [N/A]", "60, -3", "60, 1_0"]
    got = evaluate(spark, lines, lambda x: gpu.breach(gpu.telemetry(x)))
    assert got == [None, "temp", "ecc", None, None, None, "temp", None, None, None, "ecc"]
    three = ["65, 24000, 0", "65, 3000, 0", "95, 3000, 1", "65, 24000, 2", "65, 0"]
    assert evaluate(spark, three, lambda x: gpu.breach(gpu.telemetry(x, min_memory_mib=8000), min_memory_mib=8000)) == [
        None, "memory", "temp", "ecc", "memory",
    ]


def test_cuda_version(spark):
    images = ["nvidia/cuda:12.10.1-devel", "x-cuda-11.8", "plain:1.0", "cuda:latest"]
    assert evaluate(spark, images, gpu.cuda_version) == ["12.10", "11.8", "12.4", "12.4"]
    assert evaluate(spark, ["12.10", "12.4", "11.9"], lambda x: gpu.version_at_least(x, F.lit("12.9"))) == [True, False, False]


def test_vram(spark):
    raw = ["100, 24000\n1, 2", "100, 19999", "bad", "5", "", "a, 24000"]
    assert evaluate(spark, raw, lambda x: gpu.vram(x)["total_mib"]) == [24000, 19999, None, None, None, None]


def test_hours_text(spark):
    assert evaluate(spark, [2.25, 0.75, 1.0, 0.0, 26.999, 0.999], fmt.hours_text, "double") == [
        "2h 15m", "45m", "1h 00m", "0m", "26h 59m", "59m",
    ]


def test_cost_text(spark):
    rows = [(0, 5.0, 6.0), (4, 1.339, 1.341), (4, 1.34, 1.72)]
    got = spark.createDataFrame(rows, "n int, a double, b double").select(fmt.cost_text(F.col("n"), F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in got.collect()] == ["$0.00", "$1.34", "$1.34-$1.72"]


def test_key_round_trip(spark):
    root, batch, shard, item = F.lit("r"), F.lit("b"), F.lit(7), F.lit("a/b")
    parsed = spark.range(1).select(
        keys.parse_key(keys.marker_key(root, batch, shard, item), "r").alias("m"),
        keys.parse_key(keys.global_marker_key(root, batch, item), "r").alias("g"),
        keys.parse_key(F.concat(keys.shard_prefix(root, batch, shard), F.lit("DONE")), "r").alias("d"),
        keys.parse_key(F.concat(keys.job_prefix(root, batch, F.lit("job1")), F.lit("DONE")), "r").alias("j"),
        keys.parse_key(F.lit("other/b/shard_7/DONE"), "r").alias("x"),
        keys.chunk_key(F.lit("p/"), F.lit(1000), ext=".xtc").alias("c"),
    ).first()
    assert tuple(parsed.m) == ("b", "shard_7", 7, "marker", "a/b")
    assert tuple(parsed.g) == ("b", "global_markers", None, "global_marker", "a/b")
    assert tuple(parsed.d) == ("b", "shard_7", 7, "done", "DONE")
    assert tuple(parsed.j) == ("b", "job1", None, "done", "DONE")
    assert parsed.x is None
    assert parsed.c == "p/data_chunk_1000.xtc"


def test_safe_path(spark):
    paths = ["a/b", "", "/abs", "a/../b", "..", "a..b", None, "./a"]
    assert evaluate(spark, paths, keys.safe_path) == [True, False, False, False, False, True, False, True]


def test_images_from_flag(spark):
    assert evaluate(spark, [None, "", "a, b ,,", " "], image.images_from_flag) == [None, [], ["a", "b"], []]
