"""Retention rules: plans, warnings, collisions, fingerprints and checks.

Rules are rows ``bucket, pos, id, status, prefix, days, extra``; ``extra`` is
the JSON text of the fields the model does not know. Policies are rows
``bucket, raw_prefix, days``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import json_values as J
from fleetlens.functions import prefixes as P
from fleetlens.functions.text import strip
from fleetlens.operators.ordered import Running, hash_slice, running

RULE = ("bucket", "pos", "id", "status", "prefix", "days", "extra")
RULES_PER_SLICE = 1024
PARTS = 4


def parse_rules(documents: DataFrame) -> DataFrame:
    """Rules of configuration documents ``bucket, raw`` in order; no rules, no rows.

    ``extra`` is the JSON object of what the typed columns do not hold, with its
    keys in order, so the rows go straight to the planners and the writer.
    """
    rules = J.elements(J.field(F.col("_root"), "Rules"))
    rows = documents.withColumn("_root", J.parse(F.col("raw"))).select("bucket", F.posexplode(rules).alias("pos", "_rule"))
    days = J.field(F.col("_rule"), "Expiration.Days")
    return rows.select(
        "bucket",
        "pos",
        F.coalesce(J.text(F.col("_rule"), "ID"), F.lit("")).alias("id"),
        J.text(F.col("_rule"), "Status").alias("status"),
        F.coalesce(F.try_variant_get("_rule", "$.Filter.Prefix", "string"), F.lit("")).alias("prefix"),
        F.when(J.is_integer(days), F.try_variant_get(days, "$", "bigint")).alias("days"),
        _other_fields(F.col("_rule")).alias("extra"),
    )


def _other_fields(rule: Column) -> Column:
    """JSON object of the fields of a rule that ``parse_rules`` has no column for."""

    def entries(value: Column, *typed: tuple[str, Column]) -> Column:
        """Sorted ``"key":json`` texts of an object without its typed fields."""
        taken = F.array_compact(F.array(*[F.when(known, F.lit(name)) for name, known in typed]))
        pairs = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        rest = F.filter(pairs, lambda e: ~F.array_contains(taken, e["key"]))
        return F.array_sort(F.transform(rest, lambda e: F.concat(_json_text(e["key"]), F.lit(":"), F.to_json(e["value"]))))

    def is_text(value: Column) -> Column:
        return F.coalesce(J.type_of(value) == J.STRING, F.lit(False))

    def inner(name: str, field: str, known: Column) -> Column:
        """One entry with what is left of a nested object; nothing when nothing is left."""
        left = entries(J.field(rule, name), (field, known))
        return F.when(F.size(left) > 0, F.concat(F.lit(f'"{name}":{{'), F.array_join(left, ","), F.lit("}")))

    days = J.field(rule, "Expiration.Days")
    nested = {
        "Filter": ("Prefix", is_text(J.field(rule, "Filter.Prefix"))),
        "Expiration": ("Days", J.is_integer(days)),
    }
    typed = [("ID", is_text(J.field(rule, "ID"))), ("Status", is_text(J.field(rule, "Status")))]
    objects = [(name, J.is_object(J.field(rule, name))) for name in nested]
    own = F.coalesce(entries(rule, *typed, *objects), F.array().cast("array<string>"))
    parts = F.array_compact(F.array(*[inner(name, *known) for name, known in nested.items()]))
    return F.concat(F.lit("{"), F.array_join(F.array_sort(F.concat(own, parts)), ","), F.lit("}"))


def _json_text(value: Column) -> Column:
    """A string as JSON, quotes included."""
    listed = F.to_json(F.array(value))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def rule_text() -> Column:
    """Text of a rule row without its position; different rows have different texts, NULL is not ``''``."""
    fields = F.struct("id", "status", "prefix", F.col("days").cast("bigint").alias("days"), "extra")
    return F.to_json(fields, {"ignoreNullFields": "false"})


def fingerprints(rules: DataFrame) -> DataFrame:
    """Order-sensitive fingerprint and rule count per bucket.

    Every rule hashes its position and text; the hash parts are summed, so a
    bucket with most of the rules is combined before the shuffle, and the sums
    are hashed again.
    """
    digest = F.sha2(F.concat_ws("|", F.col("pos").cast("string"), rule_text()), 256)
    hashed = rules.withColumn("_digest", digest)
    parts = [
        F.sum(F.conv(F.substring("_digest", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"_p{i}") for i in range(PARTS)
    ]
    summed = hashed.groupBy("bucket").agg(F.count("*").alias("rules"), *parts)
    joined = F.concat_ws("|", F.col("rules").cast("string"), *[F.col(f"_p{i}").cast("string") for i in range(PARTS)])
    return summed.select("bucket", "rules", F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


def empty_fingerprint() -> Column:
    """Fingerprint of a bucket without rules."""
    return F.substring(F.sha2(F.lit("0"), 256), 1, 16)


def with_identity(policies: DataFrame) -> DataFrame:
    """Add ``canonical_prefix, rule_id`` and ``error``; refused prefixes keep NULLs."""
    return (
        policies.withColumn("error", F.coalesce(P.prefix_error(F.col("raw_prefix")), F.lit("")))
        .withColumn("canonical_prefix", P.canonical_prefix(F.col("raw_prefix")))
        .withColumn("rule_id", P.managed_rule_id(F.col("bucket"), F.col("canonical_prefix")))
    )


def _sides(rules: DataFrame, policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Managed prefixes without their last slash, and the foreign rules with a prefix."""
    managed = with_identity(policies).where(F.col("error") == "").select(
        "bucket", "canonical_prefix", "rule_id", F.regexp_replace("canonical_prefix", r"/\z", "").alias("_bare")
    )
    foreign = rules.where((F.col("prefix") != "") & ~F.startswith("id", F.lit(C.RULE_FAMILY))).select(
        "bucket", "pos", F.col("id").alias("foreign_id"), F.col("prefix").alias("foreign_prefix")
    )
    return managed, foreign


def _heads(side: DataFrame, text: str, other: DataFrame, other_text: str, longer: bool) -> DataFrame:
    """Rows of ``side`` with ``_head``: their text cut to each length that the other side uses in the bucket."""
    lengths = other.groupBy("bucket").agg(F.collect_set(F.length(other_text)).alias("_lengths"))
    size = F.length(text)
    fits = F.filter("_lengths", lambda n: (n < size) if longer else (n <= size))
    return (
        side.join(lengths, "bucket")
        .withColumn("_len", F.explode(fits))
        .withColumn("_head", F.substr(text, F.lit(1), F.col("_len")))
        .drop("_lengths", "_len")
    )


def overlapping_rules(rules: DataFrame, policies: DataFrame) -> DataFrame:
    """Foreign rules whose prefix covers or lies under a managed prefix, with the warning.

    The managed prefix is compared without its last slash. Overlap means one
    text starts with the other, so each side is cut to the lengths the other
    side uses in that bucket and joined on equality.
    """
    managed, foreign = _sides(rules, policies)
    wider = _heads(managed, "_bare", foreign, "foreign_prefix", longer=False).join(
        foreign.withColumn("_head", F.col("foreign_prefix")), ["bucket", "_head"]
    )
    narrower = _heads(foreign, "foreign_prefix", managed, "_bare", longer=True).join(
        managed.withColumn("_head", F.col("_bare")), ["bucket", "_head"]
    )
    columns = ("bucket", "canonical_prefix", "pos", "foreign_id", "foreign_prefix")
    both = wider.select(*columns).unionByName(narrower.select(*columns))
    return both.withColumn("warning", P.foreign_rule_warning(F.col("foreign_id"), F.col("foreign_prefix")))


def overlap_counts(rules: DataFrame, policies: DataFrame) -> DataFrame:
    """``bucket, canonical_prefix, warnings``: overlapping foreign rules, counted per prefix before any join."""
    managed, foreign = _sides(rules, policies)
    prefixes = foreign.groupBy("bucket", "foreign_prefix").agg(F.count("*").alias("_n"))
    wider = _heads(managed, "_bare", prefixes, "foreign_prefix", longer=False).join(
        prefixes.withColumnRenamed("foreign_prefix", "_head"), ["bucket", "_head"]
    )
    under = _heads(prefixes, "foreign_prefix", managed, "_bare", longer=True).groupBy("bucket", "_head").agg(F.sum("_n").alias("_n"))
    narrower = managed.withColumn("_head", F.col("_bare")).join(under, ["bucket", "_head"])
    columns = ("bucket", "canonical_prefix", "_n")
    both = wider.select(*columns).unionByName(narrower.select(*columns))
    return both.groupBy("bucket", "canonical_prefix").agg(F.sum("_n").alias("warnings"))


def _managed_matches(rules: DataFrame, policies: DataFrame) -> DataFrame:
    return policies.join(
        rules.select("bucket", F.col("id").alias("rule_id"), "pos", "status", "prefix", F.col("days").alias("rule_days"), "extra"),
        ["bucket", "rule_id"],
    )


def collisions(rules: DataFrame, policies: DataFrame) -> DataFrame:
    """Rules that carry a managed id but no retention days or another prefix."""
    found = _managed_matches(rules, with_identity(policies).where(F.col("error") == ""))
    reason = F.when(F.col("rule_days").isNull(), "no Expiration.Days").when(
        F.col("prefix") != F.col("canonical_prefix"), "bound to another prefix"
    )
    return found.withColumn("collision", reason).where(F.col("collision").isNotNull()).select(
        "bucket", "rule_id", "pos", "prefix", "collision"
    )


def lifecycle_plan(rules: DataFrame, policies: DataFrame, *, operation: str = "apply") -> DataFrame:
    """One plan row per policy: rule counts, no-op, source fingerprint, warnings and collisions.

    Applying is a no-op exactly when the managed rule is the bucket's only rule
    with that id, stands last and already has the wanted content; removing, when
    no rule has the id. So no before and after lists are built.
    """
    wanted = with_identity(policies).where(F.col("error") == "")
    prints = fingerprints(rules)
    last = rules.groupBy("bucket").agg(F.max("pos").alias("_last"))
    same = (
        F.col("status").eqNullSafe(F.lit("Enabled"))
        & F.col("prefix").eqNullSafe(F.col("canonical_prefix"))
        & F.col("rule_days").eqNullSafe(F.col("days"))
        & F.col("extra").eqNullSafe(F.lit("{}"))
    )
    matches = (
        _managed_matches(rules, wanted.select("bucket", "rule_id", "canonical_prefix", "days"))
        .groupBy("bucket", "rule_id")
        .agg(
            F.count("*").alias("_managed"),
            F.max("pos").alias("_managed_pos"),
            F.min(same).alias("_same"),
            F.max(F.col("rule_days").isNull() | (F.col("prefix") != F.col("canonical_prefix"))).alias("_collides"),
        )
    )
    warned = overlap_counts(rules, policies).withColumnRenamed("warnings", "_warnings")
    joined = (
        wanted.join(prints, "bucket", "left")
        .join(last, "bucket", "left")
        .join(matches, ["bucket", "rule_id"], "left")
        .join(warned, ["bucket", "canonical_prefix"], "left")
    )
    before = F.coalesce("rules", F.lit(0))
    managed = F.coalesce("_managed", F.lit(0))
    if operation == "apply":
        after = before - managed + 1
        no_op = (managed == 1) & (F.col("_managed_pos") == F.col("_last")) & F.coalesce("_same", F.lit(False))
        warnings = F.coalesce("_warnings", F.lit(0))
    else:
        after = before - managed
        no_op = managed == 0
        warnings = F.lit(0).cast("bigint")
    return joined.select(
        "bucket",
        "canonical_prefix",
        "rule_id",
        F.lit(operation).alias("operation"),
        before.alias("before_rules"),
        after.alias("after_rules"),
        no_op.alias("no_op"),
        F.coalesce("fingerprint", empty_fingerprint()).alias("source_fingerprint"),
        warnings.alias("warnings"),
        F.coalesce("_collides", F.lit(False)).alias("collision"),
    )


def renumbered(rules: DataFrame, *, appended: Column | None = None) -> DataFrame:
    """Rules with gapless positions in their order; those that are ``appended`` come last, by the hash of their prefix."""
    last = F.lit(0) if appended is None else F.when(appended, 1).otherwise(0)
    place = F.when(last == 1, hash_slice(F.col("prefix"))).otherwise(F.lit(""))
    name = F.when(last == 1, F.col("prefix")).otherwise(F.col("id"))
    ranked = running(
        rules.withColumns({"_last": last, "_hash": place, "_name": name}),
        ["bucket"],
        "_last",
        ["pos", "_hash", "_name"],
        [Running("_rank", "sum", F.lit(1), include_current=False)],
        slice_by=F.struct("_last", F.floor(F.col("pos") / RULES_PER_SLICE).alias("pos"), "_hash"),
    )
    return ranked.withColumn("pos", F.col("_rank").cast("int")).select(*RULE)


def rules_after(rules: DataFrame, policies: DataFrame, *, operation: str = "apply") -> DataFrame:
    """The rule sets after all policies: managed rules removed, then the new ones appended."""
    wanted = with_identity(policies).where(F.col("error") == "")
    kept = rules.join(wanted.select("bucket", F.col("rule_id").alias("id")), ["bucket", "id"], "left_anti").select(*RULE)
    if operation != "apply":
        return renumbered(kept)
    new = wanted.select(
        "bucket",
        F.lit(None).cast("int").alias("pos"),
        F.col("rule_id").alias("id"),
        F.lit("Enabled").alias("status"),
        F.col("canonical_prefix").alias("prefix"),
        F.col("days").cast("int").alias("days"),
        F.lit("{}").alias("extra"),
        F.lit(True).alias("_new"),
    )
    every = kept.withColumn("_new", F.lit(False)).unionByName(new)
    return renumbered(every, appended=F.col("_new"))


def plan_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Positions at which two rule sets differ: ``added, removed`` or ``changed``."""
    left = before.select("bucket", "pos", rule_text().alias("before_rule"))
    right = after.select("bucket", "pos", rule_text().alias("after_rule"))
    change = (
        F.when(F.col("before_rule").isNull(), "added").when(F.col("after_rule").isNull(), "removed").otherwise("changed")
    )
    return (
        left.join(right, ["bucket", "pos"], "full_outer")
        .where(~F.col("before_rule").eqNullSafe(F.col("after_rule")))
        .withColumn("change", change)
    )


def rules_equal(before: DataFrame, after: DataFrame) -> DataFrame:
    """``bucket, equal``: whether the ordered rule sets are the same."""
    buckets = before.select("bucket").union(after.select("bucket")).distinct()
    differing = plan_diff(before, after).select("bucket").distinct().withColumn("_differs", F.lit(True))
    return buckets.join(differing, "bucket", "left").select("bucket", F.col("_differs").isNull().alias("equal"))


def policy_error(bucket: Column, days_json: Column) -> Column:
    """Why a policy is refused, ``""`` when fine; days are JSON text so their type shows."""
    days = J.parse(days_json)
    number = F.try_variant_get(days, "$", "decimal(38,0)")
    return (
        F.when(F.coalesce(strip(bucket), F.lit("")) == "", "bucket must be a non-empty string")
        .when(~J.is_integer(days), "expire_after_days must be an integer")
        .when(number < 1, "expire_after_days must be >= 1")
        .otherwise("")
    )


def plan_freshness(plans: DataFrame, current: DataFrame) -> DataFrame:
    """Add ``fresh``: the bucket's rules still have the fingerprint the plan was made from."""
    now = fingerprints(current).select("bucket", F.col("fingerprint").alias("current_fingerprint"))
    joined = plans.join(now, "bucket", "left").withColumn(
        "current_fingerprint", F.coalesce("current_fingerprint", empty_fingerprint())
    )
    return joined.withColumn("fresh", F.col("current_fingerprint") == F.col("source_fingerprint"))


def post_write_check(expected: DataFrame, current: DataFrame) -> DataFrame:
    """``bucket, verified``: the rules read back equal the planned ones."""
    return rules_equal(expected, current).withColumnRenamed("equal", "verified")


def managed_rule_lookup(rules: DataFrame, policies: DataFrame) -> DataFrame:
    """The managed rule of each policy's bucket and prefix, if configured."""
    wanted = with_identity(policies).where(F.col("error") == "").select("bucket", "canonical_prefix", "rule_id")
    found = (
        _managed_matches(rules, wanted)
        .groupBy("bucket", "rule_id")
        .agg(F.min_by("status", "pos").alias("rule_status"), F.min_by("rule_days", "pos").alias("days"))
        .withColumn("_found", F.lit(True))
    )
    return (
        wanted.join(found, ["bucket", "rule_id"], "left")
        .join(fingerprints(rules), "bucket", "left")
        .select(
            "bucket",
            "canonical_prefix",
            "rule_id",
            F.when(F.col("_found"), "configured").otherwise("not configured").alias("status"),
            "rule_status",
            "days",
            F.coalesce("rules", F.lit(0)).alias("rules"),
            F.coalesce("fingerprint", empty_fingerprint()).alias("fingerprint"),
        )
    )
