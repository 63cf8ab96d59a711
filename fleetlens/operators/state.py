"""Persisted batch state: validation, migration and loading of JSON documents.

A document is one row ``path, kind, raw``; ``kind`` is ``shard`` or ``job``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import json_values as J
from fleetlens.functions.scope import recover_prefix

NO_ARRAY = "array<variant>"


def _empty() -> Column:
    return F.array().cast(NO_ARRAY)


def open_documents(docs: DataFrame) -> DataFrame:
    """Parse every document and check root, version and collection shapes.

    Adds ``schema_version`` (0 when missing), ``schema_error`` and the parsed
    columns the later steps share.
    """
    root = F.col("root")
    names = ("schema_version", "shards", "jobs", "label", "label_scope")
    parsed = docs.withColumn("root", J.parse(F.col("raw"))).withColumn("_f", J.fields(root, *names))
    parsed = parsed.withColumns({f"_{name}": F.col(f"_f.{name}") for name in names})
    version = F.when(J.is_integer(F.col("_schema_version")), F.try_variant_get("_schema_version", "$", "bigint"))

    def bad_list(name: str) -> Column:
        value = F.col(f"_{name}")
        return J.elements(value).isNull() & (J.type_of(value) != J.NULL)

    error = (
        F.when(root.isNull(), "state JSON is invalid")
        .when(F.col("_f").isNull(), "state JSON root must be an object")
        .when(F.col("_schema_version").isNotNull() & ~J.is_integer(F.col("_schema_version")), "schema_version must be an integer")
        .when(
            F.col("_schema_version").isNotNull() & ~F.coalesce(version.isin(0, C.SCHEMA_VERSION), F.lit(False)),
            "unsupported schema_version",
        )
        .when(bad_list("shards"), "persisted shards must be a list or null")
        .when(bad_list("jobs"), "persisted jobs must be a list or null")
        .otherwise("")
    )
    shared = {
        "schema_version": F.coalesce(version, F.lit(0)),
        "schema_error": error,
        "_keys": J.object_keys(root),
        "_l_shards": J.elements(F.col("_shards")),
        "_l_jobs": J.elements(F.col("_jobs")),
    }
    for name in ("label", "label_scope"):
        value = F.col(f"_{name}")
        shared[f"_{name}_text"] = J.string_or_empty(value)
        shared[f"_{name}_true"] = J.truthy(value)
        shared[f"_{name}_odd"] = J.string(value).isNull() & J.truthy(value)
    return J.computed_once(parsed, shared, keep=(*docs.columns, "root"))


def validate_schema(docs: DataFrame) -> DataFrame:
    """``path, schema_version, error`` of every document."""
    return open_documents(docs).select("path", "schema_version", F.col("schema_error").alias("error"))


def load_documents(docs: DataFrame) -> DataFrame:
    """Decide for every document: ``load, migrate, archive`` or ``reject`` with the error.

    Version-0 documents recover their scope from the legacy label. A document
    with units but no scope is archived when every unit is terminal and
    rejected otherwise.
    """
    opened = open_documents(docs)
    job = F.col("kind") == "job"

    def either(for_jobs: tuple[str, ...], for_shards: tuple[str, ...]) -> Column:
        return F.when(job, F.array(*map(F.lit, for_jobs))).otherwise(F.array(*map(F.lit, for_shards)))

    legacy = F.col("schema_version") == 0
    known = either(C.JOB_BATCH_FIELDS, C.SHARD_BATCH_FIELDS)
    status = lambda u: J.string(J.field(u, "status"))
    staged = J.computed_once(
        opened.withColumns(
            {
                "_units": F.concat(F.coalesce("_l_shards", _empty()), F.coalesce("_l_jobs", _empty())),
                "_terminal": either(C.JOB_TERMINAL, C.SHARD_TERMINAL),
                "_own": F.coalesce(F.when(job, F.col("_l_jobs")).otherwise(F.col("_l_shards")), _empty()),
            }
        ),
        {
            "_legacy": legacy,
            "_has_units": F.size("_units") > 0,
            "_all_terminal": F.forall(
                "_units", lambda u: F.coalesce(F.array_contains(F.col("_terminal"), status(u)), F.lit(False))
            ),
            "_unknown_field": F.size(
                F.array_except("_keys", F.when(legacy, F.array_append(known, F.lit("label"))).otherwise(known))
            )
            > 0,
            "_unknown_unit": _bad_units("_own"),
            "_effective": F.when(F.col("_label_scope_text") != "", F.col("_label_scope_text")).otherwise(F.col("_label_text")),
            "units": F.col("_own"),
            "_batch_id": F.try_variant_get("root", "$.batch_id", "string"),
            "_stored_scope": F.try_variant_get("root", "$.label_scope", "string"),
            "_stored_prefix": F.try_variant_get("root", "$.requested_label_prefix", "string"),
        },
        keep=(
            "path", "kind", "schema_version", "schema_error",
            "_label_text", "_label_scope_text", "_label_odd", "_label_scope_odd", "_label_scope_true",
        ),
    )
    no_scope = "nonterminal state lacks a recoverable label scope"
    is_legacy = F.col("_legacy")
    live = F.col("_has_units") & ~F.col("_all_terminal")
    disagree = (
        (F.col("_label_scope_text") != "") & (F.col("_label_text") != "") & (F.col("_label_scope_text") != F.col("_label_text"))
    )
    migration_error = F.when(
        is_legacy,
        F.when(F.col("_label_odd") | F.col("_label_scope_odd"), "label fields must be strings")
        .when((F.col("_effective") == "") & live, no_scope)
        .when(disagree, "label and label_scope disagree"),
    )
    homeless = F.when(is_legacy, F.col("_effective") == "").otherwise(~F.col("_label_scope_true")) & F.col("_has_units")
    error = F.coalesce(
        F.nullif("schema_error", F.lit("")),
        migration_error,
        F.when(homeless, F.when(live, no_scope).otherwise("")),
        F.when(F.col("_unknown_field"), "could not deserialize state"),
        F.when(F.col("_unknown_unit"), "could not deserialize units"),
        F.lit(""),
    )
    action = (
        F.when(F.col("error") != "", "reject").when(homeless, "archive").when(is_legacy, "migrate").otherwise("load")
    )
    scope = F.when(is_legacy, F.col("_effective")).otherwise(F.col("_stored_scope"))
    prefix = F.when(is_legacy, recover_prefix(F.col("_effective"))).otherwise(F.col("_stored_prefix"))
    return staged.withColumn("error", error).select(
        "path",
        "kind",
        "schema_version",
        "schema_error",
        action.alias("action"),
        "error",
        F.coalesce("_batch_id", F.lit("")).alias("batch_id"),
        F.coalesce(scope, F.lit("")).alias("label_scope"),
        F.coalesce(prefix, F.lit("")).alias("requested_label_prefix"),
        "units",
    )


def _bad_units(column: str) -> Column:
    """Some unit is no object, has an unknown field or lacks its key field."""
    allowed = F.when(F.col("kind") == "job", F.array(*map(F.lit, C.JOB_FIELDS))).otherwise(
        F.array(*map(F.lit, C.SHARD_FIELDS))
    )
    required = F.when(F.col("kind") == "job", F.lit("job_name")).otherwise(F.lit("shard_id"))

    def bad(unit: Column) -> Column:
        names = J.object_keys(unit)
        fine = (F.size(F.array_except(names, allowed)) == 0) & F.array_contains(names, required)
        return ~F.coalesce(fine, F.lit(False))

    return F.exists(column, bad)


def loaded_units(loaded: DataFrame) -> DataFrame:
    """Unit rows of the documents that load, with the defaults of missing fields."""
    unit = F.col("_unit")

    def get(name: str, kind: str, default: object) -> Column:
        return F.coalesce(F.try_variant_get(unit, f"$.{name}", kind), F.lit(default).cast(kind)).alias(name)

    key = F.when(F.col("kind") == "job", F.try_variant_get(unit, "$.job_name", "string")).otherwise(
        F.try_variant_get(unit, "$.shard_id", "string")
    )
    return (
        loaded.where(F.col("action").isin("load", "migrate"))
        .select("path", "kind", "batch_id", "label_scope", F.posexplode("units").alias("pos", "_unit"))
        .select(
            "path",
            "kind",
            "batch_id",
            "label_scope",
            "pos",
            key.alias("unit_key"),
            get("status", "string", "pending"),
            get("instance_id", "string", ""),
            get("cost_per_hour", "double", 0.0),
            get("retry_count", "bigint", 0),
            get("items_expected", "bigint", 0),
            get("items_completed", "bigint", 0),
            F.coalesce(F.try_variant_get(unit, "$.item_ids", "array<string>"), F.array().cast("array<string>")).alias("item_ids"),
            get("failure_reason", "string", ""),
        )
    )


def load_lenient(docs: DataFrame) -> DataFrame:
    """``path, ok, units``: the older loader, which skips a corrupt document instead of rejecting it.

    It does not look at the version, and an explicit null in place of the unit
    list counts as corrupt.
    """
    parsed = docs.withColumn("root", J.parse(F.col("raw")))
    own = F.when(F.col("kind") == "job", J.field(F.col("root"), "jobs")).otherwise(J.field(F.col("root"), "shards"))
    known = F.when(F.col("kind") == "job", F.array(*map(F.lit, C.JOB_BATCH_FIELDS))).otherwise(
        F.array(*map(F.lit, C.SHARD_BATCH_FIELDS))
    )
    staged = parsed.withColumn("_own", own).withColumn("_elements", J.elements(F.col("_own")))
    blank = J.type_of(F.col("_own")).isin(J.OBJECT, J.STRING) & ~J.truthy(F.col("_own"))
    ok = (
        (F.size(F.array_except(J.object_keys(F.col("root")), known)) == 0)
        & (F.col("_own").isNull() | F.col("_elements").isNotNull() | blank)
        & ~F.coalesce(_bad_units("_elements"), F.lit(False))
    )
    judged = J.computed_once(
        staged,
        {"ok": F.coalesce(ok, F.lit(False)), "_n": F.coalesce(F.nullif(F.size("_elements"), F.lit(-1)), F.lit(0))},
        keep=("path",),
    )
    return judged.select("path", "ok", F.when(F.col("ok"), F.col("_n")).alias("units"))


def migrate_documents(docs: DataFrame) -> DataFrame:
    """Version-0 documents with their action and recovered identity, and the documents whose shape or version is refused."""
    return load_documents(docs).where((F.col("schema_version") == 0) | (F.col("schema_error") != ""))
