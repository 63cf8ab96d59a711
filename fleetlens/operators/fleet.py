"""Instance listings: pages, record validation, listing health, ownership, totals.

Every function works on many listings at once; ``listing_id`` tells them apart,
so one verdict per listing is an aggregate and never a collected list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import json_values as J
from fleetlens.functions.image import image_repository
from fleetlens.functions.scope import in_scope
from fleetlens.functions.text import lookup, quoted, strip
from fleetlens.operators.units import in_class

RECORD_FIELDS = ("instance_id", "label", "state", "image_uuid", "ownership_key", "gpu_model", "cost_per_hour", "started_at")


def list_documents(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Split whole-listing documents into records; a root that is no list is an error.

    Returns the document columns with ``error`` (empty when fine) and
    ``records`` (array of VARIANT).
    """
    opened = docs.withColumn("_root", J.parse(F.col(raw))).withColumn("_records", J.elements(F.col("_root")))
    kind = lookup(J.type_of(F.col("_root")), J.TYPE_NAMES, "value")
    error = (
        F.when(F.col("_records").isNotNull(), "")
        .when(F.col("_root").isNull(), "listing JSON is invalid")
        .otherwise(F.concat(F.lit("listing must be a list, got "), kind))
    )
    return opened.select(
        *[c for c in docs.columns if c != raw],
        error.alias("error"),
        F.coalesce("_records", F.array().cast("array<variant>")).alias("records"),
    )


def explode_records(listings: DataFrame, records: str = "records") -> DataFrame:
    """One row per record with its position."""
    keep = [c for c in listings.columns if c not in (records, "error")]
    return listings.select(*keep, F.posexplode(records).alias("pos", "record"))


def open_pages(pages: DataFrame) -> DataFrame:
    """Check every page envelope: adds ``next_token``, ``records`` and ``error``."""
    parsed = pages.withColumn("_root", J.fields(J.parse(F.col("raw")), "instances", "next_token")).withColumn(
        "_token", F.col("_root.next_token")
    )
    opened = J.computed_once(
        parsed,
        {
            "records": J.elements(F.col("_root.instances")),
            "_token_type": F.coalesce(J.type_of(F.col("_token")), F.lit(J.NULL)),
            "_text": F.try_variant_get("_token", "$", "string"),
            "_object": F.col("_root").isNotNull(),
        },
        keep=("listing_id", "page_no", "after_token"),
    )
    is_text = F.col("_token_type") == J.STRING
    bad_token = (~is_text & (F.col("_token_type") != J.NULL)) | (is_text & (F.col("_text") == ""))
    error = (
        F.when(~F.col("_object"), "page must be an object")
        .when(F.col("records").isNull(), "page has no instance list")
        .when(bad_token, "invalid page token")
        .otherwise("")
    )
    return opened.select(
        "listing_id",
        "page_no",
        "after_token",
        F.when(is_text, F.col("_text")).alias("next_token"),
        "records",
        error.alias("error"),
    )


def page_chain(opened: DataFrame) -> DataFrame:
    """One verdict per listing: envelopes, token order and end, however many pages it has."""
    previous = opened.select(
        "listing_id", (F.col("page_no") + 1).alias("page_no"), F.col("next_token").alias("_expected"), F.lit(True).alias("_linked")
    )
    broken = F.when(
        F.col("page_no") == 0, F.coalesce(F.col("after_token"), F.lit("")) != ""
    ).otherwise(~F.col("after_token").eqNullSafe(F.col("_expected")))
    tokens = opened.where(F.col("next_token").isNotNull()).groupBy("listing_id", "next_token").agg(F.count("*").alias("_n"))
    repeated = tokens.groupBy("listing_id").agg(F.max(F.col("_n") > 1).alias("_repeated"))
    verdict = (
        opened.drop("records")
        .join(previous, ["listing_id", "page_no"], "left")
        .groupBy("listing_id")
        .agg(
            F.count("*").alias("pages"),
            F.max(F.col("error") != "").alias("_bad"),
            F.max(broken).alias("_broken"),
            F.count_if(F.col("next_token").isNull()).alias("_ends"),
            F.max_by("next_token", "page_no").alias("_last"),
            F.min_by("error", F.when(F.col("error") != "", F.col("page_no"))).alias("_first_error"),
        )
        .join(repeated, "listing_id", "left")
    )
    reason = (
        F.when(F.col("_bad"), F.col("_first_error"))
        .when(F.coalesce("_repeated", F.lit(False)), "invalid page token")
        .when(F.col("_broken") | (F.col("_ends") != 1) | F.col("_last").isNotNull(), "broken page chain")
        .otherwise("")
    )
    return verdict.select("listing_id", "pages", reason.alias("error"), (reason == "").alias("ok"))


def paged_records(opened: DataFrame) -> DataFrame:
    """Records of all pages of the listings whose chain holds."""
    sound = page_chain(opened).where("ok").select("listing_id")
    return opened.join(sound, "listing_id", "left_semi").select(
        "listing_id", "page_no", F.posexplode("records").alias("pos", "record")
    )


def normalize_records(records: DataFrame, record: Column, *, provider: str = C.PROVIDERS[0]) -> DataFrame:
    """Turn provider records into candidate columns and a ``reject`` reason.

    ``reject`` is empty for a valid candidate. ``canonical_id`` is also set for
    records that fail later checks, since duplicates count those too.
    """
    names = ("id", "image_uuid", "label", "actual_status", "gpu_name", "dph_total", "start_date")
    fields = J.computed_once(
        records.withColumn("_r", J.fields(record, *names)),
        {
            "is_object": F.col("_r").isNotNull(),
            "canonical_id": J.normalize_id(F.col("_r.id")),
            "_image": J.string(F.col("_r.image_uuid")),
            "label": J.string_or_empty(F.col("_r.label")),
            "state": J.string_or_empty(F.col("_r.actual_status")),
            "gpu_model": J.string_or_empty(F.col("_r.gpu_name")),
            "cost_per_hour": J.float_or_zero(F.col("_r.dph_total")),
            "started_at": J.float_or_zero(F.col("_r.start_date")),
        },
        keep=tuple(records.columns),
    )
    image = F.coalesce("_image", F.lit(""))
    typed = fields.withColumns(
        {
            "image_is_text": F.col("_image").isNotNull(),
            "provider": F.lit(provider),
            "instance_id": F.col("canonical_id"),
            "image_uuid": image,
            "ownership_key": image,
        }
    ).drop("_image")
    reject = (
        F.when(~F.col("is_object"), "not an object")
        .when(F.col("canonical_id").isNull(), "invalid id")
        .when(_bad_number(F.col("cost_per_hour")), "invalid cost_per_hour")
        .when(_bad_number(F.col("started_at")), "invalid started_at")
        .otherwise("")
    )
    return typed.withColumn("reject", reject)


def _bad_number(value: Column) -> Column:
    """NULL, NaN, infinite or negative."""
    return ~F.coalesce((value >= 0) & (value < float("inf")), F.lit(False))


def candidate_error(started_at: Column, providers: Sequence[str] = C.PROVIDERS) -> Column:
    """First broken candidate rule over the candidate columns, ``""`` when none."""
    texts = [F.col(c).isNull() for c in ("label", "state", "image_uuid", "ownership_key", "gpu_model")]
    any_null = texts[0]
    for t in texts[1:]:
        any_null = any_null | t
    ident = F.col("instance_id")
    return (
        F.when(~F.coalesce(F.col("provider").isin(*providers), F.lit(False)), "unknown provider")
        .when(~F.coalesce((ident != "") & (ident == strip(ident)), F.lit(False)), "invalid id")
        .when(any_null, "text field is not a string")
        .when(_bad_number(F.col("cost_per_hour")), "invalid cost_per_hour")
        .when(_bad_number(started_at), "invalid started_at")
        .otherwise("")
    )


def listing_health(normalized: DataFrame) -> DataFrame:
    """One row per listing: sizes, duplicate ids, and whether enumeration or verification may use it."""
    per_id = normalized.groupBy("listing_id", "canonical_id").agg(
        F.count("*").alias("_n"),
        F.count_if(~F.col("is_object") | F.col("canonical_id").isNull() | ~F.col("image_is_text")).alias("_bad"),
        F.count_if(F.col("reject") == "").alias("_good"),
    )
    duplicate = F.col("canonical_id").isNotNull() & (F.col("_n") > 1)
    return (
        per_id.groupBy("listing_id")
        .agg(
            F.sum("_n").alias("records"),
            F.sum("_good").alias("candidates"),
            F.count_if(duplicate).alias("duplicate_ids"),
            F.sum("_bad").alias("malformed"),
        )
        .withColumn("void", F.col("duplicate_ids") > 0)
        .withColumn("provable", ~F.col("void") & (F.col("malformed") == 0))
    )


def enumerate_instances(normalized: DataFrame) -> DataFrame:
    """Valid candidates of the listings without a duplicate id."""
    void = listing_health(normalized).where("void").select("listing_id")
    return (
        normalized.where(F.col("reject") == "")
        .join(void, "listing_id", "left_anti")
        .select("listing_id", "provider", *RECORD_FIELDS)
    )


def judged_instances(normalized: DataFrame, owned: DataFrame | None) -> DataFrame:
    """Enumerated candidates with the ``verification`` of their own record.

    The same verdicts as enumerating and then verifying against the same
    listing, where no candidate can be absent.
    """
    health = listing_health(normalized).where(~F.col("void")).select("listing_id", "provable")
    candidates = with_ownership(
        normalized.where(F.col("reject") == "").join(health, "listing_id"), owned, key="image_uuid"
    )
    verification = (
        F.when(F.lit(owned is None), "disabled").when(F.col("provable") & F.col("owned"), "owned").otherwise("refused")
    )
    return candidates.select("listing_id", "provider", *RECORD_FIELDS, verification.alias("verification"))


def owned_repositories(images: DataFrame, column: str = "image") -> DataFrame:
    """Distinct repositories of the owned images; malformed entries own nothing."""
    repository = image_repository(F.col(column)).alias("_repository")
    return images.select(repository).where(F.col("_repository") != "").distinct()


def with_ownership(instances: DataFrame, owned: DataFrame | None, *, key: str = "ownership_key") -> DataFrame:
    """Add ``owned``. ``owned=None`` switches the check off, an empty table refuses all."""
    if owned is None:
        return instances.withColumn("owned", F.lit(True))
    known = owned_repositories(owned).withColumn("_hit", F.lit(True))
    return (
        instances.withColumn("_repository", image_repository(F.col(key)))
        .join(known, "_repository", "left")
        .withColumn("owned", F.coalesce("_hit", F.lit(False)))
        .select(*instances.columns, "owned")
    )


def verify_ownership(requests: DataFrame, normalized: DataFrame, owned: DataFrame | None) -> DataFrame:
    """Classify requested ids as ``owned, absent, refused, disabled``.

    ``requests`` has ``listing_id, instance_id``. One malformed or duplicate
    record refuses every id of its listing, since absence cannot be proved then;
    a listing without records proves absence.
    """
    if owned is None:
        return requests.withColumn("verification", F.lit("disabled"))
    doubtful = listing_health(normalized).where(~F.col("provable")).select(
        "listing_id", F.lit(True).alias("_doubtful")
    )
    records = with_ownership(
        normalized.where(F.col("is_object") & F.col("canonical_id").isNotNull()).select(
            "listing_id", F.col("canonical_id").alias("_target"), "image_uuid"
        ),
        owned,
        key="image_uuid",
    ).groupBy("listing_id", "_target").agg(F.min("owned").alias("_owned"))
    target = F.nullif(strip(F.col("instance_id")), F.lit(""))
    return (
        requests.withColumn("_target", target)
        .join(doubtful, "listing_id", "left")
        .join(records, ["listing_id", "_target"], "left")
        .select(
            *requests.columns,
            F.when(F.col("_target").isNull() | F.col("_doubtful").isNotNull(), "refused")
            .when(F.col("_owned").isNull(), "absent")
            .when(F.col("_owned"), "owned")
            .otherwise("refused")
            .alias("verification"),
        )
    )


def scope_filter(instances: DataFrame, *scopes: str, adjacent: bool = False) -> DataFrame:
    """Instances whose label belongs to one of the scopes."""
    inside = F.lit(False)
    for scope in scopes:
        inside = inside | in_scope(F.col("label"), F.lit(scope), adjacent=adjacent)
    return instances.where(inside)


def zombies(instances: DataFrame, units: DataFrame) -> DataFrame:
    """Instances no live unit tracks; the id that a finished or failed unit keeps does not count.

    Where both sides name a provider, an id counts for its own provider only.
    """
    keys = ["instance_id", *(c for c in ("provider",) if c in units.columns and c in instances.columns)]
    tracked = in_class(units, "active").where(F.col("instance_id") != "").select(*keys)
    return instances.join(tracked, keys, "left_anti")


def eligibility_error(state: Column) -> Column:
    """Why an instance in ``state`` must not be destroyed, ``""`` when it may."""
    return (
        F.when(F.coalesce(state, F.lit("")) == "", "empty state")
        .when(
            state.isin(*C.TERMINAL_INSTANCE_STATES),
            F.concat(F.lit("state "), quoted(state), F.lit(" is final")),
        )
        .otherwise("")
    )


def fleet_totals(instances: DataFrame) -> DataFrame:
    """Hourly cost and counts over the listing; needs ``owned``."""
    cost = F.sum(F.col("cost_per_hour").cast("decimal(12,6)"))
    return instances.agg(
        F.coalesce(cost.cast("double"), F.lit(0.0)).alias("total_per_hour"),
        F.count_if(F.col("state") == "running").alias("running"),
        F.count("*").alias("instances"),
        F.count_if("owned").alias("owned"),
    )
