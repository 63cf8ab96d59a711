"""Label prefixes and scopes: ``<prefix>-<12 lower-case hex>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.text import full_match, strip

SUFFIX = "[0-9a-f]{12}"


def valid_label_prefix(prefix: Column) -> Column:
    """Non-empty and without white space around it."""
    return F.coalesce((prefix != "") & (prefix == strip(prefix)), F.lit(False))


def valid_scope(scope: Column, requested: Column) -> Column:
    """``scope`` is ``requested``, a dash and 12 lower-case hex digits."""
    head = F.concat(requested, F.lit("-"))
    tail = F.substr(scope, F.length(head) + 1)
    return F.coalesce(F.startswith(scope, head) & full_match(tail, SUFFIX), F.lit(False))


def valid_cleanup_scope(scope: Column) -> Column:
    """A full scope, as manual cleanup requires."""
    return valid_label_prefix(scope) & F.coalesce(scope.rlike(rf"(?:\A|-){SUFFIX}\z"), F.lit(False))


def recover_prefix(scope: Column) -> Column:
    """Requested prefix of a scope; a scope without the suffix is returned as it is."""
    return F.regexp_replace(scope, rf"-{SUFFIX}\z", "")


def in_scope(label: Column, scope: Column, *, adjacent: bool = False) -> Column:
    """``label`` belongs to ``scope``; ``adjacent`` drops the delimiter."""
    return F.startswith(label, scope if adjacent else F.concat(scope, F.lit("-")))


def resolve_scope(requested: Column, scope: Column, stored: Column, suffix: Column | None = None) -> Column:
    """Struct ``action, scope, error``: a new scope, the stored one, or why neither holds."""
    fresh = suffix if suffix is not None else F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)
    error = (
        F.when(
            scope.isNull() & stored.isNull(),
            F.when(~valid_label_prefix(requested), "invalid label prefix"),
        )
        .when(scope.isNull() | stored.isNull(), "partial label identity")
        .when(~valid_label_prefix(requested), "invalid label prefix")
        .when(~valid_label_prefix(stored), "invalid stored prefix")
        .when(stored != requested, "prefix mismatch")
        .when(~valid_scope(scope, stored), "malformed scope")
    )
    is_new = scope.isNull() & stored.isNull()
    return F.struct(
        F.when(error.isNotNull(), "error").when(is_new, "new").otherwise("reuse").alias("action"),
        F.when(error.isNotNull(), F.lit(None).cast("string"))
        .when(is_new, F.concat(requested, F.lit("-"), fresh))
        .otherwise(scope)
        .alias("scope"),
        F.coalesce(error, F.lit("")).alias("error"),
    )
