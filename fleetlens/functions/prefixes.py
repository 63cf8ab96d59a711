"""Object prefixes and retention-rule identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.text import quoted, strip


def prefix_error(raw: Column) -> Column:
    """Why a prefix is refused, NULL when it is fine."""
    text = strip(raw)
    return (
        F.when(raw.isNull(), "prefix must be a string")
        .when(text == "", "prefix must not be empty")
        .when(text == "/", "bucket-wide rules are not supported")
        .when(text.rlike(r"\A/+\z"), "prefix has no segment")
    )


def canonical_prefix(raw: Column) -> Column:
    """``a/b/``: trimmed, single separators, no leading and one trailing slash; NULL when refused."""
    single = F.regexp_replace(strip(raw), "/{2,}", "/")
    bare = F.regexp_replace(single, r"\A/|/\z", "")
    return F.when(prefix_error(raw).isNull(), F.concat(bare, F.lit("/")))


def managed_rule_id(bucket: Column, prefix: Column) -> Column:
    """Stable id of the managed rule of a bucket and canonical prefix."""
    digest = F.sha2(F.concat(bucket, F.char(F.lit(0)), prefix), 256)
    return F.concat(F.lit(C.RULE_ID_PREFIX), F.substring(digest, 1, 12))


def prefixes_overlap(a: Column, b: Column) -> Column:
    """One prefix starts with the other."""
    return F.startswith(a, b) | F.startswith(b, a)


def foreign_rule_warning(rule_id: Column, prefix: Column) -> Column:
    """Text for a foreign rule that can expire managed objects early."""
    return F.concat(
        F.lit("rule "),
        quoted(rule_id),
        F.lit(" of prefix "),
        quoted(prefix),
        F.lit(" overlaps and may expire objects first"),
    )
