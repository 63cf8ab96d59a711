"""Typed reads of provider records held as VARIANT.

The type of a value is the first three letters of its schema text, which one
call yields; richer checks would repeat that call for every comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import strip

STRING, OBJECT, ARRAY, BOOLEAN, NULL = "STR", "OBJ", "ARR", "BOO", "VOI"
NUMBERS = ("BIG", "DEC", "DOU", "FLO")
TYPE_NAMES = {STRING: "string", OBJECT: "object", ARRAY: "list", BOOLEAN: "boolean", NULL: "null"} | dict.fromkeys(
    NUMBERS, "number"
)


def parse(raw: Column) -> Column:
    """VARIANT of a JSON text, NULL when it does not parse."""
    return F.try_parse_json(raw)


def field(record: Column, name: str) -> Column:
    """Field of an object as VARIANT; NULL when missing or not an object."""
    return F.try_variant_get(record, f"$.{name}", "variant")


def fields(record: Column, *names: str) -> Column:
    """Struct of several fields as VARIANT, read in one pass; NULL when not an object."""
    wanted = ", ".join(f"`{name}`: variant" for name in names)
    return F.try_variant_get(record, "$", f"struct<{wanted}>")


def type_of(value: Column) -> Column:
    """Type code of a value, one of the constants above; NULL when missing."""
    return F.substring(F.schema_of_variant(value), 1, 3)


def is_integer(value: Column) -> Column:
    """True for an integer of any size.

    JSON keeps ``5.0`` as a short decimal; a decimal without fraction counts as
    an integer from 19 digits on, where 64-bit integers end.
    """
    return F.coalesce(F.schema_of_variant(value).rlike(r"\A(?:BIGINT|DECIMAL\((?:19|[23][0-9]),0\))\z"), F.lit(False))


def is_object(record: Column) -> Column:
    """True for a JSON object."""
    return F.try_variant_get(record, "$", "map<string,variant>").isNotNull()


def text(record: Column, name: str) -> Column:
    """String field as it is."""
    return F.try_variant_get(record, f"$.{name}", "string")


def string(value: Column) -> Column:
    """The string, or NULL for any other type."""
    return F.when(type_of(value) == STRING, F.try_variant_get(value, "$", "string"))


def string_or_empty(value: Column) -> Column:
    """The string, or ``""`` for any other type."""
    return F.coalesce(string(value), F.lit(""))


def float_or_zero(value: Column) -> Column:
    """The number, or 0.0 for any other type."""
    number = F.when(type_of(value).isin(*NUMBERS), F.try_variant_get(value, "$", "double"))
    return F.nanvl(F.coalesce(number, F.lit(0.0)), F.lit(0.0))


def normalize_id(value: Column) -> Column:
    """Stripped id from a string or integer; NULL for anything else or a blank."""
    as_text = F.try_variant_get(value, "$", "string")
    return F.when(type_of(value) == STRING, F.nullif(strip(as_text), F.lit(""))).when(is_integer(value), as_text)


def truthy(value: Column) -> Column:
    """Whether a JSON value counts as true: non-zero, non-empty, not null."""
    kind = type_of(value)
    return F.coalesce(
        F.when(value.isNull() | (kind == NULL), False)
        .when(kind == BOOLEAN, F.try_variant_get(value, "$", "boolean"))
        .when(kind == STRING, F.try_variant_get(value, "$", "string") != "")
        .when(kind.isin(*NUMBERS), F.try_variant_get(value, "$", "double") != 0)
        .when(kind == ARRAY, F.size(F.try_variant_get(value, "$", "array<variant>")) > 0)
        .when(kind == OBJECT, F.size(F.try_variant_get(value, "$", "map<string,variant>")) > 0),
        F.lit(False),
    )


def object_keys(record: Column) -> Column:
    """Field names of an object; NULL for anything else."""
    return F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))


def elements(value: Column) -> Column:
    """Array elements as VARIANT; NULL when not an array."""
    return F.try_variant_get(value, "$", "array<variant>")


def computed_once(df: DataFrame, columns: dict[str, Column], keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``columns``, evaluated once per row; ``keep`` limits the columns carried along.

    A filter above a projection is moved below it together with the expressions
    it reads, which would parse the JSON again for every condition. A
    one-element ``inline`` over the finished columns is a barrier for that.
    """
    kept = df.columns if keep is None else keep
    finished = df.select(*kept, *[value.alias(f"_once_{name}") for name, value in columns.items()])
    packed = F.array(F.struct(*[F.col(f"_once_{name}").alias(name) for name in columns]))
    return finished.select(*kept, F.inline(packed))
