"""Display texts and time arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_text(hours: Column) -> Column:
    """``2h 15m`` or ``45m``; minutes are cut, not rounded."""
    whole = F.floor(hours).cast("bigint")
    minutes = F.floor((hours - whole) * 60).cast("bigint")
    return F.when(
        whole > 0, F.concat(whole.cast("string"), F.lit("h "), F.lpad(minutes.cast("string"), 2, "0"), F.lit("m"))
    ).otherwise(F.concat(minutes.cast("string"), F.lit("m")))


def money(amount: Column) -> Column:
    """Dollars with two places, rounded half up on twelve decimal places."""
    return F.concat(F.lit("$"), rounded(amount, 2).cast("string"))


def rounded(amount: Column, places: int) -> Column:
    """A double rounded as a decimal number; NULL where it is none."""
    return F.round(amount.try_cast("decimal(28,12)"), places)


def cost_text(cloud_gpus: Column, low: Column, high: Column) -> Column:
    """``$0.00`` when local, one price when the range is below a cent, else the range."""
    return (
        F.when(cloud_gpus == 0, "$0.00")
        .when(F.abs(low - high) < 0.01, money(low))
        .otherwise(F.concat(money(low), F.lit("-"), money(high)))
    )


def instant(text: Column) -> Column:
    """ISO-8601 text as a timestamp; a text without zone is UTC, a bad one NULL."""
    zoned = text.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2}(?::?[0-9]{2})?)\z")
    dated = text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    full = F.when(zoned, text).when(dated, F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text != "", full.try_cast("timestamp"))


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from ``start`` to ``end``."""
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def runtime_micros(submit: Column, complete: Column, as_of: Column) -> Column:
    """Run time in microseconds of ISO texts; open runs end at ``as_of``, unsubmitted ones are 0."""
    end = F.coalesce(instant(complete), as_of.cast("timestamp"))
    return F.when(submit == "", F.lit(0).cast("bigint")).otherwise(micros_between(instant(submit), end))


def runtime_hours(submit: Column, complete: Column, as_of: Column) -> Column:
    """Run time in hours."""
    return runtime_micros(submit, complete, as_of) / F.lit(3.6e9)


def archive_suffix(ts: Column) -> Column:
    """``20240131_235959``."""
    return F.date_format(ts.cast("timestamp"), "yyyyMMdd_HHmmss")


def iso_text(ts: Column) -> Column:
    """ISO-8601 in UTC."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since the epoch."""
    return F.unix_millis(ts.cast("timestamp"))


def destroy_text(
    verdict: Column, refusal: Column, attempts: Column, last_status: Column, verify_error: Column, stop_error: Column
) -> Column:
    """Diagnostic text of a destroy run; missing parts show as ``none``."""
    parts = {
        "verdict": verdict,
        "refusal": refusal,
        "attempts": attempts,
        "last_status_code": last_status,
        "verify_error": verify_error,
        "stop_error": stop_error,
    }
    shown = [
        F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("none"))) for name, value in parts.items()
    ]
    return F.concat_ws(", ", *shown)
