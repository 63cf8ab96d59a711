"""Decisions of the cleanup protocol, over logs and candidates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import json_values as J
from fleetlens.functions.fmt import destroy_text
from fleetlens.functions.text import quoted
from fleetlens.operators.fleet import eligibility_error


def _none() -> Column:
    return F.lit(None).cast("string")


def _named(value: Column) -> Column:
    return F.coalesce(quoted(value), F.lit("unknown"))


def verify_verdict(status_code: Column, body: Column) -> Column:
    """Struct ``verdict, error`` of one status request: ``gone, present, unknown``."""
    root = J.parse(body)
    status = J.field(root, "actual_status")
    destroyed = J.string(status) == "destroyed"
    readable = J.is_object(root)
    verdict = (
        F.when(status_code == 404, "gone")
        .when(F.coalesce(status_code, F.lit(0)) != 200, "unknown")
        .when(~readable, "unknown")
        .when(F.coalesce(destroyed, F.lit(False)), "gone")
        .otherwise("present")
    )
    error = (
        F.when(status_code.isNull(), "no response")
        .when(~status_code.isin(200, 404), F.concat(F.lit("HTTP "), status_code.cast("string")))
        .when((status_code == 200) & root.isNull(), "response is not JSON")
        .when((status_code == 200) & ~readable, "response is not an object")
    )
    return F.struct(verdict.alias("verdict"), error.alias("error"))


def latest_runs(log: DataFrame) -> DataFrame:
    """The last destroy run of each instance by ``run_at``; equal times are told apart by the other columns."""
    rest = [c for c in log.columns if c not in ("instance_id", "run_at")]
    last = F.max(F.struct("run_at", *rest)).alias("_run")
    return log.groupBy("instance_id").agg(last).select("instance_id", "_run.*")


def destroy_verdict(log: DataFrame, *, verify_after_resurrection: bool = True) -> DataFrame:
    """Fold one destroy run per row into ``verdict, attempts, last_status, verify_error``.

    ``delete_statuses`` is an array of status texts, ``raise`` for a failed call
    and ``none`` for an answer without status; the whole log counts up to its
    first success. A run whose deletes all failed is ``unknown`` even if the
    instance is gone, as no attempt can be credited. ``run_at`` is kept where the
    log has it.
    """
    success = [str(s) for s in C.SUCCESS_STATUS]
    first_hit = F.array_min(F.array(*[F.nullif(F.array_position(F.col("delete_statuses"), s), F.lit(0)) for s in success]))
    steps = log.withColumn("_hit", first_hit)
    used = F.when(
        F.col("_hit").isNotNull(), F.slice(F.col("delete_statuses"), F.lit(1), F.col("_hit").cast("int"))
    ).otherwise(F.col("delete_statuses"))
    steps = steps.withColumn("_used", used)
    answered = F.transform("_used", lambda x, i: F.when(x != "raise", i + 1).otherwise(0))
    spoken = F.filter("_used", lambda x: x != "none")
    last = F.try_element_at(spoken, F.lit(-1))
    steps = steps.withColumn("_attempts", F.coalesce(F.array_max(answered), F.lit(0))).withColumn(
        "_last",
        F.when(F.size(spoken) == 0, F.col("stop_status")).when(last != "raise", last.try_cast("int")),
    )
    credited = F.col("_attempts") >= 1
    gone = F.when(~credited, "unknown").when(F.col("_last").isin(*C.SUCCESS_STATUS), "destroyed").otherwise("leaked")
    second = F.when((F.col("verify2") == "gone") & credited, "destroyed").otherwise("unknown")
    if not verify_after_resurrection:
        second = F.lit("unknown")
    verdict = (
        F.when(F.col("stop_error").isNotNull(), "unknown")
        .when(F.col("verify1") == "gone", gone)
        .when(F.col("verify1") == "present", second)
        .otherwise("unknown")
    )
    uncredited = F.lit("no delete attempt returned")
    present = F.lit("verify returned PRESENT")
    if verify_after_resurrection:
        after_second = (
            F.when(F.col("verify2") == "gone", F.when(~credited, uncredited))
            .when(F.col("verify2") == "raise", F.col("verify2_error"))
            .otherwise(F.coalesce("verify2_error", "verify1_error", present))
        )
    else:
        after_second = F.coalesce("verify1_error", present)
    verify_error = (
        F.when(F.col("stop_error").isNotNull(), _none())
        .when(F.col("verify1") == "gone", F.when(~credited, uncredited))
        .when(F.col("verify1") == "present", after_second)
        .otherwise(F.col("verify1_error"))
    )
    stopped = F.col("stop_error").isNull()
    return steps.select(
        "instance_id",
        *[c for c in log.columns if c == "run_at"],
        verdict.alias("verdict"),
        F.when(stopped, F.col("_attempts")).otherwise(0).cast("int").alias("attempts"),
        F.when(stopped, F.col("_last")).alias("last_status"),
        verify_error.alias("verify_error"),
        "stop_error",
    )


def dispatch(candidates: DataFrame, *, provider: str = C.PROVIDERS[0], credentials: str = "available") -> DataFrame:
    """Outcome of every cleanup candidate: ``verdict`` or ``refusal``, and ``error``.

    Needs ``provider, instance_id, state, verification`` and the destroy
    columns ``destroy_verdict, attempts, last_status, verify_error, stop_error``
    (NULL where no run was logged). ``credentials`` is ``available``, ``absent``
    or ``disabled``. The rule fails closed: an unknown provider is a mismatch and
    an unknown verification is refused.
    """
    ineligible = eligibility_error(F.col("state"))
    ident = quoted(F.col("instance_id"))
    mismatch = ~F.col("provider").eqNullSafe(F.lit(provider))
    disabled = F.lit(credentials == "disabled")
    refused = ~F.coalesce(F.col("verification").isin(*C.CLEARED_VERIFICATIONS), F.lit(False))
    refusal = (
        F.when(mismatch, "provider_mismatch")
        .when(ineligible != "", "ineligible_state")
        .when(disabled, "credentials_disabled")
        .when(refused, "ownership")
    )
    if credentials == "absent":
        verdict = F.when(F.col("verification") == "absent", "already_gone").otherwise("cli_attempted")
        detail = F.when(F.col("verification") == "absent", "").otherwise(
            "command line was used; no answer confirms the destruction"
        )
    else:
        verdict = F.coalesce("destroy_verdict", F.lit("unknown"))
        detail = F.when(verdict == "destroyed", "").otherwise(
            destroy_text(
                verdict, _none(), F.coalesce("attempts", F.lit(0)), F.col("last_status"), F.col("verify_error"), F.col("stop_error")
            )
        )
    error = (
        F.when(
            mismatch,
            F.concat(F.lit("candidate "), ident, F.lit(" is of provider "), _named(F.col("provider")), F.lit(f", this clean-up is for '{provider}'")),
        )
        .when(ineligible != "", ineligible)
        .when(disabled, "credentials are switched off")
        .when(refused, F.concat(F.lit("ownership of "), ident, F.lit(" is not proved")))
        .otherwise(detail)
    )
    return candidates.withColumns(
        {"refusal": refusal, "verdict": F.when(refusal.isNull(), verdict), "error": error}
    )


def outcome_violations(verdict: Column, refusal: Column, error: Column) -> Column:
    """Broken rules of a cleanup outcome as an array of texts."""
    known_verdict = verdict.isNull() | verdict.isin(*C.VERDICTS)
    known_refusal = refusal.isNull() | refusal.isin(*C.REFUSALS)
    exclusive = verdict.isNull() != refusal.isNull()
    success = F.coalesce(verdict.isin(*C.SUCCESS_VERDICTS), F.lit(False))
    rules = {
        "unknown verdict": ~known_verdict,
        "unknown refusal": ~known_refusal,
        "error must be a string": error.isNull(),
        "exactly one of verdict or refusal must be set": ~exclusive,
        "success must have an empty error": success & (error != ""),
        "unresolved outcome must have an error": ~success & (error == "") & exclusive,
    }
    return F.filter(F.array(*[F.when(broken, text) for text, broken in rules.items()]), lambda x: x.isNotNull())


def destroy_violations(verdict: Column, refusal: Column, attempts: Column, stop_error: Column, last_status: Column, verify_error: Column) -> Column:
    """Broken rules of a destroy result as an array of texts."""
    rules = {
        "exactly one of verdict or refusal must be set": verdict.isNull() == refusal.isNull(),
        "refusal requires attempts = 0": refusal.isNotNull() & (attempts != 0),
        "refusal requires no diagnostics": refusal.isNotNull()
        & (stop_error.isNotNull() | last_status.isNotNull() | verify_error.isNotNull()),
        "verdict requires attempts >= 1": refusal.isNull() & verdict.isin("destroyed", "leaked") & (attempts < 1),
    }
    return F.filter(F.array(*[F.when(broken, text) for text, broken in rules.items()]), lambda x: x.isNotNull())


def severity(verdict: Column, refusal: Column) -> Column:
    """Log level of an unresolved outcome; NULL for a confirmed destroy, ``error`` for unknown kinds."""
    known = F.create_map(*[F.lit(x) for pair in C.SEVERITY.items() for x in pair])
    verdict_keys = [v for v in C.VERDICTS if v in C.SEVERITY]
    by_verdict = F.when(verdict.isin(*verdict_keys), F.try_element_at(known, verdict))
    by_refusal = F.when(refusal.isin(*C.REFUSALS), F.try_element_at(known, refusal))
    return F.when(F.coalesce(verdict, F.lit("")) == "destroyed", _none()).otherwise(
        F.coalesce(by_verdict, by_refusal, F.lit("error"))
    )


def cleanup_totals(outcomes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by kind; an instance already gone is never counted as destroyed."""
    verdict = F.coalesce("verdict", F.lit(""))
    return outcomes.groupBy(*keys).agg(
        F.count_if(verdict == "destroyed").alias("destroyed"),
        F.count_if(verdict == "already_gone").alias("already_gone"),
        F.count_if(~verdict.isin(*C.SUCCESS_VERDICTS)).alias("unresolved"),
        F.count("*").alias("candidates"),
    )


def apply_policy(
    candidates: DataFrame, destroy: Callable[[DataFrame], DataFrame], *, provider: str
) -> DataFrame:
    """Run a caller's outcome function over the candidates of its provider.

    ``destroy`` maps candidates to candidates with ``verdict, refusal, error``.
    Outcomes that break the rules become ``unknown``; candidates of another
    provider are refused without reaching the function.
    """
    own = F.col("provider").eqNullSafe(F.lit(provider))
    mine = destroy(candidates.where(own))
    broken = F.size(outcome_violations(F.col("verdict"), F.col("refusal"), F.col("error"))) > 0
    checked = mine.withColumns(
        {
            "verdict": F.when(broken, "unknown").otherwise(F.col("verdict")),
            "refusal": F.when(broken, _none()).otherwise(F.col("refusal")),
            "error": F.when(broken, "destroy function returned an invalid result").otherwise(F.col("error")),
        }
    )
    others = candidates.where(~own).withColumns(
        {
            "verdict": _none(),
            "refusal": F.lit("provider_mismatch"),
            "error": F.concat(F.lit("is of provider "), _named(F.col("provider"))),
        }
    )
    return checked.unionByName(others)
