"""Shards and jobs: status, markers, retries, cost and budget."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import fmt
from fleetlens.functions.keys import basename
from fleetlens.operators.ordered import DAY, Running, running, sliced

MICRO_HOUR = 3.6e9


def status_class(kind: Column, status: Column) -> Column:
    """``pending, active, completed, done, failed`` or ``other``, by unit kind."""
    active = F.when(kind == "job", status.isin("deploying", "running")).otherwise(status.isin("deployed", "running"))
    done = F.when(kind == "job", status == "downloaded").otherwise(status.isin("downloaded", "destroyed"))
    return (
        F.when(status == "pending", "pending")
        .when(active, "active")
        .when((kind == "job") & (status == "completed"), "completed")
        .when(status == "failed", "failed")
        .when(done, "done")
        .otherwise("other")
    )


def in_class(units: DataFrame, *classes: str) -> DataFrame:
    """Units whose status class is one of ``classes``."""
    return units.where(status_class(F.col("kind"), F.col("status")).isin(*classes))


def all_units(shards: DataFrame, jobs: DataFrame) -> DataFrame:
    """Shards and jobs in one table; columns of one side are NULL on the other."""
    return shards.unionByName(jobs, allowMissingColumns=True)


def with_marker(units: DataFrame, markers: DataFrame, keys: Sequence[str] = ("batch_id", "unit_key")) -> DataFrame:
    """Add ``done``: the unit has a completion marker."""
    marked = markers.select(*keys).distinct().withColumn("_marked", F.lit(True))
    return (
        units.join(marked, list(keys), "left")
        .withColumn("done", F.coalesce("_marked", F.lit(False)))
        .select(*units.columns, "done")
    )


def deployable(units: DataFrame, markers: DataFrame, keys: Sequence[str] = ("batch_id", "unit_key")) -> DataFrame:
    """Pending units without a marker."""
    return in_class(units, "pending").join(markers.select(*keys), list(keys), "left_anti")


def recoverable(units: DataFrame, markers: DataFrame, keys: Sequence[str] = ("batch_id", "unit_key")) -> DataFrame:
    """Failed units whose results were uploaded after all."""
    return in_class(units, "failed").join(markers.select(*keys), list(keys), "left_semi")


def remaining_items(items: DataFrame, done_items: DataFrame, keys: Sequence[str] = ("batch_id", "item_id")) -> DataFrame:
    """Planned items without a batch-wide marker."""
    return items.join(done_items.select(*keys), list(keys), "left_anti")


def resume_plan(units: DataFrame, instances: DataFrame) -> DataFrame:
    """What to do with each active unit after a restart: ``reconnect, preempt`` or ``skip``."""
    live = instances.select("instance_id").distinct().withColumn("_live", F.lit(True))
    active = in_class(units, "active")
    unset = F.coalesce("instance_id", F.lit("")) == ""
    placed = (
        active.where(~unset)
        .join(live, "instance_id", "left")
        .withColumn("action", F.when(F.col("_live").isNotNull(), "reconnect").otherwise("preempt"))
    )
    # Units without an instance share one key; they stay out of the join.
    skipped = active.where(unset).withColumn("action", F.lit("skip"))
    return placed.select(*units.columns, "action").unionByName(skipped)


def _money_micros(rate: Column, micros: Column) -> Column:
    """Exact product of a rate and a duration, to be summed and divided once."""
    return rate.cast("decimal(12,6)") * micros.cast("decimal(18,0)")


def _hours_cost(total: Column) -> Column:
    return F.coalesce(total.cast("double"), F.lit(0.0)) / MICRO_HOUR


def job_cost(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Add ``hours`` and ``cost_usd`` of every job; open jobs run until ``as_of``."""
    micros = fmt.runtime_micros(F.col("submit_time"), F.col("complete_time"), as_of)
    return jobs.withColumn("hours", micros / MICRO_HOUR).withColumn(
        "cost_usd", _hours_cost(_money_micros(F.col("cost_per_hour"), micros))
    )


def batch_cost(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Cost per batch."""
    micros = fmt.runtime_micros(F.col("submit_time"), F.col("complete_time"), as_of)
    total = F.sum(_money_micros(F.col("cost_per_hour"), micros))
    return jobs.groupBy("batch_id").agg(_hours_cost(total).alias("cost_usd"), F.count("*").alias("jobs"))


def current_spend(units: DataFrame, as_of: Column) -> DataFrame:
    """Spend per batch of the active units from their start to ``as_of``."""
    micros = fmt.micros_between(F.col("start_ts"), as_of.cast("timestamp"))
    total = F.sum(_money_micros(F.col("cost_per_hour"), micros))
    return in_class(units, "active").groupBy("batch_id").agg(_hours_cost(total).alias("spent"))


def budget_status(spent: Column, ceiling: Column) -> Column:
    """``unlimited, ok, warning`` or ``exceeded``."""
    return (
        F.when(ceiling <= 0, "unlimited")
        .when(spent >= ceiling, "exceeded")
        .when(spent >= ceiling * C.BUDGET_WARNING_SHARE, "warning")
        .otherwise("ok")
    )


def status_counts(units: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Units per status, whatever the statuses are; one row each."""
    return units.groupBy(*keys, "status").agg(F.count("*").alias("units"))


def archivable(units: DataFrame) -> DataFrame:
    """Batches with at least one unit and only terminal ones; the terminal set depends on the kind."""
    terminal = F.when(F.col("kind") == "job", F.col("status").isin(*C.JOB_TERMINAL)).otherwise(
        F.col("status").isin(*C.SHARD_TERMINAL)
    )
    return (
        units.groupBy("batch_id", "kind")
        .agg(F.count("*").alias("units"), F.bool_and(F.coalesce(terminal, F.lit(False))).alias("_all"))
        .where("_all")
        .drop("_all")
    )


def archive_terminal(units: DataFrame, as_of: Column) -> DataFrame:
    """Add ``archive_name`` to units of finished batches; the others stay with NULL.

    The name holds the kind, since a shard batch and a job batch may share an id.
    """
    name = F.concat("kind", F.lit("_"), "batch_id", F.lit("_"), fmt.archive_suffix(as_of), F.lit(".json"))
    done = archivable(units).select("batch_id", "kind", name.alias("archive_name"))
    return units.join(done, ["batch_id", "kind"], "left")


def split_archived(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The units that stay, and those that go to an archive, of ``archive_terminal``'s result."""
    return named.where(F.col("archive_name").isNull()).drop("archive_name"), named.where(F.col("archive_name").isNotNull())


def is_loss(event: Column) -> Column:
    """Events that raise the retry count."""
    return event.isin("failed", "preempted")


def current_state(events: DataFrame, keys: Sequence[str] = ("unit_key",)) -> DataFrame:
    """Fold unit events into status, instance, price, reason and retry count.

    Only order-picking aggregates are used, so a unit with most of the events is
    still combined before the shuffle.
    """
    order = F.struct("ts", "event_id")
    event = F.col("event")
    status = (
        F.when(event == "deployed", "deployed")
        .when(event == "failed", "failed")
        .when(event == "completed", "downloaded")
        .otherwise("pending")
    )
    placed = F.when(event == "deployed", F.col("instance_id")).otherwise("")
    return events.groupBy(*keys).agg(
        F.max_by(status, order).alias("status"),
        F.coalesce(F.max_by(placed, F.when(event.isin("deployed", "preempted"), order)), F.lit("")).alias("instance_id"),
        F.coalesce(F.max_by("cost_per_hour", F.when(event == "deployed", order)), F.lit(0.0)).alias("cost_per_hour"),
        F.coalesce(F.max_by("reason", F.when(event == "failed", order)), F.lit("")).alias("failure_reason"),
        F.count_if(is_loss(event)).alias("retry_count"),
    )


def always_retry(reason: Column) -> Column:
    """Default failure classifier."""
    return F.lit("retry")


def retry_verdicts(
    events: DataFrame,
    *,
    max_retries: int = C.UNIT_RETRIES,
    classify: Callable[[Column], Column] = always_retry,
    slice_seconds: int = DAY,
) -> DataFrame:
    """Verdict on every instance loss: ``preempted`` again, or ``failed`` with the reason.

    ``classify`` maps the reason column to ``retry`` or ``fatal``; a
    ``pandas_udf`` works as well. The count excludes the event itself.
    """
    lost = F.when(is_loss(F.col("event")), 1).otherwise(0)
    counted = running(
        events,
        ["unit_key"],
        "ts",
        ["event_id"],
        [Running("retries_before", "sum", lost, include_current=False)],
        slice_seconds=slice_seconds,
    ).where(F.col("event") == "preempted")
    exhausted = F.col("retries_before") >= max_retries
    fatal = classify(F.col("reason")) == "fatal"
    return counted.select(
        "event_id",
        "unit_key",
        "ts",
        F.col("retries_before").cast("bigint").alias("retries_before"),
        F.when(exhausted | fatal, "failed").otherwise("preempted").alias("verdict"),
        F.when(exhausted, F.concat("reason", F.lit(" (retries exhausted)")))
        .when(fatal, F.concat("reason", F.lit(" (fatal)")))
        .otherwise(F.lit(""))
        .alias("failure_reason"),
    )


def spend_crossings(
    spend: DataFrame, ceiling: float, *, slice_seconds: int = DAY, key: str = "batch_id"
) -> DataFrame:
    """First moments a batch's cumulative spend reaches 80 % and 100 % of ``ceiling``.

    ``spend`` has ``batch_id, ts, event_id, amount`` with non-negative amounts.
    Only the one or two time slices in which a batch crosses are ordered row by
    row, in parts where they are heavy; all others are sums.
    """
    money = F.col("amount").cast("decimal(18,6)")
    cut = spend.withColumn("_slice", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / slice_seconds)).withColumn(
        "_money", money
    )
    parts = sliced(cut, [key], ["ts", "event_id"], [F.sum("_money").alias("_sum")])
    limits = {"warning_at": ceiling * C.BUDGET_WARNING_SHARE, "exceeded_at": ceiling}
    marks = {name: F.lit(value).cast("decimal(18,6)") for name, value in limits.items()}
    owner = F.col("_group")[key]
    upto = Window.partitionBy(owner).orderBy(F.col("_group._slice"), F.col("_group._part"))
    slices = (
        parts.totals.withColumn("_sum", F.coalesce("_sum", F.lit(0)))
        .withColumn("_end", F.sum("_sum").over(upto))
        .withColumn("_start", F.col("_end") - F.col("_sum"))
    )
    crosses = F.lit(False)
    for mark in marks.values():
        crosses = crosses | ((F.col("_start") < mark) & (F.col("_end") >= mark))
    inner = Window.partitionBy("_group").orderBy("ts", "event_id")
    run = F.col("_start") + F.coalesce(F.sum("_money").over(inner), F.lit(0))
    firsts = [F.min(F.when(F.col("_run") >= mark, F.col("ts"))).alias(name) for name, mark in marks.items()]
    moments = (
        parts.rows.join(slices.where(crosses).select("_group", "_start"), "_group")
        .withColumn("_run", run)
        .groupBy("_group")
        .agg(*firsts)
        .groupBy(owner.alias("_owner"))
        .agg(*[F.min(name).alias(name) for name in marks])
    )
    totals = slices.groupBy(owner.alias(key)).agg(F.sum("_sum").cast("double").alias("spent"))
    return totals.join(moments, F.col(key).eqNullSafe(F.col("_owner")), "left").drop("_owner")


# Deployment gates in their order, with the text of a failure.
GATES = {
    "boot_ok": "Boot timeout",
    "gpu_ok": "GPU verification failed",
    "files_ok": "File deploy failed",
    "env_ok": "Environment setup failed",
    "launch_ok": "Worker launch failed",
}


def deploy_gate(attempts: DataFrame) -> DataFrame:
    """Add ``error``: the first failing gate of each attempt, empty on success."""
    number = (F.col("attempt") + 1).cast("string")
    first = F.coalesce(
        *[F.when(~F.coalesce(F.col(gate), F.lit(False)), F.lit(text)) for gate, text in GATES.items()]
    )
    error = F.when(first.isNotNull(), F.concat(first, F.lit(" (attempt "), number, F.lit(")"))).otherwise("")
    return attempts.withColumn("error", error)


def deploy_outcome(attempts: DataFrame, units: DataFrame | None = None, *, key: str = "unit_key") -> DataFrame:
    """First successful attempt per unit, else the last error, over all logged attempts.

    With ``units`` given, units without any attempt are reported as having had
    no offers.
    """
    gated = deploy_gate(attempts)
    success = F.col("error") == ""
    outcome = gated.groupBy(key).agg(
        F.min(F.when(success, F.col("attempt"))).alias("success_attempt"),
        F.min_by("machine_id", F.when(success, F.col("attempt"))).alias("machine_id"),
        F.max_by("error", "attempt").alias("_last"),
    )
    if units is not None:
        outcome = units.select(key).join(outcome, key, "left")
    return outcome.select(
        key,
        F.col("success_attempt").isNotNull().alias("success"),
        "success_attempt",
        "machine_id",
        F.when(F.col("success_attempt").isNotNull(), "")
        .otherwise(F.coalesce("_last", F.lit("No GPU offers available")))
        .alias("error"),
    )


def missing_files(required: DataFrame, collected: DataFrame, key: str = "shard_id") -> DataFrame:
    """Required file names a unit did not deliver; collected paths count by their last segment."""
    names = collected.select(key, basename(F.col("rel_path")).alias("name"))
    return required.select(key, "name").join(names, [key, "name"], "left_anti")


def critical_files(required: DataFrame, collected: DataFrame, key: str = "shard_id") -> DataFrame:
    """Per unit: files collected, required names missing, and the files that count.

    Any missing name voids the whole result of the unit. A unit that should have
    delivered and did not is a row with 0 files.
    """
    missing = missing_files(required, collected, key).groupBy(key).agg(F.count("*").alias("missing"))
    return (
        collected.groupBy(key)
        .agg(F.count("*").alias("files"))
        .join(missing, key, "full_outer")
        .withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("files", "missing")})
        .withColumn("accepted_files", F.when(F.col("missing") > 0, 0).otherwise(F.col("files")).cast("bigint"))
    )


def unit_verdict(action: Column, collected: Column) -> Column:
    """``running, preempted, completed`` or ``failed`` from the action and the collect result."""
    return (
        F.when(action == "continue", "running")
        .when(action == "preempt", "preempted")
        .when(F.coalesce(collected, F.lit(False)), "completed")
        .otherwise("failed")
    )


def with_hooks(units: DataFrame, *, key: Column, label: Column, classes: dict[str, Column]) -> DataFrame:
    """Add ``unit_key, unit_label, class`` from the caller's expressions.

    ``classes`` names conditions such as ``pending`` or ``active``; the first
    that holds counts, and a unit none holds for is ``other``.
    """
    chosen = F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in classes.items()], F.lit("other"))
    return units.withColumns({"unit_key": key, "unit_label": label, "class": chosen})
