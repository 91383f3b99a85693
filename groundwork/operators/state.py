"""Status machines and pipeline events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork import schemas

_EDGES = (("pending", "running"), ("running", "complete"), ("running", "failed"), ("failed", "running"))
#: A projection may run again after it is complete.
MACHINES = {"parse": _EDGES, "enrichment": _EDGES, "projection": (*_EDGES, ("complete", "running"))}


class InvalidTransition(ValueError):
    def __init__(self, current: str, next_: str, machine: str) -> None:
        super().__init__(f"{machine}: {current} -> {next_} isn't allowed")
        self.current, self.next, self.machine = current, next_, machine


def check(machine: str, current: str, next_: str) -> None:
    """Raise unless the machine allows the step."""
    if (current, next_) not in MACHINES[machine]:
        raise InvalidTransition(current, next_, machine)


def allowed(machine: str, current: Column, next_: Column) -> Column:
    """Whether a step is allowed; the table of steps is a handful of literals."""
    return F.coalesce(F.concat_ws(">", current, next_).isin(*[f"{a}>{b}" for a, b in MACHINES[machine]]), F.lit(False))


def transitions(statuses: DataFrame, machine: str, key: str, order: list[str], strict: bool = False) -> DataFrame:
    """Each status with the one before it of the same key, and whether that step is valid.

    Columns key, *order, current, next, valid; a key's first status has no row. ``strict`` ends the
    job at the first invalid step.
    """
    before = F.lag("status").over(Window.partitionBy(key).orderBy(*order))
    out = statuses.withColumn("current", before).where(F.col("current").isNotNull())
    valid = allowed(machine, F.col("current"), F.col("status"))
    if strict:
        valid = F.when(valid, F.lit(True)).otherwise(
            F.raise_error(
                F.concat(F.lit(f"{machine}: "), "current", F.lit(" -> "), F.coalesce("status", F.lit("null")), F.lit(" isn't allowed"))
            ).cast("boolean")
        )
    return out.select(key, *order, "current", F.col("status").alias("next"), valid.alias("valid"))


def decode(events: DataFrame, value_col: str = "value") -> DataFrame:
    """Events of JSON text: one wide row each. ``is_valid`` is false for broken JSON, a missing or unknown type or document."""
    e = events.withColumn("e", F.from_json(F.col(value_col), schemas.EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})).select("e.*")
    known = F.col("event_type").isin(*schemas.EVENT_TYPES) & F.col("doc_id").isNotNull() & F.col("version_id").isNotNull()
    return e.withColumn("is_valid", F.col("_corrupt_record").isNull() & F.coalesce(known, F.lit(False)))


def searchable(events: DataFrame, keys: list[str], body: str = "body_chunks_indexed", active: str = "search_projection_activated") -> DataFrame:
    """(keys, n_events, is_body_searchable, is_enriched_searchable, completed): flags that events have set.

    completed: event types of the happy path seen so far.
    """
    kind = F.col("event_type")
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.bool_or(kind == body).alias("is_body_searchable"),
        F.bool_or(kind == active).alias("is_enriched_searchable"),
        F.count_distinct(kind).alias("completed"),
    )


def retries(steps: DataFrame, key: str) -> DataFrame:
    """(key, retry_count): steps from failed back to running."""
    return steps.groupBy(key).agg(F.count_if((F.col("current") == "failed") & (F.col("next") == "running")).alias("retry_count"))
