"""Outcome, audit, retry and reprocessing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import (
    AUDIT_ERROR_CHARS, FAULT_REASON_CHARS, drop_null_entries, truncate_text, ttl_epoch)
from tidemark.operators.fold import APPLY, INVALID

# Statuses, attempts and the step numbers of the trace.
SUCCESS, SKIP, FAILED, PERMANENT, DEAD = "SUCCESS", "SKIP", "FAILED", "PERMANENT_FAILED", "DLQ"
MAX_ATTEMPTS = 3
STEP_READ, STEP_MAP, STEP_GUARD, STEP_AGE, STEP_WRITE, STEP_DEAD = 1, 2, 3, 4, 5, 6
STEPS = [STEP_READ, STEP_MAP, STEP_GUARD, STEP_AGE, STEP_WRITE, STEP_DEAD]


def with_status(decided: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Status per event; a failed attempt is counted here and nowhere else."""
    failed = F.col("decision") == INVALID
    attempts = F.col("retry_count") + failed.cast("int")
    return (decided.withColumn("retry_count", attempts)
            .withColumn("status", F.when(F.col("decision") == APPLY, SUCCESS)
                        .when(~failed, SKIP)
                        .when(F.col("retry_count") >= max_attempts, PERMANENT)
                        .otherwise(FAILED)))


def step_of(decision: Column) -> Column:
    return (F.when(decision == "GUARD", STEP_GUARD).when(decision.isin("LWW", "STALE"), STEP_AGE)
            .otherwise(STEP_WRITE))


def audit_rows(outcomes: DataFrame, data: dict[str, Column], schema: str, table: str,
               map_id: int, at: Column, keep: list[str] = ()) -> DataFrame:
    """One record per event and target, with all that a reprocess needs.

    ``data`` are the row's fields; null ones are not stored.  ``keep`` are more
    columns of the outcomes.
    """
    entries = F.create_map(*[x for k, v in data.items() for x in (F.lit(k), v.cast("string"))])
    return outcomes.select(
        "event_id", F.lit(f"{schema}.{table}").alias("table_name"),
        F.struct(F.col("op").alias("operation"), "src_schema", "src_table", "event_ts",
                 "file_name").alias("event_metadata"),
        drop_null_entries(entries).alias("event_data"),
        F.lit(schema).alias("dstn_schema"), F.lit(table).alias("dstn_table"),
        F.lit(str(map_id)).alias("map_id"), "status", "retry_count",
        F.lit(False).alias("reprocess_flag"),
        ttl_epoch(F.col("status"), at).alias("ttl_epoch"), at.alias("created_at"),
        truncate_text(F.col("error_message"), AUDIT_ERROR_CHARS).alias("error_message"), *keep)


def utilization_rows(events: DataFrame, job: str, step: Column, status: Column, at: Column) -> DataFrame:
    return events.select(
        "event_id", F.concat(F.lit(job + "#"), step.cast("string")).alias("job_step"),
        F.lit(job).alias("job_name"), step.cast("int").alias("step_number"),
        status.alias("status"), at.alias("created_at"))


def fault_rows(events: DataFrame, job: str, step: Column, status: Column, reason: Column,
               at: Column, keep: list[str] = ()) -> DataFrame:
    return events.select(
        "event_id", F.concat(F.lit(job + "#"), step.cast("string")).alias("job_step"),
        F.lit(job).alias("job_name"), step.cast("int").alias("step_number"),
        status.alias("status"), truncate_text(reason, FAULT_REASON_CHARS).alias("error_reason"),
        at.alias("created_at"), *keep)


def outcome_utilization(outcomes: DataFrame, job: str, at: Column) -> DataFrame:
    done = outcomes.filter(F.col("status").isin(SUCCESS, SKIP))
    return utilization_rows(done, job, step_of(F.col("decision")), F.col("status"), at)


def outcome_faults(outcomes: DataFrame, job: str, at: Column) -> DataFrame:
    """A fault per failed attempt, and one more for each hand-over to the dead letters."""
    failed = outcomes.filter(F.col("status").isin(FAILED, PERMANENT))
    retry = F.concat(F.lit("handed to the dead letters after attempt "), F.col("retry_count").cast("string"))
    writes = fault_rows(failed, job, F.lit(STEP_WRITE), F.col("status"), F.col("error_message"), at)
    sent = fault_rows(failed.filter(F.col("status") == FAILED), job, F.lit(STEP_DEAD), F.lit(DEAD),
                      retry, at)
    return writes.unionByName(sent)


def dead_letters(outcomes: DataFrame) -> DataFrame:
    """Failed events on their way to another attempt, marked as retries."""
    return outcomes.filter(F.col("status") == FAILED).withColumn("is_retry", F.lit(True))


def retry_plan(letters: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Requeue or discard, by the attempts made so far."""
    return letters.withColumn(
        "action", F.when(F.col("retry_count") < max_attempts, "REQUEUE").otherwise("DISCARD"))


def requeued(plan: DataFrame) -> DataFrame:
    return plan.filter(F.col("action") == "REQUEUE").drop("action")


def discarded_faults(plan: DataFrame, job: str, at: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    gone = plan.filter(F.col("action") == "DISCARD")
    return fault_rows(gone, job, F.lit(STEP_READ), F.lit(PERMANENT),
                      F.lit(f"given up after {max_attempts} attempts"), at)


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if(F.col("action") == "REQUEUE").alias("requeued"),
                    F.count_if(F.col("action") == "DISCARD").alias("discarded"))


def audit_current(audit: DataFrame, order: list[str]) -> DataFrame:
    """Last record per (event, target)."""
    rest = [c for c in audit.columns if c not in ("event_id", "table_name")]
    return (audit.groupBy("event_id", "table_name")
            .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
            .select("event_id", "table_name", "_r.*"))


def retained(audit: DataFrame, now_epoch: Column) -> DataFrame:
    """Records whose retention has not run out."""
    return audit.filter(F.col("ttl_epoch") > now_epoch)


def reprocess_feed(audit: DataFrame, fields: dict[str, str], max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Change rows rebuilt from stored data alone.

    Taken: records an operator flagged, and failures with attempts left.  A
    flagged record is forced, the others stay subject to the stale check.
    """
    due = audit.filter(F.col("reprocess_flag")
                       | ((F.col("status") == FAILED) & (F.col("retry_count") < max_attempts)))
    data = F.col("event_data")
    return due.select(
        "event_id", F.col("event_metadata.operation").alias("op"),
        F.col("event_metadata.src_schema").alias("src_schema"),
        F.col("event_metadata.src_table").alias("src_table"),
        F.col("event_metadata.event_ts").alias("event_ts"),
        *[F.try_element_at(data, F.lit(k)).try_cast(t).alias(k) for k, t in fields.items()],
        "retry_count", (~F.col("reprocess_flag")).alias("is_retry"))


# Statuses from the best to the worst: of records of one moment the worst counts.
SEVERITY = (SUCCESS, SKIP, DEAD, FAILED, PERMANENT)


def step_trace(utilization: DataFrame, faults: DataFrame, order: list[str] = ("created_at",)) -> DataFrame:
    """Events as rows; per step its last status (step_n) and how many of its records failed (failed_n).

    An event id stands for a file, so a step has many records: the last by
    ``order`` counts, of several at that moment the worst.
    """
    cols = ["event_id", "step_number", "status", *order]
    both = utilization.select(*cols).unionByName(faults.select(*cols))
    worst = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("status"))
    bad = F.count_if(~F.col("status").isin(SUCCESS, SKIP))
    last = both.groupBy("event_id", "step_number").agg(
        F.max_by("status", F.struct(*order, worst)).alias("status"), bad.alias("failed"))
    traced = last.groupBy("event_id").pivot("step_number", STEPS).agg(
        F.first("status").alias("status"), F.first("failed").alias("failed"))
    return traced.select("event_id", *[F.col(f"{s}_status").alias(f"step_{s}") for s in STEPS],
                         *[F.col(f"{s}_failed").alias(f"failed_{s}") for s in STEPS])


def status_counts(outcomes: DataFrame) -> DataFrame:
    return (outcomes.groupBy(step_of(F.col("decision")).alias("step_number"), "decision", "status")
            .agg(F.count(F.lit(1)).alias("event_count")))


def guard_scoreboard(decided: DataFrame, by: list[str] = ()) -> DataFrame:
    """Blocked against processed, in one pass."""
    d = F.col("decision")
    return decided.groupBy(*by).agg(
        F.count_if(d == "GUARD").alias("guard_blocked"),
        F.count_if(d == "LWW").alias("age_blocked"),
        F.count_if(d == APPLY).alias("processed"))


def sla_report(events: DataFrame, by: list[str], latency_seconds: Column, failed: Column,
               limit_seconds: int = 60) -> DataFrame:
    """Failure count and replication latency against the time limit.

    Percentiles are read off a histogram of whole seconds, which is exact and
    as small as the spread of latencies, not as the number of events.
    """
    seconds = events.groupBy(*by, F.floor(latency_seconds).cast("bigint").alias("sec")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("bad"))
    along = Window.partitionBy(*by).orderBy("sec")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    ranked = (seconds.withColumn("upto", F.sum("n").over(upto))
              .withColumn("total", F.sum("n").over(whole)))

    def disc(p: int) -> Column:
        return F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("sec")))

    return ranked.groupBy(*by).agg(
        F.sum("n").alias("event_count"), F.sum("bad").alias("failed_count"),
        F.sum(F.when(F.col("sec") >= limit_seconds, F.col("n")).otherwise(0)).alias("late_count"),
        disc(50).alias("p50_seconds"), disc(95).alias("p95_seconds"), F.max("sec").alias("max_seconds"))
