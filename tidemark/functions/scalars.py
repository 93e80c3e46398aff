"""Small scalar builders shared by the audit tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.keys import stable_uuid

# Text limits and retention days of the audit tables.
AUDIT_ERROR_CHARS = 1000
FAULT_REASON_CHARS = 500
KEEP_DAYS_DONE = 90
KEEP_DAYS_FAILED = 180
DAY_SECONDS = 86400


def truncate_text(value: Column, limit: int) -> Column:
    return F.substring(value, 1, limit)


def file_event_id(file_name: Column) -> Column:
    """Identity of one landed file; stable, so a re-listed file keeps its id."""
    return stable_uuid(file_name)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, read as UTC."""
    gap = ts.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(gap.cast("interval second").cast("decimal(18,6)")).cast("bigint")


def keep_days(status: Column) -> Column:
    return F.when(status.isin("SUCCESS", "SKIP"), KEEP_DAYS_DONE).otherwise(KEEP_DAYS_FAILED)


def ttl_epoch(status: Column, at: Column) -> Column:
    return epoch_seconds(at) + keep_days(status).cast("bigint") * DAY_SECONDS


def drop_null_entries(entries: Column) -> Column:
    return F.map_filter(entries, lambda _k, v: v.isNotNull())
