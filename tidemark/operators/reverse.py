"""Reverse sync: rows written in the cloud go back to the legacy system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fold import CLOUD


def reverse_feed(domain_events: DataFrame, flag: str = "datasync_flag") -> DataFrame:
    """Legacy upserts, each stamped with its origin.  Works on streams as well."""
    return domain_events.withColumn(flag, F.lit(CLOUD))


def to_change_line(feed: DataFrame, schema: str, table: str, event_ts: Column,
                   fields: list[str]) -> DataFrame:
    """The change lines the legacy side would capture after the write-back."""
    data = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    return feed.select("*", F.concat_ws("|", F.col("op"), F.lit(table), F.lit(schema),
                                        event_ts.cast("string"), *data).alias("line"))

