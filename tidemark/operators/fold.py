"""The ordered fold: a change feed becomes one decision per event and one row per key.

Three things decide about an event: its origin (cloud inserts never come
back), its age (a cloud update loses against a newer row) and whether it is a
stale retry.  Legacy writes, deletes and rows without a timestamp always win
and open a new stretch; inside a stretch only the running maximum of the
modification time matters, so a window replaces the row-by-row replay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.conversions import strip
from tidemark.operators import skew

APPLY, GUARD, LWW, STALE, INVALID, BASE = "APPLY", "GUARD", "LWW", "STALE", "INVALID", "BASE"
CLOUD = "CLOUD"
DELETE = "D"


@dataclass(frozen=True)
class FoldSpec:
    """Column roles of a feed.

    ``order``  commit order inside a key (unique together; the first column is
               a number or a time)
    ``values`` columns replaced by each applied event
    ``first``  columns kept from the event that created the row
    ``valid``  optional boolean column, false = the row cannot be written
    ``retried`` optional boolean column, true = checked against ``last_seq``
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    values: tuple[str, ...]
    last_modified: str | None = "last_modified"
    op: str = "op"
    flag: str = "datasync_flag"
    first: tuple[str, ...] = ()
    valid: str | None = None
    retried: str | None = None


def is_cloud(flag: Column) -> Column:
    return F.coalesce(F.upper(strip(flag)) == CLOUD, F.lit(False))


def circular_guard(flag: Column, op: Column) -> Column:
    """True for an event that must not return to where it came from."""
    return is_cloud(flag) & (op == "I")


def _with_base(feed: DataFrame, base: DataFrame | None, spec: FoldSpec) -> DataFrame:
    events = feed.select("*", F.lit(1).alias("_kind"), F.struct(*spec.order).alias("_pos"),
                         F.lit(False).alias("_gone"))
    if base is None:
        return events
    rows = base.withColumn("_kind", F.lit(0)).withColumnsRenamed(
        {"last_seq": "_pos", "is_deleted": "_gone"})
    keep = [*spec.keys, *spec.values, *spec.first, "_kind", "_pos", "_gone"]
    return events.unionByName(rows.select(*dict.fromkeys(keep)), allowMissingColumns=True)


def _decide(rows: DataFrame, spec: FoldSpec, chunk: str | None) -> DataFrame:
    keys, order = list(spec.keys), ["_kind", "_pos"]
    is_base = F.col("_kind") == 0
    op, flag = F.col(spec.op), F.col(spec.flag)
    modified = F.col(spec.last_modified) if spec.last_modified else F.lit(None).cast("timestamp_ntz")

    valid = F.lit(True)
    for k in keys:
        valid = valid & F.col(k).isNotNull()
    if spec.valid:
        valid = valid & F.coalesce(F.col(spec.valid), F.lit(False))

    if spec.retried:
        rows = skew.prior_max(rows, keys, order, is_base, F.when(is_base, F.col("_pos")),
                              "_base_pos", chunk)
        stale = F.coalesce(F.col(spec.retried) & (F.col("_pos") <= F.col("_base_pos")), F.lit(False))
    else:
        stale = F.lit(False)

    rows = rows.select("*", (~is_base & circular_guard(flag, op)).alias("_guard"),
                       (~is_base & stale).alias("_stale"), (is_base | valid).alias("_ok"),
                       (~is_base & is_cloud(flag) & (op == "U") & modified.isNotNull()).alias("_asks"))
    mute = F.col("_guard") | F.col("_stale") | ~F.col("_ok")
    dead = F.coalesce(op == DELETE, F.lit(False)) | F.col("_gone")
    rows = skew.prior_max(rows, keys, order, is_base | (~mute & ~F.col("_asks")),
                          F.when(~mute & ~dead, modified), "_prior", chunk)
    older = F.coalesce(F.col("_asks") & (modified < F.col("_prior")), F.lit(False))
    rows = rows.withColumn(
        "decision",
        F.when(is_base, BASE).when(F.col("_guard"), GUARD).when(F.col("_stale"), STALE)
        .when(older, LWW).when(~F.col("_ok"), INVALID).otherwise(APPLY))
    if spec.first:
        takes = F.col("decision").isin(APPLY, BASE)
        rows = skew.prior_max(rows, keys, order, takes & (is_base | dead),
                              F.when(takes & ~dead, F.lit(1)), "_alive", chunk)
        rows = rows.withColumn("_start", takes & ~dead & F.col("_alive").isNull())
    return rows.drop("_base_pos", "_guard", "_stale", "_ok", "_asks", "_prior", "_alive")


def fold(feed: DataFrame, spec: FoldSpec, base: DataFrame | None = None,
         profile: skew.KeyProfile | None = None,
         task_rows: int = skew.TASK_ROWS) -> DataFrame:
    """Feed (and current rows) with a ``decision`` each; input of the two views below.

    Ordinary keys take one shuffle and one sort by key.  Keys too heavy for a
    task are cut along the whole order into pieces that run in parallel, so a key
    whose events share one commit time is cut as well.
    """
    prof = profile or skew.profile_keys(feed, list(spec.keys), task_rows)
    rows = _with_base(feed, base, spec)
    if prof.hot is None:
        return _decide(rows, spec, None)
    # current rows come before every event, hence in the first pieces
    heavy = skew.range_pieces(prof.heavy(rows), ["_kind", "_pos", *spec.keys], prof.pieces())
    light = prof.light(rows)
    return _decide(light, spec, None).unionByName(_decide(heavy, spec, "_chunk").drop("_chunk"))


def decisions(folded: DataFrame) -> DataFrame:
    """One row per event, in the columns of the feed plus ``decision``."""
    return (folded.filter(F.col("_kind") == 1)
            .drop(*[c for c in folded.columns if c.startswith("_")]))


def final_state(folded: DataFrame, spec: FoldSpec) -> DataFrame:
    """One row per key that ever held a row; ``is_deleted`` marks tombstones.

    The last applied event wins, so the aggregate combines partial results and
    no key is gathered whole.
    """
    takes = F.col("decision").isin(APPLY, BASE)
    at = F.when(takes, F.struct("_kind", "_pos"))
    dead = F.coalesce(F.col(spec.op) == DELETE, F.lit(False)) | F.col("_gone")
    # apart from the values, which are then left out where nobody asks for them
    aggs = [F.max_by(dead, at).alias("is_deleted"),
            F.max(F.when(takes, F.col("_pos"))).alias("last_seq"),
            F.bool_or(takes).alias("_any")]
    if spec.values:
        aggs.append(F.max_by(F.struct(*spec.values), at).alias("_last"))
    if spec.first:
        aggs.append(F.max_by(F.struct(*spec.first),
                             F.when(F.col("_start"), F.struct("_kind", "_pos"))).alias("_first"))
    out = folded.groupBy(*spec.keys).agg(*aggs).filter("_any")
    return out.select(*spec.keys, *[F.col(f"_last.{c}").alias(c) for c in spec.values],
                      *[F.col(f"_first.{c}").alias(c) for c in spec.first],
                      "last_seq", "is_deleted")


def live(state: DataFrame) -> DataFrame:
    return state.filter(~F.col("is_deleted")).drop("is_deleted")
