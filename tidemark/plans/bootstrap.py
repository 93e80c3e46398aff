"""From an empty target to a running stream: load, gate, tokens, check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import keyring
from tidemark.sources import snapshot
from tidemark.streaming.apply_stream import FIRST_STREAM_BATCH, ChangeApplier

LOAD_BATCH = FIRST_STREAM_BATCH - 1
POSITION = "struct<event_at: timestamp_ntz, file_name: string, line_pos: struct<block: bigint, mid: bigint>>"


class KeyringGapError(RuntimeError):
    pass


@dataclass(frozen=True)
class Ring:
    """A keyring to fill: its target, the loaded table and the columns that tie them."""

    target: str
    source: str
    number: str
    legacy: str
    uuid: str
    order: str
    start: int


def as_state(rows: DataFrame) -> DataFrame:
    """Loaded rows as the applier keeps them: live, and older than any event."""
    return rows.select("*", F.lit(None).cast(POSITION).alias("last_seq"), F.lit(False).alias("is_deleted"))


def bootstrap(applier: ChangeApplier, snapshots: dict[str, DataFrame], rings: list[Ring],
              loaded_at: str, salt: str = "") -> None:
    """Initial load in the order given (parents first), then keyrings, then their check.

    Runs before the stream starts; a second run replaces the first.
    """
    tables = {m.target: applier.table(m) for m in applier.mappings()}
    snapshot.initial_load([(as_state(rows), tables[name]) for name, rows in snapshots.items()], LOAD_BATCH)
    applier.drop_indexes()
    loaded = {name: tables[name].read(upto=LOAD_BATCH) for name in snapshots}
    snapshot.require_rows(loaded)
    for ring in rings:
        base = loaded[ring.source]
        rows = keyring.keyring_load(base, ring.number, None, ring.legacy, ring.uuid, ring.order, ring.start, salt)
        rows = rows.withColumn("created_at", F.lit(loaded_at).cast("timestamp_ntz"))
        tables[ring.target].write_batch(as_state(rows), LOAD_BATCH)
        filled = tables[ring.target].read(upto=LOAD_BATCH)
        gaps = keyring.keyring_gaps(base, ring.number, filled, ring.legacy)
        if not gaps.isEmpty():
            raise KeyringGapError(f"{ring.target} does not match {ring.source}")
