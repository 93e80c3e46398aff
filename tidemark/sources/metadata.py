"""Mapping metadata: connections, maps (table to table) and rules (field to field).

The three tables are DataFrames.  Operators that only relate them stay
DataFrames; ``load_mappings`` brings the active ones to the driver, because a
target's columns must be known before its plan can be built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE_FIELDS = ("column_order", "rule_id", "src_field_name", "src_datatype_txt",
               "dstn_field_name", "dstn_datatype_txt", "conversion_method",
               "conversion_format_txt")
MAP_FIELDS = ("map_id", "src_schema_nam", "src_tbl_nam", "dstn_schema_nam",
              "dstn_tbl_nam", "src_pks", "dstn_pks", "load_order", "stream_type")
UNKNOWN_RANK = 999
MAX_DRIVER_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    src: str
    src_type: str
    dst: str
    dst_type: str
    method: str | None
    fmt: str | None
    order: int


@dataclass(frozen=True)
class Mapping:
    map_id: int
    src_schema: str
    src_table: str
    dst_schema: str
    dst_table: str
    src_pks: tuple[str, ...]
    dst_pks: tuple[str, ...]
    load_order: int
    stream_type: str
    rules: tuple[Rule, ...]

    @property
    def source(self) -> str:
        return f"{self.src_schema}.{self.src_table}"

    @property
    def target(self) -> str:
        return f"{self.dst_schema}.{self.dst_table}"


def active(maps: DataFrame) -> DataFrame:
    return maps.filter(F.col("is_active"))


def for_stream(maps: DataFrame, kind: str) -> DataFrame:
    """Maps that take part in one stream kind (CDC or FULL_LOAD)."""
    return maps.filter(F.upper("stream_type").isin(kind.upper(), "BOTH"))


def catalog(maps: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per active map with its rules nested in column order.

    A rule list is as long as its table is wide, so collecting it is bounded.
    """
    return (active(maps).select(*MAP_FIELDS)
            .join(rules.select("map_id", *RULE_FIELDS), "map_id")
            .groupBy(*MAP_FIELDS)
            .agg(F.sort_array(F.collect_list(F.struct(*RULE_FIELDS))).alias("rules"))
            .withColumn("source", F.concat_ws(".", "src_schema_nam", "src_tbl_nam")))


def lookup(maps: DataFrame, rules: DataFrame, connections: DataFrame,
           schema: str | None = None, table: str | None = None) -> DataFrame:
    """Active maps with their target connection; maps without rules stay in.

    Without ``table`` the whole catalogue is resolved at once.
    """
    chosen = active(maps)
    if table is not None:
        chosen = chosen.filter((F.col("src_schema_nam") == schema) & (F.col("src_tbl_nam") == table))
    conn = connections.select(
        F.col("connection_id").alias("dstn_connection_id"), "connection_name",
        "db_host", "db_port", "db_name", "db_type")
    per_map = (rules.groupBy("map_id")
               .agg(F.sort_array(F.collect_list(F.struct(*RULE_FIELDS))).alias("rules")))
    return (chosen.join(conn, "dstn_connection_id").join(per_map, "map_id", "left")
            .withColumn("rules", F.coalesce("rules", F.array())))


def lint(maps: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules per map, zero included."""
    counts = rules.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))
    return (maps.select("map_id", "src_tbl_nam", "dstn_tbl_nam", "load_order", "stream_type")
            .join(counts, "map_id", "left")
            .select("map_id", "src_tbl_nam", "dstn_tbl_nam", "load_order", "stream_type",
                    F.coalesce("n", F.lit(0)).alias("rule_count")))


def dependency_ranks(maps: DataFrame, rules: DataFrame) -> DataFrame:
    """Smallest map id per source table that has an active map with rules."""
    return (active(maps).join(rules.select("map_id").distinct(), "map_id", "left_semi")
            .groupBy(F.col("src_schema_nam").alias("src_schema"),
                     F.col("src_tbl_nam").alias("src_table"))
            .agg(F.min("map_id").alias("dep_rank")))


def patch(table: DataFrame, keys: list[str], edits: DataFrame, fields: list[str],
          deletes: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Metadata evolution: remove the rows of ``deletes``, then overwrite
    ``fields`` of the rows whose ``keys`` are in ``edits`` (null = keep).

    Of several edits of one row the last by ``order`` counts, field by field;
    without an order the largest value, so that the outcome is always the same.
    """
    kept = table if deletes is None else table.join(deletes.select(*keys).distinct(), keys, "left_anti")

    def chosen(field: str) -> Column:
        return F.max(field) if order is None else F.max_by(field, F.when(F.col(field).isNotNull(), F.col(order)))

    renamed = edits.groupBy(*keys).agg(*[chosen(f).alias(f"new_{f}") for f in fields])
    return (kept.join(renamed, keys, "left")
            .select(*[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c)
                      for c in table.columns]))


def _keys(text: str) -> tuple[str, ...]:
    return tuple(part.strip() for part in text.split(","))


def load_mappings(maps: DataFrame, rules: DataFrame, stream: str | None = None) -> list[Mapping]:
    """Active mappings on the driver, ordered by source, load order and id."""
    chosen = maps if stream is None else for_stream(maps, stream)
    nested = catalog(chosen, rules)
    held = nested.agg(F.coalesce(F.sum(F.size("rules") + 1), F.lit(0))).first()[0]
    if held > MAX_DRIVER_RULES:  # maps and their rules
        raise ValueError("too many mapping rules to plan on the driver; select a source first")
    rows = nested.collect()
    found = [Mapping(
        r.map_id, r.src_schema_nam, r.src_tbl_nam, r.dstn_schema_nam, r.dstn_tbl_nam,
        _keys(r.src_pks), _keys(r.dstn_pks), r.load_order, r.stream_type,
        tuple(Rule(x.src_field_name, x.src_datatype_txt, x.dstn_field_name, x.dstn_datatype_txt,
                   x.conversion_method, x.conversion_format_txt, x.column_order) for x in r.rules))
        for r in rows]
    return sorted(found, key=lambda m: (m.source, m.load_order, m.map_id))


def by_source(mappings: list[Mapping]) -> dict[str, list[Mapping]]:
    grouped: dict[str, list[Mapping]] = {}
    for m in mappings:
        grouped.setdefault(m.source, []).append(m)
    return grouped


def source_rank(mappings: list[Mapping]) -> int:
    return min((m.map_id for m in mappings), default=UNKNOWN_RANK)


def by_wave(mappings: list[Mapping]) -> list[list[Mapping]]:
    """Source tables in dependency order, each with its maps in load order."""
    groups = by_source(mappings).values()
    return sorted(groups, key=source_rank)
