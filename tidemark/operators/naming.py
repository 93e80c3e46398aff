"""From positional change rows to named fields, and from rows to their maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.conversions import strip
from tidemark.sources.metadata import Mapping, active


def source_field(name: str, header: list[str]) -> str:
    """Column of a source field: its own name, marked where the row's header has that name already."""
    return f"src:{name}" if name in (*header, "data", "errors") else name


def source_key() -> Column:
    return F.concat_ws(".", "src_schema", "src_table")


def drop_unaddressed(rows: DataFrame) -> DataFrame:
    """Leave out rows that name no schema or no table."""
    return rows.filter((F.col("src_schema") != "") & (F.col("src_table") != ""))


def unaddressed(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("src_schema") == "") | (F.col("src_table") == ""))


def _source_pairs(maps: DataFrame) -> DataFrame:
    return (active(maps).select(F.col("src_schema_nam").alias("src_schema"),
                                F.col("src_tbl_nam").alias("src_table")).distinct())


def unmapped(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Rows whose table has no active map (to be ignored, with a fault)."""
    return drop_unaddressed(rows).join(_source_pairs(maps), ["src_schema", "src_table"], "left_anti")


def rows_of(rows: DataFrame, mapping: Mapping) -> DataFrame:
    return rows.filter((F.col("src_schema") == mapping.src_schema)
                       & (F.col("src_table") == mapping.src_table))


def primary_map(mappings: list[Mapping]) -> Mapping:
    return min(mappings, key=lambda m: (m.load_order, m.map_id))


def name_columns(rows: DataFrame, mappings: list[Mapping], position: str = "rank") -> DataFrame:
    """Name the data columns of one source table after its primary map.

    ``rank`` takes the i-th rule for the i-th column; ``column_order`` uses the
    number in the rule itself.  Missing trailing columns become null, extra
    ones are ignored.
    """
    main = primary_map(mappings)
    rules = sorted(main.rules, key=lambda r: r.order)
    data = F.col("data")
    header = [c for c in rows.columns if c != "data"]
    fields = []
    for i, rule in enumerate(rules):
        at = i if position == "rank" else rule.order - 1
        fields.append(strip(F.get(data, F.lit(at))).alias(source_field(rule.src, header)))
    # inline() of one struct: each field is stripped once, however often it is read
    return rows_of(rows, main).select(*header, F.inline(F.array(F.struct(*fields))))


def primary_fields(maps: DataFrame, rules: DataFrame) -> DataFrame:
    """Field names per source table, in order, for every table at once."""
    first = Window.partitionBy("src_schema_nam", "src_tbl_nam").orderBy("load_order", "map_id")
    with_rules = active(maps).join(rules.select("map_id").distinct(), "map_id", "left_semi")
    main = (with_rules.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
            .select("map_id", F.col("src_schema_nam").alias("src_schema"),
                    F.col("src_tbl_nam").alias("src_table"), "src_pks"))
    names = (rules.groupBy("map_id")
             .agg(F.sort_array(F.collect_list(F.struct("column_order", "rule_id", "src_field_name")))
                  .alias("r"))
             .select("map_id", F.col("r.src_field_name").alias("fields")))
    return main.join(names, "map_id").select("src_schema", "src_table", "src_pks", "fields")


def _key_names() -> Column:
    return F.transform(F.split("src_pks", ","), lambda k: strip(k))


def named_map(rows: DataFrame, fields: DataFrame, keep_data: bool = False) -> DataFrame:
    """Rows of any mix of tables with their data as a field -> value map.

    ``keep_data`` leaves the data beside it and the places of the keys in it, found once per source table.
    """
    if keep_data:
        fields = (fields.withColumn("pk_names", _key_names())
                  .withColumn("pk_places", F.transform("pk_names", lambda k: F.array_position("fields", k).cast("int"))))
    joined = rows.join(fields, ["src_schema", "src_table"])
    values = F.transform("fields", lambda _f, i: strip(F.get(F.col("data"), i)))
    named = joined.withColumn("event_data", F.map_from_arrays("fields", values))
    return named.drop("fields") if keep_data else named.drop("fields", "data")


def key_map(named: DataFrame) -> DataFrame:
    """Key fields of a row as {key: value}; composite keys keep all parts.

    Beside the data only the keys' own fields are read, and no map of all fields is made to look them up.
    """
    if "pk_places" in named.columns:  # place 0: not one of the fields
        values = F.transform("pk_places", lambda at: strip(F.get(F.col("data"), at - 1)))
        return named.withColumn("pk_values", F.map_from_arrays("pk_names", values))
    keys = _key_names()
    return named.withColumn("pk_values", F.map_from_arrays(
        keys, F.transform(keys, lambda k: F.try_element_at(F.col("event_data"), k))))


def fan_out(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """One row per event and target, with the target's place in load order."""
    targets = active(maps).select(
        F.col("src_schema_nam").alias("src_schema"), F.col("src_tbl_nam").alias("src_table"),
        "map_id", "dstn_schema_nam", "dstn_tbl_nam", "load_order")
    return rows.join(targets, ["src_schema", "src_table"])
