"""Projection of named rows onto a target table, driven by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.conversions import (
    EXCLUDED_METHODS, cast_to_target, convert, is_excluded)
from tidemark.sources.metadata import Mapping, Rule

# Fixed value: fields read for the guard but never written.
SYSTEM_ONLY = frozenset({"datasync_flag"})


def is_written(rule: Rule) -> bool:
    return not is_excluded(rule.method) and rule.src not in SYSTEM_ONLY


def written_rules(mapping: Mapping) -> list[Rule]:
    return sorted((r for r in mapping.rules if is_written(r)), key=lambda r: r.order)


def excluded_columns(mapping: Mapping) -> list[str]:
    return [r.dst for r in sorted(mapping.rules, key=lambda r: r.order) if not is_written(r)]


def _source(named: DataFrame, field: str) -> Column:
    marked = f"src:{field}"  # a source field named like one of the header
    if marked in named.columns:
        return F.col(f"`{marked}`")
    return F.col(field) if field in named.columns else F.lit(None).cast("string")


def converted(named: DataFrame, rule: Rule) -> Column:
    return convert(rule.method, _source(named, rule.src), rule.fmt)


def project_target(named: DataFrame, mapping: Mapping, keep: list[str] = (),
                   typed: bool = True) -> DataFrame | None:
    """Target columns in rule order; None when the map writes no column.

    ``typed=False`` leaves the converted values as they are (text mostly).
    """
    rules = written_rules(mapping)
    if not rules:
        return None
    cols = []
    for rule in rules:
        value = converted(named, rule)
        cols.append((cast_to_target(value, rule.dst_type) if typed else value).alias(rule.dst))
    return named.select(*keep, *cols)


def key_columns(named: DataFrame, mapping: Mapping) -> list[Column]:
    """Source keys converted by their rules, under the target's key names."""
    rule_of = {r.src: r for r in mapping.rules}
    cols = []
    for src, dst in zip(mapping.src_pks, mapping.dst_pks):
        if src in SYSTEM_ONLY:
            continue
        rule = rule_of.get(src)
        value = _source(named, src)
        value = convert(rule.method, value, rule.fmt) if rule else convert("DIRECT", value)
        cols.append(cast_to_target(value, rule.dst_type if rule else None).alias(dst))
    return cols


def delete_keys(named: DataFrame, mapping: Mapping, keep: list[str] = ()) -> DataFrame:
    """Target keys of the delete events."""
    return named.filter(F.col("op") == "D").select(*keep, *key_columns(named, mapping))


def excluded_catalog(catalog: DataFrame) -> DataFrame:
    """Per map the target columns that are never written, in rule order."""
    def left_out(rule: Column) -> Column:
        method = F.upper(F.trim(F.coalesce(rule["conversion_method"], F.lit("DIRECT"))))
        return method.isin(*EXCLUDED_METHODS) | rule["src_field_name"].isin(*SYSTEM_ONLY)

    names = F.transform(F.filter("rules", left_out), lambda r: r["dstn_field_name"])
    return catalog.select("map_id", names.alias("excluded")).filter(F.size("excluded") > 0)
