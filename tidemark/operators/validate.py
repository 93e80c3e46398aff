"""Row and table checks a target would make on write, as set operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.conversions import cast_to_target, target_type
from tidemark.operators import project
from tidemark.sources.metadata import Mapping


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    required: bool = True
    length: int | None = None


@dataclass(frozen=True)
class TableSpec:
    """Constraints of one target: columns, primary key, unique columns, parents.

    ``parent`` is (child column, parent table, parent column); a table with
    several has the others in ``more_parents``.
    """

    name: str
    keys: tuple[str, ...]
    columns: tuple[ColumnSpec, ...]
    unique: tuple[str, ...] = ()
    parent: tuple[str, str, str] | None = None
    more_parents: tuple[tuple[str, str, str], ...] = ()

    @property
    def parents(self) -> tuple[tuple[str, str, str], ...]:
        return (*((self.parent,) if self.parent else ()), *self.more_parents)

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)


def _problem(code: str, name: str, bad: Column) -> Column:
    return F.when(bad, F.lit(f"{code}:{name}"))


def _column_problems(value: Column, name: str, type_name: str, spec: ColumnSpec | None) -> list[Column]:
    typed = cast_to_target(value, type_name)
    unparsed = value.isNotNull() & typed.isNull()
    if target_type(type_name).startswith("decimal"):
        number = value.try_cast("decimal(38,10)")
        found = [_problem("TYPE", name, unparsed & number.isNull()),
                 _problem("RANGE", name, unparsed & number.isNotNull())]
    else:
        found = [_problem("TYPE", name, unparsed)]
    if spec is None:
        return found
    if spec.required:
        found.append(_problem("NOT_NULL", name, value.isNull()))
    if spec.length:
        found.append(_problem("LENGTH", name, F.length(value.cast("string")) > spec.length))
    return found


def target_rows(named: DataFrame, mapping: Mapping, spec: TableSpec | None = None,
                keep: list[str] = ()) -> DataFrame:
    """Typed target columns plus ``errors``: what a write would have refused.

    A delete needs nothing but its key.
    """
    is_delete = F.col("op") == "D"
    rules = project.written_rules(mapping)
    keys = dict(zip(mapping.dst_pks, project.key_columns(named, mapping)))
    values = [project.converted(named, r).alias(f"_v{i}") for i, r in enumerate(rules)]
    typed_keys = [k.alias(f"_k{i}") for i, k in enumerate(keys.values())]
    held = named.select(*keep, is_delete.alias("_delete"),
                        F.inline(F.array(F.struct(*values, *typed_keys))))
    key_at = {name: F.col(f"_k{i}") for i, name in enumerate(keys)}
    cols, problems = [], []
    for i, rule in enumerate(rules):
        value = F.col(f"_v{i}")
        cols.append(key_at.get(rule.dst, cast_to_target(value, rule.dst_type)).alias(rule.dst))
        for p in _column_problems(value, rule.dst, rule.dst_type, spec.column(rule.dst) if spec else None):
            problems.append(p if rule.dst in keys else F.when(~F.col("_delete"), p))
    errors = F.array_compact(F.array(*problems)).alias("errors")
    return held.select(*keep, F.inline(F.array(F.struct(*cols, errors))))


def invalid_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("errors") > 0)


def unique_violations(rows: DataFrame, keys: list[str], unique: str,
                      target: DataFrame | None = None) -> DataFrame:
    """Rows whose business number also occurs under another primary key.

    Numbers are summarised first (two keys are enough to convict one), so a
    number shared by very many rows never meets in one task.
    """
    key = F.struct(*keys)
    seen = rows.select(*keys, unique)
    if target is not None:
        seen = seen.unionByName(target.select(*keys, unique))
    clash = (seen.filter(F.col(unique).isNotNull()).groupBy(unique)
             .agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
             .filter(F.col("_lo") != F.col("_hi")).select(unique))
    return rows.join(clash, unique, "left_semi")


def fk_violations(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose parent does not exist.

    The distinct references are checked, not the rows; the rows of a heavy
    missing parent are split by the adaptive skew join.
    """
    wanted = child.filter(F.col(column).isNotNull()).select(column).distinct()
    lost = wanted.join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")
    return child.join(lost, column, "left_semi")


def fk_restrict(deleted: DataFrame, parent_column: str, child: DataFrame, column: str) -> DataFrame:
    """Deleted parents that still have live children."""
    used = child.filter(F.col(column).isNotNull()).select(F.col(column).alias(parent_column)).distinct()
    return deleted.join(used, parent_column, "left_semi")
