"""Conversion methods: text from a change file -> value for a target column.

Each method is a builder ``(value, fmt) -> Column`` made of built-in functions
only, so a mapped projection stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[[Column, "str | None"], Column]

# The null marker of change files, the fallback date, and the
# methods whose column is left to the target.
NULL_TEXT = "NULL"
FALLBACK_DATE = "1900-01-01"
LARGEST_NUMBER = "9" * 27
EXCLUDED_METHODS = frozenset({"SKIP", "UUID_GENERATE"})

# Fixed value: the characters that count as white space at the ends of a field.
WHITE_SPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
               "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(value: Column) -> Column:
    """Remove any white space at both ends (SQL trim alone removes blanks only)."""
    return F.trim(value, F.lit(WHITE_SPACE))


def is_blank(value: Column) -> Column:
    return value.isNull() | strip(value).isin("", NULL_TEXT)


def _direct(value: Column, fmt: str | None) -> Column:
    return F.when(~value.isin("", NULL_TEXT), value)


def _null_to_blank(value: Column, fmt: str | None) -> Column:
    return F.when(is_blank(value), F.lit("")).otherwise(value)


def is_number(value: Column) -> Column:
    """Digits with an optional sign, point and exponent, however large."""
    return F.coalesce(strip(value).rlike(r"^[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?$"), F.lit(False))


def _null_to_zero(value: Column, fmt: str | None) -> Column:
    """Text that is no number counts as zero; a number too large keeps its sign and the largest
    amount that can be carried, which no target column holds, so that it is refused as out of range."""
    largest = F.lit(LARGEST_NUMBER).cast("decimal(38,10)")
    return F.coalesce(value.try_cast("decimal(38,10)"),
                      F.when(is_number(value), F.when(strip(value).startswith("-"), -largest).otherwise(largest)),
                      F.lit(0).cast("decimal(38,10)"))


def _null_to_date(value: Column, fmt: str | None) -> Column:
    default = F.coalesce(F.lit(fmt).try_cast("date"),
                         F.lit(FALLBACK_DATE).cast("date"))
    return F.when(is_blank(value), default.cast("string")).otherwise(value)


def _legacy_ref(value: Column, fmt: str | None) -> Column:
    as_int = value.try_cast("bigint").cast("string")
    return F.when(~is_blank(value), F.coalesce(as_int, value))


def _uppercase(value: Column, fmt: str | None) -> Column:
    return F.when(~is_blank(value), F.upper(value))


def _trim(value: Column, fmt: str | None) -> Column:
    return F.when(~is_blank(value), strip(value))


def _unchanged(value: Column, fmt: str | None) -> Column:
    return value


_REGISTRY: dict[str, Builder] = {
    "DIRECT": _direct,
    "NULL_TO_BLANK": _null_to_blank,
    "NULL_TO_ZERO": _null_to_zero,
    "NULL_TO_DATE": _null_to_date,
    "LEGACY_REF": _legacy_ref,
    "UPPERCASE": _uppercase,
    "TRIM": _trim,
    "SKIP_NULL_CONVERSION": _unchanged,
}


def method_name(method: str | None) -> str:
    return (method or "DIRECT").strip().upper()


def is_excluded(method: str | None) -> bool:
    return method_name(method) in EXCLUDED_METHODS


def convert(method: str | None, value: Column, fmt: str | None = None) -> Column:
    """Apply one method; an unknown name copies the value as DIRECT does."""
    if is_excluded(method):
        return F.lit(None).cast("string")
    return _REGISTRY.get(method_name(method), _direct)(value, fmt)


def register_conversion(name: str, builder: Builder) -> None:
    """Add a method (or replace one); usable from metadata at once."""
    if is_excluded(name):
        raise ValueError(f"{name} is reserved")
    _REGISTRY[method_name(name)] = builder


def registered() -> list[str]:
    return sorted(_REGISTRY)


def unparsable_number(value: Column) -> Column:
    """Rows for which NULL_TO_ZERO falls back to zero although text is present."""
    return ~is_blank(value) & value.try_cast("decimal(38,10)").isNull() & ~is_number(value)


# The type names used in metadata and their Spark types.
TARGET_TYPES = {
    "BIGINT": "bigint",
    "INT": "int",
    "VARCHAR": "string",
    "UUID": "string",
    "NUMERIC": "decimal(12,2)",
    "DECIMAL": "decimal(12,2)",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "DATETIME": "timestamp_ntz",
    "BOOLEAN": "boolean",
}


def target_type(name: str | None) -> str:
    return TARGET_TYPES.get((name or "VARCHAR").strip().upper(), "string")


def cast_to_target(value: Column, type_name: str | None) -> Column:
    """Cast to the type metadata names; a value that does not fit gives null."""
    return value.try_cast(target_type(type_name))


def cast_fails(value: Column, type_name: str | None) -> Column:
    return value.isNotNull() & cast_to_target(value, type_name).isNull()
