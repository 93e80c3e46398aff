from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import conversions as conv
from tidemark.functions import keys, scalars


def apply(spark, method, values, fmt=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", conv.convert(method, F.col("v"), fmt).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


@pytest.mark.parametrize("method, fmt, values, wanted", [
    ("DIRECT", None, ["a", "", "NULL", "null", " ", None], ["a", None, None, "null", " ", None]),
    ("NULL_TO_BLANK", None, ["a", "", " NULL ", "null", None], ["a", "", "", "null", ""]),
    ("NULL_TO_ZERO", None, ["1.5", "", "NULL", "x", None, "nan", "1_000"],
     [Decimal("1.5"), 0, 0, 0, 0, 0, 0]),
    ("NULL_TO_DATE", "2001-02-03", ["2020-01-01", "", None], ["2020-01-01", "2001-02-03", "2001-02-03"]),
    ("NULL_TO_DATE", "bad", ["", "x"], ["1900-01-01", "x"]),
    ("NULL_TO_DATE", None, ["NULL"], ["1900-01-01"]),
    ("LEGACY_REF", None, ["007", " 12 ", "1000.5", "AB", "", None], ["7", "12", "1000.5", "AB", None, None]),
    ("UPPERCASE", None, ["ab", "NULL", ""], ["AB", None, None]),
    ("TRIM", None, ["\t ab ", "   ", None], ["ab", None, None]),
    ("SKIP_NULL_CONVERSION", None, ["NULL", "", None], ["NULL", "", None]),
    ("SKIP", None, ["a"], [None]),
    ("UUID_GENERATE", None, ["a"], [None]),
    ("unheard of", None, ["a", "NULL"], ["a", None]),
    (None, None, ["a", ""], ["a", None]),
    (" trim ", None, [" a "], ["a"]),
])
def test_methods(spark, method, fmt, values, wanted):
    assert apply(spark, method, values, fmt) == wanted


def test_register_and_reserved(spark):
    conv.register_conversion("reverse_it", lambda v, fmt: F.reverse(v))
    assert apply(spark, "REVERSE_IT", ["abc"]) == ["cba"]
    with pytest.raises(ValueError):
        conv.register_conversion("skip", lambda v, fmt: v)


def test_cast_to_target(spark):
    df = spark.createDataFrame([("2024-02-30", "12345678901.00", "12.345")], "d string, big string, n string")
    row = df.select(conv.cast_to_target(F.col("d"), "DATE").alias("d"), conv.cast_fails(F.col("d"), "DATE").alias("bad"),
                    conv.cast_to_target(F.col("big"), "NUMERIC").alias("big"),
                    conv.cast_to_target(F.col("n"), "NUMERIC").alias("n")).first()
    assert (row.d, row.bad, row.big, row.n) == (None, True, None, Decimal("12.35"))


def test_clock_key_round_trip(spark):
    raw = bytes([0xC7, 0xF3, 0xA2, 0xB1, 0xD4, 0xE5, 0xF6, 0x01, 0xFF])
    df = spark.createDataFrame([(bytearray(raw),), (bytearray(raw[:8]),)], "raw binary")
    rows = df.select(keys.clock_key_to_text(F.col("raw")).alias("t")).collect()
    assert [r.t for r in rows] == ["C7F3A2B1D4E5F601FF", None]
    texts = spark.createDataFrame([("C7F3A2B1D4E5F601FF",), ("C7F3A2B1D4E5F601",), ("ZZF3A2B1D4E5F601FF",)], "t string")
    back = [r.b for r in texts.select(keys.text_to_clock_key(F.col("t")).alias("b")).collect()]
    assert [None if b is None else bytes(b) for b in back] == [raw, None, None]


def test_origin_uuid_ttl_and_nulls(spark):
    df = spark.createDataFrame([(1000000, "P1"), (1000001, "P1"), (None, None)], "k bigint, n string")
    rows = df.select(keys.key_origin(F.col("k")).alias("o"), keys.stable_uuid(F.col("n"), "s").alias("u")).collect()
    assert [r.o for r in rows] == ["LEGACY", "CLOUD", None]
    assert rows[0].u == rows[1].u and len(rows[0].u) == 36 and rows[2].u is None
    one = spark.sql("select timestamp_ntz'2024-01-01 00:00:00.5' as t").select(
        scalars.ttl_epoch(F.lit("SUCCESS"), F.col("t")).alias("a"),
        scalars.ttl_epoch(F.lit("FAILED"), F.col("t")).alias("b"),
        scalars.drop_null_entries(F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit(None).cast("string"))).alias("m")).first()
    assert one.a == 1704067200 + 90 * 86400 and one.b == 1704067200 + 180 * 86400
    assert one.m == {"x": "1"}
    assert date(1900, 1, 1).isoformat() == conv.FALLBACK_DATE


def test_numbers_too_large_are_refused_and_text_is_zero(spark):
    df = spark.createDataFrame([(t,) for t in ("1e30", "-" + "9" * 30, "abc", "nan", "12.5", None)], "v string")
    value = conv.convert("NULL_TO_ZERO", F.col("v"))
    rows = df.select("v", value.alias("n"), conv.cast_fails(value, "NUMERIC").alias("bad"),
                     conv.unparsable_number(F.col("v")).alias("warn")).collect()
    got = {r.v: (r.bad, r.warn) for r in rows}
    assert got == {"1e30": (True, False), "-" + "9" * 30: (True, False), "abc": (False, True), "nan": (False, True),
                   "12.5": (False, False), None: (False, False)}
    assert {r.v: float(r.n) for r in rows if r.v in ("abc", "12.5")} == {"abc": 0.0, "12.5": 12.5}
