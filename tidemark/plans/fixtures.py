"""Inputs of the query catalogue, derived from the given tables.

Orders become insurance policies, order lines become claims, events become a
change feed on an account table, suppliers and their lines become a wide set
of mapping metadata.  Everything here runs over whole tables.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import stable_uuid
from tidemark.operators.apply import Target
from tidemark.operators.validate import ColumnSpec as C
from tidemark.operators.validate import TableSpec
from tidemark.session import fresh_path
from tidemark.sources.metadata import Mapping, load_mappings

TOKEN_SALT = "demo-salt"
ORDERS_PER_FILE = 2000

# -- fixed values: mapping metadata of the insurance schema -----------------
# map_id, source table, target table, source keys, target keys, load order
SEED_MAPS = [
    (1, "policy", "policy", "policy_id", "policy_id", 1),
    (2, "policy", "policy_keyring", "policy_num", "legacy_policy_num", 2),
    (3, "claim", "claim", "claim_id", "claim_id", 1),
    (4, "claim", "claim_keyring", "claim_num", "legacy_claim_num", 2),
]
# map_id, source field, source type, target field, target type, method, format, column order
SEED_RULES = [
    (1, "policy_id", "BIGINT", "policy_id", "BIGINT", "LEGACY_REF", None, 1),
    (1, "policy_num", "VARCHAR", "policy_num", "VARCHAR", "DIRECT", None, 2),
    (1, "policy_holder_name", "VARCHAR", "policy_holder_name", "VARCHAR", "TRIM", None, 3),
    (1, "policy_type", "VARCHAR", "policy_type", "VARCHAR", "UPPERCASE", None, 4),
    (1, "effective_date", "DATE", "effective_date", "DATE", "DIRECT", None, 5),
    (1, "expiry_date", "DATE", "expiry_date", "DATE", "DIRECT", None, 6),
    (1, "premium_amount", "DECIMAL", "premium_amount", "NUMERIC", "NULL_TO_ZERO", None, 7),
    (1, "created_at", "DATETIME", "created_at", "TIMESTAMP", "DIRECT", None, 8),
    (1, "last_modified", "DATETIME", "last_modified", "TIMESTAMP", "DIRECT", None, 9),
    (1, "datasync_flag", "VARCHAR", "datasync_flag", "VARCHAR", "DIRECT", None, 10),
    (2, "policy_num", "VARCHAR", "legacy_policy_num", "VARCHAR", "DIRECT", None, 1),
    (3, "claim_id", "BIGINT", "claim_id", "BIGINT", "LEGACY_REF", None, 1),
    (3, "claim_num", "VARCHAR", "claim_num", "VARCHAR", "DIRECT", None, 2),
    (3, "policy_id", "BIGINT", "policy_id", "BIGINT", "LEGACY_REF", None, 3),
    (3, "policy_num", "VARCHAR", "policy_num", "VARCHAR", "DIRECT", None, 4),
    (3, "claimant_name", "VARCHAR", "claimant_name", "VARCHAR", "TRIM", None, 5),
    (3, "claim_amount", "DECIMAL", "claim_amount", "NUMERIC", "NULL_TO_ZERO", None, 6),
    (3, "claim_status", "VARCHAR", "claim_status", "VARCHAR", "NULL_TO_BLANK", None, 7),
    (3, "incident_date", "DATE", "incident_date", "DATE", "NULL_TO_DATE", "1900-01-01", 8),
    (3, "created_at", "DATETIME", "created_at", "TIMESTAMP", "DIRECT", None, 9),
    (3, "last_modified", "DATETIME", "last_modified", "TIMESTAMP", "DIRECT", None, 10),
    (3, "datasync_flag", "VARCHAR", "datasync_flag", "VARCHAR", "DIRECT", None, 11),
    (4, "claim_num", "VARCHAR", "legacy_claim_num", "VARCHAR", "DIRECT", None, 1),
]
# -- end of fixed values ------------------------------------------------------

ACCOUNT_MAP = (9, "account", "account", "account_id", "account_id", 1)
ACCOUNT_RULES = [
    (9, "account_id", "BIGINT", "account_id", "BIGINT", "LEGACY_REF", None, 1),
    (9, "payload", "DECIMAL", "payload", "NUMERIC", "NULL_TO_ZERO", None, 2),
    (9, "props", "VARCHAR", "props", "VARCHAR", "DIRECT", None, 3),
    (9, "last_modified", "DATETIME", "last_modified", "TIMESTAMP", "DIRECT", None, 4),
    (9, "datasync_flag", "VARCHAR", "datasync_flag", "VARCHAR", "DIRECT", None, 5),
]

MAPS_SCHEMA = ("map_id int, src_connection_id int, dstn_connection_id int, src_schema_nam string, "
               "dstn_schema_nam string, src_tbl_nam string, dstn_tbl_nam string, src_pks string, "
               "dstn_pks string, is_active boolean, stream_type string, load_order int")
RULES_SCHEMA = ("rule_id int, map_id int, src_field_name string, src_datatype_txt string, "
                "dstn_field_name string, dstn_datatype_txt string, conversion_method string, "
                "conversion_format_txt string, column_order int")

POLICY = TableSpec("insurance.policy", ("policy_id",), (
    C("policy_id", "BIGINT"), C("policy_num", "VARCHAR", length=50),
    C("policy_holder_name", "VARCHAR", length=200), C("policy_type", "VARCHAR", length=50),
    C("effective_date", "DATE"), C("expiry_date", "DATE"), C("premium_amount", "NUMERIC"),
    C("created_at", "TIMESTAMP"), C("last_modified", "TIMESTAMP")), unique=("policy_num",))
CLAIM = TableSpec("insurance.claim", ("claim_id",), (
    C("claim_id", "BIGINT"), C("claim_num", "VARCHAR", length=50), C("policy_id", "BIGINT"),
    C("policy_num", "VARCHAR", length=50), C("claimant_name", "VARCHAR", length=200),
    C("claim_amount", "NUMERIC"), C("claim_status", "VARCHAR", length=30),
    C("incident_date", "DATE", required=False), C("created_at", "TIMESTAMP"),
    C("last_modified", "TIMESTAMP")), unique=("claim_num",),
    parent=("policy_id", "insurance.policy", "policy_id"))
POLICY_KEYRING = TableSpec("insurance.policy_keyring", ("legacy_policy_num",),
                           (C("legacy_policy_num", "VARCHAR", length=50),))
CLAIM_KEYRING = TableSpec("insurance.claim_keyring", ("legacy_claim_num",),
                          (C("legacy_claim_num", "VARCHAR", length=50),))
ACCOUNT = TableSpec("app.account", ("account_id",), (
    C("account_id", "BIGINT"), C("payload", "NUMERIC"), C("props", "VARCHAR", required=False),
    C("last_modified", "TIMESTAMP")))


def targets() -> dict[str, Target]:
    created = F.col("event_ts").try_cast("timestamp_ntz")
    return {
        POLICY.name: Target(POLICY), CLAIM.name: Target(CLAIM), ACCOUNT.name: Target(ACCOUNT),
        POLICY_KEYRING.name: Target(POLICY_KEYRING, (
            ("keyring_id", F.lit(None).cast("bigint")),
            ("policy_uuid", stable_uuid(F.col("legacy_policy_num"), TOKEN_SALT)), ("created_at", created)),
            ("keyring_id", 4000001, 2, "created_at")),
        CLAIM_KEYRING.name: Target(CLAIM_KEYRING, (
            ("keyring_id", F.lit(None).cast("bigint")),
            ("claim_uuid", stable_uuid(F.col("legacy_claim_num"), TOKEN_SALT)), ("created_at", created)),
            ("keyring_id", 3000001, 2, "created_at")),
    }


def _literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small local table: its size is known to the planner, so joins broadcast it."""
    names = [field.split()[0] for field in schema.split(", ")]
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, r)) for r in rows]), schema)


def seed_maps(spark: SparkSession) -> DataFrame:
    rows = [(m, 1, 2, "insurance", "insurance", s, t, sp, tp, True, "BOTH", o)
            for m, s, t, sp, tp, o in SEED_MAPS]
    m, s, t, sp, tp, o = ACCOUNT_MAP
    return _literal(spark, [*rows, (m, 1, 2, "app", "app", s, t, sp, tp, True, "CDC", o)], MAPS_SCHEMA)


def seed_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate([*SEED_RULES, *ACCOUNT_RULES], start=1)]
    return _literal(spark, rows, RULES_SCHEMA)


def mappings(spark: SparkSession, stream: str | None = "CDC") -> list[Mapping]:
    return load_mappings(seed_maps(spark), seed_rules(spark), stream)


def insurance(spark: SparkSession) -> list[Mapping]:
    return [m for m in mappings(spark) if m.src_schema == "insurance"]


# -- wide metadata: one source table per four suppliers ---------------------
def connections(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.select(
        F.col("n_nationkey").alias("connection_id"),
        F.concat(F.lit("conn-"), F.lower("n_name")).alias("connection_name"),
        F.concat(F.lit("host"), F.col("n_regionkey").cast("string")).alias("db_host"),
        F.lit(5432).alias("db_port"), F.lower("n_name").alias("db_name"),
        F.when(F.col("n_regionkey") < 2, "MYSQL").otherwise("POSTGRESQL").alias("db_type"))


def wide_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Two maps per supplier: one fed by its order lines' rules, and, where the
    account is overdrawn, one that no rule was ever written for."""
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    src = F.concat(F.lit("t"), F.floor(key / 4).cast("string"))

    def maps(df: DataFrame, map_id: Column, dst: Column) -> DataFrame:
        return df.select(
            map_id.cast("int").alias("map_id"), F.lit(1).alias("src_connection_id"),
            F.col("s_nationkey").alias("dstn_connection_id"), F.lit("wide").alias("src_schema_nam"),
            F.lit("cloud").alias("dstn_schema_nam"), src.alias("src_tbl_nam"), dst.alias("dstn_tbl_nam"),
            F.lit("f1, f2").alias("src_pks"), F.lit("g1,g2").alias("dstn_pks"),
            (key % 7 != 0).alias("is_active"),
            F.when(key % 3 == 0, "CDC").when(key % 3 == 1, "FULL_LOAD").otherwise("BOTH").alias("stream_type"),
            (key % 4 + 1).cast("int").alias("load_order"))

    ruled = maps(s, key * 2 + 100, F.concat(F.lit("d"), key.cast("string")))
    bare = maps(s.filter("s_acctbal < 0"), key * 2 + 101, F.concat(F.lit("e"), key.cast("string")))
    return ruled.unionByName(bare)


# a fixed list of method names, one per residue
RULE_METHODS = ["DIRECT", "NULL_TO_BLANK", "NULL_TO_ZERO", "NULL_TO_DATE", "LEGACY_REF",
                "UPPERCASE", "TRIM", "SKIP", "UUID_GENERATE", "SKIP_NULL_CONVERSION"]


def wide_rules(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber").distinct()
    line = F.col("l_linenumber").cast("string")
    methods = F.array(*[F.lit(m) for m in RULE_METHODS])
    return pairs.select(
        (F.col("l_suppkey") * 10 + F.col("l_linenumber")).cast("int").alias("rule_id"),
        (F.col("l_suppkey") * 2 + 100).cast("int").alias("map_id"),
        F.concat(F.lit("f"), line).alias("src_field_name"), F.lit("VARCHAR").alias("src_datatype_txt"),
        F.concat(F.lit("g"), line).alias("dstn_field_name"), F.lit("VARCHAR").alias("dstn_datatype_txt"),
        F.get(methods, ((F.col("l_suppkey") + F.col("l_linenumber")) % 10).cast("int")).alias("conversion_method"),
        F.lit(None).cast("string").alias("conversion_format_txt"),
        (F.col("l_linenumber") * 10).cast("int").alias("column_order"))


# -- business tables ----------------------------------------------------------
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _num(prefix: str, value: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(value.cast("string"), width, "0"))


def policy_src(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        (1000000 + 2 * k).cast("bigint").alias("policy_id"), _num("POL-", k, 15).alias("policy_num"),
        F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("policy_holder_name"),
        F.lower("c_mktsegment").alias("policy_type"), day.alias("effective_date"),
        F.date_add(day, 365).alias("expiry_date"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("premium_amount"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("last_modified"),
        F.when(k % 10 == 3, "CLOUD").alias("datasync_flag")))


def claim_src(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as claims; several lines may share a number, so they are grouped."""
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    grouped = (items.groupBy("l_orderkey", "l_linenumber")
               .agg(F.max("l_extendedprice").alias("price"), F.max(F.ascii("l_returnflag")).alias("rf"),
                    F.max("l_shipdate").alias("last_modified")))
    return grouped.selectExpr(
        "cast(2000000 + 2 * (l_orderkey * 8 + l_linenumber) as bigint) as claim_id",
        "'CLM-' || lpad(cast(l_orderkey * 8 + l_linenumber as string), 15, '0') as claim_num",
        "cast(1000000 + 2 * l_orderkey as bigint) as policy_id",
        "'POL-' || lpad(cast(l_orderkey as string), 15, '0') as policy_num",
        "cast(price as decimal(12,2)) as claim_amount",
        "case chr(rf) when 'A' then 'APPROVED' when 'N' then 'OPEN' else 'REJECTED' end as claim_status",
        "case when l_linenumber % 5 <> 0 then cast(last_modified as date) end as incident_date",
        "last_modified", "case when l_orderkey % 10 = 3 then 'CLOUD' end as datasync_flag")


def policy_tgt(spark: SparkSession, sf: str) -> DataFrame:
    """A drifted copy: rows missing, changed, stale, and some that have no source."""
    half = F.floor(F.col("policy_id") / 2)
    src = policy_src(spark, sf)
    clean = [F.expr("trim(policy_holder_name)").alias("policy_holder_name"), F.upper("policy_type").alias("policy_type")]
    copied = src.filter(half % 17 != 0).select(
        "policy_id", "policy_num", *clean,
        F.when(half % 19 == 0, F.col("premium_amount") + 1).otherwise(F.col("premium_amount"))
        .cast("decimal(12,2)").alias("premium_amount"),
        F.when(half % 23 == 0, F.col("last_modified") - F.expr("interval 48 hours"))
        .otherwise(F.col("last_modified")).alias("last_modified"))
    born = src.filter(half % 101 == 0).select(
        (F.col("policy_id") + 1).alias("policy_id"), F.concat("policy_num", F.lit("-X")).alias("policy_num"),
        *clean, "premium_amount", "last_modified")
    left = src.filter(half % 103 == 0).select(
        (-F.col("policy_id")).alias("policy_id"), F.concat("policy_num", F.lit("-Y")).alias("policy_num"),
        *clean, "premium_amount", "last_modified")
    return copied.unionByName(born).unionByName(left)


def policy_converted(spark: SparkSession, sf: str) -> DataFrame:
    """Source rows as the conversion rules would store them."""
    return policy_src(spark, sf).select(
        "policy_id", "policy_num", F.expr("trim(policy_holder_name)").alias("policy_holder_name"),
        F.upper("policy_type").alias("policy_type"), "premium_amount", "last_modified")


# -- the change feed on accounts ----------------------------------------------
def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    late = F.make_dt_interval(hours=(F.col("event_id") % 5 * 72).cast("int"))
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").alias("event_ts"), op.alias("op"),
        F.lit("app").alias("src_schema"), F.lit("account").alias("src_table"),
        F.col("user_id").alias("pk"), F.col("value").cast("decimal(12,2)").alias("payload"), "props",
        F.when(F.col("event_id") % 7 < 3, "CLOUD").alias("datasync_flag"),
        (F.col("ts") - late).alias("last_modified"))


# -- change-file lines ----------------------------------------------------------
_WRITTEN: dict[str, str] = {}


def write_cdc_lines(spark: SparkSession, sf: str) -> None:
    """Write the change lines once, in as many files as there are cores; cdc_lines() then reads them.

    For timing: change files are an input, making them is no query's work.
    """
    path = fresh_path(spark, "cdc-lines")
    cdc_lines(spark, sf).repartition(spark.sparkContext.defaultParallelism, "k").write.parquet(path)
    _WRITTEN[sf] = path


# lines of an order: number, fields, and the orders that have it
_ORDER_LINES = [
    (0, ["'B'", "cast(k as string)", "'1'", "'ts'"], None),
    (1, ["'I'", "'policy'", "'insurance'", "stamp", "pid", "num", "'  ' || name || ' '", "kind", "day", "end_day",
         "case when k % 11 = 0 then 'NULL' else cast(price as string) end", "stamp", "stamp",
         "case when k % 10 = 3 then 'CLOUD' else '' end"], None),
    (200, ["'I'", "'short'", "'insurance'", "'ts'"], "k % 50 = 0"),
    (201, ["'I'", "'agent'", "'insurance'", "'2024-01-01 00:00:00'", "'7'", "'x'"], "k % 40 = 0"),
    (202, ["'I'", "' '", "'insurance'", "'2024-01-01 00:00:00'", "'x'", "'y'"], "k % 60 = 0"),
    (300, ["' u '", "' Policy'", "'INSURANCE '", "stamp", "pid", "num",
           "'\"' || name || ' | \"\"Sons\"\"\"'", "kind", "day", "end_day",
           "cast(price + 100 as string)", "stamp",
           "cast(date_add(at, cast(k % 5 - 2 as int)) as string) || ' 00:00:00'",
           "case when k % 6 = 0 then 'cloud' else '' end"], "k % 3 = 0"),
    (301, ["'U'", "'policy'", "'insurance'", "stamp", "pid", "num", "name"], "k % 45 = 0"),
    (302, ["'U'", "'policy'", "'insurance'", "stamp", "pid", "num || repeat('-', 50)", "name", "kind",
           "'2024-02-30'", "end_day", "'99999999999.99'", "stamp", "stamp", "''", "'surplus'"], "k % 35 = 0"),
    (400, ["'D'", "'policy'", "'insurance'", "stamp", "pid", "num"], "k % 25 = 0"),
    (401, ["'I'", "'claim'", "'insurance'", "stamp", "cast(-2 - 2 * k as string)",
           "'CLM-X' || lpad(cast(k as string), 15, '0')", "cast(1000001 + 2 * k as string)", "num",
           "'stray'", "'1.00'", "'OPEN'", "''", "stamp", "stamp", "''"], "k % 70 = 0"),
    (999, ["'C'", "cast(k as string)", "'1'", "'ts'"], None)]
# lines of a claim; its place in the order is added to the number
_AT = "'2024-01-01 00:00:00'"
_CLAIM_LINES = [
    (100, ["'I'", "'claim'", "'insurance'", _AT, "cast(id as string)", "claim_num", "pid", "num", "' claimant '",
           "cast(price as string)", "name", "coalesce(day, '')", _AT, _AT,
           "case when k % 10 = 3 then 'CLOUD' else '' end"], None),
    (350, ["'D'", "'claim'", "'insurance'", _AT, "cast(id as string)", "claim_num"], "k % 50 = 0")]


def _numbers(lines: list[tuple]) -> str:
    """One row per line, before its text is made."""
    some = [f"case when {when} then {n} end" if when else str(n) for n, _, when in lines]
    return f"explode(array({', '.join(some)})) as line"


def _line_rows(spark: SparkSession, sf: str, rate: float = 1.0) -> DataFrame:
    """What each change line is made of: (k, name, kind, at, price, id, line, line_num); with a rate a sample of them."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    per_order = (orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey as k", "c_name as name", "lower(c_mktsegment) as kind", "cast(o_orderdate as date) as at",
        "cast(o_totalprice as decimal(12,2)) as price", "cast(null as bigint) as id").selectExpr("*", _numbers(_ORDER_LINES))
        .filter("line is not null").withColumn("line_num", F.col("line")))
    per_claim = (claim_src(spark, sf).selectExpr(
        "(policy_id - 1000000) div 2 as k", "claim_status as name", "cast(null as string) as kind",
        "incident_date as at", "claim_amount as price", "claim_id as id").selectExpr("*", _numbers(_CLAIM_LINES))
        .filter("line is not null")
        .withColumn("line_num", F.expr("cast((id - 2000000) div 2 % 8 + line as int)")))
    if rate < 1.0:
        per_order, per_claim = (df.sample(rate, seed=29) for df in (per_order, per_claim))
    return per_order.unionByName(per_claim)


def _with_text(rows: DataFrame, *keep: str) -> DataFrame:
    """The text of each line; what several of its fields need is made once."""
    common = rows.selectExpr(
        *keep, "k", "line_num", "line as _n", "name", "kind", "at", "price", "id",
        "cast(1000000 + 2 * k as string) as pid", "'POL-' || lpad(cast(k as string), 15, '0') as num",
        "cast(at as string) as day", "cast(date_add(at, 365) as string) as end_day",
        "cast(at as string) || ' 00:00:00' as stamp",
        "'CLM-' || lpad(cast((id - 2000000) div 2 as string), 15, '0') as claim_num")
    texts = [f"when {n} then concat_ws('|', {', '.join(parts)})" for n, parts, _ in (*_CLAIM_LINES, *_ORDER_LINES)]
    return common.selectExpr(*keep, "k", "line_num", f"case _n {' '.join(texts)} end as line")


def cdc_lines(spark: SparkSession, sf: str, rate: float = 1.0) -> DataFrame:
    """One transaction per order: (file_name, k, line_num, line).

    A marker, the policy insert, its claims, then now and then a short line, a
    table without map, a line without table, a cloud or legacy update with a
    quoted name, a ragged one, one that breaks every check, deletes of claims
    and policies, a claim without policy; a marker again.  Below a rate of 1 a
    sample of the lines, drawn before their text is made.
    """
    if sf in _WRITTEN:
        lines = spark.read.parquet(_WRITTEN[sf])
        return lines if rate == 1.0 else lines.sample(rate, seed=29)
    return _with_text(_line_rows(spark, sf, rate)).selectExpr(
        "'CDC_TXN_' || cast(k as string) || '.csv' as file_name", "k", "line_num", "line")


def cdc_rows(spark: SparkSession, sf: str, rate: float = 1.0) -> DataFrame:
    """Parsed data rows with one number for the commit order; below a rate of 1 of a sample of the lines."""
    from tidemark.sources.cdc import parse
    lines = cdc_lines(spark, sf, rate).withColumn("seq", F.col("k") * 1000 + F.col("line_num"))
    return parse(lines.drop("k"))


def write_lines(lines: DataFrame, path: str, folder: str, order: list[str]) -> None:
    """Write lines as .csv files, one folder per file, order kept."""
    put_lines(lines.repartition(folder).sortWithinPartitions(folder, *order), path, folder)


def put_lines(lines: DataFrame, path: str, folder: str) -> None:
    """Write lines that are dealt and sorted by their folder."""
    (lines.select(folder, "line")
     .write.option("quote", "").option("sep", "\u0001").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .partitionBy(folder).mode("errorifexists").csv(path))


def write_change_files(spark: SparkSession, sf: str, path: str) -> None:
    """All change lines as files of a few thousand transactions each.

    What the lines are made of is dealt to the files; their text, several times as long, is made there.
    """
    part = F.floor(F.col("k") / ORDERS_PER_FILE)
    if sf in _WRITTEN:
        write_lines(cdc_lines(spark, sf).withColumn("part", part), path, "part", ["k", "line_num"])
        return
    rows = _line_rows(spark, sf).withColumn("part", part).repartition("part")
    put_lines(_with_text(rows.sortWithinPartitions("part", "k", "line_num"), "part"), path, "part")
