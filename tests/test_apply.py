"""The scenarios of the reference's manual tests, and table maintenance."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, fold, keyring, validate
from tidemark.operators.store import KeyedTable
from tidemark.plans import fixtures as fx
from tidemark.session import fresh_path
from tidemark.sources import cdc, snapshot
from tidemark.sources.metadata import by_source
from tidemark.streaming import apply_stream as st

MAPPINGS = []
T0 = "2026-06-01 10:00:00"


def policy(op, key, num, premium="2500.00", modified=T0, flag="", ts=T0):
    return f"{op}|policy|insurance|{ts}|{key}|{num}| Regular Test Corp |auto|2026-01-01|2027-01-01|{premium}|{T0}|{modified}|{flag}"


def claim(op, key, num, policy_key, pol, flag="", ts=T0, incident="2026-06-01"):
    return f"{op}|claim|insurance|{ts}|{key}|{num}|{policy_key}|{pol}| Alice |5000.00|OPEN|{incident}|{T0}|{T0}|{flag}"


class World:
    """A landing folder with hand-written files and the tables behind it."""

    def __init__(self, spark):
        self.spark, self.n = spark, 0
        if not MAPPINGS:
            MAPPINGS.extend(fx.insurance(spark))
        self.applier = st.ChangeApplier(spark, fresh_path(spark, "world"), fx.targets(), lambda: MAPPINGS)

    def rows(self, lines):
        df = self.spark.createDataFrame(
            [(f"txn_{self.n}", (0, i), line) for i, line in enumerate(["B|1|1|ts", *lines, "C|1|1|ts"])],
            "file_name string, line_pos struct<block: bigint, mid: bigint>, line string")
        return st.with_order(cdc.parse(df))

    def send(self, *lines):
        self.n += 1
        self.applier.run(self.rows(lines), self.n)

    def table(self, name):
        mapping = next(m for m in MAPPINGS if m.dst_table == name)
        return self.applier.state(mapping)

    def keys(self, name):
        mapping = next(m for m in MAPPINGS if m.dst_table == name)
        return sorted(r[0] for r in self.table(name).select(mapping.dst_pks[0]).collect())


def test_scenarios(spark):
    """Transactions as the manual tests send them, all through the same tables."""
    w = World(spark)
    w.send(
        # a transaction with its child before its parent
        claim("I", 2000100, "CLM-A", 1000100, "POL-1"), policy("I", 1000100, "POL-1"),
        claim("I", 2000102, "CLM-B", 1000100, "POL-1"),
        # cloud rows beside normal ones
        policy("I", 1000200, "POL-CLOUD", flag="CLOUD"),
        claim("I", 2000200, "CLM-CLOUD", 1000200, "POL-CLOUD", flag="cloud "),
        # a row for the update contest, claims whose parent is late or never comes
        policy("I", 1000300, "POL-3", "1.00", "2026-06-15 14:31:00"),
        claim("I", 2000400, "CLM-4", 1000400, "POL-4"), claim("I", 2000402, "CLM-5", 1999998, "POL-X"),
        # parents with a child each
        policy("I", 1000500, "POL-7"), claim("I", 2000500, "CLM-7", 1000500, "POL-7"),
        policy("I", 1000502, "POL-8"), claim("I", 2000502, "CLM-8", 1000502, "POL-8"))
    assert w.keys("policy") == [1000100, 1000300, 1000500, 1000502]
    assert w.keys("claim") == [2000100, 2000102, 2000500, 2000502]
    assert "POL-CLOUD" not in w.keys("policy_keyring") and "CLM-CLOUD" not in w.keys("claim_keyring")
    log = w.applier.audit()
    assert log.filter("status = 'SKIP'").count() == 4
    lost = log.filter("status = 'FAILED'").collect()
    assert {(r.table_name, r.retry_count, r.error_message) for r in lost} == {
        ("insurance.claim", 1, "FOREIGN_KEY:policy_id")} and len(lost) == 2
    ring = {r.legacy_policy_num: (r.policy_uuid, r.created_at) for r in w.table("policy_keyring").collect()}
    first = {r.policy_id: r for r in w.table("policy").collect()}[1000100]
    assert (first.policy_holder_name, first.policy_type) == ("Regular Test Corp", "AUTO")

    later = "2026-06-02 10:00:00"
    second = [
        policy("U", 1000100, "POL-1", "3200.00", "2026-06-01 11:00:00", ts="2026-06-01 11:00:00"),
        f"D|claim|insurance|{later}|2000102|CLM-B",
        policy("U", 1000300, "POL-3", "2.00", "2026-06-15T14:30:22", "CLOUD", later),
        policy("I", 1000400, "POL-4", ts=later),
        f"D|policy|insurance|{later}|1000500|POL-7",
        f"D|policy|insurance|{later}|1000502|POL-8", f"D|claim|insurance|{later}|2000502|CLM-8"]
    w.send(*second)

    def check():
        rows = {r.policy_id: r for r in w.table("policy").collect()}
        assert sorted(rows) == [1000100, 1000300, 1000400, 1000500]
        assert rows[1000100].premium_amount == Decimal("3200.00")
        assert rows[1000100].last_modified == datetime(2026, 6, 1, 11)
        assert rows[1000300].premium_amount == Decimal("1.00")  # the older cloud update lost
        assert w.keys("claim") == [2000100, 2000400, 2000500]  # the late parent healed its claim
        assert "CLM-B" not in w.keys("claim_keyring")
        again = {r.legacy_policy_num: (r.policy_uuid, r.created_at) for r in w.table("policy_keyring").collect()}
        assert again["POL-1"] == ring["POL-1"]
        said = w.applier.audit().filter("batch_id = 2 and table_name = 'insurance.policy' and op = 'D'").collect()
        assert {(r.data[0], r.status) for r in said} == {("1000500", "FAILED"), ("1000502", "SUCCESS")}

    check()
    w.n -= 1
    w.send(*second)  # the batch runs again under its number
    check()

    w.send(policy("U", 1000300, "POL-3", "3.00", "2026-06-15 14:31:00", "CLOUD", "2026-06-15 16:00:00"))
    assert w.table("policy").filter("policy_id = 1000300").first().premium_amount == Decimal("3.00")
    tries = w.applier.audit().filter("table_name = 'insurance.claim' and data[0] = '2000402'").collect()
    assert sorted((r.retry_count, r.status) for r in tries) == [
        (1, "FAILED"), (2, "FAILED"), (3, "PERMANENT_FAILED")]


def test_store_newest_row_and_compaction(spark):
    table = KeyedTable(spark, fresh_path(spark, "t"), ["k"])
    assert table.read() is None
    frame = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    table.write_batch(frame((1, "a"), (2, "b")), 0)
    table.write_batch(frame((2, "c")), 1)
    table.write_batch(frame((2, "d"), (3, "e")), 1)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(table.read()) == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(table.read(upto=0)) == [(1, "a"), (2, "b")]
    table.compact(1)
    assert table.versions() == [1] and rows(table.read()) == [(1, "a"), (2, "d"), (3, "e")]
    table.write_batch(frame((1, "z")), 2)
    assert rows(table.read()) == [(1, "z"), (2, "d"), (3, "e")]
    assert rows(table.read(keys=frame((1, "")))) == [(1, "z")]
    assert rows(table.read(upto=0)) == [(1, "a"), (2, "b")]


def test_keyring_load_is_repeatable_and_gated(spark):
    base = spark.createDataFrame([(2, "B"), (1, "A"), (3, "A"), (4, None)], "id bigint, num string")
    one = keyring.keyring_load(base, "num", None, "legacy", "token", "id", 4000001)
    assert sorted((r.keyring_id, r.legacy) for r in one.collect()) == [(4000001, "A"), (4000003, "B")]
    assert keyring.keyring_load(base, "num", one, "legacy", "token", "id", 4000001).count() == 0
    more = base.unionByName(spark.createDataFrame([(9, "C")], "id bigint, num string"))
    new = keyring.keyring_load(more, "num", one, "legacy", "token", "id", 4000001, random=True)
    assert [(r.keyring_id, r.legacy, len(r.token)) for r in new.collect()] == [(4000005, "C", 36)]
    with pytest.raises(snapshot.EmptyTableError):
        snapshot.require_rows({"full": base, "empty": base.filter("id < 0")})


def test_validation_codes(spark):
    named = spark.createDataFrame(
        [("I", "1", "P" * 51, "n", "t", "2024-02-30", "2024-01-01", "99999999999.99", T0, "no time"),
         ("D", "x", None, None, None, None, None, None, None, None)],
        "op string, policy_id string, policy_num string, policy_holder_name string, policy_type string, "
        "effective_date string, expiry_date string, premium_amount string, created_at string, last_modified string")
    main = by_source(fx.insurance(spark))["insurance.policy"][0]
    got = validate.target_rows(named, main, fx.POLICY, ["op"]).collect()
    assert got[0].errors == ["LENGTH:policy_num", "TYPE:effective_date", "RANGE:premium_amount", "TYPE:last_modified"]
    assert got[1].errors == ["TYPE:policy_id"]


def test_attempts_are_counted_once(spark):
    df = spark.createDataFrame([(i, "INVALID", i) for i in range(4)], "seq int, decision string, retry_count int")
    out = audit.with_status(df)
    assert [(r.status, r.retry_count) for r in out.orderBy("seq").collect()] == [
        ("FAILED", 1), ("FAILED", 2), ("PERMANENT_FAILED", 3), ("PERMANENT_FAILED", 4)]
    plan = audit.retry_plan(audit.dead_letters(out))
    assert audit.plan_totals(plan).first().asDict() == {"requeued": 2, "discarded": 0}
    at = F.lit(T0).cast("timestamp_ntz")
    gone = audit.discarded_faults(audit.retry_plan(out.withColumn("event_id", F.lit("e"))), "job", at)
    assert {r.status for r in gone.collect()} == {"PERMANENT_FAILED"}
    assert fold.APPLY == "APPLY"
