"""Constraints the job enforces on write, and what happens when a write fails."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_stream import T, family, keys, mapping, order, parsed, spec

from tidemark.operators import fold, skew, unique
from tidemark.operators.apply import Target
from tidemark.operators.store import KeyedTable
from tidemark.operators.validate import TableSpec
from tidemark.session import fresh_path
from tidemark.streaming import apply_stream as st


def policies(spark, **options):
    """n has a unique number and no children, u a unique number and a child k."""
    maps = [mapping(1, "n", "nid", ("num", "VARCHAR", "DIRECT")), mapping(2, "u", "uid", ("num", "VARCHAR", "DIRECT")),
            mapping(3, "k", "kid", ("uid", "BIGINT", "LEGACY_REF"))]
    tables = [spec("n", "nid", ("num", "VARCHAR")), spec("u", "uid", ("num", "VARCHAR")),
              spec("k", "kid", ("uid", "BIGINT"), parents=[("uid", "t.u", "uid")])]
    tables[:2] = [TableSpec(s.name, s.keys, s.columns, ("num",)) for s in tables[:2]]
    applier = st.ChangeApplier(spark, fresh_path(spark, "target"), {s.name: Target(s) for s in tables}, lambda: maps,
                               **options)
    return applier, {m.dst_table: m for m in maps}


def held(applier, mapping):
    return {r[0]: r[1] for r in applier.state(mapping).select(mapping.dst_pks[0], "num").collect()}


def said(applier, batch_id):
    return {(r.file_name, r.line.split("|")[4], r.op): (r.status, r.error_message)
            for r in applier.audit().filter(F.col("batch_id") == batch_id).collect()}


def test_unique_numbers(spark):
    applier, m = policies(spark, compact_every=2)
    day = T.format(1)
    applier.run(*order(parsed(spark, "f1", [
        f"I|n|s|{day}|1|A", f"I|n|s|{day}|2|A", f"I|n|s|{day}|3|B", f"D|n|s|{day}|3|", f"I|n|s|{day}|4|B",
        f"I|n|s|{day}|5|", f"I|n|s|{day}|6|", f"I|u|s|{day}|1|A", f"D|u|s|{day}|1|", f"I|u|s|{day}|2|A"]), 1))
    # no number is not a number; a deleted holder's is free at once, but not where children may hold the row
    assert held(applier, m["n"]) == {1: "A", 4: "B", 5: None, 6: None} and keys(applier, m["u"]) == set()
    assert said(applier, 1)["f1", "2", "I"] == ("FAILED", "UNIQUE:num")
    applier.run(*order(parsed(spark, "f2", [f"I|n|s|{T.format(2)}|7|B", f"D|n|s|{T.format(2)}|1|",
                                            f"U|n|s|{T.format(2)}|4|C", f"I|n|s|{T.format(2)}|8|B"]), 2))
    # the holder from before counts; a renamed one's number is free for later events; the retry is older than the delete
    assert held(applier, m["n"]) == {4: "C", 5: None, 6: None, 8: "B"} and held(applier, m["u"]) == {2: "A"}
    assert said(applier, 2)["f2", "7", "I"] == ("FAILED", "UNIQUE:num")
    applier.run(*order(parsed(spark, "f3", [f"I|n|s|{T.format(3)}|9|C"]), 3))
    assert held(applier, m["n"]) == {2: "A", 4: "C", 5: None, 6: None, 8: "B"}  # healed
    plan = (applier.index(m["n"], "num").read(keys=spark.createDataFrame([("C",)], "num string"))
            ._jdf.queryExecution().executedPlan().toString())
    assert "bucket_of_" in plan


def sequential(events):
    """One event after the other; a number that another key holds is refused."""
    rows, refused = {}, set()
    for seq, op, key, number in events:
        if op == "D":
            rows.pop(key, None)
        elif number is not None and any(n == number for k, n in rows.items() if k != key):
            refused.add(seq)
        else:
            rows[key] = number
    return rows, refused


@pytest.mark.parametrize("task_rows", [skew.TASK_ROWS, 3])
def test_unique_against_one_by_one(spark, task_rows):
    """Groups of keys and numbers that never meet; where keys only gain or end, results are the same."""
    r, events, plain = random.Random(11), [], {}
    for group in range(40):
        plain[group] = group % 2 == 0
        ended = set()
        for _ in range(r.randint(2, 8)):
            key, op = 10 * group + r.randrange(3), r.choice("IIUUD")
            number = r.choice([f"{group}a", f"{group}b", None])
            if plain[group]:  # one number a key, nothing after its delete
                if key in ended:
                    continue
                number = f"{group}{'ab'[key % 2]}"
                ended |= {key} if op == "D" else set()
            events.append((op, key, number if op != "D" else None))
    events += [("I", 1000 + i, "hot") for i in range(40)]  # one number that very many keys ask for
    rows = [(i, op, key, number, None, [], True) for i, (op, key, number) in enumerate(events)]
    feed = spark.createDataFrame(rows, "seq long, op string, k long, num string, datasync_flag string, "
                                       "errors array<string>, _valid boolean")
    roles = fold.FoldSpec(("k",), ("seq",), ("num",), last_modified=None, valid="_valid")

    def keep(df):
        path = fresh_path(spark, "kept")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    first = keep(fold.fold(feed, roles, task_rows=task_rows))
    judged, folded = unique.enforce(feed, first, roles, None, ("num",), None, keep, task_rows=task_rows)
    got = {r.k: r.num for r in fold.live(fold.final_state(folded, roles)).collect()}
    numbers = [n for n in got.values() if n is not None]
    assert len(numbers) == len(set(numbers)) and got[1000] == "hot"
    refused = {r.seq for r in judged.filter("size(errors) > 0").collect()}
    want, want_refused = sequential([(i, *e) for i, e in enumerate(events)])
    mine = lambda k: k >= 1000 or plain[k // 10]
    assert {k: v for k, v in got.items() if mine(k)} == {k: v for k, v in want.items() if mine(k)}
    assert {s for s in refused if mine(events[s][1])} == {s for s in want_refused if mine(events[s][1])}


def broken_writes(monkeypatch, table, times=1):
    """The next writes of a table fail after they have written something."""
    write, left = KeyedTable.write_batch, [times]

    def failing(self, rows, batch_id):
        out = write(self, rows, batch_id)
        if self.path.endswith(f"/tables/{table}") and left[0]:
            left[0] -= 1
            raise OSError("disk full")
        return out

    monkeypatch.setattr(KeyedTable, "write_batch", failing)


def test_no_child_without_its_parent(spark, monkeypatch):
    applier, m = family(spark)
    day = T.format(1)
    broken_writes(monkeypatch, "t.p")
    applier.run(*order(parsed(spark, "f1", [f"I|p|s|{day}|1|x", f"I|c1|s|{day}|1|1", f"I|g|s|{day}|1|1",
                                            f"I|q|s|{day}|7|q"]), 1))
    assert [keys(applier, m[t]) for t in ("p", "c1", "g", "q")] == [set(), set(), set(), {7}]
    got = {r.src_table: (r.status, r.error_message) for r in applier.audit().collect()}
    assert got["q"] == ("SUCCESS", "") and got["c1"] == ("FAILED", "FOREIGN_KEY:pid")
    assert got["p"][0] == "FAILED" and "disk full" in got["p"][1] and got["g"] == ("FAILED", "FOREIGN_KEY:cid")
    applier.run(*order(parsed(spark, "f2", [f"I|q|s|{T.format(2)}|8|q"]), 2))
    assert [keys(applier, m[t]) for t in ("p", "c1", "g", "q")] == [{1}, {1}, {1}, {7, 8}]

    # the child's delete is not written: the parent's must not be either, though it was written first
    broken_writes(monkeypatch, "t.g")
    applier.run(*order(parsed(spark, "f3", [f"D|{t}|s|{T.format(3)}|1|" for t in ("p", "c1", "g")]), 3))
    assert [keys(applier, m[t]) for t in ("p", "c1", "g")] == [{1}, {1}, {1}]
    applier.run(*order(parsed(spark, "f4", [f"I|q|s|{T.format(4)}|9|q"]), 4))
    assert [keys(applier, m[t]) for t in ("p", "c1", "g")] == [set(), set(), set()]


def test_no_child_of_a_parent_that_cannot_be_decided(spark, monkeypatch):
    """The parent fails after its children were decided, in the pass for deletes."""
    applier, m = family(spark)
    decide = st.delete_fold
    monkeypatch.setattr(st, "delete_fold", lambda node, *rest: 1 / 0 if node.spec.keys == ("cid",) else decide(node, *rest))
    day = T.format(1)
    applier.run(*order(parsed(spark, "f1", [f"I|p|s|{day}|1|x", f"I|c1|s|{day}|1|1", f"I|g|s|{day}|1|1"]), 1))
    assert [keys(applier, m[t]) for t in ("p", "c1", "g")] == [{1}, set(), set()]
    got = {r.src_table: (r.status, r.error_message) for r in applier.audit().collect()}
    assert got["g"] == ("FAILED", "FOREIGN_KEY:cid") and "ZeroDivisionError" in got["c1"][1] and got["p"][0] == "SUCCESS"


def test_compaction_is_not_the_rows_fault(spark, monkeypatch):
    applier, m = family(spark, compact_every=1)
    monkeypatch.setattr(KeyedTable, "compact", lambda self, upto: 1 / 0)
    applier.run(*order(parsed(spark, "f1", [f"I|q|s|{T.format(1)}|7|q"]), 1))
    assert keys(applier, m["q"]) == {7} and [r.status for r in applier.audit().collect()] == ["SUCCESS"]
    assert "ZeroDivisionError" in applier.records("job_faults").first().error_reason


def test_restrict_reads_the_index(spark):
    """A delete of one parent reads one bucket of the children's index, not the child table."""
    applier, m = family(spark, compact_every=1)
    lines = [f"I|p|s|{T.format(1)}|{i}|x" for i in range(60)] + [f"I|c1|s|{T.format(1)}|{i}|{i % 50}" for i in range(90)]
    table = KeyedTable.__init__.__defaults__
    applier.run(*order(parsed(spark, "f1", lines), 1))
    index = applier.index(m["c1"], "pid")
    index.bucket_rows = 9
    index.write_batch(index.read(), 2)
    index.compact(2)
    found = applier._finder(m["c1"], 3)("pid", spark.createDataFrame([(7,)], "pid long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.cid for r in found.collect()) == [7, 57]
    assert "bucket_of_10" in plan and "/tables/" not in plan and "PartitionFilters: [isnotnull(bucket_of_10" in plan
    assert len([f for f in found.inputFiles() if "/index/t.c1/pid/" in f]) == len(found.inputFiles())
    assert table  # the default layout is one bucket a half million rows
    applier.drop_indexes()
    rebuilt = applier._finder(m["c1"], 3)("pid", spark.createDataFrame([(7,)], "pid long"))
    assert sorted(r.cid for r in rebuilt.collect()) == [7, 57]


def test_lines_stay_as_they_were_read(spark):
    applier, m = family(spark)
    lines = [f'i|Nope|s|{T.format(1)}|1|"a|b"|x ', f'I||s|{T.format(1)}|"q""|"| y', f' i |P |s|{T.format(1)}|1|"x|y"']
    from tidemark.sources import cdc
    from test_stream import lines_of

    classified = cdc.classify(lines_of(spark, "f1", lines))
    applier.run(st.with_order(cdc.data_rows(classified, raw=True)), 1, cdc.rejected_rows(classified))
    faults = {r.error_reason: r.line for r in applier.records("faults").collect()}
    assert faults == {st.UNMAPPED: lines[0], st.UNADDRESSED: lines[1]}
    assert [r.line for r in applier.audit().collect()] == [lines[2]]


def test_mappings_of_a_batch(spark):
    """A table that joins by metadata alone, and a batch that runs again with the mappings it had."""
    applier, m = family(spark)
    every = applier.mappings()
    applier.mappings = lambda: [x for x in every if x.dst_table != "q"]
    lines = [f"I|p|s|{T.format(1)}|1|x", f"I|q|s|{T.format(1)}|7|q"]
    applier.run(*order(parsed(spark, "f1", lines), 1))
    assert keys(applier, m["q"]) == set()
    applier.mappings = lambda: every
    applier.run(*order(parsed(spark, "f2", [f"I|q|s|{T.format(2)}|8|q"]), 2))
    assert keys(applier, m["q"]) == {8}
    applier.run(*order(parsed(spark, "f1", lines), 1))
    assert keys(applier, m["q"]) == {8} and applier.mappings_of(2) == every and len(applier.mappings_of(1)) == 4
    assert applier.audit().filter("batch_id = 1").count() == 1


def test_records_expire_by_day(spark, tmp_path):
    applier, m = family(spark, at=F.lit("2026-01-01 10:00:00").cast("timestamp_ntz"))
    applier.run(*order(parsed(spark, "f1", [f"I|p|s|{T.format(1)}|1|x", f"I|c1|s|{T.format(1)}|1|99"]), 1))
    ends = sorted(str(r.expires_on) for r in applier.audit().select("expires_on").distinct().collect())
    assert len(ends) == 2  # what failed is kept longer
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "old.csv").write_text("x")
    first, last = (datetime.fromisoformat(f"{day} 23:00:00") for day in ends)
    assert applier.purge(first, str(landing)) == {"records": 0, "files": 0}
    assert applier.purge(last) == {"records": 1, "files": 0}
    assert {r.status for r in applier.audit().collect()} == {"FAILED"}
    assert applier.purge(datetime(2099, 1, 1), str(landing))["files"] == 1 and not (landing / "old.csv").exists()


def test_retries_by_the_clock(spark, tmp_path):
    """A failure heals without a new file: the clock opens the batch."""
    applier, m = family(spark)
    good = applier.mappings()
    applier.mappings = lambda: [mapping(1, "p", "pid", ("v", "VARCHAR", "NO_SUCH_METHOD_YET")), *good[1:]]
    from tidemark.functions import conversions

    conversions.register_conversion("NO_SUCH_METHOD_YET", lambda value, fmt: F.raise_error(F.lit("not now")))
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "1.csv").write_text(f"I|p|s|{T.format(1)}|1|x\n")
    run = st.start(spark, str(landing), applier, fresh_path(spark, "checkpoint"), retry_every="1 second")
    try:
        for _ in range(120):
            run.awaitTermination(1)
            assert run.exception() is None
            try:
                if applier.audit().filter("status = 'FAILED'").count():
                    applier.mappings = lambda: good
                if keys(applier, m["p"]) == {1}:
                    break
            except Exception as error:  # records are being written
                assert "PATH_NOT_FOUND" in str(error) or "not exist" in str(error) or "INFER" in str(error), error
        assert keys(applier, m["p"]) == {1}
    finally:
        run.stop()
