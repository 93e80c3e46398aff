import pytest
from pyspark.sql import functions as F

from tidemark.functions import conversions
from tidemark.operators import audit, skew
from tidemark.operators.apply import Target
from tidemark.operators.store import KeyedTable
from tidemark.operators.validate import ColumnSpec, TableSpec
from tidemark.plans import fixtures as fx
from tidemark.session import fresh_path
from tidemark.sources import cdc
from tidemark.sources.metadata import Mapping, Rule
from tidemark.streaming import apply_stream as st

T = "2026-06-0{} 10:00:00"


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def account(op, key, day, payload, modified=None, flag=""):
    return f"{op}|account|app|{T.format(day)}|{key}|{payload}|{{}}|{modified or T.format(day)}|{flag}"


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    landing, checkpoint = tmp_path / "landing", fresh_path(spark, "checkpoint")
    applier = st.ChangeApplier(spark, fresh_path(spark, "target"), fx.targets(),
                               lambda: [m for m in fx.mappings(spark) if m.src_schema == "app"], compact_every=2)
    mapping = applier.mappings()[0]
    rows = lambda: sorted((r.account_id, float(r.payload)) for r in applier.state(mapping).collect())

    write(landing, "1.csv", ["B|1|1|ts", account("I", 1, 1, "1.00"), account("I", 2, 1, "2.00"), "C|1|1|ts"])
    write(landing, "notes.txt", ["not a change file"])
    st.start(spark, str(landing), applier, checkpoint).awaitTermination()
    assert rows() == [(1, 1.0), (2, 2.0)]

    write(landing, "2.csv", [account("U", 1, 2, "5.00"), account("D", 2, 2, "")])
    st.start(spark, str(landing), applier, checkpoint).awaitTermination()
    assert rows() == [(1, 5.0)]
    assert applier.table(mapping).versions() == [2]

    write(landing, "3.csv", [account("U", 1, 3, "7.00", T.format(1), "CLOUD"), account("I", 2, 3, "8.00")])
    st.start(spark, str(landing), applier, checkpoint).awaitTermination()
    assert rows() == [(1, 5.0), (2, 8.0)]
    said = {r.decision: r["count"] for r in applier.audit().groupBy("decision").count().collect()}
    assert said == {"APPLY": 5, "LWW": 1}
    assert applier.audit().filter(F.col("retry_count") > 0).count() == 0


def lines_of(spark, name, texts):
    rows = [(name, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file_name string, line_pos long, line string")


def parsed(spark, name, texts):
    lines = cdc.classify(lines_of(spark, name, texts))
    return st.with_order(cdc.data_rows(lines)), cdc.rejected_rows(lines)


def rule(src, dst, dst_type="VARCHAR", method="DIRECT", order=1):
    return Rule(src, "VARCHAR", dst, dst_type, method, None, order)


def mapping(map_id, table, pk, *more):
    rules = (rule(pk, pk, "BIGINT", "LEGACY_REF"), *(rule(c, c, t, m, i + 2) for i, (c, t, m) in enumerate(more)))
    return Mapping(map_id, "s", table, "t", table, (pk,), (pk,), 1, "CDC", rules)


def spec(table, pk, *columns, parents=()):
    return TableSpec(f"t.{table}", (pk,), (ColumnSpec(pk, "BIGINT"), *(ColumnSpec(c, t, False) for c, t in columns)),
                     parent=parents[0] if parents else None, more_parents=tuple(parents[1:]))


def family(spark, **options):
    """p has children c1 and c2, c1 has a child g; c2 also refers to q."""
    maps = [mapping(1, "p", "pid", ("v", "VARCHAR", "DIRECT")), mapping(2, "c1", "cid", ("pid", "BIGINT", "LEGACY_REF")),
            mapping(3, "c2", "did", ("pid", "BIGINT", "LEGACY_REF"), ("qid", "BIGINT", "LEGACY_REF")),
            mapping(4, "g", "gid", ("cid", "BIGINT", "LEGACY_REF")), mapping(5, "q", "qid", ("v", "VARCHAR", "DIRECT"))]
    specs = [spec("p", "pid", ("v", "VARCHAR")), spec("c1", "cid", ("pid", "BIGINT"), parents=[("pid", "t.p", "pid")]),
             spec("c2", "did", ("pid", "BIGINT"), ("qid", "BIGINT"),
                  parents=[("pid", "t.p", "pid"), ("qid", "t.q", "qid")]),
             spec("g", "gid", ("cid", "BIGINT"), parents=[("cid", "t.c1", "cid")]), spec("q", "qid", ("v", "VARCHAR"))]
    applier = st.ChangeApplier(spark, fresh_path(spark, "target"), {s.name: Target(s) for s in specs}, lambda: maps,
                               **options)
    return applier, {m.dst_table: m for m in maps}


def keys(applier, mapping):
    state = applier.state(mapping)
    return set() if state is None else {r[0] for r in state.select(mapping.dst_pks[0]).collect()}


@pytest.mark.parametrize("task_rows", [skew.TASK_ROWS, 1])
def test_graph_of_targets(spark, task_rows):
    applier, m = family(spark, task_rows=task_rows)
    day = T.format(1)
    applier.run(*order(parsed(spark, "f1", [
        f"I|g|s|{day}|1|1", f"I|c1|s|{day}|1|1", f"I|p|s|{day}|1|x", f"I|p|s|{day}|2|y", f"I|p|s|{day}|3|z",
        f"I|q|s|{day}|7|q", f"I|c2|s|{day}|5|2|7", f"I|c2|s|{day}|6|2|8", f"I|c1|s|{day}|9|99"]), 1))
    assert [keys(applier, m[t]) for t in ("p", "c1", "c2", "g", "q")] == [{1, 2, 3}, {1}, {5}, {1}, {7}]
    failed = {(r.src_table, r.error_message) for r in applier.audit().filter("status = 'FAILED'").collect()}
    assert failed == {("c2", "FOREIGN_KEY:qid"), ("c1", "FOREIGN_KEY:pid")}

    # p1 is held by c1, p2 by c2; p3 goes; the chain keeps c1 because of g
    applier.run(*order(parsed(spark, "f2", [f"D|p|s|{T.format(2)}|{i}|" for i in (1, 2, 3)]
                                      + [f"D|c1|s|{T.format(2)}|1|", f"D|q|s|{T.format(2)}|7|"]), 2))
    assert [keys(applier, m[t]) for t in ("p", "c1", "c2", "q")] == [{1, 2}, {1}, {5}, {7}]
    audit = applier.audit().filter("batch_id = 2 and op = 'D'")
    assert audit.count() == 5 and audit.filter("status = 'SUCCESS'").count() == 1

    # with the whole chain deleted at once everything goes
    applier.run(*order(parsed(spark, "f3", [f"D|{t}|s|{T.format(3)}|{i}|" for t, i in
                                            (("p", 1), ("p", 2), ("c1", 1), ("c2", 5), ("g", 1), ("q", 7))]), 3))
    assert [keys(applier, m[t]) for t in ("p", "c1", "c2", "g", "q")] == [set()] * 5


def order(parts, batch_id):
    return parts[0], batch_id, parts[1]


@pytest.mark.parametrize("task_rows", [skew.TASK_ROWS, 1])
def test_line_order_inside_a_file(spark, task_rows):
    applier, m = family(spark, task_rows=task_rows)
    applier.run(*order(parsed(spark, "f1", [
        f"I|p|s|{T.format(5)}|1|first", f"U|p|s|{T.format(2)}|1|second", "U|p|s||1|third",
        f"I|p|s|{T.format(5)}|2|first", "D|p|s||2|", "I|p|s||3|only"]), 1))
    assert {(r.pid, r.v) for r in applier.state(m["p"]).collect()} == {(1, "third"), (3, "only")}


def test_no_line_is_lost(spark):
    applier, m = family(spark)
    day = T.format(1)
    applier.run(*order(parsed(spark, "f1", [
        "B|1|1|ts", f"I|p|s|{day}|1|x", f"I|other|s|{day}|1", "I|p|s", f'I|p|s|{day}|2|"open', f"I|p||{day}|3|x", "",
        f"I|c1|s|{day}|1|99", "C|1|1|ts"]), 1))
    faults = applier.records("faults")
    assert sorted(r.error_reason for r in faults.filter("line is not null").collect()) == [
        "OPEN_QUOTE_ROW", "SHORT_ROW", st.UNADDRESSED, st.UNMAPPED]
    assert applier.audit().count() == 2
    assert {r.status for r in applier.records("utilization").collect()} == {"SUCCESS"}
    # the record alone is enough to build the change again
    fields = {"pid": "bigint", "cid": "bigint"}
    [again] = audit.reprocess_feed(applier.audit(), fields).collect()
    assert (again.op, again.src_table, again.cid, again.pid) == ("I", "c1", 1, 99)
    current = audit.audit_current(applier.audit().filter("src_table = 'p'"), ["batch_id"]).collect()
    assert [(r.status, r.event_data["v"]) for r in current] == [("SUCCESS", "x")]
    trace = audit.step_trace(applier.records("utilization"), faults)
    assert trace.count() == 1


def test_retries_and_flagged_records(spark):
    applier, m = family(spark)
    applier.run(*order(parsed(spark, "f1", [f"I|c1|s|{T.format(1)}|1|1"]), 1))
    applier.run(*order(parsed(spark, "f2", [f"I|p|s|{T.format(2)}|1|x"]), 2))
    assert keys(applier, m["c1"]) == {1}
    applier.run(*order(parsed(spark, "f3", [f"U|p|s|{T.format(3)}|1|new"]), 3))
    applier.request_reprocess(F.col("file_name") == "f2", 4)
    applier.run(*order(parsed(spark, "f4", [f"I|p|s|{T.format(4)}|2|y"]), 4))
    assert {(r.pid, r.v) for r in applier.state(m["p"]).collect()} >= {(2, "y")}
    forced = applier.audit().filter("batch_id = 4 and file_name = 'f2' and src_table = 'p'").collect()
    assert [r.status for r in forced] == ["SUCCESS"]


def test_a_failing_target_stands_alone(spark):
    applier, m = family(spark)
    broken = mapping(5, "q", "qid", ("v", "VARCHAR", "BREAKS"))
    conversions.register_conversion("BREAKS", lambda value, fmt: F.raise_error(F.lit("no such luck")))
    maps = [x for x in applier.mappings() if x.dst_table != "q"] + [broken]
    applier.mappings = lambda: maps
    applier.run(*order(parsed(spark, "f1", [f"I|p|s|{T.format(1)}|1|x", f"I|q|s|{T.format(1)}|7|q"]), 1))
    assert keys(applier, m["p"]) == {1} and keys(applier, m["q"]) == set()
    said = {r.src_table: r for r in applier.audit().collect()}
    assert said["p"].status == "SUCCESS" and said["q"].status == "FAILED" and "no such luck" in said["q"].error_message
    applier.mappings = family(spark)[0].mappings
    applier.run(*order(parsed(spark, "f2", [f"I|p|s|{T.format(2)}|2|y"]), 2))
    assert keys(applier, m["q"]) == {7}


def test_replay_of_a_compacted_batch(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], bucket_rows=10)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    table.write_batch(frame([(i, "old") for i in range(40)]), 1)
    table.write_batch(frame([(1, "two")]), 2)
    table.compact(2)
    table.write_batch(frame([(2, "corrected")]), 2)
    assert table.versions() == []
    got = {r.k: r.v for r in table.read().collect()}
    assert (got[1], got[2]) == ("old", "corrected")
    table.compact(2)
    assert {r.k: r.v for r in table.read().collect()} == got
    # a look-up of one key reads one bucket
    plan = table.read(keys=frame([(3, "")]).select("k"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("bucket_of_4") and "PartitionFilters: [isnotnull(bucket_of_4" in plan
    table.write_batch(frame([(5, "x")]), 3)
    table.compact(3)
    table.write_batch(frame([(6, "y")]), 4)
    table.compact(4)
    table.purge()
    assert table.versions() == [3, 4] and table.batches() == [4]
    assert {r.k: r.v for r in table.read().collect()} == {**got, 5: "x", 6: "y"}
    assert table.mark(9) is None
    table.write_mark(3, 11)
    table.write_mark(5, 15)
    assert (table.mark(4), table.mark(5)) == (11, 15)
