"""What queries and the job leave on disk while they run."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators.apply import Target
from tidemark.operators.fold import FoldSpec, final_state, fold
from tidemark.operators.validate import ColumnSpec, TableSpec
from tidemark.plans import queries
from tidemark.session import folder, fresh_path, kept
from tidemark.sources.metadata import Mapping, Rule
from tidemark.streaming import apply_stream as st

STAMP = "timestamp_ntz'2024-01-02 00:00:00'"
TABLES = {
    "orders": f"select id o_orderkey, id % 7 o_custkey, {STAMP} o_orderdate, 1.5d o_totalprice from range(1, 200)",
    "customer": "select id c_custkey, 'c' c_name, 'M' c_mktsegment from range(7)",
    "lineitem": f"select id l_orderkey, 1 l_linenumber, 2.5d l_extendedprice, 'A' l_returnflag, {STAMP} l_shipdate "
                "from range(1, 200)"}


def given(spark):
    root = fresh_path(spark, "given")
    for name, text in TABLES.items():
        spark.sql(text).write.parquet(f"{root}/{name}.parquet")
    return root


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_shuffle_files_go_with_their_execution(spark):
    before = shuffled(spark)
    rows = spark.range(100_000).groupBy((F.col("id") % 999).alias("k")).agg(F.sum("id").alias("n"))
    assert kept(rows).count() == 999
    for _ in range(50):
        left = shuffled(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    # what is executed again makes its shuffle files again
    assert len(rows.collect()) == len(rows.collect()) == 999


def test_waves_write_what_decides_and_drop_the_lines(spark, monkeypatch):
    root, written, gone = given(spark), [], []
    keep, drop = queries.kept, queries.remove
    monkeypatch.setattr(queries, "kept", lambda df, *path: written.append(df.columns) or keep(df, *path))
    monkeypatch.setattr(queries, "remove", lambda s, path: gone.append((path, len(written))) or drop(s, path))
    got = queries.CATALOGUE["apply_waves"](spark, root)
    rows = {(r.table_name, r.id) for r in got.collect()}
    claims = {i for i in range(1, 200) if i % 50 and i % 10 != 3}  # deleted, or inserted by the cloud
    assert {i for t, i in rows if t == "claim"} == {2000000 + 2 * (i * 8 + 1) for i in claims}
    assert ("policy", 1000000 + 2 * 4) in rows and ("policy", 1000000 + 2 * 50) not in rows
    assert len(gone) == 1 and gone[0][1] == 3 and "rows-" in gone[0][0]  # the lines, when both feeds are written
    assert len(written) > 4
    for columns in written[1:]:
        assert not {"data", "line", "file_name", "event_ts", "src_table"} & set(columns)


def test_values_nobody_reads_are_not_brought_together(spark):
    feed = spark.sql("select id seq, id % 3 pk, 'I' op, '' datasync_flag, 'long' v from range(9)")
    spec = FoldSpec(keys=("pk",), order=("seq",), values=("v",), last_modified=None)
    state = final_state(fold(feed, spec), spec)
    plan = state.select("pk", "last_seq", "is_deleted")._jdf.queryExecution().optimizedPlan().toString()
    assert "long" not in plan
    assert sorted((r.pk, r.v, r.last_seq.seq, r.is_deleted) for r in state.collect()) == [
        (k, "long", 6 + k, False) for k in range(3)]


def table(map_id, name, key, *columns, **more):
    rules = tuple(Rule(c, "VARCHAR", c, t, "DIRECT", None, i) for i, (c, t) in enumerate(((key, "BIGINT"), *columns), 1))
    spec = TableSpec(f"t.{name}", (key,), (ColumnSpec(key, "BIGINT"), *(ColumnSpec(c, t, False) for c, t in columns)), **more)
    return Mapping(map_id, "s", name, "t", name, (key,), (key,), map_id, "CDC", rules), Target(spec)


def lines(spark, name, texts):
    return spark.createDataFrame([(name, i // 2, t) for i, t in enumerate(texts)],
                                 "file_name string, line_pos long, line string")


@pytest.mark.parametrize("few", [st.FEW_DECISIONS, 0])
def test_folds_carry_no_lines_and_go_before_the_records(spark, monkeypatch, few):
    monkeypatch.setattr(st, "FEW_DECISIONS", few)  # the other decisions are met by a broadcast or by a shuffle
    pairs = [table(1, "p", "pid", ("v", "VARCHAR"), unique=("v",)),
             table(2, "c", "cid", ("pid", "BIGINT"), parent=("pid", "t.p", "pid"))]
    applier = st.ChangeApplier(spark, fresh_path(spark, "target"), {m.target: t for m, t in pairs}, lambda: [m for m, _ in pairs])
    fed, onto, there, write, fold_up = [], [], [], applier._write, st.upsert_fold

    def spied_write(name, parts, batch_id, by=None):
        where, fs = folder(spark, applier._work(batch_id))
        there.append(fs.exists(where))
        write(name, parts, batch_id, by)

    def spied_fold(node, *rest):
        fed.append(node.feed.columns)
        onto.append((node.spec.keys[0], node.base is not None, node.spec.retried))
        for rows in (node.feed, node.base):  # both read what is written: lines and tables are not read again
            if rows is not None:
                assert all("/work/" in f for f in rows.inputFiles())
        return fold_up(node, *rest)

    monkeypatch.setattr(applier, "_write", spied_write)
    monkeypatch.setattr(st, "upsert_fold", spied_fold)
    day = "2026-06-01 10:00:00"
    # two lines to a place, and some lines twice at one: each has its own record
    first = [f"I|p|s|{day}|1|a", f"I|p|s|{day}|2|a", f"I|c|s|{day}|1|1", f"I|c|s|{day}|1|1", f"I|c|s|{day}|5|9",
             f"I|c|s|{day}|5|9", f"I|c|s|{day}||1", f"I|p|s|{day}|3|x"]
    applier.run_lines(lines(spark, "f1", first), 1)
    applier.run_lines(lines(spark, "f2", [f"I|p|s|{day}|9|b", f"D|p|s|{day}|1|", f"U|c|s|{day}|7|8"]), 2)
    records = [(r.batch_id, r.line, r.status, r.error_message, len(r.data))
               for r in applier.audit().collect()]
    assert sorted(r for r in records if r[0] == 1) == sorted([
        (1, first[0], "SUCCESS", "", 2), (1, first[1], "FAILED", "UNIQUE:v", 2), (1, first[7], "SUCCESS", "", 2),
        *[(1, first[2], "SUCCESS", "", 2)] * 2, *[(1, first[4], "FAILED", "FOREIGN_KEY:pid", 2)] * 2,
        (1, first[6], "FAILED", "NOT_NULL:cid", 2)])
    assert sorted((line, status, error) for batch, line, status, error, _ in records if batch == 2) == sorted([
        (first[1], "FAILED", "UNIQUE:v"), *[(first[4], "SUCCESS", "")] * 2, (first[6], "FAILED", "NOT_NULL:cid"),
        (f"I|p|s|{day}|9|b", "SUCCESS", ""), (f"D|p|s|{day}|1|", "FAILED", "RESTRICT:pid"),
        (f"U|c|s|{day}|7|8", "FAILED", "FOREIGN_KEY:pid")])
    assert {tuple(r) for r in applier.state(pairs[1][0]).select("cid", "pid").collect()} == {(1, 1), (5, 9)}
    assert {tuple(r) for r in applier.index(pairs[1][0], "pid").read().select("pid", "cid").collect()} == {(1, 1), (9, 5)}
    assert fed and not {"line", "data", "event_id", "src_table", "event_ts"} & {c for columns in fed for c in columns}
    assert there and not any(there)
    # current rows of the keys of a batch, where there are any
    assert onto == [("pid", False, None), ("cid", False, None), ("pid", True, "is_retry"), ("cid", False, None)]


def test_one_decision_for_all_is_no_join(spark):
    same = spark.sql("select id `row:id`, 'INVALID' decision, array('FOREIGN_KEY:a') errors from range(5)")
    assert st.ChangeApplier._said(same) == (("INVALID", ["FOREIGN_KEY:a"]), None)
    assert st.ChangeApplier._said(same.limit(0)) == (("APPLY", []), None)
    mixed = same.unionByName(spark.sql("select 7l `row:id`, 'APPLY' decision, cast(array() as array<string>) errors"))
    usual, odd = st.ChangeApplier._said(mixed)
    assert usual == ("INVALID", ["FOREIGN_KEY:a"]) and [tuple(r) for r in odd.collect()] == [(7, "APPLY", [])]


def test_folders_are_written_without_a_sort(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 2).select("id", (F.col("id") % 3).alias("day"))
    rows.write.partitionBy("day").parquet(str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    assert back.count() == 1000 and len(back.inputFiles()) == 6
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "8"
