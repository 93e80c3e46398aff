import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import keyring, ordering, reconcile, skew, validate


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(1)
    many = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", i) for i in range(900)] + [(None, -1)]
    one = [("hot", 1), ("k1", 2), ("k2", 3), ("k2", 4), ("zz", 5)]
    return (spark.createDataFrame(many, "k string, v int"), spark.createDataFrame(one, "k string, w int"))


def test_profile_parts_the_rows(sides):
    many, _ = sides
    profile = skew.profile_keys(many, ["k"], task_rows=100)
    assert profile.hot.count() == 1 and profile.pieces() >= 3
    assert {r.k for r in profile.heavy(many).collect()} == {"hot"}
    assert profile.heavy(many).count() + profile.light(many).count() == many.count()


def test_profile_is_empty_when_even(sides):
    many, _ = sides
    assert skew.profile_keys(many, ["v"], task_rows=5).hot is None
    assert skew.profile_keys(many.limit(0), ["k"]).hot is None


def test_profile_finds_heavy_keys_in_a_thin_sample(spark):
    rows = spark.range(400_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    profile = skew.profile_keys(rows, ["k"], task_rows=50_000)
    assert profile.hot.count() == 1 and 0.8 < profile.hot_rows / 133_334 < 1.2


def test_assign_keys_has_no_gap(spark):
    df = spark.range(0, 5000).select((F.col("id") * 37 % 5000).alias("n"))
    out = keyring.assign_keys(df, "n", "key", 1000001)
    got = out.orderBy("n").collect()
    assert [r.key for r in got] == [1000001 + 2 * i for i in range(5000)]
    tied = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c")], "n int, t string")
    assert [r.key for r in keyring.assign_keys(tied, "n", "key", 1, tie=["t"]).orderBy("t").collect()] == [1, 3, 5]


def test_file_order_in_pieces(spark):
    rng = random.Random(4)
    rows = [(f"f{i % 3}", i, rng.choice([1, 3, 999])) for i in range(600)] + [("sorted", i, 1 + i // 5) for i in range(20)]
    df = spark.createDataFrame(rows, "file_name string, line_num int, dep_rank int")
    for piece in (7, 100_000):
        got = {(r.file_name, r.line_num): r.position for r in ordering.fk_order(df, piece).collect()}
        want = {}
        for f in {r[0] for r in rows}:
            for i, r in enumerate(sorted((r for r in rows if r[0] == f), key=lambda r: (r[2], r[1])), start=1):
                want[(f, r[1])] = i
        assert got == want
        flags = {r.file_name: r.reordered for r in ordering.reordered_files(df, piece).collect()}
        assert flags == {"f0": True, "f1": True, "f2": True, "sorted": False}


def test_checks_between_tables(spark):
    child = spark.createDataFrame([(1, 10), (2, 10), (3, 99), (4, None)], "id int, p int")
    parent = spark.createDataFrame([(10,), (11,)], "pid int")
    assert [r.id for r in validate.fk_violations(child, "p", parent, "pid").collect()] == [3]
    assert [r.pid for r in validate.fk_restrict(parent, "pid", child, "p").collect()] == [10]
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id int, num string")
    target = spark.createDataFrame([(9, "b"), (3, "b")], "id int, num string")
    assert sorted(r.id for r in validate.unique_violations(rows, ["id"], "num").collect()) == [1, 2]
    assert sorted(r.id for r in validate.unique_violations(rows, ["id"], "num", target).collect()) == [1, 2, 3]


def test_compare_and_alert(spark, tmp_path):
    src = spark.createDataFrame([(2, "a"), (4, "b"), (6, None)], "id bigint, v string")
    tgt = spark.createDataFrame([(2, "a"), (4, "x"), (8, "o"), (9, "c")], "id bigint, v string")
    got = {r.id: r.verdict for r in reconcile.compare(src, tgt, "id", ["v"]).collect()}
    assert got == {2: "MATCH", 4: "MISMATCH", 6: "MISSING", 8: "ORPHAN", 9: "CLOUD_ROW"}
    found = reconcile.discrepancies(reconcile.compare(spark.range(0, 60, 2).withColumn("v", F.lit("a")), tgt, "id", ["v"]))
    table = reconcile.DriftTable(spark, str(tmp_path / "drift"))
    for run in ("r1", "r2", "r2"):  # a run that is written again replaces itself
        stored = table.append(reconcile.history_rows(found, "t", "id", run), run)
        alert = {r.verdict: r.row_count for r in reconcile.alert_rows(stored).collect()}
        assert alert["MISSING"] == 27 == stored.filter("verdict = 'MISSING'").count()
    assert table.read().count() == 2 * stored.count()


def test_hot_keys_outlive_cache_and_sample(spark, tmp_path):
    """Lost blocks and rows that come anew in another way change nothing about the two halves."""
    path = str(tmp_path / "rows")
    rows = lambda hot: spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id")).alias("k"))
    rows(-1).write.parquet(path)
    profile = skew.profile_keys(spark.read.parquet(path), ["k"], task_rows=10_000)
    rows(-2).write.mode("overwrite").parquet(path)
    spark.catalog.clearCache()
    many = rows(-1)
    assert {r.k for r in profile.heavy(many).distinct().collect()} == {-1}
    assert profile.heavy(many).count() == 20_000 and profile.light(many).count() == 40_000
    plan = profile.heavy(many)._jdf.queryExecution().toString()
    assert "Sample" not in plan and "InMemoryRelation" not in plan


def test_comparison_by_digests(spark):
    rng = random.Random(2)
    left = [(i, f"v{i % 13}" if i % 7 else None, i * 1.5, None if i % 5 else "x") for i in range(0, 900, 2)]
    right = [r for r in left if r[0] % 26] + [(11, "born", 1.0, None), (-4, "left", 1.0, None)]
    right = [(k, v, n + (k % 50 == 2), "x" if v is None and k % 3 == 0 else w) for k, v, n, w in right]
    rng.shuffle(right)
    schema = "k long, v string, n double, w string"
    source, target = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    want = reconcile.compare(source, target, "k", ["v", "n", "w"]).filter("verdict <> 'MATCH'")
    rows = lambda df: {(r.k, r.verdict, r.diff_v, r.diff_n, r.diff_w) for r in df.collect()}
    for parts in (1, 7, 65_536):
        assert rows(reconcile.compare_by_digest(source, target, "k", ["v", "n", "w"], parts)) == rows(want)
    # a null that moves from one column to the next is a difference
    moved = [spark.createDataFrame([(2, *r)], "k long, v string, w string") for r in ((None, "a"), ("a", None))]
    assert reconcile.compare_by_digest(*moved, "k", ["v", "w"]).count() == 1
    # other types, same values
    wide = target.select("k", "v", "n", "w").withColumn("k", F.col("k").cast("decimal(20,0)").cast("long"))
    same = reconcile.compare_by_digest(target.withColumn("n", F.col("n").cast("decimal(12,2)")),
                                       wide.withColumn("n", F.col("n").cast("decimal(14,4)")), "k", ["v", "n", "w"])
    assert same.count() == 0
    # equal tables: nothing differs, and no row of them is read for the comparison
    assert reconcile.differing_parts(source, source, "k", ["v", "n", "w"]).isEmpty()
    plan = reconcile.compare_by_digest(source, source, "k", ["v", "n", "w"])._jdf.queryExecution().optimizedPlan()
    assert "Join" not in plan.toString() or "LocalLimit 0" in plan.toString() or plan.toString().startswith("LocalRelation")


def test_profile_of_a_sample_drawn_before(spark):
    """Rows made of a sample of their source show the same hot keys as a sample of the rows."""
    source = spark.range(400_000)
    made = lambda df: df.select(F.when(F.col("id") % 4 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    profile = skew.profile_keys(made(source.sample(skew.sample_rate(50_000), seed=1)), ["k"], 50_000, drawn=True)
    assert profile.hot.count() == 1 and 0.8 < profile.hot_rows / 100_000 < 1.2


def test_pieces_of_a_few_rows_stay_as_few_as_a_shuffle_has_partitions(spark):
    rows = spark.range(2000).select((F.col("id") % 10).alias("k"))
    profile = skew.profile_keys(rows, ["k"], task_rows=5)
    assert profile.hot_rows == 2000 and profile.pieces() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    # pieces of full size are as many as the rows ask for
    assert skew.KeyProfile(("k",), skew.TASK_ROWS, profile.hot, 900 * skew.TASK_ROWS).pieces() == 900
