from pyspark.sql import functions as F

from tidemark.operators import naming, project
from tidemark.plans import fixtures as fx
from tidemark.sources import metadata


def test_rule_counts(spark):
    rows = metadata.lint(fx.seed_maps(spark), fx.seed_rules(spark)).filter("map_id < 5").orderBy("map_id").collect()
    assert [r.rule_count for r in rows] == [10, 1, 11, 1]


def test_lookup_keeps_maps_without_rules(spark):
    maps = fx.seed_maps(spark)
    rules = fx.seed_rules(spark).filter("map_id <> 2")
    conns = spark.createDataFrame([(2, "target", "h", 5432, "d", "POSTGRESQL")],
                                  "connection_id int, connection_name string, db_host string, db_port int, db_name string, db_type string")
    got = {r.map_id: len(r.rules) for r in metadata.lookup(maps, rules, conns, "insurance", "policy").collect()}
    assert got == {1: 10, 2: 0}
    assert [m.map_id for m in metadata.load_mappings(maps, rules) if m.source == "insurance.policy"] == [1]


def test_stream_and_activity(spark):
    maps = fx.seed_maps(spark).withColumn("is_active", F.col("map_id") != 3)
    assert {m.map_id for m in metadata.load_mappings(maps, fx.seed_rules(spark), "FULL_LOAD")} == {1, 2, 4}
    assert {r.map_id for r in metadata.for_stream(maps, "cdc").collect()} == {1, 2, 3, 4, 9}


def test_waves(spark):
    waves = metadata.by_wave(fx.insurance(spark))
    assert [[m.target for m in w] for w in waves] == [
        ["insurance.policy", "insurance.policy_keyring"], ["insurance.claim", "insurance.claim_keyring"]]


def test_patch(spark):
    rules = spark.createDataFrame([(1, "a", "legacy_a"), (1, "b", "b"), (2, "a", "legacy_a")], "map_id int, src string, dst string")
    edits = spark.createDataFrame([(1, "a", "a")], "map_id int, src string, dst string")
    drops = spark.createDataFrame([(2, "a")], "map_id int, src string")
    got = metadata.patch(rules, ["map_id", "src"], edits, ["dst"], drops).orderBy("src").collect()
    assert [tuple(r) for r in got] == [(1, "a", "a"), (1, "b", "b")]


def mapping(rules, keys=("k",), dst=("k2",)):
    return metadata.Mapping(1, "s", "t", "d", "t2", keys, dst, 1, "BOTH", tuple(rules))


def rule(src, dst, order, method="DIRECT", kind="VARCHAR"):
    return metadata.Rule(src, kind, dst, kind, method, None, order)


def rows(spark, *data):
    return spark.createDataFrame([("I", "t", "s", "ts", list(d)) for d in data],
                                 "op string, src_table string, src_schema string, event_ts string, data array<string>")


def test_position_by_rank_or_by_number(spark):
    m = mapping([rule("k", "k2", 1), rule("b", "b", 3)])
    df = rows(spark, [" 1 ", "two", "three", "extra"], ["1"])
    assert [(r.k, r.b) for r in naming.name_columns(df, [m]).collect()] == [("1", "two"), ("1", None)]
    assert [r.b for r in naming.name_columns(df, [m], position="column_order").collect()] == ["three", None]


def test_composite_keys_and_exclusion(spark):
    m = mapping([rule("k", "k2", 1, "UPPERCASE"), rule("j", "j2", 2), rule("datasync_flag", "datasync_flag", 3),
                 rule("u", "u", 4, "UUID_GENERATE"), rule("x", "x", 5, "SKIP")], ("k", "j"), ("k2", "j2"))
    named = naming.name_columns(rows(spark, ["a", "b", "CLOUD", "u", "x"]), [m])
    assert project.project_target(named, m).columns == ["k2", "j2"]
    assert project.excluded_columns(m) == ["datasync_flag", "u", "x"]
    assert tuple(project.delete_keys(named.withColumn("op", F.lit("D")), m).first()) == ("A", "b")
    only = mapping([rule("u", "u", 1, "UUID_GENERATE")])
    assert project.project_target(named, only) is None


def test_edits_of_one_row(spark):
    rules = spark.createDataFrame([(1, "a", "x", "p"), (2, "b", "y", "q")], "id int, src string, dst string, kind string")
    edits = spark.createDataFrame([(1, "k", None, 1), (1, "m", "r", 2), (1, None, None, 3)],
                                  "id int, dst string, kind string, at int")
    got = {tuple(r) for r in metadata.patch(rules, ["id"], edits, ["dst", "kind"], order="at").collect()}
    assert got == {(1, "a", "m", "r"), (2, "b", "y", "q")}
    gone = spark.createDataFrame([(2,), (2,)], "id int")
    assert [tuple(r) for r in metadata.patch(rules, ["id"], edits, ["dst"], gone).collect()] == [(1, "a", "m", "p")]
