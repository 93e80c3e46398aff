"""What is made once and read often, and what is drawn before it is made."""

from pyspark.sql import functions as F

from tidemark.operators import apply as ap
from tidemark.operators import keyring, naming, ordering, unique
from tidemark.plans import fixtures as fx
from tidemark.plans import queries
from tidemark.session import fresh_path, kept
from tidemark.sources import cdc
from tidemark.sources.metadata import by_source

T0 = "2026-06-01 10:00:00"


def policy(op, key, num, flag=""):
    return f"{op}|policy|insurance|{T0}|{key}|{num}| A |auto|2026-01-01|2027-01-01|10.00|{T0}|{T0}|{flag}"


def claim(op, key, policy_key):
    return f"{op}|claim|insurance|{T0}|{key}|CLM-{key}|{policy_key}|P| B |5.00|OPEN|2026-06-01|{T0}|{T0}|"


LINES = [policy("I", 2, "P2"), policy("I", 4, "P4"), claim("I", 20, 2), claim("I", 40, 4), claim("I", 60, 6),
         policy("D", 2, "P2"), policy("D", 4, "P4"), claim("D", 40, 4), policy("U", 8, "P8", "CLOUD")]


def parsed(spark):
    rows = [(f"f{i % 2}", i, i, line) for i, line in enumerate(LINES)]
    return cdc.parse(spark.createDataFrame(rows, "file_name string, line_num int, seq long, line string"))


def counted():
    calls = []

    def keep(df):
        calls.append(df.columns)
        return kept(df)

    return calls, keep


def test_isolated_targets_read_lines_that_were_parsed_once(spark):
    rows, maps, calls_keep = parsed(spark), fx.insurance(spark), counted()
    said = lambda done: {n: sorted((r.seq, r.decision) for r in a.events.collect()) for n, a in done.items()}
    plain = said(ap.apply_isolated(rows, maps, fx.targets()))
    done = ap.apply_isolated(rows, maps, fx.targets(), sample=rows, keep=calls_keep[1])
    assert said(done) == plain and len(plain) == 4
    assert len(calls_keep[0]) == 2  # the rows and their sample, not once per target
    for applied in done.values():
        plan = applied.folded._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" in plan and "split(" not in plan


def test_pair_keeps_feeds_and_folds(spark):
    groups, t = by_source(fx.insurance(spark)), fx.targets()
    sides = []
    for name, source in (("policy", "insurance.policy"), ("claim", "insurance.claim")):
        m = groups[source][0]
        feed = ap.target_feed(naming.name_columns(parsed(spark), groups[source]), m, t[m.target])
        sides.append((feed, ap.fold_spec(m, t[m.target]), None))
    rows = lambda dfs: [sorted(map(str, df.collect())) for df in dfs]
    plain = rows(ap.apply_pair(*sides, fx.CLAIM.parent))
    calls, keep = counted()
    done = ap.apply_pair(*sides, fx.CLAIM.parent, keep)
    assert rows(done) == plain
    assert len(calls) >= 4 and "split(" not in done[1]._jdf.queryExecution().optimizedPlan().toString()


def given(spark):
    """Orders, lines and customers of a few rows, as files."""
    root = fresh_path(spark, "given")
    n = spark.range(1, 141)
    n.select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"),
             F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("o_orderdate"),
             (F.col("id") * 1.5).alias("o_totalprice")).write.parquet(f"{root}/orders.parquet")
    spark.range(8).select(F.col("id").alias("c_custkey"), F.concat(F.lit("C"), F.col("id").cast("string")).alias("c_name"),
                          F.lit("AUTO").alias("c_mktsegment")).write.parquet(f"{root}/customer.parquet")
    n.select(F.col("id").alias("l_orderkey"), (F.col("id") % 7 + 1).alias("l_linenumber"),
             (F.col("id") * 2.5).alias("l_extendedprice"), F.lit("A").alias("l_returnflag"),
             F.lit("2024-04-01 00:00:00").cast("timestamp_ntz").alias("l_shipdate")).write.parquet(f"{root}/lineitem.parquet")
    return root


def test_lines_are_drawn_before_their_text_is_made(spark):
    root = given(spark)
    plan = fx.cdc_lines(spark, root, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("concat_ws") < plan.index("Sample")  # the plan prints what comes last first
    assert 0 < fx.cdc_lines(spark, root, 0.5).count() < fx.cdc_lines(spark, root).count()


def test_change_files_hold_the_lines_in_order(spark):
    root, path = given(spark), fresh_path(spark, "landing")
    fx.write_change_files(spark, root, path)
    got = [r.value for r in spark.read.text(f"{path}/part=0").coalesce(1).collect()]
    assert len(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
               .load(path).collect()) == 1
    assert got == [r.line for r in fx.cdc_lines(spark, root).orderBy("k", "line_num").collect()]


def test_line_numbers_meet_starts_of_known_size(spark, tmp_path):
    for name, n in (("a", 5), ("b", 3)):
        (tmp_path / f"{name}.csv").write_text("".join(f"I|t|s|x|{i}\n" for i in range(n)))
    lines = cdc.read_lines(spark, str(tmp_path), numbered=True)
    assert sorted((r.file_name[-5], r.line_num) for r in lines.collect()) == [
        *[("a", i) for i in range(1, 6)], *[("b", i) for i in range(1, 4)]]
    assert "parquet" in lines._jdf.queryExecution().optimizedPlan().toString()


def test_key_fields_come_from_the_data(spark):
    maps = spark.createDataFrame([("s", "t", "b, none ,a", ["a", "b", "c"]), ("s", "u", "k", ["k"])],
                                 "src_schema string, src_table string, src_pks string, fields array<string>")
    rows = spark.createDataFrame([(1, "s", "t", [" x ", "y", "z"]), (2, "s", "t", ["x"]), (3, "s", "u", []),
                                  (4, "s", "strange", ["1"])],
                                 "seq int, src_schema string, src_table string, data array<string>")
    plain = naming.key_map(naming.named_map(rows, maps))
    lean = naming.key_map(naming.named_map(rows, maps, keep_data=True))
    said = {r.seq: r.pk_values for r in lean.collect()}
    assert said == {r.seq: r.pk_values for r in plain.collect()}
    assert said == {1: {"b": "y", "none": None, "a": "x"}, 2: {"b": None, "none": None, "a": "x"}, 3: {"k": None}}
    assert [r.event_data for r in lean.orderBy("seq").collect()] == [r.event_data for r in plain.orderBy("seq").collect()]
    plan = lean.select("seq", "pk_values")._jdf.queryExecution().optimizedPlan().toString()
    assert "event_data" not in plan and "element_at" not in plan


def test_order_reads_rows_that_were_made_once(spark):
    rows = spark.createDataFrame([("f", n, r) for n, r in ((1, 2), (2, 1), (3, 2), (4, 1))] + [("g", 1, 1)],
                                 "file_name string, line_num int, dep_rank int")
    calls, keep = counted()
    got = ordering.fk_order(rows, 2, keep)
    assert {(r.file_name, r.line_num): r.position for r in got.collect()} == {
        ("f", 2): 1, ("f", 4): 2, ("f", 1): 3, ("f", 3): 4, ("g", 1): 1}
    assert len(calls) == 1 and "LocalRelation" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_deletes_come_from_lines_parsed_once(spark, tmp_path):
    stamp = "timestamp_ntz'2024-01-02 00:00:00'"
    tables = {"orders": f"select id o_orderkey, id % 7 o_custkey, {stamp} o_orderdate, 1.5d o_totalprice from range(1, 200)",
              "customer": "select id c_custkey, 'c' c_name, 'M' c_mktsegment from range(7)",
              "lineitem": f"select id l_orderkey, 1 l_linenumber, 2.5d l_extendedprice, 'A' l_returnflag, {stamp} l_shipdate "
                          "from range(1, 200)"}
    for name, text in tables.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    got = queries.CATALOGUE["delete_keys"](spark, str(tmp_path))
    rows = {(r.table_name, r.key_text) for r in got.collect()}
    assert ("policy", str(1000000 + 2 * 25)) in rows and ("claim", str(2000000 + 2 * (50 * 8 + 1))) in rows
    assert {t for t, _ in rows} == {"policy", "policy_keyring", "claim", "claim_keyring"} and len(rows) == 2 * (7 + 3)
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_gaps_are_counted_without_a_join(spark, monkeypatch):
    base = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("d",)], "n string")
    ring = spark.createDataFrame([("a",), ("x",), ("x",), (None,), (None,), ("y",), ("y",), ("y",), ("y",), ("y",)], "legacy string")
    expected = [("b", "NO_TOKEN"), ("d", "NO_TOKEN"), (None, "NO_BASE_ROW"), (None, "NO_BASE_ROW"),
                *[("x", "NO_BASE_ROW")] * 2, *[("y", "NO_BASE_ROW")] * 5]
    for repeats in (2, 5, 100):
        monkeypatch.setattr(keyring, "REPEATS", repeats)
        got = keyring.keyring_gaps(base, "n", ring, "legacy")
        assert got.columns == ["number", "gap"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_a_batch_are_split_once(spark):
    texts = [*LINES, "I|short|s|t", "", "B|1|1|t", 'U|policy|insurance|t|"open', " u | Policy|INSURANCE |t|7", "X", "|||||"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file_name string, line_pos long, line string")
    calls, keep = counted()
    rows, rejected = cdc.read_once(lines, keep)
    plain = cdc.classify(lines)
    for got, expected in ((rows, cdc.data_rows(plain, raw=True)), (rejected, cdc.rejected_rows(plain))):
        assert got.columns == expected.columns and sorted(got.collect()) == sorted(expected.collect())
        assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and rejected.count() == 3


def test_holdings_are_made_once(spark):
    at = "struct<kind:int,pos:struct<n:int>>"
    held = spark.createDataFrame(
        [("A", 1, (1, (1,)), (2, None)), ("A", 2, (1, (2,)), (2, None)), ("B", 3, (1, (3,)), (2, None)),
         ("C", 4, (0, None), (1, (5,))), ("C", 5, (1, (4,)), (2, None)), ("C", 6, (1, (6,)), (2, None))],
        f"num string, k int, since {at}, until {at}")
    calls, keep = counted()
    got = unique.refused(held, "num", ["k"], keep=keep)
    assert {(r.num, r.k) for r in got.collect()} == {("A", 2), ("C", 5)}
    assert sorted(got.collect(), key=str) == sorted(unique.refused(held, "num", ["k"]).collect(), key=str)
    assert len(calls) == 2 and "LocalRelation" not in got._jdf.queryExecution().optimizedPlan().toString()
