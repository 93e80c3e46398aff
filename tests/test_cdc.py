import csv
import io
import random

from pyspark.sql import functions as F

from tidemark.sources import cdc, landing


def lines_df(spark, lines):
    return spark.createDataFrame([("f", i, line) for i, line in enumerate(lines)],
                                 "file_name string, line_num int, line string")


def test_kinds_and_header(spark):
    got = cdc.classify(lines_df(spark, [
        "B|1|1|ts", " c |1|1|ts", "", "I|short|s|t", ' u |Policy| INSURANCE | ts |1|"a|""b"""|', 'I|t|s|ts|"open'])).collect()
    assert [r.kind for r in got] == ["MARKER", "MARKER", "BLANK", "SHORT", "DATA", "OPEN_QUOTE"]
    rows = cdc.parse(lines_df(spark, [' u |Policy| INSURANCE | ts |1|"a|""b"""|'])).first()
    assert (rows.op, rows.src_table, rows.src_schema, rows.event_ts) == ("U", "policy", "insurance", "ts")
    assert rows.data == ["1", 'a|"b"', ""]
    bad = cdc.rejected_rows(cdc.classify(lines_df(spark, ["I|short|s|t", 'I|t|s|ts|"open']))).collect()
    assert sorted(r.reason for r in bad) == ["OPEN_QUOTE_ROW", "SHORT_ROW"]


def test_split_agrees_with_a_csv_reader(spark):
    rng = random.Random(7)
    pool = ["", "a", " b ", 'in"side', "x|y", 'q"q', "NULL", "ü", '""']
    lines = []
    for _ in range(300):
        out = io.StringIO()
        csv.writer(out, delimiter="|", lineterminator="").writerow([rng.choice(pool) for _ in range(rng.randint(1, 9))])
        lines.append(out.getvalue())
    lines += ['5" pipe|b', 'a|"b"c|d', '|', '""', 'a""b|c']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r.i: r.c for r in df.select("i", cdc.split_fields(F.col("line")).alias("c")).collect()}
    for i, line in enumerate(lines):
        want = next(csv.reader(io.StringIO(line), delimiter="|"), [""])
        assert got[i] == want, line


def test_files_keep_line_order_across_splits(spark, tmp_path):
    lines = [f"I|t|s|ts|{i}|{'x' * (i % 40)}" for i in range(5000)]
    (tmp_path / "one.CSV").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.csv").write_bytes(b"I|t|s|ts|1|\xff\r\nI|t|s|ts|2\n")
    (tmp_path / "other.txt").write_text("I|t|s|ts|9\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = cdc.read_cdc(spark, str(tmp_path), numbered=True)
        one = rows.filter(F.col("file_name").contains("one")).orderBy("line_num").collect()
        assert [r.line_num for r in one] == list(range(1, 5001))
        assert [int(r.data[0]) for r in one] == list(range(5000))
        by_pos = [int(r.data[0]) for r in cdc.read_cdc(spark, str(tmp_path)).filter(
            F.col("file_name").contains("one")).orderBy("line_pos").collect()]
        assert by_pos == list(range(5000))
        two = rows.filter(F.col("file_name").contains("two")).orderBy("line_num").collect()
        assert [r.data for r in two] == [["1", "�"], ["2"]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_discovery(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    (tmp_path / "b.CSV").write_text("xy")
    (tmp_path / "c.json").write_text("{}")
    files = landing.discover_files(spark, str(tmp_path))
    assert landing.landing_counts(files).first().asDict() == {"processed": 2, "skipped": 1}
    got = landing.pointers(files).collect()
    assert sorted(r.file_size for r in got) == [1, 2]
    assert len({r.event_id for r in got}) == 2 and all(r.retry_count == 0 and not r.is_retry for r in got)
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()  # no file is opened


def test_long_quoted_fields(spark):
    texts = ["x" * 1_000_000, '""' * 5_000, "a|b" * 2_000, ""]
    lines = [f'I|t|s|2026-01-01|"{t}"|end' for t in texts] + ['I|t|s|2026-01-01|"' + "y" * 100_000]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n int, line string")
    rows = {r.n: r for r in cdc.classify(df).collect()}
    assert [rows[i].kind for i in range(5)] == [cdc.DATA] * 4 + [cdc.OPEN_QUOTE]
    assert [rows[i].cols[4:] for i in range(4)] == [[t.replace('""', '"'), "end"] for t in texts]
