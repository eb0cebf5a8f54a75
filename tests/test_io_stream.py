import os

from pyspark.sql import functions as F

from evalspark.operators import generate as V
from evalspark.sources import io as IO
from evalspark.streaming import expand_incremental


def test_csv_quotes_round_trip(spark, tmpdir_fresh):
    rows = [('he said "hi", then left', "less, with comma", "stereo", "g1"), ("  padded ", "\ttab", " ", "g3"),
            ("line\nbreak", 'double ""quotes""', None, "g2")]
    df = spark.createDataFrame(rows, IO.PAIRS_SCHEMA)
    path = os.path.join(tmpdir_fresh, "pairs")
    df.coalesce(1).write.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = IO.read_delimited(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    out = os.path.join(tmpdir_fresh, "csv")
    IO.write_table(df, out, fmt="csv")
    back2 = IO.read_samples(spark, out, fmt="csv", schema=IO.PAIRS_SCHEMA)
    assert sorted(map(tuple, back2.collect()), key=str) == sorted(rows, key=str)


def test_read_available_and_by_label(spark, tmpdir_fresh):
    p = spark.createDataFrame([(1, "a", 0, 1, 0.7, "g", "d")], IO.PREDICTIONS_SCHEMA)
    pa = os.path.join(tmpdir_fresh, "A")
    IO.write_table(p, pa)
    df, missing = IO.read_available(spark, {"A": pa, "B": os.path.join(tmpdir_fresh, "nope")})
    assert missing == ["B"] and df.first()["model"] == "A"
    s = spark.createDataFrame([(1, "x", "neutral"), (2, "y", "unrelated")], "row_id long, text string, label string")
    IO.write_by_label(s, os.path.join(tmpdir_fresh, "bylabel"))
    folders = {f for f in os.listdir(os.path.join(tmpdir_fresh, "bylabel")) if f.startswith("label=")}
    assert folders == {"label=neutral", "label=unrelated"}


def test_parse_response_shapes(spark):
    df = spark.createDataFrame([(0, "NEUTRE: one"), (1, "  Neutre: a: b \n SANS_RAPPORT:  x1"),
                                (2, "NEUTRE: first\nNEUTRE: second\nSans rapport: y"), (3, "no marker"), (4, None)],
                               "row_id long, response string")
    r = {x["row_id"]: (x["neutral"], x["unrelated"]) for x in V.parse_response(df).collect()}
    assert r == {0: ("one", ""), 1: ("a: b", "x1"), 2: ("second", "y"), 3: ("", ""), 4: ("", "")}


def test_generate_errors_do_not_stop(spark):
    def factory():
        def gen(p):
            if "bad" in p:
                raise RuntimeError("boom")
            return "NEUTRE: ok"
        return gen
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "row_id long, prompt string")
    r = {x["row_id"]: x for x in V.generate(df, factory).collect()}
    assert r[1]["response"] == "NEUTRE: ok" and r[2]["response"] is None and "boom" in r[2]["error"]


def test_stream_restart_processes_each_input_once(spark, tmpdir_fresh):
    inp, out, ck = (os.path.join(tmpdir_fresh, x) for x in ("in", "out", "ck"))
    schema = "row_id long, text string, label string, grp string"
    spark.createDataFrame([(1, "a b c d", "stereotype", "g"), (2, "e f", "stereotype", "g")], schema) \
        .coalesce(1).write.parquet(os.path.join(inp, "part1"))
    q = expand_incremental(spark, os.path.join(inp, "*"), out, V.offline_generator_factory, ck)
    q.awaitTermination(120)
    first = spark.read.parquet(out).count()
    spark.createDataFrame([(3, "g h i j", "stereotype", "g")], schema).coalesce(1).write.parquet(os.path.join(inp, "part2"))
    q = expand_incremental(spark, os.path.join(inp, "*"), out, V.offline_generator_factory, ck)
    q.awaitTermination(120)
    res = spark.read.parquet(out)
    assert first == 4
    assert res.count() == 6
    assert res.groupBy("row_id", "origin").count().where("count > 1").count() == 0


def test_text_report_and_model_round_trip(spark, tmpdir_fresh):
    from evalspark.operators import models as MD
    reg = spark.createDataFrame([(1, "A", "B", "A vs B", "t")],
                                "pair_id int, model_a string, model_b string, name string, category string")
    p = spark.createDataFrame([(m, i, i % 2, (i + (m == "B") * (i % 3 == 0)) % 2) for m in "AB" for i in range(60)],
                              "model string, row_id long, actual_label int, predicted_label int")
    from evalspark.operators.compare import compare_all
    lines = IO.comparison_report_lines(compare_all(p, reg, reps=100))
    out = os.path.join(tmpdir_fresh, "report")
    IO.write_text_report(lines, out, by=["pair_id"])
    text = spark.read.text(os.path.join(out, "pair_id=1")).collect()
    assert len(text) == 8 and text[0]["value"].startswith("Comparison: A vs B")
    train = spark.createDataFrame([(i, "bad awful text" if i % 2 else "good nice text", i % 2) for i in range(40)],
                                  "row_id long, text string, label_int int")
    m = MD.fit_logreg(train, "label_int", "text", MD.LogRegConfig(max_iter=20, max_features=100))
    path = os.path.join(tmpdir_fresh, "model")
    MD.save_model(m, path)
    a = MD.predict(m, train, keep=["row_id"]).orderBy("row_id").collect()
    b = MD.predict(MD.load_model(path), train, keep=["row_id"]).orderBy("row_id").collect()
    assert a == b
    assert sum(r["predicted_label"] == (r["row_id"] % 2) for r in a) == 40


def test_reports_from_golden_cells(spark):
    from evalspark.operators.groups import group_stats
    from evalspark.operators.metrics import confusion_cells

    from tests.conftest import preds_from_cells

    p = preds_from_cells(spark, {(0, 0): 603, (0, 1): 68, (1, 0): 86, (1, 1): 249}, grp="g")
    cells = confusion_cells(p)
    lines = [r["line"] for r in IO.confusion_report_lines(cells).orderBy("section", "line_no").collect()]
    assert lines[:2] == ["Actual 0, predicted 0: 603 (89.87%)", "Actual 0, predicted 1: 68 (10.13%)"]
    assert "Class 1: 335 rows, 249 correct (74.33%), 86 errors" in lines
    assert lines[-2:] == ["Class 1 taken for 0: 86 (25.67%)", "Class 0 taken for 1: 68 (10.13%)"]
    spread = [r["line"] for r in IO.variance_report_lines(group_stats(cells)).orderBy("section", "line_no").collect()]
    assert spread[0] == "1 groups: mean F1 0.8253, std 0.0000, min 0.8253, max 0.8253, range 0.0000, CV 0.00%"
    assert spread[1] == "g: F1 0.8253, +0.0000 to the mean (above)" and len(spread) == 4
    cases = [r["line"] for r in IO.failure_report_lines(p, 3).orderBy("section", "line_no").collect()]
    assert len(cases) == 3 and cases[0].startswith("1. [g] actual 0, predicted 1, confidence 0.9000: t603")


def test_comparison_summary_by_category(spark):
    c = spark.createDataFrame([(1, "A vs B", "x", "ok", "B significantly better"), (2, "A vs C", "x", "no_common_rows", None),
                               (3, "B vs C", "y", "ok", "no significant difference")],
                              "pair_id int, name string, category string, status string, verdict string")
    got = [r["line"] for r in IO.comparison_summary_lines(c).orderBy("category", "line_no").collect()]
    assert got == ["x: 2 comparisons, 1 done, 1 failed", "  A vs B: B significantly better", "  A vs C: no_common_rows",
                   "y: 1 comparisons, 1 done, 0 failed", "  B vs C: no significant difference"]


def _in_small_splits(spark, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    return old


def test_quoted_files_are_read_in_splits(spark, tmpdir_fresh):
    import random

    rng = random.Random(3)
    alphabet = ["a", "bc", " ", '""', ",", "\n", "\r\n", "\n\n", "x" * 30, "é"]

    def field():
        kind = rng.random()
        if kind < 0.2:
            return rng.choice(["", "plain", 'mid"quote', "two words", 'q"x"'])
        return '"' + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) + '"'

    folder = os.path.join(tmpdir_fresh, "many")
    os.makedirs(folder)
    for k, end in enumerate(["\n", "\r\n", "\n"]):
        with open(os.path.join(folder, f"f{k}.csv"), "w", newline="") as f:
            f.write(f'id,"one{end}column",two{end}')
            for i in range(150):
                f.write(f"{k * 1000 + i},{field()},{field()}" + end)
                if i == 70:
                    f.write(f'{k * 1000 + 900},"' + "long line\n" * 300 + '",end' + end)
    schema = "id int, one string, two string"
    plain = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')

    def rows(df):  # Spark's own reader makes the line breaks within fields of a CRLF file plain ones
        return sorted((r["id"], *((x or "").replace("\r\n", "\n") for x in (r["one"], r["two"])), r["one"] is None) for r in df.collect())

    want = rows(plain.option("multiLine", True).csv(folder))
    assert len(want) == 453
    for size in (1 << 20, 900, 300):
        old = _in_small_splits(spark, size)
        try:
            df = IO.read_delimited(spark, folder, schema, sep=",")
            got = rows(df)
            tasks = spark.read.option("lineSep", "\n").text(folder).rdd.getNumPartitions()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
            spark.conf.set("spark.sql.files.openCostInBytes", old[1])
        assert got == want
        assert tasks > 30 or size > 900


def test_state_behind_a_line():
    from evalspark.sources.quoted import open_behind

    after = open_behind(",")
    assert [after(x, False) for x in ['a,b', 'a"b,c', '"a,b"', '"a""', '"a"""', 'x,"', 'x,""', '"a"b"c,d', ',', '"']] == \
        [False, False, False, True, False, True, False, False, False, True]
    assert [after(x, True) for x in ['a', 'a"', 'a""', 'a"""', 'a",b', 'a","b', '']] == [True, False, True, False, False, True, True]


def test_quoted_reader_of_empty_and_unclosed_files(spark, tmpdir_fresh):
    folder = os.path.join(tmpdir_fresh, "odd")
    os.makedirs(folder)
    for name, text in (("empty.csv", ""), ("head.csv", "a,b\n"), ("last.csv", 'a,b\n\n1,"x"'), ("blank.csv", "a,b\r\n\r\n2,y\r\n")):
        with open(os.path.join(folder, name), "w", newline="") as f:
            f.write(text)
    got = sorted(map(tuple, IO.read_delimited(spark, folder, "a int, b string", sep=",").collect()))
    assert got == [(1, "x"), (2, "y")]


def test_reports_are_written_in_order(spark, tmpdir_fresh):
    lines = spark.range(5000).repartition(7).select((F.col("id") % 2).cast("int").alias("section"), F.col("id").alias("line_no"),
                                                    F.format_string("%d", "id").alias("line"))
    out = os.path.join(tmpdir_fresh, "ordered")
    IO.write_text_report(lines, out)
    got = []
    for name in sorted(f for f in os.listdir(out) if f.startswith("part-")):
        with open(os.path.join(out, name)) as f:
            got += [int(x) for x in f.read().split()]
    assert got == [*range(0, 5000, 2), *range(1, 5000, 2)]
