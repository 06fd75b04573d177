from lexmill.sources import sinks


def test_tables_and_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', ["x"]), (2, None, [])], "id int, t string, l array<string>")
    for kind in ("csv", "json", "parquet"):
        sinks.write_table(df, str(tmp_path / kind), kind)
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').orderBy("id").collect()
    assert [(r.t, r.l) for r in back] == [('a "q", b', '["x"]'), (None, "[]")]
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    sinks.write_plain(spark.createDataFrame([("# Head\n**bold** [l](u)",), (None,)], "t string"), "t", str(tmp_path / "plain"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "plain")).collect()) == ["Head", "bold l"]


def test_evidence_matrix(spark):
    df = spark.createDataFrame([(1, "x\n| a | b | c |\n|---|---|---|\n| 1 | 2 |\nd | e | f"), (2, None)], "id int, text string")
    assert [(r.line_no, r.cells) for r in sinks.evidence_matrix(df).collect()] == [(1, ["a", "b", "c"]), (4, ["d", "e", "f"])]
    assert [r.line for r in sinks.markdown_rows(spark.createDataFrame([("a|b", None)], "p string, q string"), ["p", "q"]).collect()] == ["| a\\|b |  |"]


def test_report(spark):
    df = spark.createDataFrame([("a", 2, 5), ("b", 3, 5), ("a", 2, 4)], "value string, n_unique int, n_total int")
    assert sinks.report(df).split("\n") == ["## Findings: 7 unique", "", "| Category | Count |", "|---|---|", "| a | 4 |", "| b | 3 |"]
    assert sinks.report(df.limit(0)) == ""
