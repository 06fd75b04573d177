from datetime import datetime

from pyspark.sql import functions as F

from lexmill.operators.snapshots import neighbours, normal_path, snapshot_changes

T = lambda n: datetime(2024, 1, n)
ARGS = dict(snapshot_id="run_id", source="path", at="at", key="k", compare=["v", "w"], version="loaded")


def changes(spark, runs, rows):
    r = spark.createDataFrame(runs, "run_id string, path string, at bigint, loaded timestamp_ntz, change string, payload string")
    i = spark.createDataFrame(rows, "run_id string, k string, v string, w string, loaded timestamp_ntz, source_key string")
    return sorted(tuple(x) for x in snapshot_changes(r, i, **ARGS).collect())


def run(i, path, at, loaded=1):
    return (i, path, at, T(loaded), "x", "y")


def row(i, k, v, w=None, loaded=1):
    return (i, k, v, w, T(loaded), "z")


def test_paths(spark):
    cases = {"/a//b/": "root:/a/b", "\\a\\.\\b": "root:/a/b", "/a/x/../b": "root:/a/b", "/../a": "root:/a", "D:/a/b\\": "/D:/a/b", "../a": "/../a", "/A/b": "root:/A/b", " ": None, "": None}
    df = spark.createDataFrame(list(cases.items()), "p string, want string").select("want", normal_path(F.col("p")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_added_removed_changed_and_null_as_empty(spark):
    runs = [run("a", "/s/", 1), run("b", "\\s", 2), run("c", "/s/.", 3)]
    rows = [row("a", "1", "x"), row("a", "2", "x"), row("b", "1", "x", ""), row("b", "2", "y"), row("b", "3", "n"), row("b", "2", "old", loaded=0 + 1)]
    rows[-1] = ("b", "2", "old", None, None, "z")  # undated: older than any dated row
    assert changes(spark, runs, rows) == [("b", "2", "changed"), ("b", "3", "added"), ("c", "1", "removed"), ("c", "2", "removed"), ("c", "3", "removed")]


def test_nulls_unknown_runs_repeats_and_empty_tables(spark):
    runs = [run("a", None, 1), run("b", " ", 2), run(None, "/s", 1), run("c", "/s", 1), run("c", "/s", 1), run("d", "/s", None)]
    assert changes(spark, runs, [row("a", "1", "x"), row("zz", "1", "x"), row(None, "1", "x"), row("c", None, "x"), row("c", "1", "x")]) == []
    assert changes(spark, [], []) == []
    assert changes(spark, [run("a", "/s", 1), run("b", "/s", 1)], [row("b", "1", "x" * 100_000), row("b", "1", "x" * 100_000)]) == [("b", "1", "added")]


def test_neighbours_cross_stretches(spark):
    rows = [(f"r{i:03d}", "hot", i * 17) for i in range(200)]
    df = neighbours(spark.createDataFrame(rows, "snapshot_id string, source_key string, at bigint"), span=100)
    got = {r.snapshot_id: (r.prev_id, r.next_id) for r in df.collect()}
    assert all(got[f"r{i:03d}"] == (f"r{i - 1:03d}" if i else None, f"r{i + 1:03d}" if i < 199 else None) for i in range(200))
