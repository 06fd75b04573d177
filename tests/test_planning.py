from pyspark.sql import functions as F

from lexmill.functions import render as R
from lexmill.operators import chunking as C
from lexmill.operators import planning as P
from lexmill.operators.context import reduce_notes
from lexmill.operators.snapshots import change_notes
from lexmill.session import clear, materialise
from lexmill.sources.records import record_chunks


def test_pending_forgets_old_results(spark):
    wanted = spark.createDataFrame([("j", i) for i in range(4)], "job_id string, chunk_index int")
    stored = spark.createDataFrame([("j", 0, "2024-01-09"), ("j", 1, "2024-01-01"), ("j", 2, None)], "job_id string, chunk_index int, at string").withColumn("at", F.to_timestamp("at"))
    now = F.to_timestamp(F.lit("2024-01-10"))
    assert sorted(r.chunk_index for r in P.pending(wanted, stored, ["job_id", "chunk_index"], "at", now).collect()) == [1, 2, 3]
    assert [r.chunk_index for r in P.pending(wanted, stored, ["job_id", "chunk_index"]).collect()] == [3]


def test_keep_relevant(spark):
    files = spark.createDataFrame([("a", 0.9), ("b", 0.4), ("c", 0.1), ("d", None)], "f string, score double")
    assert {r.f for r in P.keep_relevant(files, 0.45).collect()} == {"a", "b"}
    assert P.keep_relevant(files.filter("score < 0.2 or score is null"), 0.45).count() == 2


def test_renderings(spark):
    df = spark.createDataFrame([("[SOURCE_TITLE: x]\nbody", "a\\b\\c.txt", "Mills", None, 3)], "t string, p string, title string, page int, line int")
    r = df.select(
        R.for_embedding(F.col("t"), "nomic-embed", "query").alias("q"), R.for_embedding(F.col("t"), "other", "query").alias("o"), R.display_name(F.col("p"), F.col("title")).alias("d"), R.display_name(F.lit(None), F.lit(None)).alias("n"),
        R.locator(F.col("page"), F.col("line")).alias("l"), R.header(F.col("p"), F.col("title"), F.lit(""), F.lit(None), F.lit(0)).alias("h"), R.page_summary(F.lit("# H\n|a|\n- first\n")).alias("s"), R.page_summary(F.lit(None)).alias("e"),
        R.table_answer(F.lit('```json\n[{"a": "1", "b": 2}]\n```')).alias("j"), R.table_answer(F.lit("a | b\n1 | 2\n3")).alias("b"), R.table_answer(F.lit(None)).alias("z"),
    ).first()
    assert (r.q, r.o, r.d, r.n, r.l) == ("search_query: body", "body", "b/c.txt — Mills", "source", "line 3")
    assert r.h == "[FILE_PATH: a\\b\\c.txt][CHUNK_INDEX: 1]\n[FILE_TITLE: Mills]" and (r.s, r.e) == ("first", "")
    assert r.j == [{"a": "1", "b": "2"}] and r.b == [{"a": "1", "b": "2"}] and r.z == []


def test_change_notes(spark):
    changes = spark.createDataFrame([("r", f"k{i}", "added") for i in range(10)] + [("r", "x", "removed"), ("s", "y", "changed")], "run string, key string, change string")
    names = spark.createDataFrame([("r", f"k{i}", f"item {i}") for i in range(10)], "run string, key string, name string")
    got = {r.run: r.note.split("\n") for r in change_notes(changes, names, "run", "key").collect()}
    assert got["r"][1:4] == ["- Added: 10", "- Removed: 1", "- Changed: 0"] and got["r"][5:] == [f"  - item {i}" for i in range(8)]
    assert got["s"] == ["### Changes since last run", "- Added: 0", "- Removed: 0", "- Changed: 1"]


def test_clear_removes_own_tables(spark, tmp_path):
    t = materialise(spark.range(3), "x")
    path = t.inputFiles()[0].removeprefix("file://")
    clear(spark)
    import os

    assert not os.path.exists(path)


def test_markdown_tables_and_sheets(spark):
    df = spark.createDataFrame([([["a", "b|c"], ["1"], ["2", None, "x"]],), ([],)], "r array<array<string>>")
    got = [r.t for r in df.select(R.markdown_table(F.col("r")).alias("t")).collect()]
    assert got == ["| a | b\\|c |  |\n|---|---|---|\n| 1 |  |  |\n| 2 |  | x |", ""]


def test_table_texts_hold_each_row_once(spark):
    rows = spark.range(0, 100, 1, 3).select("id", F.lit(None).cast("string").alias("empty"))
    texts = C.table_texts(rows, 7).collect()
    lines = [x for t in texts for x in t.text.split("\n")[1:]]
    assert sorted(int(x.split("\t")[0]) for x in lines) == list(range(100))
    assert all(t.n_rows <= 7 and t.text.startswith("id\tempty\n") for t in texts) and C.table_texts(rows.limit(0), 7).count() == 0


def test_notes_are_merged_level_by_level(spark):
    notes = spark.createDataFrame([(1, i, f"line {i}\nshared") for i in range(1, 124)] + [(2, 1, None)], "qid int, n int, text string")
    got = {r.qid: r.text.split("\n") for r in reduce_notes(notes, 10).collect()}
    assert got[1] == ["line 1", "shared", *[f"line {i}" for i in range(2, 124)]] and got[2] == [""]
    assert {r.qid: len(r.text.split("\n")) for r in reduce_notes(notes, 2, depth=2).collect()}[1] == 124
    assert reduce_notes(notes.limit(0)).count() == 0


def test_record_chunks_keep_order_and_whole_records(spark):
    rows = [("f", n, f"line[{n}]", {"k": "x" * 300, "e": " "}) for n in range(12)] + [("g", 1, "a", {"k": "y" * 2000})]
    got = record_chunks(spark.createDataFrame(rows, "source_path string, n int, place string, record map<string,string>"), 200).orderBy("source_path", "chunk_index").collect()
    f = [r.text for r in got if r.source_path == "f"]
    assert "\n".join(f).count("- record @ ") == 12 and [f"line[{n}]" in "\n".join(f) for n in range(12)] == [True] * 12 and len(f) == 6 and all("  e:" not in t for t in f)
    assert len([r for r in got if r.source_path == "g"]) == 1
