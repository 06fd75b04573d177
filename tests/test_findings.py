import json

from pyspark.sql import functions as F

from lexmill.functions import answers as A
from lexmill.operators import findings as K
from lexmill.operators import lexical as L
from lexmill.operators.context import batch_units, fan_in
from lexmill.operators.report import job_reports, write_reports

REF = {"file": "a.txt", "chunk": "1", "quote": "Say it"}


def chain(spark, answers, chunk="[FILE_PATH: docs/x.md]\ntext", **options):
    df = spark.createDataFrame([(i, a, chunk) for i, a in enumerate(answers)], "id int, answer string, chunk string")
    return {r.id: r.result for r in K.normalise(K.parse_results(df), "chunk", **options).collect()}


def test_answers_are_unwrapped_and_parsed(spark):
    body = json.dumps({"file": "wrong", "findings": [{"type": "a", "severity": "HIGH", "explanation": "e", "evidence_refs": [REF, {**REF, "quote": "SAY IT"}]}, {"type": "A", "severity": "high", "explanation": "E"}, None]})
    items = json.dumps({"items": [{"item": 5, "fields": {"level": "low"}}], "no_relevant_data": True})
    got = chain(spark, [f"<think>x</think><results>{body}</results>", f"```json\n{items}\n```", "no json", None, "", "[1]", '{"findings": 3}', "<results>JSON_OBJECT</results>"])
    first = got[0]
    assert first.file == "docs/x.md" and [f.severity for f in first.findings] == ["HIGH", "medium"]
    assert [r.file for r in first.findings[0].evidence_refs] == ["docs/x.md"] and first.findings[1].explanation.endswith("evidence]")
    assert got[1].findings[0].item == "5" and got[1].findings[0].fields == {"level": "low"} and got[1].no_relevant_data
    assert all(got[i] is None for i in (2, 3, 4, 7)) and got[6].findings == []


def test_file_first_keeps_severity_and_most_limits(spark):
    weak = json.dumps({"findings": [{"severity": "high", "explanation": str(i), "evidence_refs": [{"quote": "q"}]} for i in range(5)]})
    assert {f.severity for f in chain(spark, [weak])[0].findings} == {"medium"}
    assert {f.severity for f in chain(spark, [weak], file_first=True)[0].findings} == {"high"}
    assert len(chain(spark, [weak], most=2)[0].findings) == 2 and chain(spark, [weak], chunk=None)[0].file is None


def test_bodies(spark):
    long = "word " * 200
    cases = {"Let me think about it": "", "short answer": "short answer", long: "", long + "\nSummary:\n" + "s" * 60: "s" * 60, "```json\n{}\n```": "```json\n{}\n```", "<RESULTS> a </results> b": "a"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.b for r in df.select("t", A.results_body(F.col("t")).alias("b")).collect()} == cases


def test_predicates(spark):
    rows = [("How many rows?", False), ("Дай обзор заметок", True), ("сколько всего, список", False), ("", False), (None, False), ("give an overview", True)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert df.filter(A.is_analytical(F.col("t")) != F.col("want")).count() == 0
    said = spark.createDataFrame([("В источниках блокнота  нет ответа на этот вопрос.",), ("The user asks for x",), ("нет",), ("НЕТ данных",), ("note",), (None,)], "t string")
    got = [(r.r, r.l, r.n) for r in said.select(A.is_refusal(F.col("t")).alias("r"), A.loud_thinking(F.col("t")).alias("l"), A.map_note(F.col("t")).alias("n")).collect()]
    assert [g[0] for g in got] == [True] + [False] * 5 and got[1][1] and [g[2] for g in got[2:]] == ["", "", "note", ""]


def test_grounding_knows_dates_and_skips_numbers(spark):
    df = spark.createDataFrame([("on 5.3.2024 and 2024-03-06, versions 1.2.3 and v1.2 by @ann [1] a-b", "seen 2024-03-05, V1.2 by @Ann")], "a string, s string")
    assert df.select(A.ungrounded(F.col("a"), F.col("s")).alias("m")).first().m == ["1.2.3", "2024-03-06"] or df.select(A.ungrounded(F.col("a"), F.col("s")).alias("m")).first().m == ["2024-03-06"]


def test_flash_cards(spark):
    texts = ['x [{"q": "a", "answer": "b"}, {"front": "c"}, {"question": "d", "a": " e "}] y', '```json\n[{"front": "f", "back": "g"}]\n```', "none", None, "[1, 2]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [tuple(c) for c in r.c] for r in df.select("i", A.flash_cards(F.col("t")).alias("c")).collect()}
    assert got == {0: [("a", "b"), ("d", "e")], 1: [("f", "g")], 2: [], 3: [], 4: []}


def sample(spark, rows):
    schema = "result_id bigint, job_id string, chunk_index int, file string, query_alignment string, no_relevant_data boolean, findings array<struct<finding_id string, severity string, finding_type string, explanation string, fields_json string, evidence_refs array<struct<file string, chunk string, quote string>>>>, recommendations array<string>"
    return spark.createDataFrame(rows, schema)


def test_rollup_keeps_every_finding(spark):
    many = [(f"f{i}", "low", "t", f"finding {i}", None, None) for i in range(1500)]
    rows = [(1, None, 0, "a/b.txt", None, False, many, None), (2, None, 1, "a\\c.txt", None, True, [many[0]], None), (3, "j", 0, "d.txt", None, True, [], None), (3, "j", 0, "d.txt", None, True, [], None)]
    got = {(r.job_id, r.level, r.node): r for r in K.rollup(sample(spark, rows)).collect()}
    assert got[None, "file", "a/b.txt"].n_findings == got[None, "directory", "a"].n_findings == got[None, "corpus", ""].n_findings == 1500
    assert got[None, "directory", "a"].n_children == 2 and got[None, "corpus", ""].n_with_findings == 2
    assert got["j", "directory", "/"].nothing and got["j", "corpus", ""].nothing and got["j", "file", "d.txt"].n_children == 1
    assert K.rollup(sample(spark, [])).count() == 0


def test_reports(spark, tmp_path):
    rows = [(1, "j", 0, "a", None, False, [("f", "high", "t", "Bad | bar", None, [("a", "1", "q" * 100)])], [" act ", "act"]), (2, "k", 0, "a", None, True, None, None)]
    lines = job_reports(sample(spark, rows))
    text = {j: [r.line for r in sorted(lines.filter(F.col("job_id") == j).collect(), key=lambda r: (r.section, r.a, r.b, r.c))] for j in "jk"}
    assert text["j"] == ["## Executive Summary", "Findings: 1, critical or high: 1, passages: 1", "## Comprehensive Findings", "- **[HIGH]** `t`: Bad \\| bar", "## Evidence Matrix", "| a | 1 | " + "q" * 80 + " |", "## Action Plan", "- act"]
    assert text["k"] == ["## Executive Summary", "No findings.", "## Comprehensive Findings", "No data.", "## Evidence Matrix", "No data.", "## Action Plan", "No recommendations."]
    write_reports(lines, tmp_path / "r")
    (part,) = (tmp_path / "r" / "job_id=j").glob("*.txt")
    assert part.read_text().splitlines() == text["j"]


def test_hits_merge_rerank_and_first_seen(spark):
    r = lambda rows: spark.createDataFrame(rows, "qid bigint, id bigint, score double, rank int")
    a, b = r([(1, 10, 2.0, 1), (1, 11, 1.0, 2)]), r([(1, 11, 3.0, 1), (1, 12, 0.5, 2)])
    merged = L.merge_hits([a, b], 2)
    assert [(x.id, x.score, x["rank"]) for x in merged.orderBy("rank").collect()] == [(11, 3.0, 1), (10, 2.0, 2)]
    order = spark.createDataFrame([(1, 12, 0), (1, 99, 1)], "qid bigint, id bigint, place int")
    assert [x.id for x in L.apply_rerank(b, order, 5).orderBy("rank").collect()] == [12, 11]
    assert [x.id for x in L.first_seen(b, a).orderBy("rank").collect()] == [11, 12, 10]
    assert L.depth(8, 10_000) == 200 and L.depth(100, 10_000) == 500 and L.depth(8, 50) == 50


def test_neighbours_interleave(spark):
    chunks = spark.createDataFrame([(f"c{i}", "s", i) for i in range(6)], "chunk_id string, source_path string, chunk_index int")
    hits = spark.createDataFrame([(1, "c2", 2.0, 1), (1, "c3", 1.0, 2), (1, "c5", 0.5, 3)], "qid int, chunk_id string, score double, rank int")
    got = L.with_neighbours(hits, chunks, 1).orderBy("n").collect()
    assert [(r.chunk_id, r.is_neighbour) for r in got] == [("c2", False), ("c1", True), ("c3", True), ("c4", True), ("c5", False)]
    assert [r.chunk_id for r in L.with_neighbours(hits, chunks, 0).orderBy("n").collect()] == ["c2", "c3", "c5"]
    assert [r.chunk_id for r in L.with_neighbours(hits, chunks, 2, 3).orderBy("n").collect()] == ["c2", "c1", "c3"]


def test_batches_and_fan_in(spark):
    units = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([40, 40, 400, 40], 1)], "qid int, n int, text string")
    assert [r.batch for r in batch_units(units, 20).orderBy("n").collect()] == [1, 1, 2, 3]
    notes = spark.range(1, 124).select(F.lit(1).alias("qid"), F.col("id").alias("n"))
    levels = {r.n: r.level_groups for r in fan_in(notes, 10).collect()}
    assert levels[123] == [13, 2, 1] and levels[1] == [1, 1, 1] and fan_in(notes.limit(0)).count() == 0
