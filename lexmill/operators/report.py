"""Reports written by rule from findings, as ordered lines, so that a large job's report isn't one row."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.findings import findings, first_of, finding_key, null_safe_join, results

#: Sections of a report in order.
SECTIONS = ["Executive Summary", "Comprehensive Findings", "Evidence Matrix", "Action Plan"]
NOTHING = ["No findings.", "No data.", "No data.", "No recommendations."]


def _cell(c: Column, letters: int | None = None) -> Column:
    text = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " ")
    return text if letters is None else F.substring(text, 1, letters)


def _lines(df: DataFrame, section: int, place: list[Column], line: Column) -> DataFrame:
    zeros = [F.lit(0)] * (3 - len(place))
    a, b, c = [p.cast("bigint") for p in (*place, *zeros)]
    return df.select("job_id", F.lit(section).alias("section"), a.alias("a"), b.alias("b"), c.alias("c"), line.alias("line"))


def job_reports(map_sample: DataFrame) -> DataFrame:
    """Lines of each job's report: ``job_id, section, a, b, c, line``, in the order of these columns.

    A report has four sections: how much was found; the distinct findings (by type,
    severity and the first 60 letters); their evidence; the distinct recommendations. A
    section without lines says so.
    """
    res = results(map_sample).select("job_id", "result_id", "recommendations")
    found = first_of(findings(map_sample).select("job_id", "result_id", "pos", "severity", "finding_type", "explanation", "finding_id", "refs"), [F.col("job_id"), *finding_key(60)], ["result_id", "pos", "finding_id"])
    jobs = res.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_results"))
    numbers = null_safe_join(jobs, found.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("severity").isin("critical", "high"), 1)).alias("grave")), ["job_id"], "left").fillna(0, ["n", "grave"])
    first = _lines(numbers, 1, [F.lit(1)], F.when(F.col("n") > 0, F.concat(F.lit("Findings: "), "n", F.lit(", critical or high: "), "grave", F.lit(", passages: "), "n_results")).otherwise(NOTHING[0]))
    listed = _lines(found, 2, [F.col("result_id"), F.col("pos") + 1], F.concat(F.lit("- **["), F.upper("severity"), F.lit("]** `"), "finding_type", F.lit("`: "), _cell(F.col("explanation"), 200)))
    refs = found.select("job_id", "result_id", "pos", F.posexplode("refs").alias("ref", "r")).filter("r is not null")
    evidence = _lines(refs, 3, [F.col("result_id"), F.col("pos") + 1, F.col("ref") + 1], F.concat(F.lit("| "), _cell(F.col("r.file")), F.lit(" | "), _cell(F.col("r.chunk")), F.lit(" | "), _cell(F.col("r.quote"), 80), F.lit(" |")))
    advice = res.select("job_id", "result_id", F.posexplode("recommendations").alias("pos", "r")).filter("trim(r) <> ''").groupBy("job_id", F.trim("r").alias("r")).agg(F.min(F.struct("result_id", "pos")).alias("p"))
    actions = _lines(advice, 4, [F.col("p.result_id"), F.col("p.pos") + 1], F.concat(F.lit("- "), _cell(F.col("r"))))
    body = listed.unionByName(evidence).unionByName(actions)
    wanted = jobs.select("job_id", F.explode(F.array(*[F.lit(i) for i in (2, 3, 4)])).alias("section"))
    there = null_safe_join(wanted, body.select("job_id", "section").distinct().withColumn("there", F.lit(True)), ["job_id", "section"], "left")
    empty = there.filter("there is null").select("job_id", "section", *[F.lit(0).cast("bigint").alias(c) for c in "abc"], F.element_at(F.array(*map(F.lit, NOTHING)), F.col("section")).alias("line"))
    heads = jobs.select("job_id", F.posexplode(F.array(*[F.lit(f"## {s}") for s in SECTIONS])).alias("i", "line")).select("job_id", (F.col("i") + 1).alias("section"), *[F.lit(-1).cast("bigint").alias(c) for c in "abc"], "line")
    return heads.unionByName(first).unionByName(body).unionByName(empty)


def write_reports(lines: DataFrame, path: str) -> None:
    """Reports as text files, a folder per job; lines in order."""
    order = ["section", "a", "b", "c"]
    lines.repartition("job_id").sortWithinPartitions("job_id", *order).select("job_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("job_id").text(os.fspath(path))
