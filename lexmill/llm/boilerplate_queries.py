"""Queries of problem 1 over fetched_pages and fetched_docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.boilerplate import corpus_statistics, judge_pages
from lexmill.llm.mojibake import fit_counts
from lexmill.operators.snapshots import latest_version
from lexmill.session import table


def fetched(spark: SparkSession, root: str) -> DataFrame:
    """Rows of both import paths: origin, rec_id, url, title, text, version."""

    def part(name: str, key: str) -> DataFrame:
        return table(spark, root, name).select(F.lit(name).alias("origin"), F.col(key).alias("rec_id"), "url", "title", "text", F.col("fetched_at").alias("version"))

    return part("fetched_pages", "page_id").unionByName(part("fetched_docs", "fetch_id"))


def judged_pages(spark: SparkSession, root: str) -> DataFrame:
    pages = fetched(spark, root)
    ratios, pairs, words = corpus_statistics(pages)
    return judge_pages(pages, ratios, fit_counts(pairs, words))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines outside the main body, each page once (its latest row)."""
    judged = judged_pages(spark, root)
    latest = latest_version(judged, ["origin", "rec_id"], F.col("version"), F.col("outside"))
    return latest.select("origin", "rec_id", F.explode("payload").alias("line_no"))


def p1_main_text(spark: SparkSession, root: str) -> DataFrame:
    """Main body of each page."""
    judged = judged_pages(spark, root)
    return latest_version(judged, ["origin", "rec_id"], F.col("version"), F.col("main_text")).withColumnRenamed("payload", "main_text")


QUERIES = {"p1_found": p1_found, "p1_main_text": p1_main_text}
SQL: dict[str, str] = {}
