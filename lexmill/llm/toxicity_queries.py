"""Queries of problem 7 over documents, trained on labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.toxicity import FLAG, fit_on, score_documents
from lexmill.session import table


def plain_source(source: str):
    """Source in plain spelling; null and blank ones are "unknown"."""
    plain = F.lower(F.regexp_replace(F.trim(F.col(source)), r"[\s_]+", "-"))
    return F.when(F.coalesce(plain, F.lit("")) == "", "unknown").otherwise(plain)


def scored(spark: SparkSession, root: str, with_spans: bool) -> DataFrame:
    documents = table(spark, root, "documents")
    return score_documents(documents, fit_on(documents, table(spark, root, "labels")), with_spans)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return scored(spark, root, False).filter(F.col("score") >= FLAG).select("doc_id").distinct()


def p7_scores(spark: SparkSession, root: str) -> DataFrame:
    """Score and offending offsets of every document."""
    return scored(spark, root, True).select("doc_id", plain_source("source").alias("source"), F.round("score", 6).alias("score"), "spans")


def p7_source_rates(spark: SparkSession, root: str) -> DataFrame:
    """Documents, offending documents and their rate by source."""
    per = scored(spark, root, False).groupBy(plain_source("source").alias("source"))
    flagged = F.count(F.when(F.col("score") >= FLAG, 1))
    return per.agg(F.count(F.lit(1)).alias("n_docs"), flagged.alias("n_toxic"), (flagged / F.count(F.lit(1))).alias("rate"))


QUERIES = {"p7_found": p7_found, "p7_scores": p7_scores, "p7_source_rates": p7_source_rates}
SQL: dict[str, str] = {}
