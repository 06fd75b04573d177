"""Queries of problem 6 over documents and mix_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.mixing import draw, shares
from lexmill.llm.tokens import token_sizes
from lexmill.session import materialise, table


def p6_mix(spark: SparkSession, root: str) -> DataFrame:
    """Chosen documents of each mix with their number of uses."""
    sizes = materialise(token_sizes(table(spark, root, "documents")), "p6-sizes")
    return draw(sizes, table(spark, root, "mix_targets"))


def p6_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and reached shares of each mix and source."""
    return shares(p6_mix(spark, root), table(spark, root, "mix_targets"))


QUERIES = {"p6_mix": p6_mix, "p6_shares": p6_shares}
SQL: dict[str, str] = {}
