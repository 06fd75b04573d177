"""Queries of problem 5 over documents and container_sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.packing import pack_documents
from lexmill.llm.tokens import token_sizes
from lexmill.session import materialise, table


def p5_containers(spark: SparkSession, root: str) -> DataFrame:
    """Container of every document, and of every piece of one that exceeds the capacity."""
    sizes = materialise(token_sizes(table(spark, root, "documents")), "p5-sizes")
    return pack_documents(sizes, table(spark, root, "container_sizes"))


def p5_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers, pieces, tokens and unused space by capacity, and the share used."""
    packed = p5_containers(spark, root).filter("container_id is not null")
    per = packed.groupBy("container_name", "capacity_tokens", "container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("piece_tokens").alias("tokens"), F.max("unused_tokens").alias("unused"))
    used = F.sum("tokens") / (F.sum("tokens") + F.sum("unused"))
    return per.groupBy("container_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("tokens"), F.sum("unused").alias("unused_tokens"), F.round(used, 6).alias("share_used"))


QUERIES = {"p5_containers": p5_containers, "p5_fill": p5_fill}
SQL: dict[str, str] = {}
