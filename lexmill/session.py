"""Session helpers: table access and lineage cuts in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` below ``root``; a file or a folder of part files."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only where the cluster names none (tests, a local master) a folder of the
    driver's machine is taken, and remembered in the session.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lexmill.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("lexmill.shared.dir", named)
    return named


def own_dir(spark: SparkSession) -> str:
    """Folder of this application's tables in the shared folder."""
    return os.path.join(shared_dir(spark), "lexmill", spark.sparkContext.applicationId)


def materialise(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The written files survive the loss of any executor, so later stages don't
    recompute what lies before the cut. They stay until ``clear`` is called, as results
    are read from them.
    """
    spark = df.sparkSession
    path = os.path.join(own_dir(spark), f"{tag}-{uuid.uuid4().hex}")
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application wrote by ``materialise``, once no result needs them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
