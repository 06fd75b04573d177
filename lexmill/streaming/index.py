"""Incremental index of a corpus: built once, appended to from batches or from a stream of files, rebuilt when it must be."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import chunk_id, content_hash, strip_headers
from lexmill.operators import lexical as L
from lexmill.operators.chunking import semantic_chunks
from lexmill.operators.models import EmbedModel, embed_chunks
from lexmill.operators.query_plan import lexical_query
from lexmill.operators.vectors import nearest
from lexmill.session import materialise

#: Buckets of content hashes (their first two digits).
HASHES = "source_path string, text string, content_hash string, bucket string"


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """Table below ``path``, or None if there is none; any other fault is raised."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_new(batch: DataFrame, path: str) -> None:
    """Append rows of ``source_path, text`` whose text isn't in the index yet; within a batch the first path stays.

    Hashes are stored by bucket; only the buckets that the batch falls into are read.
    """
    fresh = batch.filter("text is not null").select("source_path", "text", content_hash(F.col("text")).alias("content_hash"))
    fresh = fresh.groupBy("content_hash").agg(F.min(F.struct("source_path", "text")).alias("r")).select("r.source_path", "r.text", "content_hash", F.substring("content_hash", 1, 2).alias("bucket"))
    before = stored(batch.sparkSession, path, HASHES)
    if before is not None:
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most 256
        fresh = fresh.join(before.filter(F.col("bucket").isin(touched)).select("bucket", "content_hash"), ["bucket", "content_hash"], "left_anti") if touched else fresh
    fresh.select("source_path", "text", "content_hash", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def removed_sources(index: DataFrame, current: DataFrame) -> DataFrame:
    """Indexed paths that no longer exist; any such path asks for a rebuild."""
    return index.select("source_path").distinct().join(current.select("source_path").distinct(), "source_path", "left_anti")


def follow(spark: SparkSession, folder: str, path: str, checkpoint: str):
    """Stream of text files below ``folder`` into the index; resumes from its checkpoint."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    return files.writeStream.foreachBatch(lambda df, _: append_new(df, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class CorpusIndex:
    """Chunks, postings and vectors of a corpus below ``root``.

    ``build`` writes all anew, ``update`` appends new files and says whether it could, or
    rebuilds: if there is no index, its settings differ (chunk size, overlap, model) or an
    indexed file is gone. ``search`` fuses both arms. A version is in force from the moment
    its settings file is written, so a build that fails leaves the former one.
    """

    def __init__(self, spark: SparkSession, root: str, budget: int = 800, overlap: int = 100, model: EmbedModel | None = None, model_name: str = "hashed-terms"):
        self.spark, self.root, self.model = spark, root, model
        self.settings = {"budget": budget, "overlap": overlap, "model": model_name}

    def _versions(self) -> DataFrame | None:
        return stored(self.spark, f"{self.root}/versions", "at bigint, version string, settings string")

    def current(self) -> tuple[str, dict] | None:
        """Folder and settings of the version in force."""
        versions = self._versions()
        last = versions.orderBy(F.desc("at")).first() if versions is not None else None
        return (f"{self.root}/{last.version}", json.loads(last.settings)) if last else None

    def _chunks(self, files: DataFrame) -> DataFrame:
        text = semantic_chunks(F.col("text"), self.settings["budget"], self.settings["overlap"])
        rows = files.filter("text is not null").select("source_path", F.posexplode(text).alias("chunk_index", "text"))
        rows = rows.withColumn("content_hash", content_hash(F.col("text")))
        first = rows.groupBy("content_hash").agg(F.min(F.struct("source_path", "chunk_index", "text")).alias("r")).select("content_hash", "r.*")
        return first.withColumn("chunk_id", chunk_id(F.col("source_path"), F.col("chunk_index"), F.col("text")))

    def _add(self, folder: str, chunks: DataFrame, sources: DataFrame) -> int:
        """Appends chunks with new ids; their number."""
        known = stored(self.spark, f"{folder}/chunks")
        start = (known.agg(F.max("id").alias("m")).first().m if known is not None else None) or 0
        # ids are given once and read back, so a repeated task can't give others
        placed = materialise(chunks.withColumn("id", F.monotonically_increasing_id() + F.lit(start + 1)), "new-chunks")
        L.LexicalIndex(self.spark, folder).append(placed.select("id", strip_headers(F.col("text")).alias("text")))
        embed_chunks(placed.select("id", strip_headers(F.col("text")).alias("text")), self.model).write.mode("append").parquet(f"{folder}/vectors")
        sources.select("source_path").distinct().write.mode("append").parquet(f"{folder}/sources")
        placed.write.mode("append").parquet(f"{folder}/chunks")
        return placed.count()

    def build(self, files: DataFrame) -> dict[str, int]:
        """Index over all ``files`` (``source_path, text``)."""
        version, before = uuid.uuid4().hex, self._versions()
        self._add(f"{self.root}/{version}", self._chunks(files), files)
        at = ((before.agg(F.max("at").alias("m")).first().m if before is not None else None) or 0) + 1
        self.spark.createDataFrame([(at, version, json.dumps(self.settings))], "at bigint, version string, settings string").coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        return self.stats()

    def update(self, files: DataFrame) -> tuple[dict[str, int], bool]:
        """Numbers of the index after ``files`` (all that exist now), and whether they could be appended."""
        now = self.current()
        if now is None or now[1] != self.settings:
            return self.build(files), False
        folder = now[0]
        indexed, chunks = stored(self.spark, f"{folder}/sources"), stored(self.spark, f"{folder}/chunks")
        if removed_sources(indexed, files).limit(1).count():
            return self.build(files), False
        new = files.join(indexed.select("source_path").distinct(), "source_path", "left_anti")
        fresh = self._chunks(new).join(chunks.select("content_hash"), "content_hash", "left_anti")
        self._add(folder, fresh, new)
        return self.stats(), True

    def stats(self) -> dict[str, int]:
        """Numbers of chunks and of files that gave one."""
        r = stored(self.spark, f"{self.current()[0]}/chunks").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_path").alias("s")).first()
        return {"chunks": r.n, "sources": r.s}

    def search(self, questions: DataFrame, k: int = 8, hybrid: bool = True, tail: float = 0.15, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Best ``k`` chunks of each question (``qid, text``): ``qid, chunk_id, source_path, score, rank``.

        The lexical arm asks for the exact entities of a question if it names any. If
        questions can't be embedded, the lexical arm answers alone.
        """
        folder = self.current()[0]
        chunks = stored(self.spark, f"{folder}/chunks")
        index = L.LexicalIndex(self.spark, folder)
        deep = L.depth(k, chunks.count())
        arms = [L.search(index, questions.select("qid", lexical_query(F.col("text")).alias("text")), deep)]
        if hybrid:
            try:
                asked = (embed or (lambda q: embed_chunks(q, self.model)))(questions.select(F.col("qid").alias("id"), "text"))
                # questions and chunks number themselves apart, so a question isn't taken for its own chunk
                apart = materialise(asked.select((-1 - F.col("id")).alias("id"), "vector"), "questions")
                arms.append(nearest(apart, stored(self.spark, f"{folder}/vectors"), deep).select((-1 - F.col("qid")).alias("qid"), "id", "score", "rank"))
            except Exception as e:  # the embedder is an outside service
                print(f"questions not embedded, lexical arm only: {type(e).__name__}")
        arms = [materialise(a, "arm") for a in arms]
        ranked = L.cut_tail(L.top(L.score_fusion(arms), k), tail)
        return ranked.join(chunks.select("id", "chunk_id", "source_path", "text"), "id").select("qid", "chunk_id", "source_path", "text", "score", "rank")
