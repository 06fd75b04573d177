"""Duplicates hidden by formatting: canonical keys and an incremental ledger of counts.

The ledger has one row per canonical key: ``canon`` (128-bit hash of scope and
canonical fields), ``copies`` and ``first_key``, the earliest representative. It is
stored by buckets of the key, whose number follows the number of keys; a manifest
names the folder of each bucket, so that a later job can go on with it. A batch is
aggregated with a map-side combine, so a key holding a third of all rows arrives as
one row per task, and is full-outer-joined with the buckets it touches only.

Edge cases: a null field counts as empty; a batch without rows changes nothing;
repeated updates with other keys add up, an update that fails leaves the former
manifest in force.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import shared_dir

LEDGER_SCHEMA = "canon binary, copies bigint, first_key string"
MANIFEST_SCHEMA = "bucket int, folder string, keys bigint, buckets int"
#: Keys per bucket from which the number of buckets is raised, and the least number of buckets.
BUCKET_KEYS, LEAST_BUCKETS = 4_000_000, 16
#: Groups with more than this share of all records are joined by broadcast; there are fewer than 1 / HOT of them.
HOT = 1e-3
#: Private-use characters that stand for a kept minus sign and decimal point.
MINUS, POINT = "\ue000", "\ue001"
UNIT, RECORD = "\x1f", "\x1e"


def canonical_text(text: Column) -> Column:
    """Text without white space (visible or not), letter case and punctuation.

    The minus sign before a number and the point between two digits stay. A
    hyphen after a letter or digit (INV-12, 2024-01-02) is punctuation. Null is
    the empty string; a text of punctuation only is empty too.
    """
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"\p{Cf}+", "")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])[-\u2010\u2011\u2012\u2212\uFE63\uFF0D](?=\p{N})", MINUS)
    t = F.regexp_replace(t, r"(?<=\p{N})\.(?=\p{N})", POINT)
    t = F.regexp_replace(t, r"[\p{P}\p{Z}\s\p{Cc}`|~^]+", "")
    return F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))


def canonical_list(text: Column) -> Column:
    """Comma-separated entries in canonical spelling, sorted; blanks dropped, repeats kept."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), canonical_text)
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), UNIT)


def canonical_fields(text: Column) -> Column:
    """Flat JSON object with its fields in canonical spelling, sorted.

    Null, blank and {} are empty. What is no JSON object is compared as text.
    """
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    pairs = F.transform(entries, lambda e: F.concat(canonical_text(e["key"]), F.lit(UNIT), canonical_text(e["value"])))
    return F.coalesce(F.array_join(F.array_sort(pairs), RECORD), canonical_text(text))


def canonical_key(scope: Sequence[Column], fields: Sequence[Column]) -> Column:
    """128-bit hash of the scope as stored and the canonical fields."""
    return F.unhex(F.md5(F.to_json(F.array(*[F.coalesce(s.cast("string"), F.lit("")) for s in scope], *fields))))


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.hash("canon"), F.lit(buckets)).cast("int")


def batch_counts(records: DataFrame) -> DataFrame:
    """Ledger rows of one batch; ``records`` has ``canon`` and ``copy_key``."""
    return records.groupBy("canon").agg(F.count(F.lit(1)).alias("copies"), F.min("copy_key").alias("first_key"))


def add_counts(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Ledger after a batch: full outer join on the key, counts added, earliest key kept."""
    old, new = ledger.alias("old"), batch.alias("new")
    joined = old.join(new, F.col("old.canon") == F.col("new.canon"), "full_outer")
    return joined.select(
        F.coalesce("old.canon", "new.canon").alias("canon"),
        (F.coalesce("old.copies", F.lit(0)) + F.coalesce("new.copies", F.lit(0))).cast("bigint").alias("copies"),
        F.least("old.first_key", "new.first_key").alias("first_key"),
    )


class Ledger:
    """Ledger of canonical keys in a shared folder.

    ``update`` reads the buckets that the batch touches and writes them anew into a
    fresh folder; then a new manifest is written, of which the last finished one is
    in force. Opening a ``root`` again, in the same job or another, goes on from it.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.bucket_keys = spark, bucket_keys
        self.root = root or os.path.join(shared_dir(spark), "lexmill", f"ledger-{uuid.uuid4().hex}")
        self.version, self.folders, self.buckets, self.keys = 0, {}, LEAST_BUCKETS, 0
        finished = [int(p.split("=")[1]) for p in self._entries("manifest") if p.startswith("v=") and "_SUCCESS" in self._entries(f"manifest/{p}")]
        if finished:
            self.version = max(finished)
            rows = spark.read.schema(MANIFEST_SCHEMA).json(f"{self.root}/manifest/v={self.version}").collect()  # a row per bucket
            self._enforce(rows)

    def _entries(self, below: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _enforce(self, rows: Sequence) -> None:
        self.folders = {r.bucket: r.folder for r in rows}
        self.buckets = max([r.buckets for r in rows], default=LEAST_BUCKETS)
        self.keys = sum(r["keys"] for r in rows)
        self._keys_of = {r.bucket: r["keys"] for r in rows}

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of all buckets, or of some."""
        wanted = sorted(self.folders if buckets is None else set(buckets) & set(self.folders))
        if not wanted:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(*[f"{self.folders[b]}/bucket={b}" for b in wanted])

    def update(self, records: DataFrame) -> None:
        """Add a batch of ``canon, copy_key`` rows."""
        batch = batch_counts(records)
        buckets, touched = self.buckets, None
        keys = self.keys or batch_size(records)
        while keys > buckets * self.bucket_keys:
            buckets *= 2
        if self.folders:
            if buckets == self.buckets:  # a small batch touches few buckets; their list is at most ``buckets`` numbers
                touched = [r.bucket for r in records.select(bucket_of(buckets).alias("bucket")).distinct().collect()]
            batch = add_counts(self.read(touched), batch)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        # rebalanced by bucket: large buckets are split over several tasks, small ones share one
        batch.withColumn("bucket", bucket_of(buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema(f"{LEDGER_SCHEMA}, bucket int").parquet(folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("keys")).collect()
        kept = {b: (f, self._keys_of[b]) for b, f in self.folders.items()} if buckets == self.buckets else {}
        now = kept | {r.bucket: (folder, r["keys"]) for r in written}
        if now:
            rows = [(b, f, n, buckets) for b, (f, n) in sorted(now.items())]
            manifest = self.spark.createDataFrame(rows, MANIFEST_SCHEMA)
            manifest.coalesce(1).write.mode("errorifexists").json(f"{self.root}/manifest/v={self.version + 1}")
            self.version += 1
            self._enforce(manifest.collect())


def batch_size(records: DataFrame) -> int:
    """Approximate number of keys of a first batch."""
    return records.agg(F.approx_count_distinct("canon").alias("n")).first().n


def copies_of_first(records: DataFrame, ledger: DataFrame, hot: float = HOT) -> DataFrame:
    """A row per member of a group of copies other than its smallest key.

    ``records``: ``origin, scope_id, canon, copy_key``; each key once per scope. Groups
    that hold more than the share ``hot`` of all records are few by that bound and are
    joined by broadcast, where members lie; the others by their key.
    """
    groups = ledger.filter("copies > 1").select("canon", "first_key", "copies")
    least = max(1, int(hot * (ledger.agg(F.sum("copies").alias("n")).first().n or 0)))
    large = F.broadcast(groups.filter(F.col("copies") > least).select("canon", "first_key"))
    hits = records.join(large, "canon").unionByName(records.join(large, "canon", "left_anti").join(groups.filter(F.col("copies") <= least).select("canon", "first_key"), "canon"))
    return hits.filter("copy_key <> first_key").select("origin", "scope_id", "first_key", "copy_key")
