"""Corpus planning: relevance of files, manifests, estimates, scouting, job state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the relevance of a file and of the plan's estimates.
BASE, PER_NAME, PER_HIT, MOST_HITS = 0.25, 0.15, 0.12, 0.45
SCOUT_FLOOR, SCOUT_SHRINK, CHUNK_SECONDS, SCOUT_SECONDS, WORKERS = 0.45, 0.65, 8, 2, 4


def relevance(name: Column, text: Column, terms: Sequence[str]) -> Column:
    """Relevance of a file for query terms: by its name and by hits at the head of its text."""
    low_name, head = F.lower(name), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 4096))
    named = sum((F.when(low_name.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    hits = sum((F.when(head.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    score = BASE + PER_NAME * named + F.least(F.lit(MOST_HITS), PER_HIT * hits)
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


#: Files, and bytes, that make a corpus large, and bytes from which a plain file is read as a stream of lines.
MANY_FILES, MANY_BYTES, STREAMED = 12, 20_000_000, 50 << 20


def is_large(n_files: Column, n_bytes: Column) -> Column:
    return (n_files >= MANY_FILES) | (n_bytes >= MANY_BYTES)


def keep_relevant(files: DataFrame, threshold: float) -> DataFrame:
    """Files (``score``) of at least 0.85 of the threshold, and 0.15; all of them if none is."""
    floor = max(0.15, 0.85 * threshold)
    some = files.filter(F.col("score") >= floor).limit(1).count() > 0
    return files.filter(F.col("score") >= floor) if some else files


def pending(wanted: DataFrame, stored: DataFrame, keys: Sequence[str], at: str | None = None, now: Column | None = None, days: int = 7) -> DataFrame:
    """``wanted`` rows without a stored result; those stored more than ``days`` ago (column ``at``) don't count."""
    kept = stored if at is None else stored.filter(F.col(at) >= (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(days)))
    return wanted.join(kept.select(*keys).distinct(), list(keys), "left_anti")


def scout_score(score: Column, relevant: Column, nothing: Column) -> Column:
    """Scout verdict as a score: nothing found is 0, a yes is at least 0.45, clamped to 0..1."""
    s = F.coalesce(score, F.lit(0.0))
    s = F.when(F.coalesce(relevant, F.lit(False)), F.greatest(s, F.lit(SCOUT_FLOOR))).otherwise(s)
    return F.when(F.coalesce(nothing, F.lit(False)), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))


def keep_scouted(chunks: DataFrame, verdicts: DataFrame, key: str, threshold: float) -> DataFrame:
    """Chunks whose score reaches the threshold or is unknown."""
    return chunks.join(verdicts, key, "left").filter(F.col("score").isNull() | (F.col("score") >= threshold))


def plan(files: DataFrame, chunk_tokens: int = 6000, threshold: float = 0.45) -> DataFrame:
    """Estimates of chunks and time over files (``n_bytes``)."""
    chunks = F.ceil(F.greatest(F.lit(1), F.floor(F.col("n_bytes") / 4)) / chunk_tokens)
    total = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum(chunks), F.lit(0)).alias("n_chunks"))
    kept = F.ceil(F.col("n_chunks") * (1 - (1 - threshold) * SCOUT_SHRINK))
    return total.withColumn("n_after_scout", kept).withColumn("seconds", F.ceil(F.col("n_after_scout") * CHUNK_SECONDS / WORKERS) + F.col("n_chunks") * SCOUT_SECONDS).withColumn("warning", F.when(F.col("n_chunks") > 50_000, "many chunks").when(F.col("n_bytes") > 2_000_000_000, "large input").otherwise(""))


def job_id(paths: Column, query: Column) -> Column:
    """Identity of a job: hash of its sorted paths and query."""
    return F.substring(F.sha2(F.concat_ws("\n", F.array_sort(paths), query), 256), 1, 24)
