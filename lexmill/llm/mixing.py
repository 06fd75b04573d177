"""Mixing sources to target shares by systematic sampling.

Each source's documents stand in a row ordered by size and key hash. A document's
expected copies are summed up along the row, one random offset per mix and source
is added, and the document is used once per whole number that its stretch
crosses. Neighbours in size stand together, so the number of copies drawn is off by
less than one and the tokens by less than the longest document of the source. As a
few very long documents may weigh much, the expected copies of a source are first
calibrated within a quarter, so that the tokens drawn by that offset come nearest to
its share; what remains is reported beside the longest document used.
The prefix sums are taken in two levels (groups by size class and hash, then the few
groups of a source), so no source is one task.

Edge cases: documents without key, source or tokens can't be chosen; repeated rows
count once; targets that spell one source in several ways are added up (the lowest
number of repeats holds); those without name, source, share or repeats are left out;
a source without documents gets nothing and the others keep their proportions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import materialise

#: Hash groups of a size class; sizes are classed by eighths of a power of two.
GROUPS = 256
#: Rows of the plan (mixes times sources) up to which it is broadcast; a longer one is joined by source.
FEW_TARGETS = 100_000
#: Factors of the expected copies that are tried for each mix and source.
FACTORS = [1 + (j - 16) / 64 for j in range(33)]


def plain_source(source: Column) -> Column:
    """Source in plain spelling: lower case, trimmed, hyphens for blanks and underscores; blank is null."""
    plain = F.lower(F.regexp_replace(F.trim(source), r"[\s_]+", "-"))
    return F.when(plain != "", plain)


def ranked(sizes: DataFrame, seed: int) -> DataFrame:
    """``doc_id, source, n_tokens, rank``: place of each document within its source, by size."""
    s = sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("size_class", F.floor(8 * F.log2("n_tokens")).cast("int")).withColumn("part", F.pmod("h", F.lit(GROUPS)).cast("int"))
    groups = ["source", "size_class", "part"]
    s = s.withColumn("within", F.row_number().over(Window.partitionBy(*groups).orderBy("n_tokens", "h", "doc_id")))
    before = Window.partitionBy("source").orderBy("size_class", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = s.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).select(*groups, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return s.join(offsets, groups).select("doc_id", "source", "n_tokens", (F.col("offset") + F.col("within")).alias("rank"))


def plain_targets(targets: DataFrame) -> DataFrame:
    """Usable targets, a row per mix and source in plain spelling."""
    t = targets.filter("mix_name is not null and target_share > 0 and max_repeats >= 1").select("mix_name", plain_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    return t.filter("source is not null").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def mix_plan(totals: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Expected copies per document for each mix and source.

    ``totals``: ``source, source_tokens``; ``targets``: ``mix_name, source,
    target_share, max_repeats``. Without ``total_tokens`` a mix is as large as its
    shares allow: the source that first reaches its repeats sets the size. With it,
    a source that can't give its share gives all it may. Sources without documents
    get no copies.
    """
    t = plain_targets(targets).join(totals, "source", "left")
    limit = F.col("max_repeats") * F.col("source_tokens") / F.col("target_share")
    size = F.lit(float(total_tokens)) if total_tokens else F.min(limit).over(Window.partitionBy("mix_name"))
    expected = F.least(F.col("target_share") * size / F.col("source_tokens"), F.col("max_repeats").cast("double")) * (1 - 1e-12)
    return t.withColumn("expected", F.coalesce(expected, F.lit(0.0))).withColumn("aim", F.col("expected") * F.col("source_tokens"))


def draw(sizes: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: float | None = None) -> DataFrame:
    """Chosen documents of each mix: ``mix_name, source, doc_id, n_tokens, n_uses``.

    ``sizes``: ``doc_id, source, n_tokens``. Rows without a doc_id, source or tokens
    can't be chosen; repeated rows of a doc_id count once. No document is used more
    than its source's ``max_repeats``.
    """
    docs = sizes.filter("doc_id is not null and n_tokens > 0").withColumn("source", plain_source(F.col("source"))).filter("source is not null")
    docs = docs.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("d")).select("doc_id", "d.source", "d.n_tokens")
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    plan = mix_plan(totals, targets, total_tokens).filter("expected > 0").select("mix_name", "source", "expected", "max_repeats", "aim")
    offset = (F.pmod(F.xxhash64(F.lit(seed), "mix_name", "source"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    few = plan.limit(FEW_TARGETS + 1).collect()
    side = F.broadcast(sizes.sparkSession.createDataFrame(few, plan.schema)) if len(few) <= FEW_TARGETS else plan
    drawn = materialise(ranked(docs, seed).join(side, "source").withColumn("offset", offset), "p6-ranked")

    def uses(expected: Column) -> Column:
        return (F.floor(F.col("rank") * expected + F.col("offset")) - F.floor((F.col("rank") - 1) * expected + F.col("offset"))).cast("int")

    # expected copies are calibrated: of a few factors beside 1 the one whose draw, by the one offset, comes nearest to the share
    scaled = [F.least(F.col("expected") * f, F.col("max_repeats") * (1 - 1e-12)) for f in FACTORS]
    tried = drawn.groupBy("mix_name", "source").agg(F.first("aim").alias("aim"), F.array(*[F.sum(F.col("n_tokens") * uses(e)) for e in scaled]).alias("sums"))
    off = F.array(*[F.struct(F.abs(F.col("sums")[j] - F.col("aim")).alias("off"), F.lit(abs(f - 1)).alias("far"), F.lit(f).alias("factor")) for j, f in enumerate(FACTORS)])
    factor = tried.select("mix_name", "source", F.array_min(off)["factor"].alias("factor"))
    chosen = drawn.join(F.broadcast(factor) if len(few) <= FEW_TARGETS else factor, ["mix_name", "source"])
    best = F.least(F.col("expected") * F.col("factor"), F.col("max_repeats") * (1 - 1e-12))
    return chosen.withColumn("n_uses", uses(best)).select("mix_name", "source", "doc_id", "n_tokens", "n_uses").filter("n_uses > 0")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of each source of each mix, and the longest document used, which bounds how far a share may be off."""
    got = drawn.groupBy("mix_name", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_uses").alias("n_uses"), F.max("n_uses").alias("most_uses"),
        F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens"), F.max("n_tokens").alias("longest"),
    )
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    out = plain_targets(targets).join(got, ["mix_name", "source"], "left").fillna(0, ["n_docs", "n_uses", "most_uses", "tokens", "longest"])
    return out.withColumn("actual_share", F.round(F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0), 6))
