"""Choice of contexts for an answer as windows over bounded rankings: near-duplicates, shares of sources, budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import count_tokens, strip_headers
from lexmill.operators.chunking import bounds


def contexts(ranked: DataFrame, max_tokens: int = 8000, max_items: int = 12, char_cap: int = 6000, per_source: int = 5) -> DataFrame:
    """``qid, n, chunk_id, source_path, score`` of the contexts chosen from ``qid, chunk_id, source_path, text, score, rank``.

    Rankings are short (candidates of one question). Texts are cut to ``char_cap``
    letters. Of texts that agree in their first 240 letters (service lines, spaces and
    case aside) the best ranked stays, blank ones go. Each source gives its best
    ``per_source`` first: these are taken by rank until one is over the budget or
    ``max_items`` are reached. Then the others ranked above that one are taken in the
    same way. The first context is taken at any size.
    """
    text = F.substring(F.coalesce("text", F.lit("")), 1, char_cap)
    key = F.substring(F.lower(F.trim(F.regexp_replace(strip_headers(text), r"\s+", " "))), 1, 240)
    hits = ranked.select("qid", "chunk_id", F.coalesce("source_path", F.lit("")).alias("source_path"), "score", "rank", count_tokens(text).alias("tokens"), key.alias("key")).filter("key <> ''")
    by_rank = lambda *keys: Window.partitionBy("qid", *keys).orderBy("rank", "chunk_id")
    hits = hits.withColumn("again", F.row_number().over(by_rank("key"))).filter("again = 1")
    hits = hits.withColumn("held", F.row_number().over(by_rank("source_path")) > per_source)
    # running sums within each round; a round is over at its first hit that doesn't fit
    so_far = by_rank("held").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("sum", F.sum("tokens").over(so_far)).withColumn("count", F.count(F.lit(1)).over(so_far))
    fits = ~F.col("held") & (((F.col("sum") <= max_tokens) | (F.col("count") == 1)) & (F.col("count") <= max_items))
    whole = Window.partitionBy("qid")
    hits = hits.withColumn("first_round", fits)
    hits = hits.withColumn("used", F.sum(F.when(fits, F.col("tokens"))).over(whole)).withColumn("taken", F.count(F.when(fits, 1)).over(whole)).withColumn("stop", F.min(F.when(~F.col("held") & ~fits, F.col("rank"))).over(whole))
    second = F.col("held") & (F.col("stop").isNull() | (F.col("rank") < F.col("stop"))) & (F.col("used") + F.col("sum") <= max_tokens) & (F.col("taken") + F.col("count") <= max_items)
    chosen = hits.filter(F.col("first_round") | second)
    return chosen.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("held", "rank", "chunk_id")).alias("n"), "chunk_id", "source_path", "score")


def batch_units(units: DataFrame, max_tokens: int = 2500) -> DataFrame:
    """``units`` (``qid, n, text`` and others) with the number of their ``batch``: in order, filled up to the budget.

    The units of a question are few (they were capped when gathered). A larger unit is alone.
    """
    sized = units.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", count_tokens(F.col("text")).alias("t")))).alias("u"))
    runs = sized.select("qid", "u", F.posexplode(bounds(F.transform("u", lambda x: x["t"]), max_tokens)).alias("b", "at"))
    placed = runs.select("qid", F.explode(F.slice("u", F.col("at.lo") + 1, F.col("at.hi") - F.col("at.lo"))).alias("x"), (F.col("b") + 1).alias("batch")).select("qid", F.col("x.n").alias("n"), "batch")
    return units.join(placed, ["qid", "n"])


def fan_in(items: DataFrame, size: int = 10) -> DataFrame:
    """``items`` (``qid, n``, n from 1) with the groups they fall into when they are summed up by ``size``, level by level: ``level_groups``."""
    most = F.max("n").over(Window.partitionBy("qid"))
    levels = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log(F.greatest(F.col("most"), F.lit(2)).cast("double")) / F.log(F.lit(float(size))) - 1e-9).cast("int"))), lambda level: F.floor((F.col("n") - 1) / F.pow(F.lit(float(size)), level)).cast("int") + 1)
    return items.withColumn("most", most).withColumn("level_groups", levels).drop("most")


def reduce_notes(notes: DataFrame, size: int = 10, depth: int = 6) -> DataFrame:
    """``qid, text``: notes (``qid, n, text``, n from 1) of each question merged by ``size``, level by level, to one.

    By rule a merge keeps each line once, in order. ``depth`` bounds the levels; what is
    then left is merged at once. A group never holds more than ``size`` notes before that.
    """
    level = notes.select("qid", "n", "text")
    most = notes.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
    for at in range(depth):
        if most <= 1:
            break
        width = size if at < depth - 1 else most
        group = F.floor((F.col("n") - 1) / width).cast("int") + 1
        lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: F.split(F.coalesce(x["text"], F.lit("")), "\n")))
        level = level.groupBy("qid", group.alias("n")).agg(F.array_join(F.array_distinct(F.filter(lines, lambda x: F.trim(x) != "")), "\n").alias("text"))
        most = -(-most // width)
    return level.select("qid", "text")
