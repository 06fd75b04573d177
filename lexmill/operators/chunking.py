"""Texts into chunks under a token budget, as expressions over arrays of segments (no Python per row)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import count_tokens

#: Most tokens of a segment before it is cut into sentences.
SEGMENT_TOKENS = 8000
#: Splits a text into sentences: a mark put after each sentence end.
MARK = "\x1f"


def estimate(text: str) -> int:
    """Offline estimate of tokens: a quarter of the letters, at least one; blank texts have none."""
    return max(1, len(text) // 4) if text.strip() else 0


def bounds(sizes: Column, budget: int, overlap: bool = False) -> Column:
    """Stretches (``lo``, ``hi``) of an array of sizes: whole units in order, filled up to the budget.

    A larger unit is alone. With ``overlap`` a stretch begins with the last unit of the
    one before it, unless either is such a larger unit. Stretches are half open.
    """
    state = F.struct(F.array().cast("array<struct<lo:int,hi:int>>").alias("done"), F.lit(0).alias("lo"), F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("fill"), F.lit(0).cast("bigint").alias("last"))

    def step(s: Column, n: Column) -> Column:
        n = n.cast("bigint")
        closed = F.concat(s["done"], F.array(F.struct(s["lo"].alias("lo"), s["at"].alias("hi"))))
        some, large, again = s["at"] > s["lo"], n > budget, F.lit(overlap)
        full = some & ((s["fill"] + n) > budget)
        done = F.when(large, F.concat(F.when(some, closed).otherwise(s["done"]), F.array(F.struct(s["at"].alias("lo"), (s["at"] + 1).alias("hi"))))).when(full, closed).otherwise(s["done"])
        lo = F.when(large, s["at"] + 1).when(full, s["at"] - again.cast("int")).otherwise(s["lo"])
        fill = F.when(large, F.lit(0).cast("bigint")).when(full & again, s["last"] + n).when(full, n).otherwise(s["fill"] + n)
        return F.struct(done.alias("done"), lo.alias("lo"), (s["at"] + 1).alias("at"), fill.alias("fill"), n.alias("last"))

    end = lambda s: F.when(s["at"] > s["lo"], F.concat(s["done"], F.array(F.struct(s["lo"].alias("lo"), s["at"].alias("hi"))))).otherwise(s["done"])
    return F.aggregate(sizes, state, step, end)


def packed(units: Column, budget: int, separator: str, overlap: bool = False) -> Column:
    """Whole units joined into runs, as of ``bounds``; one fold, in which ``units`` stand once, so they are made once."""
    sized = F.transform(units, lambda x: F.struct(x.alias("x"), count_tokens(x).cast("bigint").alias("n")))
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    state = F.struct(F.array().cast("array<string>").alias("done"), none.alias("now"), zero.alias("fill"), none.alias("last"), zero.alias("last_n"))

    def step(s: Column, u: Column) -> Column:
        some, large = s["now"].isNotNull(), u["n"] > budget
        full = some & (s["fill"] + u["n"] > budget)
        closed = F.concat(s["done"], F.array(s["now"]))
        again = F.lit(overlap)
        return F.struct(
            F.when(large, F.concat(F.when(some, closed).otherwise(s["done"]), F.array(u["x"]))).when(full, closed).otherwise(s["done"]).alias("done"),
            F.when(large, none).when(full & again, F.concat(s["last"], F.lit(separator), u["x"])).when(full | ~some, u["x"]).otherwise(F.concat(s["now"], F.lit(separator), u["x"])).alias("now"),
            F.when(large, zero).when(full & again, s["last_n"] + u["n"]).when(full, u["n"]).otherwise(s["fill"] + u["n"]).alias("fill"),
            u["x"].alias("last"),
            u["n"].alias("last_n"),
        )

    return F.aggregate(sized, state, step, lambda s: F.when(s["now"].isNotNull(), F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def packed_groups(sizes: Column, budget: int) -> Column:
    """Number of runs that whole units of such sizes make."""
    return F.size(bounds(sizes, budget))


def segments(text: Column, budget: int) -> Column:
    """Paragraphs and sections (from heading to heading) of a text; very long ones as runs of sentences."""
    limit = min(SEGMENT_TOKENS, budget)
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), r"\n(#{1,6}\s)", "\n\n$1")
    parts = F.filter(F.transform(F.split(apart, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    sentences = lambda p: F.split(F.regexp_replace(p, r"([.!?])\s+", "$1" + MARK), MARK)
    return F.flatten(F.transform(parts, lambda p: F.when(count_tokens(p) <= limit, F.array(p)).otherwise(packed(sentences(p), limit, " "))))


def windows(text: Column, budget: int, overlap: int) -> Column:
    """Windows of ``budget`` tokens (four letters each), each starting ``budget - overlap`` after the last."""
    size, step = budget * 4, max(1, budget - overlap) * 4
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - F.lit(max(0, size - step)) - 1), F.lit(step))
    return F.transform(starts, lambda a: F.substring(text, a + 1, F.lit(size)))


def semantic_chunks(text: Column, budget: int = 800, overlap: int = 100) -> Column:
    """Chunks of whole segments under the budget; with overlap each begins with the last segment of the one before.

    A segment that is longer than the budget gives windows of its own.
    """
    chunks = packed(segments(text, budget), budget, "\n\n", overlap > 0)
    # two overlapping segments may pass the budget together; only a chunk of one segment is cut
    return F.flatten(F.transform(chunks, lambda c: F.when((count_tokens(c) > budget) & ~F.contains(c, F.lit("\n\n")), windows(c, budget, overlap)).otherwise(F.array(c))))


def chunk_documents(documents: DataFrame, budget: int = 800, overlap: int = 100) -> DataFrame:
    """``doc_id, chunk_index, text`` of every document (``doc_id, text``)."""
    return documents.select("doc_id", F.posexplode(semantic_chunks(F.col("text"), budget, overlap)).alias("chunk_index", "text"))


def window_chunks(documents: DataFrame, budget: int, overlap: int) -> DataFrame:
    """``windows`` of every document: ``doc_id, chunk_index, text``."""
    return documents.filter(F.length("text") > 0).select("doc_id", F.posexplode(windows(F.col("text"), budget, overlap)).alias("chunk_index", "text"))


def file_parts(documents: DataFrame, most_tokens: int = 80_000) -> DataFrame:
    """``doc_id, part, n_parts, text``: documents above the limit in parts of that many tokens, others whole."""
    parts = F.when(count_tokens(F.col("text")) > most_tokens, windows(F.col("text"), most_tokens, 0)).otherwise(F.array("text"))
    split = documents.filter(F.length("text") > 0).select("doc_id", parts.alias("parts"))
    return split.select("doc_id", F.posexplode("parts").alias("i", "text"), F.size("parts").alias("n_parts")).select("doc_id", (F.col("i") + 1).alias("part"), "n_parts", "text")


def table_texts(rows: DataFrame, rows_per_batch: int) -> DataFrame:
    """``n_rows, text``: rows of a table in batches as tab-separated text under the names of its columns.

    Batches are cut within tasks, so no order over the whole table is needed; each row is in one batch.
    """
    names = rows.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int32()), pa.array(["\n".join(["\t".join(names), *held])])], names=["n_rows", "text"])
            held.clear()
            return done

        for b in batches:
            for line in b.column("line").to_pylist():
                held.append(line)
                if len(held) == rows_per_batch:
                    yield out()
        if held:
            yield out()

    plain = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names])
    return rows.select(plain.alias("line")).mapInArrow(cut, "n_rows int, text string")
