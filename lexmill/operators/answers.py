"""Answers to questions from their contexts by rule: sentences that share words with the question, cited and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.answers import REFUSAL, caveat, ungrounded
from lexmill.functions.text import strip_headers, tokenize
from lexmill.operators.chunking import MARK

#: Sentences of an answer, and words of the question that each must share.
SENTENCES, SHARED = 3, 2


def extract_answers(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """``qid, answer, refused, missing`` for each question (``qid, text``) from its numbered contexts (``qid, n, text``).

    The answer is the sentences that share most words with the question, at least two,
    in the order of their contexts and each with its number ``[n]``; without any it is the
    refusal. ``missing`` are tokens that the contexts lack: none here, but for an answer
    of another model the same check applies. Contexts of a question are few.
    """
    asked = questions.select("qid", F.array_distinct(tokenize(F.col("text"))).alias("words"))
    parts = F.split(F.regexp_replace(strip_headers(F.coalesce("text", F.lit(""))), r"([.!?])\s+|\n", "$1" + MARK), MARK)
    told = contexts.select("qid", "n", F.posexplode(parts).alias("pos", "s")).withColumn("s", F.trim("s")).filter("s <> ''").join(asked, "qid")
    told = told.withColumn("shared", F.size(F.array_intersect(tokenize(F.col("s")), "words"))).filter(F.col("shared") >= SHARED)
    once = told.groupBy("qid", "s").agg(F.min(F.struct(-F.col("shared"), "n", "pos")).alias("k")).select("qid", "s", (-F.col("k.col1")).alias("shared"), "k.n", "k.pos")
    best = once.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("shared"), "n", "pos"))).filter(F.col("r") <= SENTENCES)
    lines = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "pos", "s"))).alias("l"))
    answer = F.array_join(F.transform("l", lambda x: F.concat(x["s"], F.lit(" ["), x["n"].cast("string"), F.lit("]"))), " ")
    done = asked.select("qid").join(lines.select("qid", answer.alias("answer")), "qid", "left")
    return checked(done.select("qid", F.coalesce("answer", F.lit(REFUSAL)).alias("answer"), F.col("answer").isNull().alias("refused")), contexts)


def checked(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Answers with their tokens that none of their contexts holds (``missing``), named in a note."""
    source = contexts.groupBy("qid").agg(F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), " ").alias("source"))
    both = answers.join(source, "qid", "left")
    missing = both.withColumn("missing", ungrounded(F.col("answer"), F.coalesce("source", F.lit(""))))
    return missing.withColumn("answer", caveat(F.col("answer"), F.col("missing"))).drop("source")
