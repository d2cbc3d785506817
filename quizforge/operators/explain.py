"""Sentences of a passage that explain an answer: scores, explanations, excerpts, trimmed passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import score_sentence, sentences

#: Characters of an excerpt or a passage, at most.
MOST = 1200


def scored(items: DataFrame) -> DataFrame:
    """(id, pos, s, score) of each sentence of items (id, text, question, answer); pos counts from 1."""
    each = items.select("id", "question", "answer", F.posexplode(sentences(F.col("text"))).alias("i", "s"))
    return each.select("id", (F.col("i") + 1).alias("pos"), "s", score_sentence(F.col("s"), F.col("question"), F.col("answer")).alias("score"))


def best_sentences(items: DataFrame, k: int = 2) -> DataFrame:
    """The k best sentences of each item (ties: the first); pos gives the order in the passage."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "pos"))
    return scored(items).withColumn("rank", rank).where(F.col("rank") <= k)


def explanations(items: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, explanation, two): 'X is correct.', the first of the two best sentences and the other one if it scores over `least`."""
    two = best_sentences(items, 2).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "s", "score"))).alias("b"))
    first, other = F.col("b")[0]["s"], F.when(F.get(F.col("b"), F.lit(1))["score"] > least, F.get(F.col("b"), F.lit(1))["s"])
    found = items.select("id", "answer").join(two, "id")
    return found.select("id", F.concat_ws(" ", F.concat("answer", F.lit(" is correct.")), first, other).alias("explanation"), other.isNotNull().alias("two"))


def _with_best(items: DataFrame) -> DataFrame:
    best = best_sentences(items, 1).select("id", F.col("pos").alias("best"))
    return items.join(best, "id", "left")


def excerpts(items: DataFrame) -> DataFrame:
    """(id, excerpt): the best sentence with the one before and the one after, at most MOST characters; null without sentences."""
    around = F.slice(sentences(F.col("text")), F.greatest(F.col("best") - 1, F.lit(1)), F.lit(3))
    return _with_best(items).select("id", F.when(F.col("best").isNotNull(), F.substring(F.array_join(around, " "), 1, MOST)).alias("excerpt"))


def prefix_within(parts: Column, most: int) -> Column:
    """The parts joined by spaces up to the last that still fits: the first overflow ends it."""
    start = F.struct(F.lit("").alias("kept"), F.lit(True).alias("open"))

    def take(s: Column, x: Column) -> Column:
        empty = s["kept"] == ""
        more = s["open"] & (F.length(s["kept"]) + F.when(empty, F.lit(0)).otherwise(F.lit(1)) + F.length(x) <= most)
        return F.struct(F.when(more, F.concat(s["kept"], F.when(empty, "").otherwise(" "), x)).otherwise(s["kept"]).alias("kept"), more.alias("open"))

    return F.aggregate(parts, start, take, lambda s: s["kept"])


def trimmed(items: DataFrame, most: int = MOST) -> DataFrame:
    """(id, passage): the whole text if it is short, else sentences from two before the best on while they fit, else a hard cut."""
    ss = sentences(F.col("text"))
    run = prefix_within(F.slice(ss, F.greatest(F.col("best") - 2, F.lit(1)), F.greatest(F.size(ss), F.lit(1))), most)
    cut = F.when(F.length("text") <= most, F.col("text")).when(F.col("best").isNotNull() & (run != ""), run).otherwise(F.substring("text", 1, most))
    return _with_best(items).select("id", cut.alias("passage"))
