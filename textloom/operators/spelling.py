"""Spelling correction by k-gram overlap and the indel distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings
from .search import small

JACCARD, DISTANCE = 0.4, 2


def overlaps(words: DataFrame, vocab: DataFrame, *, k: int = 2, most: int | None = DISTANCE) -> DataFrame:
    """word, term, df, jaccard of all pairs that share a k-gram.

    most: a term within that distance differs in length by as much at most, so lengths
    cut the join before anything is counted."""
    gram = lambda df, c: df.select("*", F.explode(strings.kgrams(F.col(c), k)).alias("kgram"))
    sized = lambda df, c: df.withColumn(f"n_{c}", F.size(strings.kgrams(F.col(c), k)))
    w = gram(words.select("word").distinct(), "word")
    met = gram(vocab.select("term", "df"), "term").join(small(w), "kgram")
    if most is not None:
        met = met.where(F.abs(F.length("word") - F.length("term")) <= most)
    # sizes are made for pairs that meet, not for every k-gram of the vocabulary
    shared = sized(sized(met.groupBy("word", "term", "df").agg(F.count("*").alias("both")), "word"), "term")
    return shared.select("word", "term", "df", strings.jaccard(F.col("n_word"), F.col("n_term"), F.col("both")).alias("jaccard"))


def candidates(words: DataFrame, vocab: DataFrame, *, k: int = 2, least: float = JACCARD, most: int = DISTANCE, in_bytes: bool = False) -> DataFrame:
    """word, term, jaccard, distance, score for each word's corrections. in_bytes: as for `strings.indel_distance`."""
    scored = overlaps(words, vocab, k=k, most=most).where(F.col("jaccard") >= least)
    found = scored.withColumn("distance", strings.indel_distance(F.col("word"), F.col("term"), in_bytes=in_bytes)).where(F.col("distance") <= most)
    return found.select("word", "term", "jaccard", "distance", (F.col("jaccard") / (F.col("distance") + 1) * (1 + F.ln(F.col("df") + 1))).alias("score"))


def correct(q: DataFrame, vocab: DataFrame, *, limit: int = 10, slots: int | None = None, in_bytes: bool = False) -> DataFrame:
    """query_id, rank, phrase, score: up to `limit` corrected phrases for each query.

    Known terms stand for themselves with score 1. A query with a slot that has no
    candidate gets nothing. After each slot from the second on the best 5 * limit stay."""
    words = q.select("query_id", "idx", F.col("term").alias("word"))
    known = words.join(vocab.select(F.col("term").alias("word")), "word", "left_semi").select("query_id", "idx", F.col("word").alias("term"), F.lit(1.0).alias("score"))
    unknown = words.join(vocab.select(F.col("term").alias("word")), "word", "left_anti")
    fixed = unknown.join(candidates(unknown, vocab, in_bytes=in_bytes), "word").select("query_id", "idx", "term", "score")
    options = known.unionByName(fixed)
    slots = slots if slots is not None else (q.agg(F.max("idx")).first()[0] or 0) + 1
    size = q.groupBy("query_id").agg(F.count_distinct("idx").alias("size"))
    done = options.where("idx = 0").select("query_id", F.col("term").alias("phrase"), "score")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "phrase")
    ready = done.withColumn("slots", F.lit(1))
    for i in range(1, slots):
        more = options.where(F.col("idx") == i).select("query_id", "term", F.col("score").alias("s"))
        done = done.join(more, "query_id").select("query_id", F.concat_ws(" ", "phrase", "term").alias("phrase"), (F.col("score") * F.col("s")).alias("score"))
        done = done.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 5 * limit).drop("r")
        ready = ready.unionByName(done.withColumn("slots", F.lit(i + 1)))
    whole = ready.join(size, (ready.query_id == size.query_id) & (ready.slots == size.size)).select(ready.query_id, "phrase", "score")
    return whole.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= limit).select("query_id", "rank", "phrase", "score")


def shown(phrase, most: int = 50):
    """A phrase as a dialog shows it: cut after `most` characters."""
    return F.when(F.length(phrase) > most, F.concat(F.substring(phrase, 1, most), F.lit("..."))).otherwise(phrase)
