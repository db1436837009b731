"""Retrieval for batches of queries: boolean, phrase, wildcard and ranked.

A batch is a table query_terms(query_id, idx, term, weight). It is a few rows
against a whole corpus, and is broadcast only while it stays so (`BATCH_ROWS`);
larger batches are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings
from ..session import written
from . import index

#: Rows of a query batch up to which it is broadcast.
BATCH_ROWS = 100_000


def parse_queries(spark: SparkSession, texts: list[str] | DataFrame) -> DataFrame:
    """query_id, idx, term, weight: lower-cased, split at white space, weight 1; no tokenizer."""
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, q string") if isinstance(texts, list) else texts
    split = F.array_remove(F.split(F.trim(F.lower("q")), r"\s+"), "")
    return df.select("query_id", F.posexplode(split).alias("idx", "term")).withColumn("weight", F.lit(1.0))


def query_sizes(q: DataFrame) -> DataFrame:
    """query_id, n_terms, length (sum of weights)."""
    return q.groupBy("query_id").agg(F.count("*").alias("n_terms"), F.sum("weight").alias("length"))


def fits(q: DataFrame) -> bool:
    """Whether a batch's rows are within the bound for a broadcast."""
    return q.limit(BATCH_ROWS + 1).count() <= BATCH_ROWS


def small(df: DataFrame, few: bool | None = None) -> DataFrame:
    """df with a broadcast hint, if its rows are within the bound.

    few: what is known of a batch that df has no more rows than."""
    return F.broadcast(df) if (fits(df) if few is None else few) else df


def expand_wildcards(q: DataFrame, vocab: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """Each wildcard term becomes all terms it matches, each with its full weight; idx stays (the slot).

    A pattern meets the terms that have one of its k-grams, by an equi-join with the
    k-gram index (`grams`, of two characters; made from the vocabulary if not given);
    the match itself is a LIKE. A pattern of single inner letters alone (`*a*`) has no
    such k-gram and meets the terms by its letter."""
    wild = q.where(F.contains("term", F.lit("*"))).withColumn("pattern", strings.like_pattern(F.col("term"))).where("pattern is not null")
    wild = wild.withColumn("gram", strings.longest_gram(F.col("term")))
    plain = q.where(~F.contains("term", F.lit("*"))).select("query_id", "idx", "term", "weight")
    few = fits(wild)
    letter = F.length("gram") == 1
    out = plain
    for rows, index_ in ((wild.where(~letter), grams if grams is not None else index.kgram_index(vocab, 2)), (wild.where(letter), index.kgram_index(vocab, 1))):
        found = index_.select("kgram", F.col("term").alias("found")).join(small(rows.withColumnRenamed("gram", "kgram"), few), "kgram").where(F.expr("found like pattern"))
        out = out.unionByName(found.select("query_id", "idx", F.col("found").alias("term"), "weight"))
    return out


def intersection(q: DataFrame, tf: DataFrame) -> DataFrame:
    """query_id, doc_id of documents that have a term of every slot of the query (AND)."""
    few = fits(q)
    slots = q.select("query_id", "idx", "term").distinct()
    need = q.groupBy("query_id").agg(F.count_distinct("idx").alias("need"))
    hit = tf.select("term", "doc_id").join(small(slots, few), "term").groupBy("query_id", "doc_id").agg(F.count_distinct("idx").alias("n"))
    return hit.join(small(need, few), "query_id").where("n = need").select("query_id", "doc_id")


def wildcard_intersection(q: DataFrame, tf: DataFrame, vocab: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    expanded = written(expand_wildcards(q, vocab, grams), "terms")
    need = q.groupBy("query_id").agg(F.count_distinct("idx").alias("need"))
    slots = expanded.select("query_id", "idx", "term").distinct()
    hit = tf.select("term", "doc_id").join(small(slots), "term").groupBy("query_id", "doc_id").agg(F.count_distinct("idx").alias("n"))
    return hit.join(small(need), "query_id").where("n = need").select("query_id", "doc_id")


def union(q: DataFrame, posts: DataFrame) -> DataFrame:
    """query_id, doc_id, score (summed tf), offsets of documents with any term (OR)."""
    hit = posts.join(small(q.select("query_id", "term").distinct()), "term")
    return hit.groupBy("query_id", "doc_id").agg(F.sum("tf").alias("score"), F.sort_array(F.flatten(F.collect_list("offsets"))).alias("offsets"))


def phrase(q: DataFrame, toks: DataFrame, *, slots: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, offsets: where phrases end. One pass: equal start = pos - idx for every slot.

    slots: (query_id, idx, term) if slots have several terms."""
    use = (slots if slots is not None else q).select("query_id", "idx", "term").distinct()
    need = q.groupBy("query_id").agg(F.count_distinct("idx").alias("need"))
    at = toks.join(small(use), "term").select("query_id", "doc_id", "idx", (F.col("pos") - F.col("idx")).alias("start"))
    whole = at.groupBy("query_id", "doc_id", "start").agg(F.count_distinct("idx").alias("n")).join(small(need), "query_id").where("n = need")
    return whole.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list((F.col("start") + F.col("need") - 1).cast("int"))).alias("offsets"))


def document_phrase(q: DataFrame, found: DataFrame, *, slots: DataFrame | None = None) -> DataFrame:
    """`phrase` over tokens in their rows (doc_id, found), where no document id is given twice.

    A token carries those that follow it, as many as the batch's longest query asks for. It
    meets the first slot, and each next token the next slot, so only whole phrases are
    shuffled, not the tokens of frequent terms."""
    few = fits(slots if slots is not None else q)
    need = q.groupBy("query_id").agg(F.min("idx").alias("lead"), F.collect_set("idx").alias("asked"))
    use = (slots if slots is not None else q).select("query_id", "idx", "term").distinct().join(small(need, few), "query_id").withColumn("nth", F.col("idx") - F.col("lead"))
    use = written(use.select("query_id", "nth", "term", "lead", "asked"), "slots")
    longest = use.agg(F.max("nth")).first()[0] or 0
    ahead = [F.slice("found", k + 1, F.greatest(F.size("found"), F.lit(1))).alias(f"t{k}") for k in range(longest + 1)]
    hit = found.select("doc_id", F.posexplode(F.arrays_zip(*ahead)).alias("pos", "x")).select("doc_id", "pos", *(F.col("x")[f"t{k}"].alias(f"t{k}") for k in range(longest + 1)))
    hit = hit.join(small(use.where("nth = 0").select("query_id", F.col("term").alias("t0"), "lead", "asked"), few), "t0")
    for k in range(1, longest + 1):
        nth = use.where(F.col("nth") == k).select("query_id", F.col("term").alias(f"t{k}"), F.lit(True).alias("met"))
        hit = hit.join(small(nth, few), ["query_id", f"t{k}"], "left").where(F.coalesce("met", ~F.array_contains("asked", F.col("lead") + k))).drop("met", f"t{k}")
    end = (F.col("pos") - F.col("lead") + F.size("asked") - 1).cast("int")
    return hit.select("query_id", "doc_id", end.alias("end")).groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list("end")).alias("offsets"))


def wildcard_phrase(q: DataFrame, toks: DataFrame, vocab: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    return phrase(q, toks, slots=written(expand_wildcards(q, vocab, grams), "terms"))


def matching(q: DataFrame, tf: DataFrame, few: bool | None = None) -> DataFrame:
    """term, doc_id, tf, query_id, weight (summed over equal terms of a query)."""
    return tf.join(small(q.groupBy("query_id", "term").agg(F.sum("weight").alias("weight")), fits(q) if few is None else few), "term")


def tfidf(q: DataFrame, tf: DataFrame, lengths: DataFrame, n: Column, length_col: str) -> DataFrame:
    """query_id, doc_id, score = sum of tf idf weight / length; 0 where the length is 0.

    df is counted over the rows that match the queries' terms alone: those are all
    the rows of their postings."""
    few = fits(q)
    hit = matching(q, tf, few)
    df = tf.join(small(q.select("term").distinct(), few), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    part = hit.join(small(df, few), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * index.idf(n) * F.col("weight")).alias("w"))
    return part.join(lengths.select("doc_id", length_col), "doc_id").select("query_id", "doc_id", F.coalesce(F.try_divide("w", length_col), F.lit(0.0)).alias("score"))


def by_pagerank(q: DataFrame, tf: DataFrame, pagerank: DataFrame) -> DataFrame:
    """query_id, doc_id, score: documents with any term, by PageRank, 0 if they have none."""
    docs = matching(q, tf).select("query_id", "doc_id").distinct()
    return docs.join(pagerank.select("doc_id", "pr"), "doc_id", "left").select("query_id", "doc_id", F.coalesce("pr", F.lit(0.0)).alias("score"))


def combination(tfidf_scores: DataFrame, pagerank: DataFrame, tfidf_weight: float = 1.0, pagerank_weight: float = 500.0) -> DataFrame:
    joined = tfidf_scores.join(pagerank.select("doc_id", "pr"), "doc_id", "left")
    return joined.select("query_id", "doc_id", (tfidf_weight * F.col("score") + pagerank_weight * F.coalesce("pr", F.lit(0.0))).alias("score"))


def top(scores: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """query_id, rank, doc_id, score: ranks offset+1 to offset+k, ties by doc_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where((F.col("rank") > offset) & (F.col("rank") <= offset + k)).select("query_id", "rank", "doc_id", "score")


def rocchio(q: DataFrame, relevant: DataFrame, tf: DataFrame, vocab: DataFrame, n: Column, alpha: float = 0.2, beta: float = 0.8) -> DataFrame:
    """query_id, idx, term, weight after feedback without a negative part.

    relevant: (query_id, doc_id). Weights times alpha; each term of a relevant document
    adds beta / R tf idf. Of equal terms the first takes the feedback; new terms come
    after, idx null. Without relevant documents a query is unchanged."""
    count = relevant.groupBy("query_id").agg(F.count("*").alias("r"))
    rows = tf.join(relevant, "doc_id").join(count, "query_id").join(vocab, "term")
    gain = rows.groupBy("query_id", "term").agg(F.sum(F.lit(beta) / F.col("r") * F.col("tf") * index.idf(n)).alias("gain"))
    first = Window.partitionBy("query_id", "term").orderBy("idx")
    own = q.join(count, "query_id", "left").withColumn("k", F.row_number().over(first)).select("query_id", "idx", "term", F.when(F.col("r").isNull(), F.col("weight")).otherwise(alpha * F.col("weight")).alias("weight"), "k")
    both = own.join(gain.withColumn("k", F.lit(1)), ["query_id", "term", "k"], "full_outer")
    return both.select("query_id", "idx", "term", (F.coalesce("weight", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("weight"))


def suggestions_needed(q: DataFrame, results: DataFrame, vocab: DataFrame) -> DataFrame:
    """query_id of AND or phrase queries without results that have a term outside the vocabulary."""
    out = q.join(vocab.select("term"), "term", "left_anti").select("query_id").distinct()
    return out.join(results.select("query_id").distinct(), "query_id", "left_anti")
