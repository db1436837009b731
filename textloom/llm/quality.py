r"""Quality rules: fixed counts, and a hashed n-gram log-likelihood ratio.

DataFrame functions only; no Python runs on the executors.

Words are runs of anything but space and \t\n\v\f\r. The fixed rule fails a text
of fewer than `MIN_WORDS` words, or one with more than half of its words inside
three-word windows that the text has twice or more.

The ratio compares two multinomials over `BUCKETS` hash buckets of n-grams
(tokens: lower-case runs of letters, digits and `_`, or of other visible
characters; unigrams, and bigrams with the last token followed by nothing). The
raw one counts every document. The trusted one counts documents labelled good: at
most `TRUSTED_ROWS` of them, those with the smallest hash of their id, whose ids
(bounded by that parameter) are broadcast. It is smoothed towards the raw one by
`BUCKETS` counts. A text's score is the sum of log(trusted / raw) over its
n-grams, divided by their number; it is kept at `THRESHOLD` or more. The table
that scores read is `BUCKETS` numbers, whatever the corpus.

Defined cases: a null text is the empty text, which fails the fixed rule; a very
long text is read whole; ties do not arise, as every text is held against the
threshold by itself (of labels of one id the smallest counts); repeated rows give a row each; a null id stays null and is never trusted; without
trusted documents every score is 0; an empty table gives no rows; further
columns are ignored by the scores and kept by `keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, name, with_row

BUCKETS = 1 << 14
TRUSTED_ROWS = 20_000
MIN_WORDS = 50
THRESHOLD = -0.05
_SPACE = r"[\x20\x09-\x0D]+"


def fixed_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    names = [*map(name, docs.columns)]
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"_w": F.array_remove(F.split(t, _SPACE), ""), "_lines": lines})
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"), "word_chars": F.length(F.array_join("_w", "")).cast("long"), "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_g": F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))),
    })
    df = df.drop("_w", "_lines").withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = lambda x, k: F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False))
    df = df.drop("_g").withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(F.filter("_s", again), lambda x: x["i"]))))
    gaps = F.transform("_p", lambda x, k: F.coalesce(F.least(F.lit(3), F.get("_p", k + 1) - x), F.lit(3)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0))


def _bucket(*cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")


def ratio_table(docs: DataFrame, trusted: DataFrame, *, text: str = "text") -> Column:
    """log(trusted / raw) of each bucket as one array: a scalar subquery.

    trusted: doc_id of the trusted documents, already bounded."""
    ids = F.broadcast(trusted.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_t")))
    t = docs.select("doc_id", tokens(F.col(text)).alias("a")).join(ids, F.col("doc_id") == F.col("_id"), "left")
    pairs = t.select(F.coalesce("_t", F.lit(0)).cast("long").alias("t"), F.explode(F.arrays_zip("a", F.slice("a", F.lit(2), F.greatest(F.size("a"), F.lit(1))).alias("b"))).alias("p"))
    grams = pairs.select("t", F.explode(F.array(_bucket("p.a"), _bucket("p.a", "p.b"))).alias("k"))
    counted = grams.groupBy("k").agg(F.sum("t").cast("double").alias("t"), F.count("*").cast("double").alias("r"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("k"), F.lit(0.0).alias("t"), F.lit(1.0).alias("r"))  # one raw count each: no bucket is impossible
    rows = counted.unionByName(every).groupBy("k").agg(F.sum("t").alias("t"), F.sum("r").alias("r"))
    whole = rows.agg(F.sort_array(F.collect_list(F.struct("k", "t", "r"))).alias("c"), F.sum("t").alias("nt"), F.sum("r").alias("nr"))
    p_raw = lambda x: x["r"] / F.col("nr")
    ratio = F.transform("c", lambda x: F.when(F.col("nt") > 0, F.ln((x["t"] + BUCKETS * p_raw(x)) / (F.col("nt") + BUCKETS) / p_raw(x))).otherwise(0.0))
    return whole.select(ratio.alias("w")).scalar()


def with_ratio(docs: DataFrame, table: Column, text: str = "text") -> DataFrame:
    """docs with score, the length-normalised log-likelihood ratio."""
    names = [*map(name, docs.columns)]
    df = docs.withColumns({"_a": tokens(F.col(text)), "_table": table})
    one = lambda i: F.get("_table", _bucket(F.get("_a", i))) + F.get("_table", _bucket(F.get("_a", i), F.get("_a", i + 1)))
    total = F.aggregate(F.sequence(F.lit(0), F.size("_a") - 1), F.lit(0.0), lambda s, i: s + one(i))
    return df.withColumn("score", F.when(F.size("_a") > 0, total / (2 * F.size("_a"))).otherwise(0.0)).select(*names, "score")


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id")


def quality_rules(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = THRESHOLD, rows: int = TRUSTED_ROWS) -> DataFrame:
    """docs' columns, the fixed rules' columns, score and kept."""
    scored = with_ratio(docs, ratio_table(docs, trusted_ids(labels, rows), text=text), text)
    # a filter on `kept` must not be pushed below the arrays it comes from, where they would be made anew for every element
    ruled = fixed_rules(scored, text).withColumn("_row", F.monotonically_increasing_id())
    return ruled.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold) & (F.col("_row") >= 0)).drop("_row")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the rows that are not kept; the same columns, whatever their names."""
    rows = with_row(docs, doc_id=name(id_col), text=name(text))
    return quality_rules(rows, labels, **how).where("kept").select("row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
