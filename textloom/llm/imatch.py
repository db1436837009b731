r"""I-Match fingerprints over randomised lexicon subsets.

DataFrame functions only; no Python runs on the executors.

A text's terms are its distinct lower-case runs of letters and digits. The
lexicon holds the terms whose inverse document frequency ln(N / df) lies in
[`IDF_LOW`, `IDF_HIGH`]. Document frequencies are counted over all documents, by
the terms' 64-bit hashes. The lexicon is read as a bit map of 2^22 hash values, half
a megabyte whatever the corpus. The band holds terms of df >= N e^-IDF_HIGH alone,
so it has at most e^IDF_HIGH (4,915) times as many as a document has terms on
average; a term outside the band is taken for one inside with the probability that
the map is set, which does not grow with the vocabulary (see README). A text with fewer than `LEAST` terms in the lexicon keeps all its
terms, so that short texts have a fingerprint too.

A term's hashes place it in the randomised subsets of the lexicon: for each of
eight seeds (16 bits of two 64-bit hashes) it is in the subset of rate 2^-b if the
seed's first b bits are zero. The text's terms are sorted, and those in each
subset hashed together: 16 bits a subset, 0 for none. The fingerprint is the hash
of all terms (16 hex digits), then 96 subset hashes of 4 hex digits, by rate, then
seed.

Likeness of two fingerprints is the share of seeds whose rarest subset with terms
in either text is the same in both, 1 if the fingerprints are equal.

The next document is found on ids alone: they are range-partitioned and written,
and only the edges of the partitions (one row each) meet in one place. Texts are
shuffled once, by id; of the next document only the part that is used moves.

Defined cases: a null text is the empty text, whose fingerprint is all zeros; a
null id sorts before all others; a very long text is read whole; ties in order are
ties of ids: rows with equal ids each give a row, share their
neighbours, and stand as a neighbour by the one whose text has the smallest
SHA-256; a lone id is its own neighbour; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

BITS = 22
IDF_LOW, IDF_HIGH = 1.6, 8.5
LEAST = 4
SEEDS = 8
#: Zero bits that a subset asks for: rates 1/2 to 1/16384.
DEPTHS = (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14)
#: Stands for a null id: below every long.
_NULL_ID = Decimal(-(1 << 63) - 1)


def terms(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""))


def lexicon(docs: DataFrame, *, text: str = "text", low: float = IDF_LOW, high: float = IDF_HIGH) -> Column:
    """The band's bit map: a scalar subquery of 2^16 longs."""
    many = docs.agg(F.count("*").cast("double").alias("n")).scalar()
    hashed = docs.select(F.explode(terms(F.col(text))).alias("t")).select(F.xxhash64("t").alias("h"))
    counted = hashed.groupBy("h").agg(F.count("*").alias("df")).withColumn("idf", F.ln(many / F.col("df")))
    inside = counted.where(F.col("idf").between(low, high)).select(F.pmod("h", F.lit(1 << BITS)).cast("int").alias("k")).select(F.shiftright("k", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k").bitwiseAND(63)).alias("b"))
    every = docs.sparkSession.range(1 << (BITS - 6)).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    words = inside.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("m")).scalar()


def fingerprint(df: DataFrame, table: Column, texts: dict[str, str]) -> DataFrame:
    """df with a fingerprint column for each text column: texts maps text to fingerprint names."""
    names = [c for c in df.columns if c not in texts]
    df = df.select(*names, *(F.transform(terms(F.col(t)), lambda x: F.xxhash64(x)).alias(f"_t_{f}") for t, f in texts.items()), table.alias("_m"))

    def known(h):
        k = F.pmod(h, F.lit(1 << BITS)).cast("int")
        return F.getbit(F.get("_m", F.shiftright(k, 6)), k.bitwiseAND(63)) == 1

    df = df.select(*names, *(F.col(f"_t_{f}") for f in texts.values()), *(F.filter(f"_t_{f}", known).alias(f"_b_{f}") for f in texts.values()))
    df = df.select(*names, *(F.sort_array(F.when(F.size(f"_b_{f}") >= LEAST, F.col(f"_b_{f}")).otherwise(F.col(f"_t_{f}"))).alias(f"_a_{f}") for f in texts.values()))
    df = df.select("*", *(F.sort_array(F.transform(f"_a_{f}", lambda x: F.xxhash64(x))).alias(f"_c_{f}") for f in texts.values()))
    mark = lambda c: F.when(F.size(c) > 0, F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(c), F.lit(65535)) + 1)), 4, "0")).otherwise("0000")
    whole = lambda c: F.when(F.size(c) > 0, F.lpad(F.lower(F.hex(F.xxhash64(c))), 16, "0")).otherwise("0" * 16)
    df = df.select(*names, *(x for f in texts.values() for x in (whole(F.col(f"_a_{f}")).alias(f), *((F.col(f"_a_{f}") if j < SEEDS // 2 else F.col(f"_c_{f}")).alias(f"_s{j}_{f}") for j in range(SEEDS)))))
    done = 0
    for depth in DEPTHS:
        cut = lambda j, a=done, b=depth: (lambda h: F.shiftrightunsigned(h, 16 * (j % (SEEDS // 2)) + a).bitwiseAND(F.lit((1 << (b - a)) - 1)) == 0)
        df = df.select(*names, *(x for f in texts.values() for x in (F.col(f), *(F.filter(f"_s{j}_{f}", cut(j)).alias(f"_s{j}_{f}") for j in range(SEEDS)))))
        df = df.select(*names, *(x for f in texts.values() for x in (F.concat(f, *(mark(F.col(f"_s{j}_{f}")) for j in range(SEEDS))).alias(f), *(F.col(f"_s{j}_{f}") for j in range(SEEDS)))))
        done = depth
    return df.select(*names, *texts.values())


def likeness(a: str, b: str) -> Column:
    part = lambda c, level, j: F.substring(F.col(c), 17 + 4 * (level * SEEDS + j), F.lit(4))
    levels, seeds = (F.sequence(F.lit(0), F.lit(n - 1)) for n in (len(DEPTHS), SEEDS))
    rarest = lambda j: F.array_max(F.filter(levels, lambda x: (part(a, x, j) != "0000") | (part(b, x, j) != "0000")))
    found = F.filter(F.transform(seeds, lambda j: F.struct(j.alias("j"), rarest(j).alias("level"))), lambda x: x["level"].isNotNull())
    share = F.aggregate(found, F.lit(0.0), lambda s, x: s + (part(a, x["level"], x["j"]) == part(b, x["level"], x["j"])).cast("double")) / F.greatest(F.size(found), F.lit(1))
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(share)


def neighbours(ids: DataFrame) -> DataFrame:
    """k, next_k, prev_k, prev_n of distinct keys k with a number n, in a circle."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = written(ids.repartitionByRange(parts, "k").select("k", "n", F.spark_partition_id().alias("p")), "ids")
    edges = held.groupBy("p").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.max_by("n", "k").alias("last_n"))
    order, all_ = Window.orderBy("p"), Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(  # as many rows as partitions
        "p",
        F.coalesce(F.lead("first").over(order), F.first("first").over(all_)).alias("after"),
        F.coalesce(F.lag("last").over(order), F.last("last").over(all_)).alias("before"),
        F.coalesce(F.lag("last_n").over(order), F.last("last_n").over(all_)).alias("before_n"),
    )
    inner = Window.partitionBy("p").orderBy("k")
    rows = held.select("p", "k", F.lead("k").over(inner).alias("next_k"), F.lag("k").over(inner).alias("prev_k"), F.lag("n").over(inner).alias("prev_n"))
    return rows.join(F.broadcast(edges), "p").select("k", F.coalesce("next_k", "after").alias("next_k"), F.coalesce("prev_k", "before").alias("prev_k"), F.coalesce("prev_n", "before_n").alias("prev_n"))


def with_edited(docs: DataFrame) -> DataFrame:
    """k, next_k, text, edited of each row of doc_id, text; k stands for the id.

    Both uses of the texts ask for the same columns, so that they share one shuffle."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(_NULL_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    near = neighbours(rows.groupBy("k").agg(F.max(F.length("text")).alias("n")))
    joined = rows.join(near, "k")
    heads = joined.select("prev_k", "k", F.substring(F.col("text"), F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")).alias("head"), F.sha2("text", 256).alias("sha"))
    heads = heads.groupBy("k", "prev_k").agg(F.min_by("head", "sha").alias("head")).select(F.col("prev_k").alias("k"), "head")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("head"), F.lit(1), cut))
    return joined.join(heads, "k").select("k", "next_k", "text", edited.alias("edited"))


def fingerprints(docs: DataFrame, *, text: str = "text", **band) -> DataFrame:
    """doc_id and fingerprint of every row."""
    rows = docs.select("doc_id", F.col(text).alias("text"))
    return fingerprint(rows, lexicon(rows, **band), {"text": "fingerprint"})


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    table = lexicon(docs)
    rows = with_edited(docs)
    rows = rows.select("k", "next_k", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.sha2("text", 256).alias("sha"), "text", "edited")
    marked = written(fingerprint(rows, table, {"text": "fingerprint", "edited": "edited_fingerprint"}), "imatch")
    following = marked.groupBy(F.col("k").alias("next_k")).agg(F.min_by("fingerprint", "sha").alias("next_fingerprint"))
    both = marked.join(following, "next_k")
    return both.select(F.when(F.col("k") != F.lit(_NULL_ID), F.col("k").cast("long")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
