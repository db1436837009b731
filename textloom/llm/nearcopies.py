r"""SimHash near copies down to a Jaccard index of 0.8 of five-word shingles.

A text's set holds the XXH64 values (UTF-8, seed 42) of its lower-cased word
shingles; a text with fewer words than a shingle has one, all its words, and
texts without words are alike. Equal sets are one class before anything else. A
class's fingerprint is the SimHash of its set (see `simhash`).

At 0.8 two fingerprints differ in some ten bits of 64, beyond what buckets of equal
parts can find, so buckets are made of bands of MinHash values: sets at 0.8 share
none of `BANDS` bands of `ROWS` values with a probability of (1 - 0.8^4)^32, 5 in
100 million; closer ones miss less. Bands with the same members are compared once.
Within buckets fingerprints are compared bit-sliced, many buckets in the same
planes, and pairs beyond `RADIUS` bits are abandoned. A bit of sets at 0.8 differs
with a probability of 0.15 (0.19 for sets of four and five), so that a pair has more
than 26 differing ones with one of less than 1 in 100,000. What is left is settled
by the Jaccard index of the whole sets, so nothing that is less alike links. Pairs
that are joined already are left out, so of a large group of copies no pairs are
listed. A bucket with more classes than `block` is cut into blocks by hash. Blocks
are compared by themselves first; where their links have not joined the whole bucket,
each pair of its blocks is compared too, in a task of its own. The links kept hold
the same components as all links.

Defined cases: a null text is the empty text; a very long text is read whole; rows
without an id link nothing and stay; of rows that repeat id and text one stays, of
rows with one id the smallest text hash's; an empty table gives no rows; further
columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, map_arrow, name, texts_of, with_row, written
from .components import connected_components
from .simhash import close_pairs, forest, keep_runs, majority, runs_of

SIZE, LEAST = 5, 0.8
BANDS, ROWS, BLOCK, RADIUS = 32, 4, 1024, 26
#: Bytes of sets whose buckets are compared in the same planes.
_HELD_BYTES = 32 << 20
_RNG = np.random.default_rng(31)
_FLIP = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingles(text: str, size: int = SIZE) -> np.ndarray:
    """The text's set, sorted."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), len(words)
    if n <= size:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64))


def bands(x: np.ndarray) -> np.ndarray:
    """A signed number for each band of the set's MinHash values."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 2048):
        least = np.minimum(least, ((x[at : at + 2048] ^ _FLIP) * _TIMES).min(1))
    out = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out = out ^ (out >> np.uint64(29))
    return out.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def marks_of(docs: DataFrame) -> DataFrame:
    """doc_id, th, the class of the text's set, its fingerprint and bands (none for the empty set)."""

    def work(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            sets = [shingles(t) for t in texts_of(b)]
            cls = np.array([xxh64_intdigest(x.tobytes(), 7) for x in sets], np.uint64).view(np.int64)
            fp = np.array([majority(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls), pa.array(fp), pa.array([bands(x) if len(x) else [] for x in sets], pa.list_(pa.int64()))], names=["doc_id", "th", "cls", "fp", "bands"])

    return map_arrow(docs, work, "doc_id long, th long, cls long, fp long, bands array<long>")


def links_of(docs: DataFrame, classes: DataFrame, *, least: float = LEAST, block: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between classes that hold all components; docs has doc_id, th, text."""
    rows = classes.select("cls", "fp", F.posexplode("bands").alias("band", "value")).select("cls", "fp", F.xxhash64("band", "value").alias("bucket"))
    mark = lambda seed: F.sum(F.xxhash64("cls", F.lit(seed)).cast("decimal(38,0)"))
    size = rows.groupBy("bucket").agg(F.count("*").alias("n"), mark(1).alias("m1"), mark(2).alias("m2")).where("n > 1")
    once = size.groupBy("n", "m1", "m2").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("cuts"))
    rows = written(rows.join(once, "bucket"), "buckets")
    wanted = rows.select("cls").distinct().join(classes.select("cls", "at.doc_id", "at.th"), "cls")
    # rows that repeat an id and its text have one set
    texts = docs.join(wanted, ["doc_id", "th"]).select("cls", "text")

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in texts_of(b)], pa.binary())], names=["cls", "x"])

    sets = written(map_arrow(texts, work, "cls long, x binary").dropDuplicates(["cls"]), "sets")
    own = F.pmod(F.xxhash64("cls"), F.col("cuts")).cast("int")

    def compare(batches):
        """Rows of a task stand sorted by block pair; rows with one label are joined already."""
        for table in keep_runs(batches, 3, _HELD_BYTES, lambda held: sum(b.nbytes for b in held)):
            x, y, left, cls, fp, label = (table.column(c).to_numpy() for c in ("x", "y", "left", "cls", "fp", "label"))
            _, first, same = np.unique(label, return_index=True, return_inverse=True)
            sets, root = table.column("set"), first[same]
            read = lambda i: np.frombuffer(sets[i].as_buffer(), np.uint64)
            found = forest(close_pairs(fp.view(np.uint64), runs_of(table, 3), x == y, left, root, radius), root, lambda i, j: alike(read(i), read(j), least))
            if found:
                i, j = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cls[i]), pa.array(cls[j])], names=["a", "b"])

    def compared(dealt: DataFrame) -> DataFrame:
        ready = dealt.join(sets.withColumnRenamed("x", "set"), "cls").select("bucket", "x", "y", "left", "cls", "fp", "label", "set")
        return arrow(ready.repartition(F.col("bucket"), F.col("x"), F.col("y")).sortWithinPartitions("bucket", "x", "y"), compare, "a long, b long").distinct()

    # each block by itself
    within = compared(rows.select("bucket", own.alias("x"), own.alias("y"), F.lit(True).alias("left"), "cls", "fp", F.col("cls").alias("label")))
    large = rows.where("cuts > 1")
    if large.isEmpty():
        return within
    # then each block with every other one of its bucket, where the blocks have not joined the bucket already
    within = written(within, "within")
    parts = connected_components(within)
    labelled = written(large.join(parts, F.col("cls") == F.col("node"), "left").select("bucket", "cls", "fp", "cuts", F.coalesce("root", "cls").alias("label")), "labelled")
    apart = labelled.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("bucket")
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: k != own), lambda k: F.struct(F.least(k, own).alias("x"), F.greatest(k, own).alias("y")))
    dealt = labelled.join(apart, "bucket").select("bucket", "cls", "fp", "label", own.alias("own"), F.explode(others).alias("p"))
    across = compared(dealt.select("bucket", "p.x", "p.y", (F.col("own") == F.col("p.x")).alias("left"), "cls", "fp", "label"))
    return within.unionByName(across)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """docs with one row of each component: the smallest id's, of equal ids the smallest text hash's."""
    keyed = with_row(docs, k=name(id_col).cast("long"), text=name(text_col), th=F.xxhash64(F.coalesce(name(text_col), F.lit(""))))
    named = keyed.where("k is not null")
    texts = named.select(F.col("k").alias("doc_id"), "th", "text")
    classes = written(marks_of(texts).groupBy("cls").agg(F.min(F.struct("doc_id", "th")).alias("at"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
    parts = connected_components(links_of(texts, classes, least=least, block=block))
    whole = classes.join(parts, F.col("cls") == F.col("node"), "left").select(F.coalesce("root", "cls").alias("root"), "at")
    first = whole.groupBy("root").agg(F.min("at").alias("w")).select(F.col("w.doc_id").alias("k"), "w.th")
    kept = named.join(first, ["k", "th"], "left_semi").dropDuplicates(["k", "th"])
    return kept.select("row.*").unionByName(keyed.where("k is null").select("row.*"))
