r"""SimHash near-duplicates with bit-sliced distances.

A fingerprint's bit is 1 if it is set in more than half of the XXH64 values
(UTF-8, seed 42) of the text's word shingles, repeats included. Texts with fewer
words than a shingle have one shingle, all their words; without words the
fingerprint is zero and links like any other.

Fingerprints that differ in `radius` bits at most link. Equal fingerprints are
one class before anything else is done. Two that differ in three bits agree in
two of five parts of their bits at least, so each class goes to ten buckets, one
for each pair of parts. Buckets are compared bit-sliced, many at once: the
fingerprints of all buckets that a task holds lie in shared bit planes, so one
machine word holds one bit of 64 fingerprints. Each is compared with the one d
places on, for every d that stays in a bucket: the planes are shifted by d and
their differences added by carry-save counters, and a word is abandoned as soon as
all its counters exceed the radius. Pairs that are joined already are left out. A
bucket with more classes than `block` is cut into blocks by hash; each pair of
blocks is a task of its own, so no bucket meets in one task. Only links that join
what was not joined yet are kept; they hold the same components as all links.

Component ids are the smallest document ids reachable. Defined cases: a null
text is the empty text; a very long text is read whole; repeated rows and rows with equal ids each give a row;
rows with a null id have no component id but their own (null) and link nothing;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, documents, map_arrow, name, texts_of, with_row, written
from .components import connected_components

#: Bits of the five parts, and the most classes in a block.
PARTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BLOCK = 4096


def simhash(text: str, size: int = 3) -> int:
    """The fingerprint as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    # laid out with single spaces, a shingle is a slice from its first word to its last
    line = b" ".join(words)
    n = len(words)
    if n <= size:
        return xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The number whose bits are those that more than half of h have."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        set_bits += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, also: str | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and a long column to take along."""
    more = [also] if also else []

    def work(batches):
        for b in batches:
            fp = np.array([simhash(t, size) for t in texts_of(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names=["doc_id", "fp", *more])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more), work, ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in more)]))


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, blocks) machine words: bit j of word [p, i] is bit p of fingerprint 64 i + j."""
    n = -(-len(fps) // 64) * 64
    full = np.zeros(n, np.uint64)
    full[: len(fps)] = fps
    bits = np.unpackbits(full.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T).reshape(64, n // 64, 64), axis=2, bitorder="little")).view("<u8").reshape(64, n // 64)


_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliced(differ, over: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with lanes whose differing bits are `radius` at most, and those lanes as bits.

    differ(p, words) gives plane p of the differences; `over` holds the lanes that do
    not count from the start. Carry-save: eight differing planes are summed by full
    adders before they meet the running counters; `over` gains the lanes beyond the
    radius, and words that are over throughout are abandoned."""
    width = max(1, radius.bit_length())
    live = np.flatnonzero(over != _ONES)
    over = over[live]
    counters = np.zeros((width, len(live)), np.uint64)
    for p in range(0, 64, 8):
        if not len(live):
            break
        columns: list[list[np.ndarray]] = [[differ(p + k, live) for k in range(8)]]
        level = 0
        while level < len(columns):
            column = columns[level]
            if level < width:
                column.append(counters[level])
            while len(column) >= 3:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.append(half ^ c)
                if len(columns) == level + 1:
                    columns.append([])
                columns[level + 1].append(a & b | half & c)
            if len(column) == 2:
                a, b = column
                column[:] = [a ^ b]
                if len(columns) == level + 1:
                    columns.append([])
                columns[level + 1].append(a & b)
            if level < width:
                counters[level] = column[0]
            else:
                over = over | column[0]
            level += 1
        # of the counters' values, those above the radius are over too
        above, equal = np.zeros(len(live), np.uint64), np.full(len(live), _ONES)
        for k in range(width - 1, -1, -1):
            if radius >> k & 1:
                equal = equal & counters[k]
            else:
                above = above | equal & counters[k]
                equal = equal & ~counters[k]
        over = over | above
        keep = over != _ONES
        if not keep.all():
            live, over, counters = live[keep], over[keep], counters[:, keep]
    return live, ~over


def _lanes(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at, lane = np.nonzero(np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little"))
    return words[at] * 64 + lane


def within(fp: int, vertical: np.ndarray, radius: int) -> np.ndarray:
    """Numbers of the fingerprints that differ from fp in `radius` bits at most."""
    return _lanes(*sliced(lambda p, w: vertical[p, w] ^ (_ONES if fp >> p & 1 else np.uint64(0)), np.zeros(vertical.shape[1], np.uint64), radius))


def close_pairs(fps: np.ndarray, end: np.ndarray, whole: np.ndarray, left: np.ndarray, root: np.ndarray, radius: int):
    """Pairs (i, j) of fingerprints of one bucket that differ in `radius` bits at most, i < j, as arrays.

    end: where i's bucket ends; whole: whether all its pairs count, or only those of a
    left and a right one; root: what i is joined to, read anew for every distance."""
    n = len(fps)
    p = np.pad(planes(fps), ((0, 0), (0, n // 64 + 2)))
    here = np.arange(n)
    for d in range(1, int((end - here).max(initial=1))):
        here = here[here + d < end[here]]  # what has no partner at this distance has none beyond
        i = here[(root[here] != root[here + d]) & (whole[here] | (left[here] != left[here + d]))]
        if not len(i):
            continue
        words, at = np.unique(i >> 6, return_inverse=True)
        valid = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(valid, at, np.uint64(1) << (i & 63).astype(np.uint64))
        q, s = d >> 6, np.uint64(d & 63)
        up = np.uint64(64) - s

        def differ(k, live, words=words, q=q, s=s, up=up):
            w = words[live]
            far = p[k, w + q]
            if s:
                far = far >> s | p[k, w + q + 1] << up
            return p[k, w] ^ far

        live, near = sliced(differ, ~valid, radius)
        if len(live):
            i = _lanes(words[live], near)
            yield i, i + d


def forest(pairs, root: np.ndarray, accept=None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs that join what was not joined yet; root is kept up to date. accept(i, j) may turn a pair down."""
    out = []
    for i, j in pairs:
        if accept is not None:
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                a, b = sorted((root[x], root[y]))
                if a != b and accept(x, y):
                    root[root == b] = a
                    out.append((np.array([x]), np.array([y])))
            continue
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            _, first = np.unique(high, return_index=True)  # each root moves once, to a lower one
            root[high[first]] = low[first]
            out.append((i[first], j[first]))
            while (root[root] != root).any():
                root[:] = root[root]
    return out


#: Rows whose buckets are compared in the same planes.
_HELD_ROWS = 1 << 15


def keep_runs(batches, keys: int, most: int = _HELD_ROWS, size=None):
    """Columns of rows that stand sorted by their first `keys` columns, in pieces that hold whole runs.

    size(columns) may say how large a piece is already, where rows alone do not tell."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if (sum(x.num_rows for x in held) if size is None else size(held)) < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        k = [table.column(c).to_numpy() for c in range(keys)]
        new = np.flatnonzero(np.any([np.diff(c) != 0 for c in k], axis=0))
        if not len(new):
            continue
        cut = int(new[-1]) + 1  # the last run may go on
        yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def runs_of(table: pa.Table, keys: int) -> np.ndarray:
    """Where the run of each row ends."""
    k = [table.column(c).to_numpy() for c in range(keys)]
    ends = np.r_[np.flatnonzero(np.any([np.diff(c) != 0 for c in k], axis=0)) + 1, len(k[0])]
    return np.repeat(ends, np.diff(np.r_[0, ends]))


def near_links(classes: DataFrame, *, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that hold all components within the radius."""
    if radius > 3:
        raise ValueError("the buckets find differences of up to three bits")
    keys = []
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    for n, (i, j) in enumerate(pairs):
        part = lambda k: F.shiftrightunsigned("fp", PARTS[k][0]).bitwiseAND(F.lit((1 << PARTS[k][1]) - 1))
        keys.append((F.lit(n) * F.lit(1 << 26) + part(i) * F.lit(1 << 13) + part(j)).cast("long"))
    rows = classes.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    size = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("cuts"))
    rows = rows.join(size, "bucket")
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    # each block meets itself and every other block of its bucket once: block pairs (x, y), x <= y
    pair = F.when(F.col("cuts") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(F.least(k, own).alias("x"), F.greatest(k, own).alias("y")))
    )
    rows = rows.select("bucket", "fp", own.alias("own"), F.explode(pair).alias("p")).select("bucket", "p.x", "p.y", (F.col("own") == F.col("p.x")).alias("left"), "fp")

    def work(batches):
        """Rows of a task stand sorted by block pair."""
        for table in keep_runs(batches, 3):
            x, y, left, fp = (table.column(c).to_numpy() for c in ("x", "y", "left", "fp"))
            fps, root = fp.view(np.uint64), np.arange(len(fp))
            found = forest(close_pairs(fps, runs_of(table, 3), x == y, left, root, radius), root)
            if found:
                i, j = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

    spread = rows.repartition(F.col("bucket"), F.col("x"), F.col("y")).sortWithinPartitions("bucket", "x", "y")
    return arrow(spread, work, "a long, b long").distinct()


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, block: int = BLOCK, also: str | None = None) -> DataFrame:
    """doc_id, fp, component_id of every row, and the column `also`."""
    marks = written(fingerprints(docs, id_col=id_col, text_col=text_col, size=size, also=also), "simhash")
    classes = marks.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(near_links(classes.select("fp"), radius=radius, block=block))
    # roots are fingerprints; a component's id is the least document id of its classes
    whole = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = whole.join(ids, "root").select("fp", "component_id")
    return marks.join(by_class, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), *([also] if also else []))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each component: the smallest id's, of equal ids the smallest text hash's.

    Rows without an id link nothing and stay. Of rows that repeat id and text one stays."""
    keyed = with_row(docs, k=name(id_col).cast("long"), text=name(text_col), th=F.xxhash64(F.coalesce(name(text_col), F.lit(""))))
    named = keyed.where("k is not null")
    found = near_components(named, id_col="k", text_col="text", also="th", **how)
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "th")).alias("w")).select(F.col("w.doc_id").alias("k"), "w.th")
    kept = named.join(first, ["k", "th"], "left_semi").dropDuplicates(["k", "th"])
    return kept.select("row.*").unionByName(keyed.where("k is null").select("row.*"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
