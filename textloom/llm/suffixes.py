r"""Exact removal of byte strings that a corpus has more than once.

A byte goes if a `LENGTH`-byte window of its text that covers it starts anywhere
else too, in the same text or another. Windows never cross texts.

All windows of a corpus are too many to sort, so equal windows are first brought
together. Every window has an anchor: of the `GRAM`-byte strings in it the first
whose hash is least. Equal windows have equal anchors at the same distance, and
neighbouring windows mostly share theirs, so anchors are some 70 times fewer than
bytes. Only anchors whose string occurs twice or more are kept. An anchor's
context is what its windows cover. Contexts of one string that are equal (by a
64-bit BLAKE2b digest of their bytes, beside the string's own hash) are a class.

* All windows of a class with several members repeat. That is not left to the
  digest: of each class two members are compared, with those of neighbouring classes
  laid together to runs, in slices of `_SLICE` bytes.
* Where a string has several classes, one context of each is compared with the
  others. The window that starts d bytes left of the anchor repeats if another
  context shares d bytes to the left and LENGTH - d to the right. For d of `_HALF`
  or more that takes `_HALF` equal bytes on the left, for smaller d LENGTH - `_HALF`
  + 1 on the right, so contexts meet in two groups, by either string, which decide
  half of the distances each. A string that is common, in contexts that differ, thus
  falls apart into small groups.

Slices and contexts are compared by the suffix sort:

* right of the anchors and, read backwards, left of them, the contexts are
  suffixes; they are sorted by a merge sort that compares two suffixes by a binary
  search over prefix polynomial hashes for their common extension, in logarithmic
  time, and then one byte;
* neighbours' extensions are verified byte by byte; should a hash have collided,
  the block is sorted again by its bytes. Members of a class whose bytes differ stop
  the job, rather than that bytes go wrongly;
* contexts that share r bytes are neighbours in sorted order, so every distance is
  settled by the neighbours' extensions of both orders.

A group with more than `HOT` contexts does not meet in one task: each of its
windows is counted by a 128-bit digest, with partial sums first, and counts are
joined back. Nothing is dropped in either way. Keys that may have very many rows (a
string, a class, a window, a text that repeats) are aggregated with partial sums,
and joined to tables that are written first, so that adaptive execution can split
them over tasks.

Defined cases: a null text is the empty text; texts shorter than a window keep all
bytes; a very long text is read in blocks of a megabyte that overlap by a window;
ties between equal hashes go to the first string of a window; rows that repeat an
id and its text are documents of their own, so what is long enough in them goes; a
null id stays null and is told from every other; an empty table gives no rows;
further columns are ignored by op8 and kept by `without_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, documents, map_arrow, name, with_row, written
from .simhash import keep_runs

LENGTH, GRAM, HOT = 200, 64, 4096
_SLICE = 1024
_REACH = LENGTH - GRAM
#: Distances from here on are settled by contexts that are equal on the left, smaller ones by those equal on the right.
_HALF = _REACH // 2
_CHUNK = (1 << 20) - LENGTH
_BLOCK = 6144
_LOW = np.uint64((1 << 20) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLES: list = []


def _tables():
    """Random byte values, and powers of the base and of its inverse modulo 2^64."""
    if not _TABLES:
        values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        n = 1 << 20
        powers = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))]
        _TABLES.extend([values, *powers])
    return _TABLES


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by least of block heads and tails."""
    n = len(x)
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    grid = full.reshape(rows, width)
    head = np.minimum.accumulate(grid, 1).reshape(-1)
    tail = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def anchors(raw: bytes, ends: np.ndarray):
    """Anchors of texts laid end to end (ends: where each text ends).

    Gives arrays: text number, anchor, first and last window start (in the text),
    hash of the anchor's string, and its context's digest."""
    values, power, inverse = _tables()
    starts = np.concatenate([[0], ends[:-1]])
    data = np.frombuffer(raw, np.uint8)
    out = []
    for at in range(0, max(0, len(data) - LENGTH + 1), _CHUNK):
        part = data[at : at + _CHUNK + LENGTH - 1]
        n = len(part)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values[part] * power[:n], out=total[1:])
        gram = mixed((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
        where = (sliding_least(gram & ~_LOW | np.arange(len(gram), dtype=np.uint64), LENGTH - GRAM + 1) & _LOW).astype(np.int64)
        s = np.arange(len(where))
        text = np.searchsorted(ends, s + at, "right")
        fits = s + at + LENGTH <= ends[text]
        s, text, where = s[fits], text[fits], where[fits]
        if not len(s):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(where) != 0) | (np.diff(s) != 1) | (np.diff(text) != 0)]))
        first, last = s[new], s[np.concatenate([new[1:] - 1, [len(s) - 1]])]
        p, text = where[new], text[new]
        block, digest = part.tobytes(), hashlib.blake2b
        found = b"".join([digest(block[x:y], digest_size=8).digest() for x, y in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)])
        # equal bytes are one class only with the anchor in the same place
        c = np.frombuffer(found, np.int64) ^ mixed((p - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64)
        shift = at - starts[text]
        out.append((text, p + shift, first + shift, last + shift, gram[p].view(np.int64), c))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with _k and _th, which name a text of a document; a null id is told apart in _th."""
    return docs.withColumns({"_k": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "_th": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).isNull())})


def all_anchors(keyed: DataFrame, text_col: str = "text") -> DataFrame:
    def work(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            if not len(ends):
                continue
            text, *found = anchors(b"".join(texts), ends)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(x) for x in found)], names=["k", "th", "p", "first", "last", "g", "c"])

    long_enough = keyed.select(F.col("_k").alias("k"), F.col("_th").alias("th"), F.encode(F.col(text_col), "UTF-8").alias("b")).where(F.length("b") >= LENGTH)
    return map_arrow(long_enough, work, "k long, th long, p long, first long, last long, g long, c long")


class Suffixes:
    """Rows of bytes of different lengths, compared by hashes of their prefixes."""

    def __init__(self, rows: list[bytes], width: int):
        values, power, _ = _tables()
        self.length = np.fromiter(map(len, rows), np.int64, len(rows))
        self.data = np.zeros((len(rows), width), np.uint8)
        self.data[np.arange(width)[None, :] < self.length[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
        self.prefix = np.zeros((len(rows), width + 1), np.uint64)
        np.cumsum(values[self.data] * power[:width], axis=1, out=self.prefix[:, 1:])
        self.steps = width.bit_length()

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension: a binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        for _ in range(self.steps):
            mid = (low + high + 1) >> 1
            same = self.prefix[a, mid] == self.prefix[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(low, mid - 1))
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        end = np.minimum(self.length[a], self.length[b]) == n
        at = np.minimum(n, self.data.shape[1] - 1)
        return np.where(end, self.length[a] < self.length[b], self.data[a, at] < self.data[b, at])

    def order(self, group: np.ndarray) -> np.ndarray:
        """Rows sorted within their groups (which stand together): merge sort, all runs at once."""
        n = len(group)
        order = np.arange(n)
        begin = np.searchsorted(group, group, "left")
        size = np.searchsorted(group, group, "right") - begin
        width = 1
        while n and width < size.max():
            slot = np.flatnonzero(size > width)
            b, m = begin[slot], size[slot]
            pos = slot - b
            run = pos // width
            other = run ^ 1
            low = np.minimum(other * width, m)
            high = np.minimum((other + 1) * width, m)
            base = low.copy()
            mine, right = order[slot], (run & 1).astype(bool)
            for _ in range(width.bit_length()):
                open_ = low < high
                mid = np.where(open_, (low + high) >> 1, 0)
                it = order[np.minimum(b + mid, n - 1)]
                # equal ones of the left run come first
                before = np.where(right, ~self.less(mine, it), self.less(it, mine))
                low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
            to = b + np.minimum(run, other) * width + (pos - run * width) + (low - base)
            new = order.copy()
            new[to] = mine
            order = new
            width *= 2
        return order

    def sorted_groups(self, group: np.ndarray):
        """Order and the extension that each row shares with the one before, verified by bytes."""
        order = self.order(group)
        share = np.zeros(len(order), np.int64)
        if len(order) > 1:
            a, b = order[:-1], order[1:]
            share[1:] = np.where(group[a] == group[b], self.common(a, b), 0)
            w = np.arange(self.data.shape[1])[None, :] < share[1:, None]
            if ((self.data[a] != self.data[b]) & w).any() or self._unsorted(order, share, group):
                rows = [bytes(self.data[i, : self.length[i]]) for i in range(len(order))]
                order = np.array(sorted(range(len(rows)), key=lambda i: (group[i], rows[i])), np.int64)
                share = np.zeros(len(order), np.int64)
                for r in range(1, len(order)):
                    x, y = rows[order[r - 1]], rows[order[r]]
                    if group[order[r - 1]] == group[order[r]]:
                        share[r] = next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        return order, share

    def _unsorted(self, order, share, group) -> bool:
        """Whether a neighbour's next byte speaks against the order."""
        a, b, n = order[:-1], order[1:], share[1:]
        inner = (group[a] == group[b]) & (n < self.length[a])
        at = np.minimum(n, self.data.shape[1] - 1)
        return bool((inner & ((n >= self.length[b]) | (self.data[a, at] >= self.data[b, at]))).any())


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes], distances=range(_REACH + 1)) -> np.ndarray:
    """(rows, distances): whether the window that starts d bytes left of the anchor repeats in the group."""
    n = len(group)
    found = np.zeros((n, len(distances)), bool)
    sides = []
    for rows in (right, [x[::-1] for x in left]):
        order, share = Suffixes(rows, max(1, max(map(len, rows), default=1))).sorted_groups(group)
        fresh = np.concatenate([[True], group[order[1:]] != group[order[:-1]]])
        sides.append((order, share, fresh))
    (ro, rs, rf), (lo, ls, lf) = sides
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    nl, nr = np.fromiter(map(len, left), np.int64, n), np.fromiter(map(len, right), np.int64, n)
    for col, d in enumerate(distances):
        a[ro] = np.cumsum(rf | (rs < LENGTH - d))
        b[lo] = np.cumsum(lf | (ls < d))
        use = np.flatnonzero((nl >= d) & (nr >= LENGTH - d))
        if len(use) < 2:
            continue
        key = a[use] * (n + 1) + b[use]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        hit = np.zeros(len(use), bool)
        hit[by[1:]] |= same
        hit[by[:-1]] |= same
        found[use, col] = hit
    return found


def _windows_to_spans(found: np.ndarray):
    """Runs of columns as (row, least, largest)."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, low, high - 1


_NEAR, _FAR = range(_HALF), range(_HALF, _REACH + 1)
#: kind: 0 a slice of a run, 1 a context that meets others by its right side, 2 one by its left side.
#: single: the class has one member, (k, th, p), whose windows are asked for.
_CONTEXT = "key long, kind int, k long, th long, p long, single boolean, left binary, right binary"
_SPAN = "k long, th long, s long, e long"


def _compare(contexts: DataFrame) -> DataFrame:
    """Spans of repeated windows of single members; each group within one task. Slices must be equal."""

    def work(batches):
        for table in keep_runs(batches, 1, _BLOCK):
            kinds = table.column("kind").to_numpy()
            for kind, distances in ((0, None), (1, range(_HALF)), (2, range(_HALF, _REACH + 1))):
                rows = np.flatnonzero(kinds == kind)
                if not len(rows):
                    continue
                part = table.take(pa.array(rows))
                group = np.unique(part.column("key").to_numpy(), return_inverse=True)[1]
                right = part.column("right").to_pylist()
                if distances is None:
                    order, share = Suffixes(right, max(map(len, right))).sorted_groups(group)
                    same = group[order[1:]] == group[order[:-1]]
                    size = np.fromiter(map(len, right), np.int64, len(right))[order]
                    if (same & ((share[1:] != size[1:]) | (size[1:] != size[:-1]))).any():
                        raise RuntimeError("contexts with one digest differ")
                    continue
                row, low, high = _windows_to_spans(repeated_windows(group, part.column("left").to_pylist(), right, distances))
                k, th, p, single = (part.column(x).to_numpy()[row] for x in ("k", "th", "p", "single"))
                s, e = p - high - distances[0], p - low - distances[0] + LENGTH
                yield pa.RecordBatch.from_arrays([pa.array(x[single]) for x in (k, th, s, e)], names=["k", "th", "s", "e"])

    return arrow(contexts.repartition(F.col("key")).sortWithinPartitions("key"), work, _SPAN)


def _count_windows(contexts: DataFrame) -> DataFrame:
    """The same for groups of very many contexts: every window is counted by its digest."""

    def work(batches):
        for b in batches:
            found, rows = [], []
            for kind, k, th, p, single, left, right in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                for d in range(_HALF) if kind == 1 else range(_HALF, _REACH + 1):
                    if d <= len(left) and LENGTH - d <= len(right):
                        found.append(hashlib.blake2b(left[len(left) - d :] + right[: LENGTH - d], digest_size=16).digest())
                        rows.append((k, th, p - d, single))
            h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            at = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in (*h.T, *at.T[:3])), pa.array(at[:, 3] == 1)], names=["h1", "h2", "k", "th", "s", "single"])

    rows = written(map_arrow(contexts, work, "h1 long, h2 long, k long, th long, s long, single boolean"), "windows")
    many = written(rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "many")
    return rows.where("single").join(many, ["h1", "h2"]).select("k", "th", "s", (F.col("s") + LENGTH).alias("e"))


def _cut(batches):
    """Slices and contexts of texts, as their lists ask for."""
    from xxhash import xxh64_intdigest

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    long = lambda x: x.to_bytes(8, "little", signed=True)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    for b in batches:
        out = [[] for _ in kinds]

        def put(common, *row, out=out):
            for c, v in zip(out, (signed(xxh64_intdigest(common, row[0])), *row), strict=True):
                c.append(v)

        for k, th, raw, todo in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for t in todo:
                if t["runs"] is None:
                    g, p, first, last, single = long(t["g"]), t["p"], t["first"], t["last"], t["single"]
                    if p - last < _HALF:
                        right = raw[p : last + LENGTH]
                        put(right[: LENGTH - _HALF + 1], 1, k, th, p, single, raw[max(first, p - _HALF + 1) : p], right)
                    if p - first >= _HALF:
                        left = raw[first:p]
                        put(left[-_HALF:] + g, 2, k, th, p, single, left, raw[p : min(last, p - _HALF) + LENGTH])
                    continue
                # g names the pair of texts, p is how far this one's offsets lie from the first one's
                for at, last in merged([(x["first"], x["last"] + 1) for x in t["runs"]]):
                    end = last - 1 + LENGTH
                    while at + LENGTH <= end:  # every window lies in a slice
                        stop = min(at + _SLICE, end)
                        put(long(t["g"]) + long(at), 0, k, th, 0, False, b"", raw[at + t["p"] : stop + t["p"]])
                        at = stop - LENGTH + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, kinds, strict=True)], names=[c.split()[0] for c in _CONTEXT.split(", ")])


def repeated_spans(keyed: DataFrame, text_col: str = "text", *, hot: int = HOT) -> DataFrame:
    """Spans [s, e) of bytes that go, as (k, th, s, e); they may overlap."""
    every = all_anchors(keyed, text_col)
    strings = written(every.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "strings")
    known = written(every.join(strings, "g"), "anchors")
    at = F.struct("k", "th", "p", "first", "last")
    classes = written(known.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(at).alias("one"), F.max(at).alias("two")), "classes")
    settled = known.join(classes.where("n > 1").select("g", "c"), ["g", "c"]).select("k", "th", F.col("first").alias("s"), (F.col("last") + LENGTH).alias("e"))
    # one context of each class of a string with several; two members of each class with several
    wide = written(classes.groupBy("g").agg(F.count("*").alias("classes")).where("classes > 1").select("g"), "wide")
    none = F.lit(None).cast("array<struct<first:long,last:long>>").alias("runs")
    contexts = classes.join(wide, "g").select("one.k", "one.th", F.struct("g", "one.p", "one.first", "one.last", (F.col("n") == 1).alias("single"), none).alias("x"))
    pairs = classes.where("n > 1 and one <> two").groupBy(F.col("one.k").alias("k1"), F.col("one.th").alias("th1"), F.col("two.k").alias("k2"), F.col("two.th").alias("th2"), (F.col("two.p") - F.col("one.p")).alias("far"))
    pairs = pairs.agg(F.collect_list(F.struct("one.first", "one.last")).alias("runs")).withColumn("g", F.xxhash64("k1", "th1", "k2", "th2", "far"))
    zero = F.lit(0).cast("long")
    run = lambda far: F.struct("g", far.alias("p"), zero.alias("first"), zero.alias("last"), F.lit(False).alias("single"), "runs").alias("x")
    sides = pairs.select(F.explode(F.array(F.struct(F.col("k1").alias("k"), F.col("th1").alias("th"), run(zero)), F.struct(F.col("k2").alias("k"), F.col("th2").alias("th"), run(F.col("far"))))).alias("y")).select("y.*")
    lists = contexts.unionByName(sides).groupBy("k", "th").agg(F.collect_list("x").alias("todo"))
    # of rows with equal id and text one is enough to read from; an anchor whose
    # windows meet an edge of a block has a context on either side of it
    texts = keyed.select(F.col("_k").alias("k"), F.col("_th").alias("th"), F.encode(F.col(text_col), "UTF-8").alias("raw"))
    found = texts.join(lists, ["k", "th"]).groupBy("k", "th").agg(F.first("raw").alias("raw"), F.first("todo").alias("todo"))
    cut = written(map_arrow(found, _cut, _CONTEXT), "contexts")
    large = written(cut.where("kind > 0").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "large")
    some = _compare(cut.join(large, "key", "left_anti"))
    rest = _count_windows(cut.where("kind > 0").join(large, "key"))
    return settled.unionByName(some).unionByName(rest)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """docs with _spans: per row the byte spans that go (null if none), not yet merged."""
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed, text_col, hot=hot).groupBy("k", "th").agg(F.collect_set(F.struct("s", "e")).alias("_spans"))
    spans = written(spans, "spans")
    return keyed.join(spans.select(F.col("k").alias("_k"), F.col("th").alias("_th"), "_spans"), ["_k", "_th"], "left").drop("_k", "_th")


def kept_bytes(text: str | None, spans) -> tuple[bytes, bytes, list[tuple[int, int]]]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    gone = merged([(x["s"], x["e"]) for x in spans or ()])
    at, parts = 0, []
    for s, e in gone:
        parts.append(raw[at:s])
        at = e
    return raw, b"".join([*parts, raw[at:]]), gone


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs without repeated strings; same columns and rows. Characters cut in two go whole."""
    names = docs.columns
    rows = with_row(docs, doc_id=name(id_col).cast("long"), text=name(text_col))

    def work(batches):
        for b in batches:
            cols = dict(zip(names, b.column(b.schema.get_field_index("row")).flatten(), strict=True))
            was = cols[text_col].to_pylist()
            new = [t if not s else kept_bytes(t, s)[1].decode("utf-8", "ignore") for t, s in zip(was, b.column(b.schema.get_field_index("_spans")).to_pylist(), strict=True)]
            cols[text_col] = pa.array(new, cols[text_col].type)
            if length_col in names:
                cols[length_col] = pa.array([None if t is None else len(t) for t in new], cols[length_col].type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return map_arrow(removals(rows).select("row", "_spans"), work, docs.schema)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")

    def work(batches):
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, kept, gone = kept_bytes(text, spans)
                rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, x) for c, x in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(removals(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_spans"), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
