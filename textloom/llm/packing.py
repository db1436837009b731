"""Sum-of-squares online packing of tokenised documents into fixed windows.

A window holds `capacity` tokens. A document (its ids, then the end id) that is
longer than a window first fills whole windows. What remains is put into the
fill level l that minimises the sum over levels of N(h)^2, N(h) being the number
of open windows filled to h (l = 0 opens a window). N is the level array. Where
`max_open` windows are open already and the choice is to open one more, the
piece's front fills the fullest window instead, and the rest is placed by the same
rule; so memory is bounded whatever the sizes are, and every placement is made by
the level array.

Each task packs its own rows and hands on the windows that are still open at its
end. These are packed by the same rule again, `FAN` tasks' windows in one task of
the next round, until one task is left; only open windows move, a bounded number
for each task. The last task then winds down: the emptiest window's pieces are
placed again with one window less, until one window of the whole corpus is left,
which is cut into powers of two and needs no padding.

Every round's pieces are written, so a lost executor costs no more than its tasks;
a retried task gives the same windows. Sequence ids are made of the round, the
task's number and a counter.

Defined cases: null and empty texts are the end id alone; a very long text is
tokenised whole in the task that holds its row and cut into windows as any other;
repeated rows and ties are packed as rows of their own (of equal levels the fullest
is taken); a null id stays null; an empty table gives no rows; further columns of
the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, texts_of, written

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Tasks whose open windows meet in one task of the next round.
FAN = 8
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64())])
#: Pieces in an Arrow batch that goes back to Spark.
_OUT_ROWS = 2048
#: Texts of these characters alone take the fast path: their classes and lower case are the same in every Unicode version.
_PLAIN = "\x00-\x1b\x20-\x84\x86-\u02ff\u0391-\u03a1\u03a3-\u03c9\u0400-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5"
#: Caches by tokenizer path; they outlive a task where Python workers are reused.
_HELD: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids of whole texts by a word-level BPE file (NFC, lower case, `</w>`).

    The file's pre-tokeniser never joins across its matches, so a text's ids are
    its pre-tokens' ids in order; those of known pre-tokens come from a bounded
    cache. New ones are merged by rank: `</w>` is the byte FF, which UTF-8 never
    has, and the pairs with it have the lowest ranks, so they merge first. Texts
    with rarer characters go to the tokenizers library whole."""

    def __init__(self, path: str, cached: int = 600_000, cached_bytes: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.pattern = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = {t["content"] for t in file["added_tokens"]}
        self.odd = re.compile(f"[^{_PLAIN}]")
        # the strings of special tokens are theirs in a text too, as the library reads them by default
        self.special = tuple(sorted(special))
        byte = byte_of_char()
        ranks = {bytes(byte[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>"): i for t, i in file["model"]["vocab"].items() if t not in special}
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cache: dict[str, bytes] = {}
        self.cached, self.cached_bytes = cached, cached_bytes

    @staticmethod
    def held(path: str) -> WordTokenizer:
        if path not in _HELD:
            _HELD[path] = WordTokenizer(path)
        return _HELD[path]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.odd.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        words = self.pattern.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())
        cache = self.cache
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            pass
        if len(cache) > self.cached:
            cache.clear()
        parts, get, merge, most = [], cache.get, self.merge, self.cached_bytes
        for w in words:
            ids = get(w)
            if ids is None:
                ids = array("I", merge(w.encode() + b"\xff")).tobytes()
                if len(w) <= most:
                    cache[w] = ids
            parts.append(ids)
        return b"".join(parts)


def byte_of_char() -> dict[str, int]:
    """The byte that each printable stand-in character of byte-level BPE files means."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class SumOfSquares:
    """The level array and the open windows of one task.

    A piece is (doc, start, ids, doc_tokens); a closed window goes to `done`."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.level = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0
        self.done: list[list] = []

    def best(self, size: int) -> int:
        """The level to add to; among equals the fullest."""
        n, c = self.level, self.capacity
        change = 2 * (n[size:] - n[: c - size + 1]) + 2
        change[0] -= 1
        change[-1] -= 1
        shut = n[: c - size + 1] == 0
        shut[0] = False
        change[shut] = np.iinfo(np.int64).max
        return c - size - int(np.argmin(change[::-1]))

    def add(self, doc, ids: bytes) -> None:
        c, total = self.capacity, len(ids) // 4
        full = total - total % c
        for s in range(0, full, c):
            self.done.append([(doc, s, ids[4 * s : 4 * (s + c)], total)])
        if total > full:
            self.place([(doc, full, ids[4 * full :], total)], total - full)

    def place(self, pieces: list, size: int) -> None:
        """Puts pieces, fewer tokens than a window together, where the level array says."""
        c = self.capacity
        at = self.best(size)
        while not at and self.n_open >= self.max_open:
            # as many windows are open as may be: the front of the pieces fills the fullest
            top = int(np.flatnonzero(self.level)[-1])
            front, pieces = split(pieces, c - top)
            self._onto(top, front, c - top)
            size -= c - top
            if not size:
                return
            at = self.best(size)
        self._onto(at, pieces, size)

    def _onto(self, at: int, pieces: list, size: int) -> None:
        if at:
            window = self.windows[at].pop()
            self.level[at] -= 1
            self.n_open -= 1
        else:
            window = []
        window.extend(pieces)
        if at + size == self.capacity:
            self.done.append(window)
            return
        self.windows[at + size].append(window)
        self.level[at + size] += 1
        self.n_open += 1

    def left(self) -> list[list]:
        """The open windows, fullest first; none is open any more."""
        out = [w for level in reversed(self.windows) for w in level]
        for level in self.windows:
            level.clear()
        self.level[:] = 0
        self.n_open = 0
        return out

    def close(self) -> None:
        """Winds down: the emptiest window's pieces are placed anew with one window less, until one is left.

        That one is cut into powers of two."""
        while self.n_open > 1:
            low = int(np.flatnonzero(self.level)[0])
            window = self.windows[low].pop()
            self.level[low] -= 1
            self.n_open -= 1
            self.max_open = self.n_open
            self.place(window, low)
        pieces = [p for w in self.left() for p in w]
        left = size_of(pieces)
        while left:
            room = 1 << (left.bit_length() - 1)
            window, pieces = split(pieces, room)
            self.done.append(window)
            left -= room


def size_of(pieces: list) -> int:
    return sum(len(p[2]) for p in pieces) // 4


def split(pieces: list, room: int) -> tuple[list, list]:
    """The first `room` tokens of the pieces, and the rest."""
    front, room = [], 4 * room
    for k, (doc, start, ids, total) in enumerate(pieces):
        if len(ids) > room:
            if room:
                front.append((doc, start, ids[:room], total))
            return front, [(doc, start + room // 4, ids[room:], total), *pieces[k + 1 :]]
        front.append(pieces[k])
        room -= len(ids)
    return front, []


class _Rows:
    """Numbers windows and gathers their pieces as Arrow batches; part is null for closed windows."""

    def __init__(self, first: int):
        self.next, self.rows = first, []

    def take(self, windows: list, part=None) -> None:
        for window in windows:
            at = 0
            for doc, start, ids, total in window:
                self.rows.append((doc, start, len(ids) // 4, ids, total, self.next, at, part))
                at += len(ids) // 4
            self.next += 1
        windows.clear()

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
        self.rows.clear()
        return out


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, max_open: int = 256) -> DataFrame:
    """Packed pieces with their ids; the columns of SCHEMA."""

    def first_round(batches):
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        tokens, packer, out = WordTokenizer.held(tokenizer_path), SumOfSquares(capacity, max_open), _Rows(part << 34)
        end = np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                packer.add(doc, tokens.encode(text) + end)
                out.take(packer.done)
                if len(out.rows) >= _OUT_ROWS:
                    yield out.batch()
        out.take(packer.left(), part)
        if out.rows:
            yield out.batch()

    def next_round(number: int, last: bool):
        def work(batches):
            """Rows stand sorted by the group of tasks, then by window, fullest first within a task."""
            group, packer, out = None, None, None
            window, now = [], None

            def end_group():
                if packer is None:
                    return
                if window:
                    packer.place(list(window), size_of(window))
                    window.clear()
                if last:
                    packer.close()
                out.take(packer.done)
                out.take(packer.left(), group)

            for b in batches:
                cols = [c.to_pylist() for c in b.columns]
                for g, doc, start, ids, total, sequence in zip(*cols, strict=True):
                    if sequence != now or g != group:
                        if g != group:
                            end_group()
                            if out is not None and out.rows:
                                yield out.batch()
                            group, packer, out = g, SumOfSquares(capacity, max_open), _Rows((number << 58) | (g << 34))
                        elif window:
                            packer.place(list(window), size_of(window))
                            window.clear()
                            out.take(packer.done)
                            if len(out.rows) >= _OUT_ROWS:
                                yield out.batch()
                        now = sequence
                    window.append((doc, start, ids, total))
            end_group()
            if out is not None and out.rows:
                yield out.batch()

        return work

    names = [f.name for f in _ARROW][:-1]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = written(map_arrow(rows, first_round, SCHEMA + ", part long"), "packed")
    done, number = made.where("part is null").select(*names), 0
    while True:
        still = made.where("part is not null")
        most = still.agg(F.max("part")).first()[0]
        if most is None:
            return done
        number += 1
        groups = most // FAN + 1
        dealt = still.select((F.col("part") / FAN).cast("long").alias("g"), "doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset")
        dealt = dealt.repartition(min(groups, 4096), "g").sortWithinPartitions("g", "sequence_id", "offset").drop("offset")
        made = map_arrow(dealt, next_round(number, groups == 1), SCHEMA + ", part long")
        if groups == 1:
            return done.unionByName(made.select(*names))
        made = written(made, "packed")
        done = done.unionByName(made.where("part is null").select(*names))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
