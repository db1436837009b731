"""Byte-level BPE by overlapping chunks, and its inverse.

Every text is read as chunks of `chunk_chars` that overlap by `overlap`. Each chunk
is pre-tokenised by itself, from its first character on. The pre-token pattern
looks ahead but never back, so from the first boundary on that two neighbouring
chunks have both, they agree: there the chunks are stitched. Where an overlap has
no common boundary (a run of one kind longer than it), the text is pre-tokenised
from the last boundary that is known to be right, over twice the distance each time,
until a later chunk agrees; so a text takes time in proportion to its length,
whatever it holds. Boundaries that may depend on what follows a chunk are left out.
The pieces between the boundaries found are then encoded by themselves; those of
known pieces come from a bounded cache. Decoding concatenates the tokens' raw bytes.

The chunks of a text are read in the task that holds its row; texts, of which there
are many more than cores, are what runs in parallel.

Defined cases: a null text is the empty text, which has no ids; a very long text is
held whole with its ids in one task; ties do not arise (of merges of one rank the
leftmost is first, as the library has it); repeated rows give a row each; a null id
stays null; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, texts_of

CHUNK_CHARS, OVERLAP_CHARS, LOOKAHEAD_CHARS = 2048, 128, 16
#: Encoders by ranks' path and pattern; they outlive a task where Python workers are reused.
_HELD: dict[tuple[str, str], ChunkedBpe] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ChunkedBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, lookahead: int = LOOKAHEAD_CHARS, cached: int = 300_000, cached_chars: int = 40):
        import regex
        import tiktoken

        self.merge = tiktoken.Encoding("textloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pattern = regex.compile(pattern)
        self.chunk_chars, self.overlap, self.lookahead = chunk_chars, overlap, lookahead
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.cache: dict[str, bytes] = {}
        self.cached, self.cached_chars = cached, cached_chars

    @staticmethod
    def held(ranks_path: str, pattern: str, chunk_chars: int, overlap: int) -> ChunkedBpe:
        if (bpe := _HELD.get((ranks_path, pattern))) is None:
            bpe = _HELD[ranks_path, pattern] = ChunkedBpe(read_ranks(ranks_path), pattern)
        bpe.chunk_chars, bpe.overlap = chunk_chars, overlap
        return bpe

    def pre_tokens(self, text: str, start: int, stop: int) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of text[start:stop] and where they end in the text.

        Those that end close to `stop` may depend on what follows and are left out."""
        pieces = self.pattern.findall(text, start, stop)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) + start
        if stop < len(text):
            n = int(np.searchsorted(ends, stop - self.lookahead, "right"))
            return pieces[:n], ends[:n]
        return pieces, ends

    def split(self, text: str) -> list[str]:
        """The text's pre-tokens, from chunks that are stitched where they agree."""
        n, c = len(text), self.chunk_chars
        if n <= c:
            return self.pre_tokens(text, 0, n)[0]
        starts = range(0, n, c)
        chunk = lambda k: self.pre_tokens(text, starts[k], min(n, starts[k] + c + self.overlap + self.lookahead))
        out, (pieces, ends) = [], chunk(0)
        k, last, reach = 1, 0, 2 * (c + self.overlap)
        while k < len(starts):
            new, new_ends = chunk(k)
            common = np.intersect1d(ends[ends > starts[k]], new_ends, assume_unique=True)
            if len(common):
                out += pieces[: int(np.searchsorted(ends, common[0], "right"))]
                at = int(np.searchsorted(new_ends, common[0], "right"))
                pieces, ends = new[at:], new_ends[at:]
                last, reach = int(common[0]), 2 * (c + self.overlap)
                k += 1
                continue
            # no agreement: go on from the last boundary known to be right, further each time
            out += pieces
            last = int(ends[-1]) if len(ends) else last
            stop = min(n, max(last, starts[k]) + reach)
            pieces, ends = self.pre_tokens(text, last, stop)
            reach *= 2
            if stop == n:
                break
            # of the chunks that begin before the new end, the last one may agree
            while k + 1 < len(starts) and len(ends) and starts[k + 1] < ends[-1]:
                k += 1
            while not len(ends) and k + 1 < len(starts) and starts[k + 1] < stop:
                k += 1
        return out + pieces

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        cache = self.cache
        pieces = self.split(text)
        try:
            return b"".join([cache[p] for p in pieces])
        except KeyError:
            pass
        if len(cache) > self.cached:
            cache.clear()
        parts, get, merge, most = [], cache.get, self.merge, self.cached_chars
        for p in pieces:
            ids = get(p)
            if ids is None:
                ids = array("I", merge(p.encode())).tobytes()
                if len(p) <= most:
                    cache[p] = ids
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Each text's ids (little-endian unsigned 32-bit) and the bytes they decode to."""
    return _mapped(docs, ranks_path, pattern, id_col, text_col, chunk_chars, overlap, SCHEMA, lambda ids, raw: (len(ids), array("I", ids).tobytes(), raw))


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """The same with the SHA-256 of the comma-joined ids and of the decoded bytes."""

    def digests(ids, raw):
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()

    return _mapped(docs, ranks_path, pattern, id_col, text_col, chunk_chars, overlap, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(docs, ranks_path, pattern, id_col, text_col, chunk_chars, overlap, schema, shape) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def work(batches):
        bpe = ChunkedBpe.held(ranks_path, pattern, chunk_chars, overlap)
        for b in batches:
            rows = []
            for text in texts_of(b):
                ids = np.frombuffer(bpe.encode(text), "<u4").tolist()
                rows.append(shape(ids, bpe.decode(ids)))
            cols = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))], names=names)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
