r"""License scans: Aho-Corasick for tags and notices, shunting-yard for expressions.

Texts are lower-cased in A-Z and read as words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
One Aho-Corasick automaton finds all phrases as words that stand consecutively.
Base labels come from four phrases; every place counts, overlaps included.
The method's labels add notice phrases with versions, and the identifiers of
licence expressions that follow an identifier tag (`SPDX-License-Identifier:`).
Expressions are parsed by a shunting-yard with the precedence with > and > or;
unclosed or misplaced parts end the expression. `permissive` is the expression's
value, with an identifier true if its licence is permissive.

score is the strength of the best evidence: 1 for a parsed expression, 0.9 for a
notice phrase within eight words after a word of licensing, 0.6 for a bare
phrase, 0 without any.

Defined cases: a null text is the empty text (no words, no labels, score 0); a very
long text is read whole, in time and memory proportional to it, however many hits
it has; phrases that overlap count each; repeated rows give a row each; a null id stays null; an empty table gives no
rows; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_arrow, texts_of

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices of the method's own labels.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0-1.0",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
PERMISSIVE = ("mit", "isc", "bsd", "apache", "cc0", "cc-by-1", "cc-by-2", "cc-by-3", "cc-by-4", "unlicense", "zlib", "0bsd", "bsl-1", "python", "x11")
_NEAR_WORDS = 8
#: Bytes of words: digits, lower-case letters and all above 7F; A-Z are lowered.
_WORDS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


@lru_cache(1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    kinds: dict[str, list] = {}
    for phrase, label in BASE.items():
        kinds.setdefault(phrase, []).append(("base", label))
    for phrase, label in NOTICES.items():
        kinds.setdefault(phrase, []).append(("notice", label))
    kinds[TAG] = [("tag", "")]
    for w in ("licensed", "license", "licence", "released under", "distributed under"):
        kinds.setdefault(w, []).append(("near", ""))
    for phrase, what in kinds.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, what))
    a.make_automaton()
    return a


def parse(text: str, start: int = 0) -> tuple[list, int]:
    """Reverse Polish form of the longest expression of the line from `start` on, and where it ends.

    Operands are lower-case identifiers; operators are ("or",) and the like."""
    out: list = []
    ops: list[str] = []
    at, want, depth = start, True, 0
    # the longest whole expression so far: operands and operators in `out`, operators still open, end
    best: tuple[int, list[str], int] = (0, [], start)
    while m := _TOKEN.match(text, at):
        t = m[1].lower()
        if want and t == "(":
            ops.append(t)
            depth += 1
        elif want and t not in _RANK and t != ")":
            out.append(t)
            want = False
        elif not want and t in _RANK:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[t]:
                out.append((ops.pop(),))
            ops.append(t)
            want = True
        elif not want and t == ")" and depth:
            while ops[-1] != "(":
                out.append((ops.pop(),))
            ops.pop()
            depth -= 1
        else:
            break
        at = m.end()
        if not want and not depth:
            best = (len(out), ops[::-1], at)  # at most one operator of each rank is open here
    return [*out[: best[0]], *((o,) for o in best[1])], best[2]


def evaluate(polish: list) -> bool:
    """The expression with permissive licences as true; an exception changes nothing."""
    stack: list[bool] = []
    for x in polish:
        if isinstance(x, tuple):
            b, a = stack.pop(), stack.pop()
            stack.append(a if x[0] == "with" else a and b if x[0] == "and" else a or b)
        else:
            stack.append(x.startswith(PERMISSIVE))
    return bool(stack and stack[0])


def identifiers(polish: list) -> list[str]:
    """Licence identifiers; one with an exception is named `licence with exception`."""
    stack: list[list[str]] = []
    for x in polish:
        if isinstance(x, tuple):
            b, a = stack.pop(), stack.pop()
            if x[0] == "with":
                stack.append([f"{a[-1]} with {b[0]}"])
            elif len(a) >= len(b):
                a.extend(b)
                stack.append(a)
            else:
                b[:0] = a
                stack.append(b)
        else:
            stack.append([x])
    return stack[0] if stack else []


_TAG_TEXT = re.compile(r"(?ai:spdx[^A-Za-z0-9\x80-\U0010ffff]+license[^A-Za-z0-9\x80-\U0010ffff]+identifier)[ \t]*:?[ \t]*")


def scan(text: str) -> dict:
    words = words_of(text)
    row = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "expressions": [], "permissive": None}
    plain = f" {b' '.join(words).decode('latin-1')} "
    hits = [(end + 1 - n, end, what) for end, (n, what) in automaton().iter(plain)]
    if not hits:
        return row
    # the number of the word that starts after the space at a hit's start: spaces before it
    starts = np.fromiter((h[0] for h in hits), np.int64, len(hits))
    spaces = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), np.uint8) == 0x20)
    index = np.searchsorted(spaces, starts).tolist()
    base, labels, base_labels = [], set(), set()
    near = sorted(w for w, (_, _, what) in zip(index, hits, strict=True) if ("near", "") in what)
    for w, (_, _, what) in zip(index, hits, strict=True):
        for kind, label in what:
            if kind == "base":
                base.append(w)
                base_labels.add(label)
            if kind in ("base", "notice"):
                labels.add(label)
                k = bisect_right(near, w)
                row["score"] = max(row["score"], 0.9 if k and w - near[k - 1] <= _NEAR_WORDS else 0.6)
    if any(kind == "tag" for _, _, what in hits for kind, _ in what):
        for m in _TAG_TEXT.finditer(text):
            polish, end = parse(text, m.end())
            if polish:
                labels.update(identifiers(polish))
                row["expressions"].append(text[m.end() : end].strip())
                row["permissive"] = evaluate(polish) and row["permissive"] is not False
                row["score"] = 1.0
    row |= {"n_base": len(base), "first_word": min(base, default=None), "last_word": max(base, default=None), "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels))}
    return row


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_())])


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    from pyspark.sql import functions as F

    def work(batches):
        for b in batches:
            rows = [scan(t) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in list(_ARROW)[1:])], schema=_ARROW)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("expressions", "permissive")
