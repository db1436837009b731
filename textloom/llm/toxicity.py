r"""Toxicity: a linear-chain CRF tags toxic spans; its marginals give scores.

Labels exist for documents, so words get theirs first: in toxic documents of the
training rows a word is toxic if one of its character n-grams (of the word with
its ends marked) is at least `LIFT` times likelier in toxic documents than in
clean ones; all other words are clean. The CRF (labels clean, toxic) learns from
these: a word's emission is the sum of its n-grams' weights, plus weights of its
neighbours' first n-grams as whole words. Forward-backward runs exactly over
whole texts: blocks of words are multiplied into 2x2 matrices, carried over, and
run through again. A document's score is a logistic function, fitted on training
documents, of the log odds that any word is toxic.

Training reads at most `TRAIN_ROWS` labelled documents of either class, those
with the smallest hash of their id (of an id that repeats, the least text); the
bound is a parameter, and these whole texts are what the driver holds. Only rows with
crc32(doc_id as text) mod 5 != 0 are read. Scores see the text alone.

Spans are the code-point offsets, in the text as given, of runs of words that are
toxic with `threshold` or more.

Defined cases: a null text is the empty text and, like any text without words,
scores as one without toxic words; a very long text is read whole, in time and
memory proportional to it; a score of exactly 0.5 is predicted toxic; repeated rows give a row each; rows with a
null id are scored, held_out is null; without labelled rows of both classes every
score is 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, texts_of
from .crf import FeatureCrf

TRAIN_ROWS = 1500
LIFT, SUPPORT = 15.0, 4
SIZES = (5, 6, 7)
BLOCK = 64
_WORD = re.compile(r"\w+")
_KNOWN: dict[str, tuple[dict, list]] = {}  # by tagger: words' numbers, and [table of their weights]


def lowered(text: str) -> str:
    """The text in lower case, character by character: offsets stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


def grams(word: str) -> list[str]:
    x = f"^{word}$"
    return [x, *(x[i : i + n] for n in SIZES for i in range(len(x) - n + 1))]


@dataclass
class Tagger:
    """Differences toxic - clean of n-gram weights; log transitions; score line."""

    own: dict[str, float]
    left: dict[str, float]
    right: dict[str, float]
    bias: float
    trans: np.ndarray
    start: np.ndarray
    line: tuple[float, float]

    def __post_init__(self):
        self.key = uuid.uuid4().hex
        self._fresh()

    def _fresh(self):
        """Known words' numbers and weights; where workers are reused they outlive a task."""
        if len(_KNOWN) > 2:
            _KNOWN.clear()
        _KNOWN[self.key] = self.index, self.values = {}, [np.zeros((1 << 12, 3))]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "values")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        if self.key in _KNOWN:
            self.index, self.values = _KNOWN[self.key]
        else:
            self._fresh()

    def numbers(self, words: list[str]) -> list[int]:
        index, own = self.index, self.own
        try:
            return [index[w] for w in words]
        except KeyError:
            pass
        for w in set(words):
            if w not in index:
                at = index[w] = len(index)
                if at >= len(self.values[0]):
                    self.values[0] = np.concatenate([self.values[0], np.zeros_like(self.values[0])])
                said = {g for g in grams(w) if g in own}
                if said or w in self.left or w in self.right:
                    self.values[0][at] = sum(own[g] for g in sorted(said)), self.left.get(w, 0.0), self.right.get(w, 0.0)
        return [index[w] for w in words]

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """P(word is toxic) of each word of each text."""
        if len(self.index) > 300_000:
            self._fresh()
        numbers = [self.numbers(ws) for ws in texts]
        n = sum(map(len, numbers)) + len(texts)
        table = self.values[0]
        flat = np.full(n, -1, np.int64)
        at, cuts = 0, []
        for x in numbers:
            flat[at + 1 : at + 1 + len(x)] = x
            cuts.append((at + 1, at + 1 + len(x)))
            at += len(x) + 1
        here = np.where(flat[:, None] >= 0, table[flat], 0.0)
        em = self.bias + here[:, 0]
        em[1:] += here[:-1, 1]
        em[:-1] += here[1:, 2]
        m = chain_marginals(em, flat < 0, self.trans, self.start)
        return [m[a:b] for a, b in cuts]

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        return logistic(self.line[0] + self.line[1] * np.array([any_odds(m) for m in self.marginals(texts)]))


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def any_odds(m: np.ndarray) -> float:
    """Log odds that some word is toxic, between -8 and 8."""
    none = float(np.log1p(-np.minimum(m, 1 - 1e-6)).sum())
    return float(np.clip(np.log(max(-np.expm1(none), 1e-12)) - none, -8.0, 8.0))


def chain_marginals(em: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward over texts laid end to end; `first` marks what stands before each.

    The mark is a step whose matrix is of rank one: whatever was before, the next
    word starts anew, and what comes after has no say in what was before."""
    n = len(em)
    rows = -(-n // BLOCK)
    e = np.exp(np.clip(em, -30, 30))
    steps = np.empty((rows * BLOCK, 2, 2))
    steps[:n] = np.exp(trans)
    steps[:n, :, 1] *= e[:, None]
    steps[n:] = np.eye(2)
    steps[:n][first] = 1.0
    after = np.flatnonzero(first) + 1
    after = after[(after < n) & ~first[np.minimum(after, n - 1)]]
    steps[after] = np.exp(start) * np.stack([np.ones(len(after)), e[after]], 1)[:, None, :]
    # (step of a block, from, to, block): every operation below runs over all blocks
    m = np.ascontiguousarray(steps.reshape(rows, BLOCK, 2, 2).transpose(1, 2, 3, 0))
    t00, t01, t10, t11 = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for (a, b), (c, d) in m:
        t00, t01, t10, t11 = t00 * a + t01 * c, t00 * b + t01 * d, t10 * a + t11 * c, t10 * b + t11 * d
        scale = 1.0 / (t00 + t01 + t10 + t11)
        t00, t01, t10, t11 = t00 * scale, t01 * scale, t10 * scale, t11 * scale
    whole = list(zip(t00.tolist(), t01.tolist(), t10.tolist(), t11.tolist(), strict=True))
    head, tail = np.empty(rows), np.empty(rows)  # the first of two numbers that sum to 1
    v = 0.5
    for r, (a, b, c, d) in enumerate(whole):
        head[r] = v
        x, y = v * a + (1 - v) * c, v * b + (1 - v) * d
        v = x / (x + y)
    v = 0.5
    for r in range(rows - 1, -1, -1):
        tail[r] = v
        a, b, c, d = whole[r]
        x, y = a * v + b * (1 - v), c * v + d * (1 - v)
        v = x / (x + y)
    alpha, beta = np.empty((BLOCK, rows)), np.empty((BLOCK, rows))
    for i, ((a, b), (c, d)) in enumerate(m):
        x, y = head * a + (1 - head) * c, head * b + (1 - head) * d
        head = x / (x + y)
        alpha[i] = head
    for i in range(BLOCK - 1, -1, -1):
        beta[i] = tail
        (a, b), (c, d) = m[i]
        x, y = a * tail + b * (1 - tail), c * tail + d * (1 - tail)
        tail = x / (x + y)
    clean, toxic = alpha * beta, (1 - alpha) * (1 - beta)
    return (toxic / (clean + toxic)).T.reshape(-1)[:n]


def fit(toxic: list[str], clean: list[str], *, lift: float = LIFT, support: int = SUPPORT, window: int = 8, weights: tuple[float, float] = (1.0, 1.0)) -> Tagger | None:
    """Learns from texts of either class; None if a class has none.

    weights: how many documents a toxic and a clean text stand for in the scores' scale."""
    if not toxic or not clean:
        return None
    tw, cw = [words_of(t) for t in toxic], [words_of(t) for t in clean]
    apart = [ws[::4] if len(tw) >= 40 and len(cw) >= 40 else ws for ws in (tw, cw)]  # the scale is fitted on texts that the words' weights have not seen
    if len(tw) >= 40 and len(cw) >= 40:
        tw, cw = ([ws for i, ws in enumerate(x) if i % 4] for x in (tw, cw))
    known: dict[str, list[str]] = {}
    of = lambda w: known.get(w) or known.setdefault(w, grams(w))

    def in_docs(docs):
        n: dict[str, int] = {}
        for ws in docs:
            for g in {g for w in set(ws) for g in of(w)}:
                n[g] = n.get(g, 0) + 1
        return n

    nt, nc = in_docs(tw), in_docs(cw)
    scale = (len(cw) + 1) / (len(tw) + 1)
    strong = {g for g, k in nt.items() if k >= support and k * scale >= lift * (nc.get(g, 0) + 0.5)}
    some = {g for g, k in nt.items() if k >= support and k * scale >= 2 * (nc.get(g, 0) + 0.5)} | strong
    number = {g: i + 2 for i, g in enumerate(sorted(some))}
    near: dict[tuple[str, str], int] = {}
    base = len(number) + 2
    bad = {w for ws in tw for w in ws if any(g in strong for g in of(w))}
    for ws in tw:
        for i, w in enumerate(ws):
            if w in bad:
                for side, j in (("l", i - 1), ("r", i + 1)):
                    if 0 <= j < len(ws):
                        near.setdefault((side, ws[j]), base + len(near))
    numbered: dict[str, list[int]] = {}

    def sequence(ws, a, b, toxic_text):
        rows = []
        for i in range(a, b):
            if ws[i] not in numbered:
                numbered[ws[i]] = sorted({number[g] for g in of(ws[i]) if g in number})
            rows.append([1, *numbered[ws[i]], *(near[k] for k in (("l", ws[i - 1]) if i else None, ("r", ws[i + 1]) if i + 1 < len(ws) else None) if k in near)])
        x = np.zeros((b - a, max(map(len, rows))), np.int32)
        for r, fs in enumerate(rows):
            x[r, : len(fs)] = fs
        return x, np.array([toxic_text and ws[i] in bad for i in range(a, b)], np.int64)

    xs, ys = [], []
    for texts, is_toxic in ((tw, True), (cw, False)):
        for ws in texts:
            hot = [i for i, w in enumerate(ws) if any(g in some for g in of(w))]
            end = 0
            for i in hot:  # stretches around words that say something, of each training text
                if i >= end:
                    a, end = max(end, i - window), min(len(ws), i + window + 1)
                    x, y = sequence(ws, a, end, is_toxic)
                    xs.append(x)
                    ys.append(y)
    if not xs:
        return None
    crf = FeatureCrf(base + len(near), 2).fit(xs, ys, epochs=4, batch=256)
    d = crf.w[:, 1] - crf.w[:, 0]
    tagger = Tagger({g: float(d[i]) for g, i in number.items()}, {w: float(d[i]) for (s, w), i in near.items() if s == "l"}, {w: float(d[i]) for (s, w), i in near.items() if s == "r"}, float(d[1]), crf.trans, crf.start, (0.0, 1.0))
    x = np.array([any_odds(m) for m in tagger.marginals(apart[0] + apart[1])])
    y = np.repeat([1.0, 0.0], [len(a) for a in apart])
    many = np.repeat(weights, [len(a) for a in apart])
    a, b = 0.0, 1.0
    for _ in range(100):  # Newton's method by short steps, lightly regularised
        p = logistic(a + b * x)
        w = np.maximum(p * (1 - p), 1e-6) * many
        r = (y - p) * many
        g = np.array([r.sum() - 1e-2 * a, (r * x).sum() - 1e-2 * (b - 1)])
        h = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    tagger.line = (float(a), float(max(b, 1e-3)))
    tagger._fresh()
    return tagger


def fold(col):
    return F.crc32(F.encode(F.col(col).cast("string"), "UTF-8")) % 5


def train(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS) -> Tagger | None:
    """Fits on at most `rows` labelled documents of either class outside the held-out fifth."""
    known = labels.where("doc_id is not null and toxic is not null").where(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = None
    for value in (0, 1):
        part = known.where(F.col("toxic") == value).orderBy(*by_hash).limit(rows)
        few = part if few is None else few.unionByName(part)
    held = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most 2 * rows ids
    held = held.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    got = sorted((r.toxic, r.doc_id, r.text) for r in held.collect())
    texts = {v: [t for y, _, t in got if y == v] for v in (1, 0)}
    total = {r.toxic: r["count"] for r in known.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    return fit(texts[1], texts[0], weights=tuple(total.get(v, 0) / max(1, len(texts[v])) for v in (1, 0)))


def toxic_runs(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    out, last = [], -2
    for k, w in enumerate(_WORD.finditer(lowered(text))):
        if hit[k]:
            if k == last + 1:
                out[-1]["end"] = w.end()
            else:
                out.append({"start": w.start(), "end": w.end()})
            last = k
    return out


def score_toxicity(docs: DataFrame, tagger: Tagger | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score, and spans: code-point offsets of runs of words that are toxic with `threshold` or more."""

    def work(batches):
        for b in batches:
            texts = texts_of(b)
            words = [words_of(t) for t in texts]
            if tagger is None:
                score, spans = np.zeros(len(texts)), [[] for _ in texts]
            else:
                ms = tagger.marginals(words)
                score = logistic(tagger.line[0] + tagger.line[1] * np.array([any_odds(m) for m in ms]))
                spans = []
                for t, m in zip(texts, ms, strict=True):
                    hit = m >= threshold
                    spans.append(toxic_runs(t, hit) if hit.any() else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "score", "spans"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, score double, spans array<struct<start:long,end:long>>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tagger = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score_toxicity(docs, tagger)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))
