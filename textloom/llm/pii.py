r"""Personal data: fixed rules, and a character BiLSTM-CRF that adds to them.

Rules (kind: pattern, condition), leftmost and non-overlapping per kind, a match
that fails its condition is dropped: email; ip (four parts of at most 255); card
(13 to 19 digits that pass Luhn); phone (`+`, 9 to 15 digits). Spans are whole
matches, in code points, end exclusive.

The tagger reads every character of every text, both ways, with LSTMs of numpy
and decodes with CRF transitions. Texts are read in windows of `WINDOW`
characters that overlap by `OVERLAP`. A window is decoded unless a bound on its
emissions proves that its best path is outside throughout (`may_tag`), so what is
skipped has no span. Windows are reconciled over the whole text: a character takes
its label from the window in whose middle it is nearest, and runs of a label are
spans, however many windows they pass through. Spans that touch no rule's span are
added, as `lstm_<label>`. Digits and signs of other scripts are read as the ASCII
ones that they stand for. The tagger is trained in numpy on spans of lines that
this module writes by a seeded generator.

Defined cases: a null text is the empty text, which has no spans; a very long text
is read whole, in blocks of windows, in time and memory proportional to it; spans
that touch are one if they have the same label; of equal scores the path with the
earlier label wins; repeated rows give a row each; a null id stays null; an empty
table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import random
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear_of, documents, map_arrow, texts_of
from .crf import forward_backward, padded, viterbi

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
LABELS = ("", "email", "phone", "ssn", "iban")
WINDOW, OVERLAP = 448, 48
#: Windows that are read at once.
_BLOCK = 768


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the rules, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


_DIGIT = re.compile("[0-9]")
#: Characters by number: 0 is past the end, ASCII by themselves, then other letters and the rest.
_CODES = 131


@lru_cache(1)
def _code_table() -> np.ndarray:
    def code(c: str) -> int:
        plain = unicodedata.normalize("NFKC", c) if "\uff01" <= c <= "\uff5e" else c
        digit = unicodedata.digit(c, None) if c.isdecimal() else None
        plain = plain if digit is None else str(digit)
        return ord(plain) + 1 if ord(plain) < 128 else 129 + (not c.isalpha())

    return np.array([code(chr(i)) for i in range(1 << 16)], np.uint8)


def codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _code_table()[np.minimum(raw, 0xFFFF)]


_ONE, _THIRD = np.float32(1), np.float32(1 / 3)


def _sigmoids(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """1 / (1 + exp(96 x)) in place, within 1e-6: exp(6 x) is (x x + x + 1/3) / (x x - x + 1/3), of which four squares are taken.

    Weights bound 96 x to some tens. This takes less time than numpy's exp."""
    np.multiply(x, x, out=low)
    low += _THIRD
    np.add(low, x, out=high)
    low -= x
    high /= low
    for _ in range(4):
        np.multiply(high, high, out=high)
    high += _ONE
    np.divide(_ONE, high, out=x)


class CharTagger:
    """Embedding, one LSTM each way, a linear layer and CRF transitions."""

    def __init__(self, embed: int = 12, hidden: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        k, g = len(LABELS), 4 * hidden
        self.hidden = hidden
        self.p = {
            "e": rng.normal(0, 0.3, (_CODES + 1, embed)), "wf": rng.normal(0, 0.25, (embed + hidden, g)), "bf": np.zeros(g), "wb": rng.normal(0, 0.25, (embed + hidden, g)), "bb": np.zeros(g),
            "o": rng.normal(0, 0.2, (2 * hidden, k)), "ob": np.zeros(k), "t": np.zeros((k, k)), "s": np.zeros(k),
        }
        self.p["bf"][hidden : 2 * hidden] = self.p["bb"][hidden : 2 * hidden] = 1.0

    def _lstm(self, x, w, b, keep):
        n, t, _ = x.shape
        h = self.hidden
        hs, cs = np.zeros((t + 1, n, h)), np.zeros((t + 1, n, h))
        gates = np.empty((t, n, 4 * h))
        xw = x @ w[: x.shape[2]] + b
        wh = w[x.shape[2] :]
        for i in range(t):
            z = xw[:, i] + hs[i] @ wh
            a = 1.0 / (1.0 + np.exp(-z[:, : 3 * h]))
            c = np.tanh(z[:, 3 * h :])
            gates[i, :, : 3 * h], gates[i, :, 3 * h :] = a, c
            cs[i + 1] = a[:, h : 2 * h] * cs[i] + a[:, :h] * c
            hs[i + 1] = a[:, 2 * h :] * np.tanh(cs[i + 1])
        return (hs, cs, gates) if keep else (hs, None, None)

    def _lstm_back(self, x, w, held, grad):
        hs, cs, gates = held
        n, t, d = x.shape
        h = self.hidden
        gz = np.empty((t, n, 4 * h))
        gh, gc = np.zeros((n, h)), np.zeros((n, h))
        wh = w[d:]
        for i in range(t - 1, -1, -1):
            gh = gh + grad[:, i]
            a, f, o, c = (gates[i, :, j * h : (j + 1) * h] for j in range(4))
            tc = np.tanh(cs[i + 1])
            gc = gc + gh * o * (1 - tc * tc)
            gz[i, :, :h] = gc * c * a * (1 - a)
            gz[i, :, h : 2 * h] = gc * cs[i] * f * (1 - f)
            gz[i, :, 2 * h : 3 * h] = gh * tc * o * (1 - o)
            gz[i, :, 3 * h :] = gc * a * (1 - c * c)
            gc = gc * f
            gh = gz[i] @ wh.T
        flat = gz.transpose(1, 0, 2).reshape(n * t, -1)
        gw = np.concatenate([x.reshape(n * t, d).T @ flat, hs[:-1].transpose(1, 0, 2).reshape(n * t, h).T @ flat])
        return gw, flat.sum(0), (flat @ w[:d].T).reshape(n, t, d)

    def emissions(self, ids: np.ndarray, keep: bool = False):
        p = self.p
        x = p["e"][ids]
        back = x[:, ::-1]
        f = self._lstm(x, p["wf"], p["bf"], keep)
        b = self._lstm(back, p["wb"], p["bb"], keep)
        both = np.concatenate([f[0][1:].transpose(1, 0, 2), b[0][1:].transpose(1, 0, 2)[:, ::-1]], 2)
        em = both @ p["o"] + p["ob"]
        return (em, x, back, f, b, both) if keep else em

    def fit(self, xs, ys, *, epochs: int = 8, batch: int = 128, rate: float = 0.03, seed: int = 3) -> CharTagger:
        """Adam on the conditional log-likelihood of the labels."""
        rng, p = np.random.default_rng(seed), self.p
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v = {k: np.zeros_like(x) for k, x in p.items()}
        step, last = 0, epochs * -(-len(xs) // batch)
        for _ in range(epochs):
            by_length = np.argsort([len(x) + rng.integers(0, 16) for x in xs], kind="stable")
            groups = [by_length[at : at + batch] for at in range(0, len(xs), batch)]
            for g in rng.permutation(len(groups)):
                pick = groups[g]
                ids, length = padded([xs[i] for i in pick])
                y, _ = padded([ys[i] for i in pick])
                live = np.arange(ids.shape[1])[None, :] < length[:, None]
                em, x, back, f, b, both = self.emissions(ids, True)
                marginal, pair, first = forward_backward(em, length, p["t"], p["s"])
                ge = (np.eye(len(LABELS))[y] * live[:, :, None] - marginal) / len(pick)
                g = {"t": -pair, "s": np.bincount(y[:, 0], minlength=len(LABELS)) - first}
                np.add.at(g["t"], (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1.0)
                g["t"], g["s"] = g["t"] / len(pick), g["s"] / len(pick)
                n = both.shape[0] * both.shape[1]
                g["o"], g["ob"] = both.reshape(n, -1).T @ ge.reshape(n, -1), ge.sum((0, 1))
                gh = ge @ p["o"].T
                h = self.hidden
                g["wf"], g["bf"], gx = self._lstm_back(x, p["wf"], f, gh[:, :, :h])
                g["wb"], g["bb"], gb = self._lstm_back(back, p["wb"], b, gh[:, ::-1, h:])
                g["e"] = np.zeros_like(p["e"])
                np.add.at(g["e"], ids, gx + gb[:, ::-1])
                step += 1
                now = rate * (1.0 - 0.9 * step / last)
                for k in p:
                    q = np.clip(g[k], -1.0, 1.0)
                    m[k] += 0.1 * (q - m[k])
                    v[k] += 0.001 * (q * q - v[k])
                    p[k] += now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def fast(self) -> tuple[np.ndarray, np.ndarray]:
        """Single-precision embeddings (size, codes), and for either way one matrix from (hidden, embedding, 1) to the gates and the labels.

        Gates are signed and scaled for `_sigmoids`; hidden values are held halved."""
        if getattr(self, "_fast", None) is None:
            p, h = self.p, self.hidden
            d, k = p["e"].shape[1], len(LABELS)
            scale = np.r_[np.full(3 * h, -1.0), np.full(h, -2.0)] / 96
            ways = []
            for w, b, o in ((p["wf"], p["bf"], p["o"][:h]), (p["wb"], p["bb"], p["o"][h:])):
                gates = np.concatenate([2 * w[d:], w[:d], b[None]]) * scale
                ways.append(np.concatenate([gates, np.concatenate([2 * o, np.zeros((d + 1, k))])], 1).T)
            self._fast = np.ascontiguousarray(p["e"].T, np.float32), np.ascontiguousarray(ways, np.float32)
        return self._fast

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_fast"}

    def read(self, ids: np.ndarray) -> np.ndarray:
        """Emissions (time, windows, labels) of codes (time, windows).

        Both ways are read at once, a row of memory for each gate. A step's product also
        gives the labels' share of the hidden values before it."""
        (e, w), h = self.fast(), self.hidden
        (t, n), d, g = ids.shape, len(e), 4 * h
        em = np.empty((t, len(LABELS), n), np.float32)
        em[:] = self.p["ob"][:, None]
        held, z, cell = np.zeros((2, h + d + 1, n), np.float32), np.empty((2, w.shape[1], n), np.float32), np.zeros((2, h, n), np.float32)
        spare = np.empty((2, 2, g, n), np.float32)
        held[:, -1] = 1.0
        hid, gates, tanh = held[:, :h], z[:, :g], z[:, 3 * h : g]
        with np.errstate(over="ignore"):  # exp that is infinite gives 0, as it should
            for i in range(t + 1):
                if i < t:
                    np.take(e, ids[i], axis=1, out=held[0, h:-1], mode="clip")
                    np.take(e, ids[t - 1 - i], axis=1, out=held[1, h:-1], mode="clip")
                np.matmul(w, held, out=z)
                if i:
                    em[i - 1] += z[0, g:]
                    em[t - i] += z[1, g:]
                if i == t:
                    break
                _sigmoids(gates, *spare)
                tanh *= -4.0  # cells are held times -2, as exp takes them
                tanh += 2.0
                tanh *= z[:, :h]
                cell *= z[:, h : 2 * h]
                cell += tanh
                np.exp(cell, out=hid)
                hid += 1.0
                np.divide(_ONE, hid, out=hid)
                hid -= 0.5
                hid *= z[:, 2 * h : 3 * h]
        return em.transpose(0, 2, 1)

    def may_tag(self, em: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Windows whose best path may leave label 0; of the others it is proven not to.

        A stretch of other labels gains at most its characters' best emission over
        label 0's, the best way in, the best way out and the best step within for
        each further character. No stretch gains if the best sum is not above 0."""
        t = self.p["t"] - self.p["t"][0, 0]
        into = max(float(t[0, 1:].max()), float((self.p["s"][1:] - self.p["s"][0]).max()))
        out, step = max(0.0, float(t[1:, 0].max())), float(t[1:, 1:].max())
        gain = em[:, :, 1].copy()
        for k in range(2, em.shape[2]):
            np.maximum(gain, em[:, :, k], out=gain)
        gain += np.float32(step) - em[:, :, 0]
        gain[np.arange(len(gain))[:, None] >= length[None, :]] = -np.inf
        run = np.full(em.shape[1], -np.inf, np.float32)
        best = run.copy()
        for g in gain:
            run = np.maximum(run, 0.0) + g
            np.maximum(best, run, out=best)
        return best + into + out - step > -1e-3

    def labels(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Labels of code arrays, each decoded as one window."""
        ids, length = padded(rows)
        path = viterbi(self.read(np.ascontiguousarray(ids.T)).transpose(1, 0, 2), length, self.p["t"], self.p["s"])
        return [path[i, :n] for i, n in enumerate(length)]


def window_starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and start of every window; windows overlap and cover all texts."""
    stride = WINDOW - OVERLAP
    many = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // stride)), 0)
    text = np.repeat(np.arange(len(lengths)), many)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * stride


def tagged(texts: list[str], tagger: CharTagger) -> list[list[tuple[str, int, int]]]:
    """Spans (label, start, end) of each text."""
    known = [codes(t) for t in texts]
    lengths = np.fromiter(map(len, known), np.int64, len(known))
    flat = np.concatenate([*known, np.zeros(WINDOW, np.uint8)])
    base = np.cumsum(lengths) - lengths
    text, start = window_starts(lengths)
    order = np.argsort(-np.minimum(lengths[text] - start, WINDOW), kind="stable")  # of one size together, so that few steps are past an end
    text, start = text[order], start[order]
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # text, position, label
    step = np.arange(WINDOW)
    for at in range(0, len(text), _BLOCK):
        i, a = text[at : at + _BLOCK], start[at : at + _BLOCK]
        size = np.minimum(lengths[i] - a, WINDOW)
        ids = flat[(base[i] + a)[None, :] + step[:, None]]
        ids[step[:, None] >= size[None, :]] = 0
        ids = ids[: int(size.max())]
        em = tagger.read(ids)
        use = np.flatnonzero(tagger.may_tag(em, size))
        if not len(use):
            continue
        path = viterbi(em[:, use].transpose(1, 0, 2), size[use], tagger.p["t"], tagger.p["s"])
        row, col = np.nonzero(path)
        w = use[row]
        # the middle of an overlap parts what either window decides
        mine = ((a[w] == 0) | (col >= OVERLAP // 2)) & ((a[w] + WINDOW >= lengths[i[w]]) | (col < WINDOW - OVERLAP // 2))
        hits.append((i[w[mine]], a[w[mine]] + col[mine], path[row[mine], col[mine]]))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if sum(len(h[0]) for h in hits):
        i, at, y = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.lexsort((at, i))
        i, at, y = i[order], at[order], y[order]
        new = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(at) != 1) | (np.diff(y) != 0)])
        for s, e in zip(new.tolist(), [*new[1:].tolist(), len(i)], strict=True):
            out[i[s]].append((LABELS[y[s]], int(at[s]), int(at[e - 1]) + 1))
    return out


_NAMES = "Anna Maria Peter John Jane Ahmed Olga Luis Wei Priya Emma Noah Sofia Ivan Chloe Hans Yuki Fatima Carlos Elena Smith Garcia Miller Rossi Novak Schmidt Dubois Kim Tanaka Singh Haddad Larsen Costa Brown".split()
_PLAIN = "the and of to in is at on by it as or be for with that this are was from der die das und ist im von zu la le de du des et en el los las que y un une por para per con al not at dot an a was at in call me my mail phone number account".split()
_SYLLABLES = "th he an er in on re ed nd ha at en es of or nt ti to it st io le is ou ar as de rt ve ing ion ent ly ble tion sch ein ge be ung keit lich eau eux oi qu ment ci ado os mi ra ñas ción ja ll ß ü ö ä é è ê ç í ó ko ma ni sa ta shi wo ri ku pr tr st br gl tz zu pf wh ez oz cz wi vi fu ju xa zi qu ck".split()
_CUES = {
    "email": ["email ", "e-mail: ", "mail me at ", "write to ", "contact: ", ""],
    "phone": ["phone: ", "call ", "call me on ", "tel. ", "Tel: ", "mobile ", "fax ", ""],
    "ssn": ["SSN ", "ssn: ", "social security number ", ""],
    "iban": ["IBAN ", "iban: ", "account ", ""],
    "": ["", "", "no. ", "id ", "at ", "version ", "order ", "page "],
}


def _sample(rng: random.Random) -> tuple[str, np.ndarray]:
    """A made-up line of a window's length at most, and its characters' labels."""
    low, dig, up = "abcdefghijklmnopqrstuvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    of = lambda chars, a, b=0: "".join(rng.choice(chars) for _ in range(rng.randint(a, b or a)))
    word = lambda: "".join(rng.choices(_SYLLABLES, k=rng.choice([1, 2, 2, 3, 3, 4, 5]))) if rng.random() < 0.7 else of(low + "etaoinsr" + "éüñäßçèêóí", 1, 12)
    any_word = lambda: rng.choice(_PLAIN) if rng.random() < 0.3 else word()

    def prose(n):
        """n words of sentences."""
        said = [any_word() + rng.choice(["", "", "", "", "", "", ",", ".", ".\n"]) for _ in range(n)]
        return " ".join(w.capitalize() if i == 0 or said[i - 1][-1:] in (".", "\n") else w for i, w in enumerate(said))

    made_name = lambda: rng.choice([rng.choice(_NAMES), of(up, 1) + of(low, 2, 8)])
    user, host = (lambda: of(low + dig, 2, 10)), (lambda: of(low, 3, 9))
    end = lambda: rng.choice(["com", "org", "net", "de", "io", "co.uk"])
    kinds = {
        "email": [
            lambda: f"{user()}@{host()}.{end()}", lambda: f"{word()}.{of(dig, 1, 2)}@mail{of(dig, 1)}.example.com", lambda: f"{user()} @ {host()}.{end()}", lambda: f"{user()}@{host()}",
            lambda: f"{user()} [at] {host()}.{end()}", lambda: f"{user()}[at]{host()}[dot]{end()}", lambda: f"{user()} (at) {host()} (dot) {end()}", lambda: f"{user()} [at] {host()} [dot] {end()}",
        ],
        "phone": [
            lambda: f"+{of(dig, 1, 2)} ({of(dig, 3)}) {of(dig, 3)}-{of(dig, 4)}", lambda: f"({of(dig, 3)}) {of(dig, 3)}-{of(dig, 4)}", lambda: f"({of(dig, 3)}) {of(dig, 3)}-{of(dig, 4)}", lambda: f"{of(dig, 3)}-{of(dig, 3)}-{of(dig, 4)}", lambda: f"{of(dig, 3)}.{of(dig, 3)}.{of(dig, 4)}",
            lambda: f"0{of(dig, 2, 4)} {of(dig, 3)} {of(dig, 3, 4)}", lambda: f"+{of(dig, 2)} {of(dig, 3)} {of(dig, 3)} {of(dig, 3, 4)}", lambda: f"{of(dig, 3)} {of(dig, 3)} {of(dig, 4)}",
        ],
        "ssn": [lambda: f"{of(dig, 3)}-{of(dig, 2)}-{of(dig, 4)}"],
        "iban": [lambda: f"{of(up, 2)}{of(dig, 2)} {' '.join(of(dig, 4) for _ in range(rng.randint(3, 5)))}", lambda: f"{of(up, 2)}{of(dig, 16, 20)}", lambda: f"{of(up, 2)}{of(dig, 2)} {' '.join(of(dig, 4) for _ in range(rng.randint(3, 5)))} {of(dig, 1, 3)}"],
        "": [
            lambda: of(dig, 1, 20), lambda: of(dig, 15, 17), lambda: ".".join(of(dig, 1, 3) for _ in range(4)), lambda: of("0123456789abcdef", 8, 40), lambda: f"token = \"{of('0123456789abcdef', 40)}\"", lambda: f"{rng.choice(['', '2', '20', '19'])}{of(dig, 2)}-{of(dig, 2)}-{of(dig, 2)}", lambda: f"{of(dig, 4)}-{of(dig, 2)}-{of(dig, 2)}", lambda: f"{of(dig, 2)}.{of(dig, 2)}.{of(dig, 4)}", lambda: " ".join([any_word()] * rng.randint(3, 12)), lambda: f"{of(dig, 1, 3)},{of(dig, 3)}.{of(dig, 2)}",
            lambda: f"{of(dig, 1, 2)}.{of(dig, 1, 2)}.{of(dig, 1, 2)}", lambda: f"{word()}{of(dig, 1, 3)}", lambda: f"{of(dig, 2)}:{of(dig, 2)}", lambda: f"{of(dig, 4)} {of(dig, 4)} {of(dig, 4)} {of(dig, 4)}", lambda: f"{of(dig, 4)}-{of(dig, 4)}", lambda: " ".join(any_word() for _ in range(6)),
            lambda: " ".join(any_word() for _ in range(8)), lambda: " ".join(made_name() for _ in range(rng.randint(1, 4))), lambda: " | ".join(word() + word() for _ in range(4)), lambda: f"CC BY-NC {of(dig, 1)}.0.", lambda: f"Version {of(dig, 1)}.{of(dig, 1)}", lambda: f"@{word()}", lambda: f"{of(dig, 1, 3)} - {of(dig, 1, 4)}",
            lambda: f"{word()}{rng.choice(['###', '***', '%%%', '&&&', '$$$'])} {word()}{rng.choice(['###', '***', '%%%'])}", lambda: f"{word()} at {word()}", lambda: f"{word()} dot {word()}", lambda: f"{of(up, 2, 5)}{of(dig, 1, 4)}", lambda: f"AKIA{of(up + dig, 16)}",
        ],
    }
    text, y = "", []

    def put(part, label=0):
        nonlocal text
        text += part
        y.extend([label] * len(part))

    size = rng.randint(40, 150)
    if rng.random() < 0.25:  # nothing personal: prose, one word or few over and over, signs
        few = [any_word() + rng.choice(["", "", ",", ".", "***", "%%%", "###"]) for _ in range(rng.choice([1, 1, 2, 4]))]
        put(rng.choice([lambda: prose(40), lambda: " ".join(rng.choice(few) for _ in range(80)), lambda: " ".join(word() + rng.choice(["%%%", "###", "***", "&&&", "$$$", ",***", ".%%%"]) for _ in range(30))])())
        at = rng.randint(0, 20)
        return text[at : at + size], np.array(y[at : at + size], np.int64)
    while len(text) < size:
        put(prose(rng.choice([0, 1, 2, 3, 5, 8, 13, 20])) + rng.choice([" ", " ", " ", ", ", ". ", ": ", "\n"]))
        kind = rng.choice(["", "", "", *kinds])
        put(rng.choice(_CUES[kind]))
        put(rng.choice(kinds[kind])(), LABELS.index(kind))
        put(rng.choice([" ", ". ", ", ", "\n", "###\n", "; ", ".\n"]))
    at = rng.randint(0, 12) * (rng.random() < 0.3)
    return text[at : at + size + 24], np.array(y[at : at + size + 24], np.int64)


def labelled(n: int, seed: int):
    rng = random.Random(seed)
    made = [_sample(rng) for _ in range(n)]
    return [codes(t) for t, _ in made], [y for _, y in made]


@lru_cache(2)
def train(samples: int = 7000, seed: int = 17, epochs: int = 8) -> CharTagger:
    return CharTagger().fit(*labelled(samples, seed), epochs=epochs)


def all_spans(texts: list[str], tagger: CharTagger) -> list[tuple[list, list]]:
    """Per text: the rules' spans, and those with the tagger's added, as (kind, start, end)."""
    out = []
    for text, more in zip(texts, tagged(texts, tagger), strict=True):
        base = [(KINDS[k], s, e) for k, s, e in base_spans(text)]
        clear = clear_of([(s, e) for _, s, e in base])
        new = [(f"lstm_{k}", s, e) for k, s, e in more if clear(s, e)]
        out.append((base, base + sorted(new)))
    return out


def scan_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tagger: CharTagger | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end)."""
    tagger = tagger or train()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        for b in batches:
            found = all_spans(texts_of(b), tagger)
            cols = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f[j]] for f in found], kind) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "base", "spans"])

    item = "array<struct<kind:string,start:long,end:long>>"
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, f"doc_id long, base {item}, spans {item}")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import span_list

    found = scan_pii(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(n(k) for k in KINDS), F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"))
