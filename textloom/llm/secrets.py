r"""Secret scans: fixed rules, and a linear-chain CRF that adds to them.

Rules (kind: pattern, condition), leftmost and non-overlapping per kind:
assign: a key word, `:` or `=`, a value of 12 characters or more; access:
`AKIA...` of 18 or more; hex: runs of [0-9a-f] of 16 or more. A span is the
whole match, in code points, end exclusive.

The CRF tags every token of a text begin / inside / outside by its shape, the
words around it and features of the file, in one chain from the text's start to
its end, and is decoded by Viterbi; inside never follows outside. A token is a run
of word characters and `+/~-` (inner dots, two `=` at the end) or one other visible
character; a secret may have several (`inside`). What a token adds to its own
emission and to its neighbours' depends on the token alone, so it is kept for known
tokens, and a batch's emissions are gathered at once. Viterbi runs on the stretches
in which a bound on the emissions lets a label other than outside win; elsewhere
outside is proven to be best (`stretches`). Tagged spans that touch no span of the
rules are added, as kind `crf`. The tagger is fitted on lines that this module
writes by a seeded generator (`train`); nothing is read from the corpus.

Defined cases: a null text is the empty text, which has no spans; a very long text
is read whole, in time and memory proportional to it; of equal scores the path with
the earlier label (outside, begin, inside) wins; repeated rows give a row each; a
null id stays null; an empty table gives no rows; further columns of the input are
ignored, and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import random
import re
import uuid
from functools import lru_cache
from operator import ne
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii
from .common import clear_of, documents, map_arrow, texts_of, with_row
from .crf import FeatureCrf, padded, viterbi

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the rules, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # a run of [0-9a-f]+ is maximal, so dropping short ones is asking for 16
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


#: A run of word characters with inner dots, or one other visible character.
_TOKEN = re.compile(r"[\w+/~-]+(?:\.[\w+/~-]+)*={0,2}(?!\w)|[^\w\s]|\S")
_BUCKETS = 1 << 15
OUTSIDE, BEGIN, INSIDE = range(3)
_NEVER = -1e4
#: Known tokens' numbers and what they add to emissions, by tagger; where Python workers are reused they outlive a task.
_KNOWN: dict[str, dict] = {}
_MOST_KNOWN = 250_000
#: Characters that are tagged at once, unless one text has more.
_PART_CHARS = 1 << 19


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text)


#: Lower-case letters as a, capitals as A, digits as 0.
_CLASSES = str.maketrans({chr(c): "a" if chr(c).islower() else "A" if chr(c).isupper() else "0" for c in range(0x250) if chr(c).isalnum()})
_RUNS = re.compile(r"(.)\1+", re.DOTALL)


def kind_of(token: str) -> int:
    """0 sign, 1 word, 2 number, 3 short mixture, 4 long mixture."""
    plain = token.rstrip("=")
    if plain.isalpha() and (plain.islower() or plain.isupper() or plain[1:].islower()):
        return 1 if len(plain) < 20 else 4
    if len(plain) < 2 and not plain.isalnum():
        return 0
    if plain.replace(".", "").replace("-", "").isdigit():
        return 2
    return (3 if len(plain) < 12 else 4) if any(map(str.isalnum, plain)) else 0


_OWN = 11
#: Feature numbers: 0 is none, then counted features (which, value, kind), then the few named ones, then hashed ones.
_COUNTED, _NAMED = 64 * 5, 8 * 64 * 5 + 1
_HASHED = _NAMED + 64
_SALTS = tuple(0x9E3779B1 * (2 * k + 1) & 0xFFFFFFFF for k in range(7))


def _hashed(crc: int, which: int) -> int:
    return _HASHED + ((crc ^ _SALTS[which]) * 0x85EBCA6B >> 7) % (_BUCKETS - _HASHED)


def token_features(token: str) -> tuple[list[int], int]:
    """Feature numbers: `_OWN` of the token itself, then two each for the next token, the one after and the one before; its kind.

    Its own are its kind, length, shares of digits, capitals and vowels, changes of
    class, variety, first characters, signs, shape and name."""
    n, kind, low = len(token), kind_of(token), token.lower().rstrip("=")
    classes = token.translate(_CLASSES)
    switches = sum(map(ne, classes, classes[1:]))
    vowels = sum(map(low.count, "aeiouy"))
    # whole words of up to 16 characters are known by name, others by their kind and length
    name = crc32((low if kind < 2 and n <= 16 else f"<{kind}{min(n // 8, 4)}>").encode("utf-8", "replace"))
    shape = _RUNS.sub(r"\1+", classes) if kind > 1 else ""
    signs = "".join(sorted({c for c in token if not c.isalnum()})) if kind != 1 else ""
    counted = (1, min(n // 4, 12), classes.count("0") * 4 // n, classes.count("A") * 4 // n, min(switches * 8 // n, 8), vowels * 6 // n, min(len(set(token)) * 8 // min(n, 32), 8))
    own = [1 + _COUNTED * k + 5 * v + kind for k, v in enumerate(counted)]
    own += (_hashed(crc32(token[:4].encode("utf-8", "replace")), 0), _hashed(crc32(signs.encode("utf-8", "replace")), 1), _hashed(crc32(shape.encode("utf-8", "replace")) if len(shape) < 12 else 7, 2), _hashed(name, 3))
    own += (_hashed(name, 4), _NAMED + kind, _hashed(name, 5), _NAMED + 5 + kind, _hashed(name, 6), _NAMED + 10 + kind)
    return own, kind


#: The mark that parts texts, and what it gives to its neighbours.
_EDGE = (_NAMED + 15, _NAMED + 16, _NAMED + 17, _NAMED + 18)


def file_features(text: str) -> tuple[int, int]:
    n = max(1, len(text))
    return min(sum(text.count(c) for c in "{};=()<>") * 200 // n, 6), min(text.count("\n") * 400 // n, 6)


def _of_file(file: tuple[int, int], kind: int) -> list[int]:
    return [1 + _COUNTED * 7 + 5 * file[0] + kind, 1 + _COUNTED * 7 + 5 * (8 + file[1]) + kind]


def chain_features(text: str) -> np.ndarray:
    """(1 + tokens, features): a mark before the text, then its tokens."""
    file, o = file_features(text), _OWN
    edge = ([_EDGE[0], *[0] * (o - 1), _EDGE[1], 0, _EDGE[2], 0, _EDGE[3], 0], 0)
    each = [edge, *map(token_features, tokens_of(text)), edge]
    rows = []
    for i in range(len(each) - 1):
        fs = [*each[i][0][:o], *each[i + 1][0][o + 4 :], *(_of_file(file, each[i][1]) if i else ())]
        if i:
            fs += each[i - 1][0][o : o + 2]
        if i > 1:
            fs += each[i - 2][0][o + 2 : o + 4]
        rows.append(fs)
    out = np.zeros((len(rows), max(map(len, rows))), np.int32)
    for i, fs in enumerate(rows):
        out[i, : len(fs)] = fs
    return out


class SecretTagger:
    def __init__(self, crf: FeatureCrf):
        self.crf = crf
        self.key = uuid.uuid4().hex

    def known(self) -> dict:
        """Known tokens; begun anew, between batches alone, once there are very many."""
        held = _KNOWN.get(self.key)
        if held is None or len(held["number"]) > _MOST_KNOWN:
            if len(_KNOWN) > 2:
                _KNOWN.clear()
            w = self.crf.w
            table = np.zeros((1 << 14, 12), np.float32)
            # number 0 is the mark that parts texts; it is outside, so that nothing passes through it
            table[0] = np.concatenate([[0.0, _NEVER, _NEVER], *w[list(_EDGE[1:])]])
            held = _KNOWN[self.key] = {"number": {}, "table": table, "kind": np.zeros(1 << 14, np.int8), "file": {}}
        return held

    def numbers(self, held: dict, tokens: list[str]) -> list[int]:
        number = held["number"]
        try:
            return [number[t] for t in tokens]
        except KeyError:
            pass
        new = list(dict.fromkeys(t for t in tokens if t not in number))
        found = [token_features(t) for t in new]
        at = len(number) + 1
        number.update(zip(new, range(at, at + len(new)), strict=True))
        while at + len(new) > len(held["table"]):
            held["table"] = np.concatenate([held["table"], np.zeros_like(held["table"])])
            held["kind"] = np.concatenate([held["kind"], np.zeros_like(held["kind"])])
        w, o = self.crf.w[np.array([f for f, _ in found])], _OWN
        held["table"][at : at + len(new)] = np.concatenate([w[:, :o].sum(1), w[:, o : o + 2].sum(1), w[:, o + 2 : o + 4].sum(1), w[:, o + 4 :].sum(1)], 1)
        held["kind"][at : at + len(new)] = [k for _, k in found]
        return [number[t] for t in tokens]

    def emissions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of the texts' tokens, laid end to end with a mark before each; where each text's mark stands."""
        held = self.known()
        flat, marks = [], np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            flat.append(0)
            flat += self.numbers(held, tokens_of(t))
            marks[i + 1] = len(flat)
        at = np.array(flat, np.int64)
        rows = held["table"][at]
        em = rows[:, :3].astype(float)
        em[1:] += rows[:-1, 3:6]
        em[2:][at[1:-1] != 0] += rows[:-2, 6:9][at[1:-1] != 0]
        em[:-1] += rows[1:, 9:12]
        if len(em):
            em[-1] += held["table"][0, 9:12]
        kinds = held["kind"][at]
        for i, t in enumerate(texts):
            if (file := file_features(t)) not in held["file"]:
                held["file"][file] = np.stack([self.crf.w[_of_file(file, k)].sum(0) for k in range(5)])
            em[marks[i] + 1 : marks[i + 1]] += held["file"][file][kinds[marks[i] + 1 : marks[i + 1]]]
        em[at == 0] = (0.0, _NEVER, _NEVER)
        return em, marks[:-1]

    def stretches(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the parts where a best path may leave `outside`; elsewhere it is proven not to.

        A stretch of other labels gains at most the best step in, the best step out,
        and for each token its best emission over outside's and the best step within.
        best[i] is the greatest such sum of all stretches through i."""
        t = self.crf.trans - self.crf.trans[0, 0]
        into, out, step = float(t[0, BEGIN]), max(0.0, float(t[1:, 0].max())), float(t[1:, 1:].max())
        gain = np.maximum(em[:, 1:].max(1) - em[:, 0] + step, -60.0)
        gain[em[:, 1] <= _NEVER / 2] = -1e3
        total = np.concatenate([[0.0], np.cumsum(gain)])
        ending = total[1:] - np.minimum.accumulate(total[:-1])
        starting = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        best = ending + starting - gain + into + out - step
        use = np.flatnonzero(best > -1e-6)
        if not len(use):
            return use, use
        new = np.flatnonzero(np.r_[True, np.diff(use) != 1])
        return use[new], use[np.r_[new[1:] - 1, len(use) - 1]] + 1

    def paths(self, em: np.ndarray) -> np.ndarray:
        """The best labels of the chain."""
        path = np.zeros(len(em), np.int8)
        first, last = self.stretches(em)
        order = np.argsort(last - first, kind="stable")
        at, trans = 0, self.crf.trans
        while at < len(order):
            n = int(np.searchsorted(np.cumsum((last - first)[order[at:]]), 1 << 16)) + 1
            pick = order[at : at + n]
            at += n
            rows, length = padded([em[first[k] : last[k]] for k in pick], 0.0)
            rows[np.arange(len(pick)), length - 1] += trans[:, OUTSIDE]  # outside follows
            found = viterbi(rows, length, trans, trans[OUTSIDE])
            for k, p in zip(pick, found, strict=True):
                path[first[k] : last[k]] = p[: last[k] - first[k]]
        return path

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= _PART_CHARS:
                size += len(texts[end])
                end += 1
            em, marks = self.emissions(texts[at:end])
            path = self.paths(em)
            for i in np.unique(np.searchsorted(marks, np.flatnonzero(path), "right") - 1).tolist():
                labels = path[marks[i] + 1 : marks[i + 1] if i + 1 < len(marks) else len(path)]
                got = out[at + i]
                for m, y in zip(_TOKEN.finditer(texts[at + i]), labels.tolist(), strict=True):
                    if y == BEGIN:
                        got.append((m.start(), m.end()))
                    elif y == INSIDE:
                        got[-1] = (got[-1][0], m.end())
            at = end
        return out


_KEY_WORDS = "token secret password api_key apikey auth authorization access_key client_secret private_key credential credentials passphrase aws_secret_access_key session_key passcode pwd pass secret_key auth_token refresh_token pin licence_key license_key recovery_key seed_phrase wifi_password login db_password encryption_key signing_key".split()
_HEADS = "ghp_ gho_ sk_live_ sk_test_ sk- xoxb- glpat- AKIA AIza npm_ eyJ pypi- dop_v1_ SG.".split()


def _sample(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A made-up text and its secret spans."""
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    of = lambda chars, a, b=0: "".join(rng.choice(chars) for _ in range(rng.randint(a, b or a)))
    word = lambda: "".join(rng.choices(pii._SYLLABLES, k=rng.choice([1, 2, 2, 3, 3, 4, 5, 6]))) if rng.random() < 0.7 else of(low + "etaoinsr" + "éüñäß", 2, 9)
    any_word = lambda: rng.choice(pii._PLAIN) if rng.random() < 0.3 else word()
    text, spans, code = "", [], rng.random() < 0.3

    def prose(n):
        said = [any_word() + rng.choice(["", "", "", "", "", "", ",", ".", ".\n"]) for _ in range(n)]
        return " ".join(w.capitalize() if i == 0 or said[i - 1][-1:] in (".", "\n") else w for i, w in enumerate(said))

    def put(part, secret=False):
        nonlocal text
        if secret:
            spans.append((len(text), len(text) + len(part)))
        text += part

    def value():
        return rng.choice([
            lambda: of(low + up + dig, 12, 48), lambda: of(low + up, 12, 40), lambda: of(low, 14, 32), lambda: of(up, 14, 32), lambda: of(hexa, 16, 64), lambda: of(low + up + dig + "+/", 16, 60) + rng.choice(["", "=", "=="]), lambda: of(low + dig, 10, 32), lambda: of(up + dig, 12, 32),
            lambda: "-".join(of(up + dig, 4, 6) for _ in range(rng.randint(3, 6))), lambda: "".join(word() for _ in range(4)), lambda: of(low + up + dig, 4, 8) + rng.choice("!@#$%&*") + of(low + up + dig, 3, 8) + rng.choice(["", "!", "$", "#"]),
            lambda: rng.choice(_HEADS) + of(low + up + dig, 16, 40), lambda: f"{of(low + up + dig, 16, 24)}.{of(low + up + dig, 20, 40)}.{of(low + up + dig, 20, 40)}",
        ])()

    def words_value():
        return rng.choice([lambda: " ".join(word() for _ in range(rng.randint(3, 7))), lambda: " ".join(of(low + up + dig, 4) for _ in range(rng.randint(3, 6))), lambda: " ".join(of(up + dig, 4, 6) for _ in range(rng.randint(3, 6))), lambda: " ".join(of(low, 4, 5) for _ in range(rng.randint(4, 6)))])()

    if rng.random() < 0.3:  # no secret: long prose, words over and over, signs
        few = [any_word() + rng.choice(["", "", ",", ".", "***", "%%%"]) for _ in range(rng.choice([1, 2, 4]))]
        put(rng.choice([lambda: prose(90), lambda: prose(90), lambda: prose(60).upper(), lambda: " ".join(rng.choice(few) for _ in range(60)), lambda: " ".join(" ".join([any_word()] * rng.randint(2, 20)) for _ in range(8)), lambda: " ".join(word() + rng.choice(["%%%", "###", "***", "&&&", "$$$", ",***"]) for _ in range(60)), lambda: " ".join(w + rng.choice(["!!", "!!", "", "!", "?!"]) for w in prose(60).upper().split(" ")), lambda: " | ".join(prose(1) for _ in range(40))])())
        return text, spans
    for _ in range(rng.randint(1, 4)):
        put(prose(rng.choice([0, 1, 2, 4, 7, 12])) + rng.choice([" ", " ", " ", ", ", ". ", "\n"]))
        r = rng.random()
        key = rng.choice(_KEY_WORDS)
        key = rng.choice([key, key, key.upper(), key.capitalize(), key.replace("_", " "), key.replace("_", "-"), f"{word()}_{key}"])
        if r < 0.22:
            put(rng.choice(["", "", "my ", "the ", "export ", '"', "set "]) + key + rng.choice([" = ", "=", ": ", ":", " := ", '": "', ' = "', "='", " is ", ": '", " was ", " -> "]))
            quote = text[-1] if text[-1] in "\"'" else ""
            put(value(), True)
            put(quote)
        elif r < 0.32:
            put(rng.choice(["Authorization: Bearer ", "Authorization: Basic ", "Authorization: token ", "authorization: bearer ", "bearer ", "Bearer ", "-H 'X-Api-Key: ", "x-auth-token: "]))
            put(value(), True)
        elif r < 0.50:
            quote = rng.choice(['"', "'", ""])
            put(rng.choice(["passphrase", "recovery phrase", "the recovery phrase", "seed phrase", "recovery key", "password", "secret", "backup code", "licence key", "passphrase", "mnemonic"]) + rng.choice([" is ", ": ", " = ", "="]) + quote)
            put(words_value(), True)
            put(quote or rng.choice([".", "\n", "\n", ";"]))
        elif r < 0.55:
            put(rng.choice(_HEADS) + of(low + up + dig, 18, 40), True)
        elif r < 0.58:
            put(f"{rng.choice(['postgres', 'mysql', 'https', 'mongodb', 'redis', 'amqp'])}://{of(low, 3, 8)}:")
            put(of(low + up + dig, 8, 20), True)
            put(f"@{of(low, 3, 8)}.{of(low, 2, 6)}{rng.choice([':5432', '', ''])}/{of(low, 2, 6)}")
        elif r < 0.61:
            name = rng.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY", "EC PRIVATE KEY"])
            put(f"-----BEGIN {name}-----\n")
            put("\n".join([*("".join(rng.choices(low + up + dig + "+/", k=64)) for _ in range(rng.randint(1, 3))), of(low + up + dig, 8, 50) + rng.choice(["", "=", "=="])]), True)
            put(f"\n-----END {name}-----")
        elif r < 0.72:  # words of secrets without one
            put(rng.choice([key, key.lower(), "password", "secret", "token", "key"]) + rng.choice([" is required", " must be changed", " reset", "s are kept safe", " ring", " of " + prose(3), " and " + prose(2), ": see page " + of(dig, 1, 3), " is " + prose(1), ": none", " = None", " = input()", " expired on " + of(dig, 4) + "-" + of(dig, 2) + "-" + of(dig, 2), "? " + prose(4)]))
        else:
            put(rng.choice([
                lambda: of(dig, 8, 19), lambda: ".".join(of(dig, 1, 3) for _ in range(4)), lambda: f"+1 ({of(dig, 3)}) {of(dig, 3)}-{of(dig, 4)}", lambda: f"{of(dig, 3)}-{of(dig, 3)}-{of(dig, 4)}", lambda: f"{word()}.{of(dig, 1, 2)}@{word()}{of(dig, 1)}.example.com", lambda: f"{of(dig, 4)}-{of(dig, 2)}-{of(dig, 2)}",
                lambda: f"https://{word()}.com/{word()}/{of(dig, 2, 8)}", lambda: f"https://www.{word()}.org/{word()}-{word()}-{word()}.html", lambda: f"{word()}_{of(dig, 1, 4)}.{rng.choice(['txt', 'png', 'csv'])}", lambda: f"version-{of(dig, 1, 2)}.{of(dig, 1, 2)}.{of(dig, 1, 2)}", lambda: word() + word() + of(dig, 1, 4),
                lambda: f"{of(dig, 1, 3)}.{of(dig, 3)}.{of(dig, 3)}", lambda: "-".join(of(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: f"{of(dig, 2)}:{of(dig, 2)}:{of(dig, 2)}.{of(dig, 3)}", lambda: "".join(word() for _ in range(6)), lambda: f"{word()}{word().capitalize()}{word().capitalize()}()", lambda: " | ".join(word() + word() for _ in range(4)),
                lambda: " ".join(word() + rng.choice(["###", "***", "%%%", "&&&", "$$$", ",***"]) for _ in range(5)), lambda: " ".join([word()] * rng.randint(3, 9)), lambda: f"{word()}: {word()}", lambda: f"{word()} = {word()}", lambda: f"{word()}({word()}, {of(dig, 1, 3)});", lambda: f"SPDX-License-Identifier: {rng.choice(['MIT', 'Apache-2.0', 'GPL-3.0-only'])}",
                lambda: "CC BY-NC-ND 4.0", lambda: rng.choice(["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "GNU General Public License v3"]), lambda: word().upper() + "-" + of(dig, 2, 4), lambda: f"{word()} is {prose(3)}", lambda: f"name: {prose(2)}", lambda: prose(12),
            ])())
        put(rng.choice([" ", ". ", ", ", "\n", ";\n" if code else "\n"]))
    return text + prose(rng.choice([0, 2, 5, 20])), spans


def labelled(n: int, seed: int):
    """Chains of features and labels of n made-up texts; each chain is a whole text."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(n):
        text, spans = _sample(rng)
        y, k = [OUTSIDE], 0
        for m in _TOKEN.finditer(text):
            while k < len(spans) and spans[k][1] <= m.start():
                k += 1
            inside = k < len(spans) and m.start() < spans[k][1] and spans[k][0] < m.end()
            y.append((INSIDE if m.start() > spans[k][0] and y[-1] != OUTSIDE else BEGIN) if inside else OUTSIDE)
        xs.append(chain_features(text))
        ys.append(np.array(y, np.int64))
    return xs, ys


@lru_cache(2)
def train(samples: int = 4500, seed: int = 11, epochs: int = 7) -> SecretTagger:
    xs, ys = labelled(samples, seed)
    return SecretTagger(FeatureCrf(_BUCKETS, 3, never=[(OUTSIDE, INSIDE)]).fit(xs, ys, epochs=epochs))


def all_spans(texts: list[str], tagger: SecretTagger) -> list[tuple[list, list]]:
    """Per text: the rules' spans, and those with the tagger's added, as (start, end, kind)."""
    out = []
    for text, tagged in zip(texts, tagger.spans(texts), strict=True):
        base = [(s, e, KINDS[k]) for s, e, k in base_spans(text)]
        clear = clear_of([(s, e) for s, e, _ in base])
        more = [(s, e, "crf") for s, e in tagged if clear(s, e)]
        order = (*KINDS, "crf")
        out.append((base, sorted(base + more, key=lambda x: (x[0], order.index(x[2]), x[1]))))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tagger: SecretTagger | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end)."""
    tagger = tagger or train()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        for b in batches:
            found = all_spans(texts_of(b), tagger)
            cols = [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in f[j]] for f in found], kind) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "base", "spans"])

    item = "array<struct<kind:string,start:long,end:long>>"
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, f"doc_id long, base {item}, spans {item}")


def span_list(col: str):
    return F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(n(k) for k in KINDS), F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", tagger: SecretTagger | None = None) -> DataFrame:
    """docs with every secret span replaced by `mark`; same columns, same rows."""
    tagger = tagger or train()
    names = docs.columns

    def clean(text: str, spans) -> str:
        out, end = [], 0
        for s, e, _ in spans:
            if s >= end:
                out += [text[end:s], mark]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def work(batches):
        for b in batches:
            cols = dict(zip(names, b.column(0).flatten(), strict=True))
            texts = [t or "" for t in cols[text_col].to_pylist()]
            new = [clean(t, f[1]) if f[1] else t for t, f in zip(texts, all_spans(texts, tagger), strict=True)]
            known = cols[text_col].is_valid().to_pylist()
            cols[text_col] = pa.array([t if k else None for t, k in zip(new, known, strict=True)], cols[text_col].type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return map_arrow(with_row(docs), work, docs.schema)
