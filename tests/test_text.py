import itertools
import random

from pyspark.sql import functions as F

from textloom.functions import strings, text
from textloom.operators import index

CHUNKS = {
    "see https://a.b/c?d=e now": "see https://a.b/c?d=e now",
    "24/7 open": "24/7 open",
    "mail me@here.org, or": "mail me@here.org or",
    "notes.doc and file.txt": "notes.doc and file txt",
    "call 08-123.45 or 1,000": "call 08-123.45 or 1,000",
    "well-known foo-bar@x.com": "well-known foo bar@x.com",
    "the u.s. and u.s.a.": "the u.s. and u.s. a",
    "$80/hour +12": "$80 hour +12",
    "don't don't, 'word rock'n'roll": "don't don t 'word rock n roll",
    "a€5 x’y": "a 5 x y",
    "": "",
    "...": "",
}


def test_pattern_tokens(spark):
    docs = spark.createDataFrame([(i, c) for i, c in enumerate(CHUNKS)], "doc_id long, text string")
    got = {}
    for r in index.tokens(docs, patterns=text.PATTERNS).collect():
        got.setdefault(r.doc_id, {})[r.pos] = r.term
    for i, want in enumerate(CHUNKS.values()):
        assert " ".join(got.get(i, {})[k] for k in sorted(got.get(i, {}))) == want


def test_last_chunk_and_separators(spark):
    docs = spark.createDataFrame([(0, "one two"), (1, "a\x00b_c'd"), (2, None)], "doc_id long, text string")
    got = [(r.doc_id, r.term) for r in index.tokens(docs).orderBy("doc_id", "pos").collect()]
    assert got == [(0, "one"), (0, "two"), (1, "a"), (1, "b"), (1, "c"), (1, "d")]


def test_diacritics():
    table = dict(zip(*text.diacritics(), strict=True))
    assert [table[c] for c in "ÀÉÿßđĐłŁšŽžœ"] == list("AEySdDlLsZzo")
    assert len(table) == 0x17F - 0xC0


def test_indel_distance_against_dynamic_programming(spark):
    def slow(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else 2))
        return d[len(a), len(b)]

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))
    pairs = [(word(), word()) for _ in range(3000)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", strings.indel_distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in rows:
        want = slow(r.a, r.b)
        assert r.d == (want if want <= 2 else None)


def test_kgrams(spark):
    df = spark.createDataFrame([("aa",), ("",)], "t string").select(strings.kgrams(F.col("t"), 2).alias("two"), strings.kgrams(F.col("t"), 3).alias("three"))
    assert [tuple(r) for r in df.collect()] == [(["^a", "aa", "a$"], ["^aa", "aa$"]), (["^$"], [])]
