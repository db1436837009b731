"""k-grams, Jaccard overlap and the indel distance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kgrams(term: Column, k: int = 2) -> Column:
    """Distinct windows of k characters of ^term$; none if it is shorter."""
    p = F.concat(F.lit("^"), term, F.lit("$"))
    windows = F.transform(F.sequence(F.lit(1), F.length(p) - (k - 1)), lambda i: F.substring(p, i, F.lit(k)))
    # a look-ahead finds them faster, but goes by halves of characters beyond U+FFFF
    found = F.regexp_extract_all(p, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    return F.array_distinct(F.when(~p.rlike(r"[\x{10000}-\x{10FFFF}]"), found).when(F.length(p) >= k, windows).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column, both: Column) -> Column:
    """Overlap of sets of a and b elements with `both` in common; 0 for empty sets."""
    return F.coalesce(F.try_divide(both.cast("double"), a + b - both), F.lit(0.0))


def _without_one(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))


def _as_bytes(x: Column) -> Column:
    """A character for each UTF-8 byte."""
    return F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")


def indel_distance(a: Column, b: Column, *, in_bytes: bool = False) -> Column:
    """Edit distance with insertions and deletions at 1 and substitutions at 2; null beyond 2.

    in_bytes: the underlying Levenshtein distance counts UTF-8 bytes, as DuckDB's does, so
    that a letter beyond ASCII that is put in or left out is beyond 2 or not one edit."""
    d = F.levenshtein(_as_bytes(a), _as_bytes(b)) if in_bytes else F.levenshtein(a, b)
    gap = F.abs(F.length(a) - F.length(b))
    return (
        F.when(a == b, 0)
        .when((d == 1) & (gap == 1), 1)
        .when((d == 1) & (gap == 0), 2)
        .when((d == 2) & (gap == 2), 2)
        .when((d == 2) & (gap == 0) & F.arrays_overlap(_without_one(a), _without_one(b)), 2)
    )


def like_pattern(term: Column) -> Column:
    """LIKE pattern of a wildcard term: `*` is any run; a lone `*` matches nothing (null)."""
    escaped = F.regexp_replace(term, r"([\\%_])", r"\\$1")
    return F.when(term != "*", F.regexp_replace(escaped, r"\*", "%"))


def longest_gram(term: Column) -> Column:
    """Two neighbouring characters of the longest literal run of ^term$ between its `*`; one letter if no run has two."""
    runs = F.filter(F.split(F.concat(F.lit("^"), term, F.lit("$")), r"\*"), lambda x: ~x.isin("", "^", "$"))
    best = F.array_max(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return F.substring(best, F.lit(1), F.least(F.length(best), F.lit(2)))
