"""Readers and writers of corpora, link graphs, titles, scores and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import dense_ids


def corpus(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """doc_id, name, text: every file below a directory is a document; ids by ascending path."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias(text_col))
    return dense_ids(files, "name").select(F.col("idx").alias("doc_id"), "name", text_col)


def pattern_lines(lines: list[str]) -> tuple[str, ...]:
    """Patterns of a pattern file's lines: blank ones and // comments go."""
    trimmed = (x.strip() for x in lines)
    return tuple(x for x in trimmed if x and not x.startswith("//"))


def patterns(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A pattern file is a few lines, read whole."""
    return pattern_lines([r.value for r in spark.read.text(path, wholetext=True).collect()][0].splitlines())


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", ";", 2)
    return spark.read.text(path).where(F.contains("value", F.lit(";"))).select(part[0].alias("src"), F.explode(F.split(part[1], ",")).alias("dst")).where("dst <> ''")


def links_by_name(spark: SparkSession, path: str) -> DataFrame:
    """src, dst as strings from `src;dst1,dst2,...`; equal links once (for PageRank)."""
    return _pairs(spark, path).distinct()


def links_by_number(spark: SparkSession, path: str) -> DataFrame:
    """src, dst as longs; what is no number is skipped, repeated links stay (for HITS)."""
    return _pairs(spark, path).select(F.expr("try_cast(trim(src) as bigint)").alias("src"), F.expr("try_cast(trim(dst) as bigint)").alias("dst")).where("src is not null and dst is not null")


def titles(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """node, title of `node;title`; whole: titles may hold `;`, else they end there."""
    part = F.split("value", ";", 2)
    title = part[1] if whole else F.split("value", ";")[1]
    return spark.read.text(path).where(F.contains("value", F.lit(";"))).select(F.expr("try_cast(split(value, ';')[0] as bigint)").alias("node"), title.alias("title")).where("node is not null")


def pagerank_scores(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """doc_id, pr of `name score` lines whose name is a document's."""
    part = F.split(F.trim("value"), r"\s+")
    scores = spark.read.text(path).select(part[0].alias("name"), F.expr("try_cast(split(trim(value), '\\\\s+')[1] as double)").alias("pr"))
    return docs.select("doc_id", "name").join(scores, "name").select("doc_id", "pr")


def doc_info(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, name, n_tokens of `id;path;length`; the path may hold `;`."""
    e = F.regexp_extract
    return spark.read.text(path).select(e("value", r"^([0-9]+);", 1).cast("long").alias("doc_id"), e("value", r"^[0-9]+;(.*);[0-9]+$", 1).alias("name"), e("value", r";([0-9]+)$", 1).cast("long").alias("n_tokens"))


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, euclid_len of `id length` lines."""
    part = F.split("value", " ")
    return spark.read.text(path).select(part[0].cast("long").alias("doc_id"), part[1].cast("double").alias("euclid_len"))


def view_document(docs: DataFrame, name: str) -> DataFrame:
    return docs.where(F.col("name") == name).select("text")


def write_lines(df: DataFrame, line, path: str, mode: str = "overwrite") -> None:
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_doc_info(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_lines(stats, F.concat_ws(";", "doc_id", "name", "n_tokens"), path, mode)


def write_lengths(stats: DataFrame, path: str) -> None:
    write_lines(stats, F.concat_ws(" ", "doc_id", "euclid_len"), path)


def write_postings(lines: DataFrame, path: str) -> None:
    """`term<postings` lines."""
    write_lines(lines, F.concat("term", F.lit("<"), "line"), path)


def write_pagerank(scores: DataFrame, path: str) -> None:
    """`name score` with six decimals."""
    write_lines(scores, F.concat_ws(" ", "name", F.format_string("%.6f", "pr")), path)


def top_lines(scores: DataFrame, value: str, k: int = 30, fmt: str = "%d: %.5g") -> DataFrame:
    """The k best as `node: value` lines, in order."""
    best = scores.orderBy(F.desc(value), "node").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc(value), "node")).cast("long").alias("rank"), F.format_string(fmt, "node", value).alias("line"))


def result_lines(ranked: DataFrame, ranked_query: bool = True) -> DataFrame:
    """Results as shown: `rank. name  score`, the score for ranked queries alone."""
    line = F.format_string("%d. %s   %.5f", "rank", "name", "score") if ranked_query else F.format_string("%d. %s", "rank", "name")
    return ranked.select("query_id", "rank", line.alias("line"))
