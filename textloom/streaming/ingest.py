"""Incremental indexing: every micro-batch of documents becomes a segment; segments are merged when asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index
from ..session import written


def ingest(stream: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """Starts a query that appends each batch's postings under path/segment=<batch>.

    A batch that is run again overwrites its own segment, so nothing counts twice."""

    def segment(batch: DataFrame, number: int) -> None:
        # a batch may be one file, which one task would read and index
        spread = batch.repartition(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        index.document_postings(spread, **how).write.mode("overwrite").parquet(f"{path}/segment={number}")

    return stream.writeStream.foreachBatch(segment).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """Postings of all segments, merged by term and document; a document that lies in one segment is merged there already."""
    rows = spark.read.option("recursiveFileLookup", False).parquet(path)
    split = written(rows.select("doc_id", "segment").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "split")
    posts = rows.select("term", "doc_id", "tf", "offsets")
    if split.isEmpty():
        return posts
    return posts.join(split, "doc_id", "left_anti").select(*posts.columns).unionByName(index.merge_segments(posts.join(split, "doc_id", "left_semi")))


def publish(spark: SparkSession, path: str, to: str) -> None:
    """Writes the merged index aside, sorted by term; a reader switches to it by its path."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged(spark, path).repartitionByRange(parts, "term", F.col("doc_id")).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(to)
