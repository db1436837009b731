"""Sessions, and the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "textloom", **conf: str) -> SparkSession:
    """A session with adaptive execution; further settings by keyword (dots as __)."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


#: Bytes of an Arrow batch, in place of Spark's default.
_BATCH, _BATCH_BYTES, _SPARK_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, "67108864b"


def with_small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches, of which a task holds several, where the session has Spark's default."""
    if spark.conf.get(_BATCH, _SPARK_BYTES) == _SPARK_BYTES:
        spark.conf.set(_BATCH, str(_BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where it is unset on a local master, as in tests."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by a Parquet copy in the shared folder, which no lost executor takes along."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


#: Rows of a bucket below which a table that is read in every round gets fewer buckets.
BUCKET_ROWS = 250_000


def bucketed(df: DataFrame, name: str, *key: str, rows: int | None = None) -> DataFrame:
    """The same as a table bucketed and sorted by key: joins and sums by the key need no shuffle of it.

    There are as many buckets as shuffle partitions, so what is shuffled by the key meets
    them; fewer where `rows`, df's number of rows, is given and small."""
    spark = df.sparkSession
    path, buckets = scratch(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        buckets = min(buckets, 1 + rows // BUCKET_ROWS)
    table = "textloom_" + path.rsplit("-", 1)[1]
    df.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._textloom_path, out._textloom_table = path, table
    return out


def dropped(*copies: DataFrame | None) -> None:
    """Deletes copies made by `written` or `bucketed` that no plan reads any more."""
    for df in copies:
        if (path := getattr(df, "_textloom_path", None)) is not None:
            if (table := getattr(df, "_textloom_table", None)) is not None:
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
