"""Tables that end a lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
#: Rows that may be broadcast; beyond it joins are shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows of narrow tables that a file should have at least.
FILE_ROWS = 50_000
#: A key is hot if it holds a HOT-th of all rows.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local sessions without it, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="roadspark-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return "file://" + _OWN[0]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to twice as many tasks as a shuffle has (Spark drops a deal that the rows already have); for much work on few bytes, which it would merge into few tasks."""
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/roadspark/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read back; of a table of `rows` at most that are known to be few no more files are made than FILE_ROWS asks for."""
    path = scratch(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more, such as a loop's earlier rounds."""
    for df in tables:
        path = getattr(df, "_stored_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def spread_join(left: DataFrame, right: DataFrame, key: str, total: int, columns: list[str], rows: int | None = None) -> DataFrame:
    """left inner-joined with right, which has one row a key, its count n and columns; keys of a HOT-th of total rows of left are broadcast, or all of right where it is known to have few rows."""
    if rows is not None and rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.select(key, *columns)), key).select(*left.columns, *columns)
    hot = right.where(F.col("n") * HOT >= total).select(key, *[F.col(c).alias(f"hot_{c}") for c in columns])  # HOT rows at most
    rest = right.where(F.col("n") * HOT < total).select(F.col(key).alias("rest_key"), *columns)
    both = left.join(F.broadcast(hot), key, "left")
    # rows that have found theirs spread by a hash of their own, which can match nothing in effect: what is broadcast comes first
    own = F.when(F.col(f"hot_{columns[0]}").isNull(), F.xxhash64(key)).otherwise(F.xxhash64(*left.columns))
    both = both.withColumn("rest_hash", own).join(rest.withColumn("rest_hash", F.xxhash64("rest_key")), "rest_hash", "left").where(F.col(f"hot_{columns[0]}").isNotNull() | (F.col("rest_key") == F.col(key)))
    return both.select(*left.columns, *[F.coalesce(f"hot_{c}", c).alias(c) for c in columns]).where(F.col(columns[0]).isNotNull())
