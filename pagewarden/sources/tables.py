"""The folder that all executors share, tables written there, and joins in which no key's rows lie in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; in local mode alone (tests) a temporary one stands in for it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed and written to the shared folder, so that what follows doesn't compute it again."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it again; also the table's path, for remove_table()."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table of write_table() that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of one key that may lie in one task, and keys with more rows than their share that are looked at.
KEY_ROWS, HOT_KEYS = 1024, 100_000


def hot_keys(rows: DataFrame, on: str) -> list[tuple[object, int]]:
    """The keys with more than KEY_ROWS of ``rows``, and in how many parts each is dealt; with very many rows only those with over a HOT_KEYS-th of all, so there are HOT_KEYS at most. ``rows`` is read twice."""
    total = rows.count()
    most = max(KEY_ROWS, -(-total // HOT_KEYS))
    if total <= most:
        return []
    found = rows.groupBy(on).agg(F.count("*").alias("n")).filter((F.col("n") > most) & F.col(on).isNotNull()).collect()
    return [(r[0], -(-r.n // most)) for r in found]


def dealt_join(rows: DataFrame, table: DataFrame, on: str, by: str, how: str = "inner", counted: DataFrame | None = None, hot: list[tuple[object, int]] | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row at most for each ``on``; how: inner, left or left_semi.

    A key with many rows is dealt to as many parts as it takes (see hot_keys()), by a hash of ``by``; its row of ``table`` is there once for each part. The rows of other keys stay as they are, so nothing else is copied. What is
    broadcast are the keys that are dealt, HOT_KEYS at most. Keys are counted in ``counted``, a written table with the keys of ``rows`` (which then may be computed), or given as ``hot``.
    """
    hot = hot_keys(rows if counted is None else counted, on) if hot is None else hot
    if not hot:
        return rows.join(table, on, how)
    kind = rows.schema[on].dataType.simpleString()
    parts = F.broadcast(rows.sparkSession.createDataFrame(hot, f"`{on}` {kind}, dealt_parts int"))
    many = F.coalesce("dealt_parts", F.lit(1))
    left = rows.join(parts, on, "left").withColumn("dealt", F.pmod(F.xxhash64(by), many).cast("int")).drop("dealt_parts")
    right = table.join(parts, on, "left").withColumn("dealt", F.explode(F.sequence(F.lit(0), many - 1))).drop("dealt_parts")
    return left.join(right, [on, "dealt"], how).drop("dealt")
