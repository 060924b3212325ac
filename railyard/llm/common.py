"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A folder no other run uses, under the shared checkpoint location."""
    return shared_path(spark, "llm", f"{tag}_{uuid.uuid4().hex}")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor
    costs a reread of these files, not the plan behind them."""
    path = fresh_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> bool:
    """Deletes all that :func:`stored` and :func:`fresh_folder` have left under
    the shared checkpoint location, of every run: to be called when no frame of
    these operators is read any more. Whether there was anything."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "llm"))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def row_ids(docs: DataFrame):
    """A number for every row of a stored table, the same in each scan.

    ``monotonically_increasing_id`` follows the split of the files, which
    depends on the number of cores known at that moment unless
    ``spark.sql.files.minPartitionNum`` is set: it is pinned here once per
    session. The operators expect ``docs`` to be read from files (select and
    filter on top are fine), not the outcome of a shuffle.
    """
    spark = docs.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return F.monotonically_increasing_id().alias("uid")


#: Row ids are broadcast up to so many (8 bytes each), else joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without_rows(docs: DataFrame, uids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose :func:`row_ids` number is in ``uids`` (uid)."""
    uids = stored(uids.select(F.col("uid").alias("__row")).distinct(), "dropped")
    if uids.count() <= BROADCAST_IDS:
        uids = F.broadcast(uids)
    return docs.select(row_ids(docs).alias("__row"), "*").join(uids, "__row", "left_anti").drop("__row")


def ascii_lower(col):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
