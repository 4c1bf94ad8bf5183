"""Tables that loops write, so that plans do not grow with their rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, shared_path


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the checkpoint folder, without its lineage.

    A cluster names the folder in ``spark.checkpoint.dir``; only where it is unset, a local run gets a temporary one.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, session: SparkSession | None = None) -> DataFrame:
    """``df``, computed once and kept as Parquet in the shared folder: for wide rows that are read often, a few columns at a time.

    It is read by ``session`` or that of ``df``.
    """
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def blocks(df: DataFrame, limit: int) -> list[DataFrame]:
    """``df`` in parts of about ``limit`` rows, each of which may be broadcast; one part if it has no more."""
    n = df.limit(limit + 1).count()
    if n <= limit:
        return [df]
    parts = -(-df.count() // limit)
    dealt = cut(df.withColumn("__b", F.pmod(F.xxhash64(*df.columns), F.lit(parts))))
    return [dealt.where(F.col("__b") == i).drop("__b") for i in range(parts)]
