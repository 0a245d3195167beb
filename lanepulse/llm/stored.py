"""Intermediate results that survive a lost executor."""

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def _folder(spark: SparkSession) -> None:
    """The cluster names its shared folder; only where it names none is one chosen here."""
    if spark.conf.get(SETTING, None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints"))


def held(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared checkpoint folder; its lineage ends there."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """`df` written as a Parquet table of its own in the shared folder and read again."""
    spark = df.sparkSession
    _folder(spark)
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.parquet(path)
