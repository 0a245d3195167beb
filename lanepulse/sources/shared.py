"""A folder every executor can reach, for tables a job writes and reads back."""

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir, else one in its warehouse: both
    are shared by the driver and all executors."""
    named = spark.conf.get(SETTING, None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for every run, so reruns and parallel runs never meet."""
    return f"{shared_dir(spark)}/lanepulse-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table at a `new_path` that its job has read for the last time."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written below the shared folder and read back, so that it is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
