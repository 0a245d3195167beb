"""Flat sources: Parquet and CSV observations, timing tables, text; dataset sizes."""

from math import ceil

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanepulse import schemas
from lanepulse.sources.xml import CORRUPT

TARGET_PARTITION_BYTES = 128 * 1024 * 1024
MONTH_LADDER = (1, 2, 3, 6, 12)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """One path, a wildcard, or several paths (their rows follow each other)."""
    return spark.read.parquet(*paths)


def months_back(last: str, count: int) -> list[str]:
    """The ``count`` months that end with ``last``, as YYYYMM, oldest first."""
    end = int(last[:4]) * 12 + int(last[4:]) - 1
    return [f"{m // 12:04d}{m % 12 + 1:02d}" for m in range(end - count + 1, end + 1)]


def month_ladder(last: str, sizes=MONTH_LADDER) -> dict[str, list[str]]:
    """Named month ranges of growing size that end with the same month."""
    return {f"{n}_month{'s' if n > 1 else ''}_{last}": months_back(last, n) for n in sizes}


def read_months(spark: SparkSession, root: str, months: list[str]) -> DataFrame:
    """The named months only; ``month`` is the partition column, so others are not listed."""
    table = spark.read.parquet(root)
    return table.filter(F.col("month").cast("string").isin(*months))


def read_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.OBSERVATIONS,
             **options) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows of CSV files.

    The corrupt column must be part of the schema, or Spark pads bad rows silently.
    """
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    rows = (
        spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).options(**options).csv(path)
    )
    bad = F.col(CORRUPT).isNotNull()
    # Only cells a query reads are parsed. Reading them all in the split (the test always
    # holds) makes a row bad whichever columns the caller goes on to use.
    columns = [F.col(f"`{f.name}`") for f in schema.fields]
    parsed = rows.filter(F.xxhash64(*columns).bitwiseOR(F.lit(1)) != 0)
    return parsed.filter(~bad).select(*columns), parsed.filter(bad)


def peek_csv(spark: SparkSession, glob: str) -> DataFrame:
    """CSV files by header, all text: for looking, not for work."""
    return spark.read.csv(glob, header=True)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_timings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schemas.TIMINGS)
    return reader.csv(path, header=True) if fmt == "csv" else reader.parquet(path)


def dataset_size(files: DataFrame) -> DataFrame:
    """Files, bytes and rows of a file-based table, from the scan's own metadata."""
    per_file = files.groupBy(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")
    ).agg(F.count(F.lit(1)).alias("rows"))
    return per_file.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("data_size_bytes"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_records"),
    )


def partitions_for(size_bytes: int, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    return max(1, ceil(size_bytes / target_bytes))


def version_of(df: DataFrame) -> str:
    """What a table was read from: its files with their sizes and times of change, as one
    digest. Empty for data that no file holds."""
    own = df.sparkSession
    paths = df.inputFiles()
    if not paths:
        return ""
    files = own.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    seen = files.agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"),
        F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("digest")).first()
    return f"{seen.n}-{seen.bytes}-{seen.digest}"


def read_or_compute(spark: SparkSession, path: str, compute, version: str = "") -> DataFrame:
    """The table at ``path``; computed and written first if it is not finished for ``version``.

    ``version`` names what the table is made from (see ``version_of``). The table lies in a
    folder of that version below ``path`` with a small mark beside its rows, which is written
    last: without it (nothing there, a run that died half-way, or another input) the table is
    computed. Any other error is the caller's to see.
    """
    root = f"{path.rstrip('/')}/{version or 'any'}"
    if not is_finished(spark, path, version):
        compute().write.mode("overwrite").parquet(f"{root}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{root}/finished")
    return spark.read.parquet(f"{root}/rows")


def is_finished(spark: SparkSession, path: str, version: str = "") -> bool:
    try:
        mark = f"{path.rstrip('/')}/{version or 'any'}/finished"
        return not spark.read.schema("id long").parquet(mark).isEmpty()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
