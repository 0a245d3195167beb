"""Sinks. A rerun of an ingest unit replaces what that unit wrote before, and nothing else."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanepulse.functions import columns as C
from lanepulse.operators.sampling import bernoulli_sample
from lanepulse.sources.tables import TARGET_PARTITION_BYTES, partitions_for

COMPRESSION = "snappy"
UNIT = "ingest_unit"


def with_month(obs: DataFrame) -> DataFrame:
    """The stored layout: month to prune by, hour so that hour filters reach the scan."""
    return C.with_hour(obs).withColumn("month", F.date_format("date", "yyyyMM"))


def write_unit(df: DataFrame, path: str, by: list[str], unit: str) -> None:
    """Parquet below `by` and the unit of ingest (a folder's or batch's lasting name).

    The unit is part of every partition, so a second run of a unit leaves its rows once while
    rows that other units stored for the same month or day stay: files of one unit may hold
    rows of neighbouring months, or rows without a date. The rebalance hint sizes the files at
    run time: small partitions merge, and one that holds a third of all rows is split. A unit
    whose rows for a partition are gone after a correction must be cleared by the caller.
    """
    rows = df.hint("rebalance", *by).withColumn(UNIT, F.lit(unit))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "compression", COMPRESSION
    ).partitionBy(*by, UNIT).parquet(path)


def write_by_month(obs: DataFrame, path: str, unit: str) -> None:
    """Parquet, one folder per month and ingest unit."""
    write_unit(with_month(obs), path, ["month"], unit)


def write_by_date(obs: DataFrame, path: str, unit: str) -> None:
    """Parquet, one folder per date and ingest unit."""
    write_unit(obs, path, ["date"], unit)


def write_csv(summary: DataFrame, path: str, single_file: bool = False) -> None:
    """A summary as CSV with a header.

    Adaptive execution already merges a small result into one file, and a large one stays
    spread. ``single_file`` forces one file, for results the caller knows to be small.
    """
    rows = summary.coalesce(1) if single_file else summary
    rows.write.mode("overwrite").csv(path, header=True)


def write_csv_by_date(obs: DataFrame, path: str) -> None:
    rows = obs.hint("rebalance", "date").write.mode("overwrite")
    rows.option("compression", COMPRESSION).partitionBy("date").csv(path, header=True)


def compact(table: DataFrame, path: str, by: str = "date") -> None:
    """Rewrite many small files as few per partition value, to a new path, with the ingest
    units of a value merged; the old files stay until the caller switches over."""
    table.drop(UNIT).hint("rebalance", by).write.mode("overwrite").option(
        "compression", COMPRESSION
    ).partitionBy(by).parquet(path)


def size_partitions(df: DataFrame, size_bytes: int,
                    target_bytes: int = TARGET_PARTITION_BYTES) -> DataFrame:
    """Repartition to about ``target_bytes`` per task, from a known total size."""
    return df.repartition(partitions_for(size_bytes, target_bytes))


def write_cleaned(clean: DataFrame, path: str) -> None:
    clean.write.mode("overwrite").option("compression", COMPRESSION).parquet(path)


def export_summaries(summaries: dict[str, DataFrame], root: str, at_once: int = 8) -> None:
    """Each named summary as CSV in its own folder. Summaries are short jobs, so several
    run at the same time."""
    with ThreadPoolExecutor(at_once) as pool:
        jobs = [pool.submit(write_csv, df, f"{root}/{name}") for name, df in summaries.items()]
        for job in jobs:
            job.result()


def write_timings(timings: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    writer = timings.write.mode(mode)
    writer.csv(path, header=True) if fmt == "csv" else writer.parquet(path)


def write_subset(df: DataFrame, path: str, fraction: float, seed: int = 42) -> None:
    bernoulli_sample(df, fraction, seed).write.mode("overwrite").parquet(path)
