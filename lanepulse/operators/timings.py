"""Run timings as a table, and the reports over it."""

import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanepulse import schemas
from lanepulse.functions import columns as C
from lanepulse.functions import fixed_values as V

RUN = ("dataset_size", "tool")


def materialise(df: DataFrame) -> None:
    """Run a plan to its end once, without keeping rows."""
    df.write.format("noop").mode("overwrite").save()


def time_phases(spark: SparkSession, tool: str, phases, dataset_size: str | None = None,
                data_size_bytes: int | None = None, total_records: int | None = None) -> DataFrame:
    """Run named steps in order and return their timing rows, the total last.

    A step that returns a DataFrame is run to its end, since building a plan takes no
    time worth measuring. A step that fails is recorded, and no later step runs.
    """
    rows, begun = [], time.perf_counter()

    def record(phase, seconds, details):
        rows.append((
            datetime.now().isoformat(), dataset_size, data_size_bytes, total_records, tool, phase,
            seconds, total_records, details,
        ))

    failed = None
    for phase, step in phases:
        start = time.perf_counter()
        try:
            outcome = step()
            if isinstance(outcome, DataFrame):
                materialise(outcome)
        except Exception as error:
            failed = f"{V.FAILED_MARK}: {error}"
        record(phase, time.perf_counter() - start, failed or "")
        if failed:
            break
    record(V.TOTAL_PHASE, time.perf_counter() - begun, failed or "")
    return spark.createDataFrame(rows, schemas.TIMINGS)


def totals(timings: DataFrame) -> DataFrame:
    return timings.filter(F.col("phase") == V.TOTAL_PHASE)


def phases_only(timings: DataFrame) -> DataFrame:
    return timings.filter(F.col("phase") != V.TOTAL_PHASE)


def average_by_tool(timings: DataFrame) -> DataFrame:
    """Fastest tool first."""
    means = totals(timings).groupBy("tool").agg(F.avg("duration_seconds").alias("avg_seconds"))
    return C.top(means, None, F.asc("avg_seconds"), "tool")


def average_by_phase(timings: DataFrame) -> DataFrame:
    means = phases_only(timings).groupBy("tool", "phase").agg(
        F.avg("duration_seconds").alias("avg_seconds")
    )
    return means.orderBy("tool", "phase")


def recent_totals(timings: DataFrame, days: int = 7, today=None) -> DataFrame:
    """Totals since ``days`` before today (or before a given date)."""
    until = F.current_date() if today is None else F.lit(today).cast("date")
    recent = totals(timings).filter(F.to_date("timestamp") >= F.date_sub(until, days))
    columns = ("timestamp", "tool", "duration_seconds")
    return recent.select(*columns).orderBy(*columns)  # all columns, so few rows tie


def dataset_by_tool(timings: DataFrame, tools: list[str]) -> DataFrame:
    """Mean total per data set (rows) and tool (columns)."""
    return totals(timings).groupBy("dataset_size").pivot("tool", tools).agg(F.avg("duration_seconds"))


def phase_share(timings: DataFrame, run=RUN) -> DataFrame:
    """Part of each phase in the total of its run, in percent. Runs are summed per phase
    first, so the window sees a handful of rows per run."""
    sums = timings.groupBy(*run, "phase").agg(F.sum("duration_seconds").alias("duration_seconds"))
    whole = F.max(F.when(F.col("phase") == V.TOTAL_PHASE, F.col("duration_seconds")))
    shares = sums.withColumn("total_seconds", whole.over(Window.partitionBy(*run)))
    return phases_only(shares).withColumn(
        "percentage", C.percent(F.col("duration_seconds"), F.col("total_seconds"))
    )


def speedup(timings: DataFrame) -> DataFrame:
    """Per data set: mean total of each tool, the fastest tool, and how much slower each is."""
    means = totals(timings).groupBy(*RUN).agg(F.avg("duration_seconds").alias("avg_seconds"))
    every = Window.partitionBy("dataset_size")
    best = F.min(F.struct("avg_seconds", "tool")).over(every)
    return means.withColumn("best", best).select(
        *RUN, "avg_seconds", F.col("best.tool").alias("fastest_tool"),
        F.try_divide(F.col("avg_seconds"), F.col("best.avg_seconds")).alias("times_fastest"),
    )


def failed_runs(timings: DataFrame) -> DataFrame:
    return timings.filter(F.col("details").contains(V.FAILED_MARK)).select("tool", "dataset_size", "details")


def run_phases(timings: DataFrame, tool: str, dataset_size: str) -> DataFrame:
    """Phases of one tool on one data set."""
    run = phases_only(timings).filter((F.col("tool") == tool) & (F.col("dataset_size") == dataset_size))
    return run.select("phase", "duration_seconds", "details")
