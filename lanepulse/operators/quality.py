"""Data quality: validity, missing values, outliers, cleaning, coverage."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanepulse.functions import columns as C
from lanepulse.functions import fixed_values as V
from lanepulse.functions.measures import DISTINCT, measures


def valid_only(obs: DataFrame) -> DataFrame:
    return obs.filter(C.is_valid())


def invalid_readings(obs: DataFrame) -> DataFrame:
    return obs.filter(F.col("valid") == "N")


def validity_distribution(obs: DataFrame) -> DataFrame:
    counts = obs.groupBy("valid").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("percentage", C.percent_of_total("count"))


def null_counts(obs: DataFrame) -> DataFrame:
    """One row: per column, how many rows have no value."""
    return obs.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in obs.columns])


def temporal_coverage(obs: DataFrame) -> DataFrame:
    """First day, last day and number of days; one row per day leaves the scan."""
    return obs.select("date").distinct().agg(
        F.min("date").alias("Start_Date"),
        F.max("date").alias("End_Date"),
        F.count("date").alias("Unique_Days"),
    )


def _has_null(column: str):
    return F.coalesce(F.max(F.col(column).isNull().cast("long")), F.lit(0))


def _distinct_counts(obs: DataFrame, named: dict[str, str], nulls: bool, extra=()) -> DataFrame:
    """Distinct values of several columns in one scan.

    The columns belong together (a detector has one road and one district), so their
    combinations are few; counting on those avoids expanding every input row once per
    column. A bare distinct() would be optimised away again, hence the count and its
    filter. ``nulls`` counts a missing value as one more value. A roll-up that lists the
    values is answered from those.
    """
    if all(c + DISTINCT in obs.columns for c in named.values()):
        m = measures(obs)
        missing = lambda c: (F.coalesce(F.sum(f"{c}_nulls"), F.lit(0)) > 0).cast("long")
        return obs.agg(*extra, *[
            (m.distinct(c) + missing(c) if nulls else m.distinct(c)).alias(out) for out, c in named.items()])
    combos = obs.groupBy(*named.values()).agg(F.count(F.lit(1)).alias("seen")).filter("seen > 0")

    def distinct(column):
        n = F.count_distinct(column)
        return n + _has_null(column) if nulls else n

    return combos.agg(*extra, *[distinct(column).alias(out) for out, column in named.items()])


def spatial_coverage(obs: DataFrame) -> DataFrame:
    return _distinct_counts(obs, {
        "Unique_Detectors": "detector_id", "Unique_Districts": "District", "Unique_Roads": "Road_EN",
    }, nulls=False)


def clean_coverage(clean: DataFrame) -> DataFrame:
    first, last = ("date_min", "date_max") if "date_min" in clean.columns else ("date", "date")
    return _distinct_counts(
        clean,
        {"distinct_dates": "date", "distinct_detectors": "detector_id",
         "distinct_roads": "Road_EN", "distinct_districts": "District"},
        nulls=True,
        extra=[F.min(first).alias("min_date"), F.max(last).alias("max_date")],
    )


def missing_report(obs: DataFrame, ignore=("valid",)) -> DataFrame:
    """Per column with gaps, the rows that are NULL or NaN. NaN exists only in
    floating columns, so only those are tested for it."""
    floats = (T.DoubleType, T.FloatType)

    def absent(field):
        gap = F.col(field.name).isNull()
        return gap | F.isnan(field.name) if isinstance(field.dataType, floats) else gap

    fields = [f for f in obs.schema.fields if f.name not in ignore]
    wide = obs.agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(absent(f)).alias(f.name) for f in fields]
    )
    long = wide.unpivot("_all", [f.name for f in fields], "column_name", "missing_count")
    return long.filter("missing_count > 0").select(
        "column_name", "missing_count",
        C.percent(F.col("missing_count"), F.col("_all")).alias("missing_pct"),
    )


def outlier_report(obs: DataFrame) -> DataFrame:
    return obs.agg(
        F.count_if(C.speed_outlier()).alias("speed_outliers"),
        F.count_if(C.volume_outlier()).alias("volume_outliers"),
        F.count_if(C.occupancy_outlier()).alias("occupancy_outliers"),
    )


def clean_observations(obs: DataFrame) -> DataFrame:
    """Valid and plausible readings: two narrow filters, pushed into the scan."""
    return obs.filter(C.is_valid()).filter(C.plausible())


def cleaning_summary(obs: DataFrame) -> DataFrame:
    valid, clean = F.col("valid_records"), F.col("clean_records")
    return obs.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(C.is_valid()).alias("valid_records"),
        F.count_if(C.is_valid() & C.plausible()).alias("clean_records"),
    ).select(
        "*", (valid - clean).alias("removed_records"),
        C.percent(valid - clean, valid).alias("removed_pct"),
    )


def data_quality_report(obs: DataFrame) -> DataFrame:
    """Record count, gaps in the key columns, distinct roads and districts.

    Rows are first counted per (road, district): the gaps add up, and the distinct
    counts see one row per pair.
    """
    measures, places = ("volume", "occupancy", "period_from"), ("Road_EN", "District")
    per_place = obs.groupBy(*places).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in measures]
    )
    gaps = {c: F.sum(F.when(F.col(c).isNull(), F.col("n")).otherwise(0)) for c in places}
    gaps |= {c: F.sum(c) for c in measures}
    distinct = {
        "distinct_roads": "Road_EN", "distinct_districts": "District",
    }
    report = per_place.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        *[F.coalesce(gap, F.lit(0)).alias(f"null_{c}") for c, gap in gaps.items()],
        *[(F.count_distinct(c) + _has_null(c)).alias(out)
          for out, c in distinct.items()],
    )
    return reduce(
        lambda df, c: df.withColumn(
            f"null_{c}_pct", C.percent(F.col(f"null_{c}"), F.col("total_records"))
        ),
        gaps, report,
    )


def district_counts(obs: DataFrame) -> DataFrame:
    return obs.filter(F.col("Road_EN").isNotNull()).groupBy("District").agg(
        F.count(F.lit(1)).alias("count")
    )


def records_per_file(obs: DataFrame, total_files: int | None = None) -> DataFrame:
    """Average rows per source file and what that projects to for ``total_files``."""
    per_file = obs.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    report = per_file.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.avg("n").alias("avg_records_per_file"),
    )
    files = F.col("files") if total_files is None else F.lit(total_files)
    projected = F.floor(files * F.col("avg_records_per_file"))
    return report.withColumn("projected_records", projected).withColumn(
        "projected_mb", F.col("projected_records") * V.BYTES_PER_CSV_ROW / 1024 / 1024
    )


def ingest_statistics(obs: DataFrame) -> DataFrame:
    """Row and detector counts after an ingest (one row per detector leaves the scan)."""
    per_detector = obs.groupBy("detector_id").agg(F.count(F.lit(1)).alias("n"))
    return per_detector.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.count(F.lit(1)).alias("unique_detectors"),
    )


def distinct_dates(obs: DataFrame) -> DataFrame:
    return obs.select("date").distinct().orderBy("date")


def distinct_lanes(obs: DataFrame) -> DataFrame:
    return obs.select("lane_id").distinct()
