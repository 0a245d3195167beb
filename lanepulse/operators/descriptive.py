"""Descriptive statistics: overall distributions and summaries by one dimension.

The grouped summaries accept observations or a roll-up (see functions.measures).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanepulse.functions import columns as C
from lanepulse.functions.measures import five_metrics, measures, need_observations, need_quantiles, three_means
from lanepulse.operators.distribution import describe_column

_QUARTILES = {"25th_Percentile": 0.25, "75th_Percentile": 0.75, "95th_Percentile": 0.95}


def _overall(obs, column, shares, **options):
    need_quantiles(obs, column, "overall distribution")
    stats = describe_column(obs, column, {"Median": 0.5, **shares}, **options)
    return stats.select(
        F.col("mean").alias("Mean"), "Median", F.col("std").alias("Std_Dev"),
        F.col("min").alias("Min"), F.col("max").alias("Max"), *[f"`{s}`" for s in shares],
    )


def overall_speed(obs: DataFrame, **options) -> DataFrame:
    return _overall(obs, "speed", _QUARTILES, **options)


def overall_volume(obs: DataFrame, **options) -> DataFrame:
    return _overall(obs, "volume", _QUARTILES, **options)


def overall_occupancy(obs: DataFrame, **options) -> DataFrame:
    return _overall(obs, "occupancy", _QUARTILES, **options)


def overall_speed_sd(obs: DataFrame, **options) -> DataFrame:
    return _overall(obs, "standard_deviation", {}, **options)


def overall_wide(clean: DataFrame, accuracy: int | None = None) -> DataFrame:
    """One row of 18 figures over speed, volume, occupancy and the speed deviation.

    The speed percentiles come from value counts, the other figures from one plain
    aggregate; only distinct speed values and one row per task are shuffled.
    """
    need_quantiles(clean, "speed", "overall_wide")
    m = measures(clean)
    speed = describe_column(
        clean, "speed",
        {"speed_p25": 0.25, "speed_p50": 0.5, "speed_p75": 0.75, "speed_p95": 0.95},
        accuracy=accuracy,
    ).select(
        F.col("mean").alias("avg_speed"), F.col("std").alias("std_speed"),
        F.col("min").alias("min_speed"), F.col("max").alias("max_speed"),
        "speed_p25", "speed_p50", "speed_p75", "speed_p95",
    )
    rest = clean.agg(
        m.mean("volume").alias("avg_volume"), m.spread("volume").alias("std_volume"),
        m.total("volume").alias("total_volume"),
        m.low("volume").alias("min_volume"), m.high("volume").alias("max_volume"),
        m.mean("occupancy").alias("avg_occupancy"), m.spread("occupancy").alias("std_occupancy"),
        m.low("occupancy").alias("min_occupancy"), m.high("occupancy").alias("max_occupancy"),
        m.mean("standard_deviation").alias("avg_speed_std"),
    )
    # two one-row results side by side: stack them and keep each column's only value
    both = speed.unionByName(rest, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def summary_by(obs: DataFrame, *keys: str) -> DataFrame:
    """Records, three averages and the total volume per group."""
    return obs.groupBy(*keys).agg(*five_metrics(measures(obs)))


def district_stats(obs: DataFrame) -> DataFrame:
    """Slowest district first."""
    return C.top(summary_by(obs, "District"), None, F.asc("Avg_Speed"), "District")


def road_stats(obs: DataFrame, approximate: bool = False) -> DataFrame:
    """Summary per road and district with its number of detectors.

    Rows are aggregated per (road, district, detector) first; a road that holds a third
    of the data is thus split by detector and pre-aggregated before any shuffle.
    """
    if "detector_id" in obs.columns:
        detectors = (F.approx_count_distinct if approximate else F.count_distinct)("detector_id")
    else:  # a roll-up with sketches
        detectors = measures(obs).distinct("detector_id")
    return obs.groupBy("Road_EN", "District").agg(
        *five_metrics(measures(obs)), detectors.alias("Num_Detectors")
    )


def road_slowest(obs: DataFrame, k: int = 20) -> DataFrame:
    return C.top(road_stats(obs), k, F.asc("Avg_Speed"), "Road_EN", "District")


def road_busiest(obs: DataFrame, k: int = 20) -> DataFrame:
    return C.top(road_stats(obs), k, F.desc("Total_Volume"), "Road_EN", "District")


def road_fastest(obs: DataFrame, k: int = 20) -> DataFrame:
    return C.top(road_stats(obs), k, F.desc("Avg_Speed"), "Road_EN", "District")


def lane_stats(obs: DataFrame) -> DataFrame:
    return summary_by(obs, "lane_id").orderBy("lane_id")


def hourly_stats(obs: DataFrame) -> DataFrame:
    return summary_by(C.with_hour(obs), "hour").orderBy("hour")


def dow_stats(obs: DataFrame) -> DataFrame:
    named = obs.withColumn("day_of_week", C.day_of_week()).withColumn("day_name", C.day_name())
    return summary_by(named, "day_of_week", "day_name").orderBy("day_of_week")


def weekday_weekend(obs: DataFrame) -> DataFrame:
    labelled = obs.withColumn("is_weekend", C.weekend_label())
    return summary_by(labelled, "is_weekend").drop("Total_Volume")


def direction_stats(obs: DataFrame) -> DataFrame:
    return summary_by(obs, "direction").orderBy("direction")


def _statistics(clean, key, with_total, order):
    m = measures(clean)
    total = [m.total("volume").alias("total_volume")] if with_total else []
    stats = clean.groupBy(key).agg(m.records().alias("record_count"), *three_means(m), *total)
    return C.top(stats, None, F.desc(order), key)


def district_statistics(clean: DataFrame) -> DataFrame:
    return _statistics(clean, "District", True, "total_volume")


def lane_statistics_by_speed(clean: DataFrame) -> DataFrame:
    return _statistics(clean, "lane_id", False, "avg_speed")


def direction_statistics(clean: DataFrame) -> DataFrame:
    return _statistics(clean, "direction", True, "total_volume")


def fastest_roads(obs: DataFrame, k: int = 10) -> DataFrame:
    """Highest average speed, over readings with a road and a speed."""
    known = obs.dropna(subset=["Road_EN", "speed"])
    means = known.groupBy("Road_EN", "District").agg(F.avg("speed").alias("avg_speed"))
    return C.top(means, k, F.desc("avg_speed"), "Road_EN", "District")


def speed_by_detector_lane(obs: DataFrame) -> DataFrame:
    return obs.groupBy("detector_id", "lane_id").agg(
        measures(obs).mean("speed").alias("avg_speed")
    )


def volume_by_hour(obs: DataFrame) -> DataFrame:
    total = measures(obs).total("volume").alias("total_volume")
    return C.with_hour(obs).groupBy("hour").agg(total).orderBy("hour")


def slowest_roads_by_name(obs: DataFrame, k: int = 10) -> DataFrame:
    means = obs.groupBy("Road_EN").agg(measures(obs).mean("speed").alias("avg_speed"))
    return C.top(means, k, F.asc("avg_speed"), "Road_EN")


def busiest_roads_by_name(obs: DataFrame, k: int = 10) -> DataFrame:
    totals = obs.groupBy("Road_EN").agg(measures(obs).total("volume").alias("total_volume"))
    return C.top(totals, k, F.desc("total_volume"), "Road_EN")
