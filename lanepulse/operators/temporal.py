"""Patterns over hours, weekdays, months and seasons."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanepulse.functions import columns as C
from lanepulse.functions import fixed_values as V
from lanepulse.functions.measures import measures, three_means


def _with_week(obs: DataFrame) -> DataFrame:
    return obs.withColumn("day_of_week", C.day_of_week()).withColumn("is_weekend", C.weekend_label())


def _flow(m):
    """Mean speed, total volume, mean occupancy."""
    return [
        m.mean("speed").alias("avg_speed"),
        m.total("volume").alias("total_volume"),
        m.mean("occupancy").alias("avg_occupancy"),
    ]


# --- within the day ---------------------------------------------------------------

def hourly_profile(clean: DataFrame) -> DataFrame:
    m = measures(clean)
    profile = C.with_hour(clean).groupBy("hour").agg(
        *three_means(m), m.records().alias("record_count"), m.spread("speed").alias("std_speed")
    )
    return profile.orderBy("hour")


def peak_hour(clean: DataFrame, window) -> DataFrame:
    """The slowest hour of a window, both ends included."""
    hours = C.with_hour(clean).filter(C.in_window_inclusive(window))
    return C.top(hourly_profile(hours), 1, F.asc("avg_speed"), "hour")


def morning_peak_hour(clean: DataFrame) -> DataFrame:
    return peak_hour(clean, V.MORNING)


def evening_peak_hour(clean: DataFrame) -> DataFrame:
    return peak_hour(clean, V.EVENING)


def _hourly_by(clean, key):
    flow = C.with_hour(clean).groupBy("hour", key).agg(*_flow(measures(clean)))
    return flow.orderBy("hour", key)


def hourly_direction_profile(clean: DataFrame) -> DataFrame:
    return _hourly_by(clean, "direction")


def hourly_lane_profile(clean: DataFrame) -> DataFrame:
    return _hourly_by(clean, "lane_id")


# --- within the week ---------------------------------------------------------------

def daily_statistics(clean: DataFrame) -> DataFrame:
    m = measures(clean)
    named = clean.withColumn("day_of_week", C.day_of_week()).withColumn(
        "day_name", F.date_format("date", "EEEE")
    )
    days = named.groupBy("day_of_week", "day_name").agg(
        *three_means(m), m.total("volume").alias("total_volume"), m.records().alias("record_count")
    )
    return days.orderBy("day_of_week")


def weekday_weekend_comparison(clean: DataFrame) -> DataFrame:
    m = measures(clean)
    return _with_week(clean).groupBy("is_weekend").agg(
        *three_means(m), m.total("volume").alias("total_volume"), m.spread("speed").alias("std_speed")
    )


def hourly_weekday_weekend(clean: DataFrame) -> DataFrame:
    means = three_means(measures(clean))
    hours = C.with_hour(_with_week(clean)).groupBy("hour", "is_weekend").agg(*means)
    return hours.orderBy("hour", "is_weekend")


def monday_effect(clean: DataFrame) -> DataFrame:
    label = F.when(F.col("day_of_week") == 2, "Monday").otherwise("Other Weekdays")
    weekdays = _with_week(clean).filter(~C.is_weekend_day())
    return weekdays.groupBy(label.alias("is_monday")).agg(*three_means(measures(clean)))


def friday_evening(clean: DataFrame, window=V.EVENING) -> DataFrame:
    fridays = C.with_hour(clean).filter(C.day_of_week() == 6).filter(C.in_window_inclusive(window))
    return fridays.groupBy("hour").agg(*three_means(measures(clean))).orderBy("hour")


# --- months and seasons ---------------------------------------------------------------

def monthly_statistics(clean: DataFrame, by_year: bool = False) -> DataFrame:
    """Per calendar month; ``by_year`` keeps the months of different years apart."""
    m = measures(clean)
    keys = (["year"] if by_year else []) + ["month", "month_name"]
    dated = (
        clean.withColumn("year", F.year("date"))
        .withColumn("month", F.month("date"))
        .withColumn("month_name", F.date_format("date", "MMMM"))
    )
    months = dated.groupBy(*keys).agg(
        *three_means(m), m.total("volume").alias("total_volume"),
        m.records().alias("record_count"), m.spread("speed").alias("std_speed"),
    )
    return months.orderBy(*keys[:-1])


def seasonal_statistics(clean: DataFrame) -> DataFrame:
    m = measures(clean)
    seasons = clean.groupBy(C.season_label(F.month("date")).alias("season")).agg(
        *three_means(m), m.total("volume").alias("total_volume")
    )
    return seasons.orderBy(C.season_order(F.col("season")))


def month_trend(clean: DataFrame, chronological: bool = False) -> DataFrame:
    """Change of mean speed and total volume from the first month to the last, in percent.

    First and last go by month number, or by date when ``chronological``. No row comes
    back when there is only one month.
    """
    months = monthly_statistics(clean, by_year=chronological)
    order = F.col("year") * 12 + F.col("month") if chronological else F.col("month")
    month = F.struct("month_name", "avg_speed", "total_volume")
    ends = months.agg(
        F.min_by(month, order).alias("first"), F.max_by(month, order).alias("last"),
        F.count(F.lit(1)).alias("months"),
    ).filter("months > 1")

    def change(field):
        return C.percent(F.col(f"last.{field}") - F.col(f"first.{field}"), F.col(f"first.{field}"))

    return ends.select(
        F.col("first.month_name").alias("first_month"),
        F.col("last.month_name").alias("last_month"),
        change("avg_speed").alias("speed_change_pct"),
        change("total_volume").alias("volume_change_pct"),
    )


# --- rush hours ---------------------------------------------------------------

def rush_by_weekend(clean: DataFrame, window) -> DataFrame:
    m = measures(clean)
    rush = C.with_hour(_with_week(clean)).filter(C.in_window(window))
    return rush.groupBy("is_weekend").agg(*three_means(m), m.records().alias("record_count"))


def morning_rush_weekend(clean: DataFrame) -> DataFrame:
    return rush_by_weekend(clean, V.MORNING)


def evening_rush_weekend(clean: DataFrame) -> DataFrame:
    return rush_by_weekend(clean, V.EVENING)


def morning_rush_top10_congested(clean: DataFrame, k: int = 10) -> DataFrame:
    rush = C.with_hour(clean).filter(C.in_window(V.MORNING)).filter(~C.is_weekend_day())
    m = measures(clean)
    roads = rush.groupBy("Road_EN", "District").agg(
        m.mean("speed").alias("avg_speed"), m.mean("occupancy").alias("avg_occupancy"),
        m.total("volume").alias("total_volume"),
    )
    scored = roads.withColumn("congestion_score", C.congestion_index())
    return C.top(scored, k, F.desc("congestion_score"), "Road_EN", "District")
