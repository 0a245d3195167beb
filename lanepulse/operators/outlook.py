"""Further analyses of the cleaned observations: growth, gaps, congestion episodes, delay,
model features and a live view.

Reports that look back or ahead in time run on hourly means per detector, which are at most
8,784 rows a detector and year however many readings there are. Episodes need single readings
and are found by day, then merged, so no window holds more than a lane's readings of one day.
"""

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.functions import columns as C
from lanepulse.operators.distribution import describe_column
from lanepulse.operators.ranking import with_percent_rank
from lanepulse.sources import shared

HOUR = 3600
DAYS = range(1, 8)
#: Upper ends of the bands of the congestion index.
BANDS = (("Low", 25), ("Moderate", 50), ("High", 75))
TOP_BAND = "Severe"
ROAD = ("Road_EN", "District")


# --- volumes and growth ---------------------------------------------------------

def hour_dow_heatmap(clean: DataFrame) -> DataFrame:
    """Mean speed per hour (rows) and day of week (columns, 1 is Sunday)."""
    cells = C.with_hour(clean).withColumn("_dow", F.dayofweek("date"))
    return cells.groupBy("hour").pivot("_dow", list(DAYS)).agg(F.avg("speed")).withColumnsRenamed(
        {str(d): f"dow_{d}" for d in DAYS})


def _hourly(clean: DataFrame, *keys: str) -> DataFrame:
    return C.with_hour(clean).groupBy(*keys, "date", "hour").agg(
        F.avg("speed").alias("avg_speed"), F.avg("occupancy").alias("avg_occupancy"), F.sum("volume").alias("volume"))


def volume_rollups(clean: DataFrame) -> DataFrame:
    """Vehicles per day, per month and in all, with the mean per hour that has readings."""
    hours = _hourly(clean).withColumn("month", F.date_format("date", "yyyy-MM"))
    return hours.rollup("month", "date").agg(
        F.sum("volume").alias("total_volume"), F.avg("volume").alias("avg_hourly_volume"))


def month_growth(clean: DataFrame) -> DataFrame:
    """Each month's volume and speed against the month before (months are few)."""
    months = clean.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.sum("volume").alias("total_volume"), F.avg("speed").alias("avg_speed"))
    before = Window.orderBy("month")

    def growth(name: str) -> Column:
        last = F.lag(name).over(before)
        return F.try_divide((F.col(name) - last) * 100.0, last)

    return months.select("*", growth("total_volume").alias("volume_growth_pct"), growth("avg_speed").alias("speed_growth_pct"))


# --- coverage ---------------------------------------------------------------------

def missing_days(obs: DataFrame) -> DataFrame:
    """Days between the first and the last that have no reading."""
    seen = obs.select("date").where("date IS NOT NULL").distinct()
    ends = seen.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.sequence("a", "b")).alias("date")).join(seen, "date", "left_anti")


def coverage_gaps(obs: DataFrame) -> DataFrame:
    """Days without a reading per detector, among the days on which any detector has one."""
    seen = obs.select("detector_id", "date").where("date IS NOT NULL").distinct()
    days = seen.select("date").distinct().agg(F.count(F.lit(1))).scalar()
    return seen.groupBy("detector_id").agg(F.count(F.lit(1)).alias("days_seen")).withColumn(
        "days_missing", days - F.col("days_seen")).where("days_missing > 0")


# --- congestion ---------------------------------------------------------------------

def regime_share(clean: DataFrame) -> DataFrame:
    """Share of each road's readings in each traffic regime."""
    counts = clean.groupBy(*ROAD, C.regime().alias("traffic_regime")).agg(F.count(F.lit(1)).alias("record_count"))
    return counts.withColumn(
        "share_pct", F.col("record_count") * 100.0 / F.sum("record_count").over(Window.partitionBy(*ROAD)))


def sd_speed_relation(clean: DataFrame) -> DataFrame:
    """How the spread within a reading goes with its speed."""
    return clean.agg(
        F.corr("standard_deviation", "speed").alias("sd_speed_corr"),
        F.avg(F.try_divide("standard_deviation", "speed")).alias("avg_cv"))


def congestion_index_banded(clean: DataFrame, keys=ROAD) -> DataFrame:
    """Index of percentile ranks and relative spread per road (or whatever `keys` name), with
    its band. Groups may be many: ranks come from blocks of values, not from one sorted task."""
    groups = shared.stored(clean.groupBy(*keys).agg(
        F.avg("speed").alias("avg_speed"), F.avg("occupancy").alias("avg_occupancy"), F.stddev("speed").alias("sd")), "index")
    ranked = with_percent_rank(with_percent_rank(groups, "avg_speed", "fast"), "avg_occupancy", "full")
    index = ((100 - F.col("fast") * 100) * 0.4 + F.col("full") * 100 * 0.4
             + F.try_divide("sd", "avg_speed") * 100 * 0.2)
    scored = ranked.select(*keys, index.alias("congestion_index"))
    band = F.lit(TOP_BAND)
    for label, below in reversed(BANDS):
        band = F.when(F.col("congestion_index") < below, label).otherwise(band)
    return scored.withColumn("band", F.when(F.col("congestion_index").isNotNull(), band))


def congestion_episodes(clean: DataFrame, longest_gap: int = 3600) -> DataFrame:
    """Runs of congested readings of one detector's lane, over midnight and over days. A run
    ends with a reading that is not congested or a gap of more than `longest_gap` seconds (a day
    at most), both times taken to the nearest second. `date` is the day it starts on, `episode` its
    number among that day's.

    Two steps, so that no window holds more than a day of a lane's readings: runs are found
    within days; then those that touch the first or last reading of their day, two a day at
    most, are merged with their neighbour's. Readings without a time take no part; of readings
    of equal times the uncongested come first.
    """
    if not 0 <= longest_gap <= 24 * HOUR:
        raise ValueError("longest_gap is up to a day: only neighbouring days are merged")
    lane = ["detector_id", "lane_id"]
    day = Window.partitionBy(*lane, "date").orderBy("period_from", "period_to", "on")
    # Days are those of the rounded times: two readings at most a day apart lie in neighbouring ones.
    at = F.rint(F.unix_micros(F.col("period_from").cast("timestamp")) / 1_000_000).cast("long")
    marked = clean.where("period_from IS NOT NULL").select(
        *lane, F.to_date(F.timestamp_seconds(at)).alias("date"), "period_from", "period_to", C.moderate().alias("on"), at.alias("at"))
    placed = marked.select(
        "*", F.lag("on").over(day).alias("before"), F.lag("at").over(day).alias("at_before"),
        F.lead("at").over(day).isNull().alias("is_last"))
    opened = placed.withColumn("first", F.col("on") & (
        ~F.coalesce("before", F.lit(False)) | (F.col("at") - F.col("at_before") > longest_gap)))
    runs = opened.withColumn("run", F.sum(F.col("first").cast("int")).over(day)).where("on").groupBy(*lane, "date", "run").agg(
        F.min("period_from").alias("start"), F.max("period_to").alias("stop"), F.count(F.lit(1)).alias("readings"),
        F.min("at").alias("opens"), F.max("at").alias("closes"),
        F.bool_or(F.col("at_before").isNull()).alias("from_edge"), F.bool_or("is_last").alias("to_edge"))

    edges = Window.partitionBy(*lane).orderBy("date", "run")
    goes_on = (F.col("from_edge") & F.lag("to_edge").over(edges) & (F.lag("date").over(edges) == F.date_sub("date", 1))
               & (F.col("opens") - F.lag("closes").over(edges) <= longest_gap))
    edge = runs.where("from_edge OR to_edge").withColumn("new", ~F.coalesce(goes_on, F.lit(False)))
    merged = edge.withColumn("whole", F.sum(F.col("new").cast("int")).over(edges)).groupBy(*lane, "whole").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("readings").alias("readings"))
    columns = [*lane, F.to_date("start").alias("date"), "start", "stop", "readings"]
    every = runs.where("NOT (from_edge OR to_edge)").select(*columns).unionByName(merged.select(*columns))
    number = F.row_number().over(Window.partitionBy(*lane, "date").orderBy("start"))
    return every.select(*lane, "date", number.cast("long").alias("episode"), "start", "stop", "readings")


def delay_cost(clean: DataFrame, free_speed: str | float = 60.0, value_of_time: float = 100.0, seconds: int = 30) -> DataFrame:
    """Vehicle hours lost per road below free speed, and their cost. `free_speed` is one number
    or a column name; `delay_against_own_speed` takes each road's own percentile."""
    free = F.col(free_speed) if isinstance(free_speed, str) else F.lit(float(free_speed))
    lost = F.greatest(F.try_divide(free - F.col("speed"), free), F.lit(0.0)) * F.lit(seconds / HOUR) * F.col("volume")
    roads = clean.groupBy(*ROAD).agg(F.sum(lost).alias("delay_hours"))
    return roads.withColumn("delay_cost", F.col("delay_hours") * value_of_time)


def delay_against_own_speed(clean: DataFrame, share: float = 0.85, value_of_time: float = 100.0, seconds: int = 30) -> DataFrame:
    """`delay_cost` with each road's own free speed, the given percentile of its speeds. Readings
    are added up per road and speed before the join, so a road is joined at most once per
    speed it was ever driven at."""
    same = reduce(Column.__and__, [F.col(f"v.{k}").eqNullSafe(F.col(f"f.{k}")) for k in ROAD])
    by_speed = clean.groupBy(*ROAD, "speed").agg(F.sum("volume").alias("volume"))
    free = describe_column(clean, "speed", {"free_speed": share}, ROAD).select(*ROAD, "free_speed")
    placed = by_speed.alias("v").join(free.alias("f"), same).select(
        *[f"v.{k}" for k in ROAD], "v.speed", "v.volume", "f.free_speed")
    lost = delay_cost(placed, "free_speed", value_of_time, seconds)
    same = reduce(Column.__and__, [F.col(f"d.{k}").eqNullSafe(F.col(f"f.{k}")) for k in ROAD])
    return lost.alias("d").join(free.alias("f"), same).select("d.*", "f.free_speed")


def threshold_incidents(clean: DataFrame, drop: float = 0.5, spike: float = 1.5) -> DataFrame:
    """Detector hours far slower, or far fuller, than the same hour on all days."""
    hours = _hourly(clean, "detector_id")
    usual = hours.groupBy("detector_id", "hour").agg(
        F.avg("avg_speed").alias("usual_speed"), F.avg("avg_occupancy").alias("usual_occupancy"))
    both = hours.join(usual, ["detector_id", "hour"])
    slow, full = F.col("avg_speed") < drop * F.col("usual_speed"), F.col("avg_occupancy") > spike * F.col("usual_occupancy")
    return both.where(slow | full).select(
        "detector_id", "date", "hour", F.coalesce(slow, F.lit(False)).alias("slow"), F.coalesce(full, F.lit(False)).alias("full"))


# --- features for models -----------------------------------------------------------

def _epoch_hour() -> Column:
    return F.unix_date("date").cast("long") * 24 + F.col("hour")


def calendar_lag_features(clean: DataFrame) -> DataFrame:
    """Hourly mean speed per detector with its values 1, 2 and 24 hours before, the mean of
    the seven days before, the mean of the same hour and day of week, and calendar flags.
    Lags follow the clock: an hour without readings is NULL, not the next older one."""
    hours = _hourly(clean, "detector_id").withColumn("at", _epoch_hour()).withColumn("dow", F.dayofweek("date"))
    clock = Window.partitionBy("detector_id").orderBy("at")
    back = lambda a, b: F.avg("avg_speed").over(clock.rangeBetween(-a, -b))
    alike = Window.partitionBy("detector_id", "hour", "dow")
    return hours.select(
        "detector_id", "date", "hour", "avg_speed", back(1, 1).alias("speed_1h"), back(2, 2).alias("speed_2h"),
        back(24, 24).alias("speed_24h"), back(168, 1).alias("speed_7d"), F.avg("avg_speed").over(alike).alias("speed_alike"),
        "dow", F.col("dow").isin(1, 7).alias("is_weekend"))


def next_period_label(clean: DataFrame, below: float = 40.0) -> DataFrame:
    """Whether the detector's next hour is slow; NULL where the next hour has no readings."""
    hours = _hourly(clean, "detector_id").withColumn("at", _epoch_hour())
    following = F.avg("avg_speed").over(Window.partitionBy("detector_id").orderBy("at").rangeBetween(1, 1))
    return hours.select("detector_id", "date", "hour", "avg_speed", (following < below).alias("next_congested"))


def holiday_effect(clean: DataFrame, holidays: DataFrame) -> DataFrame:
    """Means on holidays, on the days next to one, and on others. `holidays` has a `date`."""
    days = holidays.select(F.col("date").alias("h")).distinct()
    near = days.select(F.explode(F.array(F.date_sub("h", 1), F.col("h"), F.date_add("h", 1))).alias("date"), "h")
    kinds = near.groupBy("date").agg(F.max((F.col("date") == F.col("h")).cast("int")).alias("is_holiday"))
    kind = F.when(F.col("is_holiday") == 1, "holiday").when(F.col("is_holiday") == 0, "next to one").otherwise("normal")
    by_day = clean.groupBy("date").agg(
        F.sum("speed").alias("s"), F.count("speed").alias("n"), F.sum("volume").alias("v"), F.count(F.lit(1)).alias("c"))
    return by_day.join(kinds, "date", "left").groupBy(kind.alias("day_kind")).agg(
        F.try_divide(F.sum("s").cast("double"), F.sum("n")).alias("avg_speed"), F.sum("v").alias("total_volume"),
        F.sum("c").alias("record_count"))


def road_profiles(clean: DataFrame) -> DataFrame:
    """Mean speed per road and hour of day as columns h0 to h23; hours without readings take
    the road's mean."""
    roads = C.with_hour(clean).groupBy(*ROAD, "hour").agg(F.avg("speed").alias("s"))
    wide = roads.groupBy(*ROAD).pivot("hour", list(range(24))).agg(F.first("s"))
    mean = roads.groupBy(*ROAD).agg(F.avg("s").alias("m"))
    same = F.col("a.Road_EN").eqNullSafe(F.col("b.Road_EN")) & F.col("a.District").eqNullSafe(F.col("b.District"))
    return wide.alias("a").join(mean.alias("b"), same).select(
        "a.Road_EN", "a.District", *[F.coalesce(F.col(f"a.`{h}`"), "b.m").alias(f"h{h}") for h in range(24)])


def road_clusters(clean: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Roads grouped by their daily profile: each with its `cluster`, the mean speed of the
    cluster's centre and its distance from it. Clusters are numbered from 1 by that mean speed,
    slowest first, so a number says something and does not hang on the fit's own order. No
    roads give no rows."""
    hours = [f"h{h}" for h in range(24)]
    profiles = shared.stored(road_profiles(clean).na.drop(subset=hours), "profiles")
    if profiles.isEmpty():
        return profiles.select(*ROAD, F.lit(0).alias("cluster"), F.lit(0.0).alias("centre_speed"), F.lit(0.0).alias("distance"))
    rows = VectorAssembler(inputCols=hours, outputCol="profile").transform(profiles)
    fitted = KMeans(k=k, seed=seed, featuresCol="profile", predictionCol="fit").fit(rows)
    centres = [[float(x) for x in c] for c in fitted.clusterCenters()]
    slowest = sorted(range(len(centres)), key=lambda i: (sum(centres[i]), centres[i]))
    numbers = F.array(*[F.lit(slowest.index(i) + 1) for i in range(len(centres))])
    centre = F.array(*[F.array(*map(F.lit, c)) for c in centres])[F.col("fit")]
    gaps = F.zip_with(F.array(*hours), centre, lambda a, b: (a - b) * (a - b))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return fitted.transform(rows).select(
        *ROAD, numbers[F.col("fit")].alias("cluster"), (total(centre) / 24).alias("centre_speed"),
        F.sqrt(total(gaps)).alias("distance"))


def live_congestion(readings: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and mean speed per detector and window of a stream (or table) of readings; rows
    later than `late` are dropped by a stream's watermark."""
    timed = readings.withColumn("period_from", F.col("period_from").cast("timestamp"))
    return timed.withWatermark("period_from", late).groupBy(
        F.window("period_from", window).alias("w"), "detector_id"
    ).agg(F.count(F.lit(1)).alias("record_count"), F.avg("speed").alias("avg_speed"),
          F.count_if(C.severe()).alias("severe_count")).select(
        F.col("w.start").alias("window_start"), "detector_id", "record_count", "avg_speed", "severe_count")
