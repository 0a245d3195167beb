"""From nested reading documents to typed observations with a location."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse import schemas
from lanepulse.functions import fixed_values as V


def explode_periods(docs: DataFrame) -> DataFrame:
    """One row per document and period."""
    kept = [c for c in docs.columns if c != "periods"]
    return docs.select(*kept, F.explode("periods.period").alias("period"))


def reading_time(date: Column, time: Column) -> Column:
    """Timestamp from a date text and a time text; NULL where either has no match."""
    day = F.regexp_extract(date, V.DATE_PATTERN, 1)
    clock = F.regexp_extract(time, V.TIME_PATTERN, 1)
    return F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyy-MM-dd HH:mm:ss"))


def time_periods(periods: DataFrame) -> DataFrame:
    """Typed date and times. A period has thousands of lane rows, so this is done before
    they are unfolded."""
    kept = [c for c in periods.columns if c != "date"]
    date = F.col("date")
    return periods.select(
        *kept,
        F.regexp_extract(date, V.DATE_PATTERN, 1).try_cast("date").alias("date"),
        reading_time(date, F.col("period.period_from")).alias("period_from"),
        reading_time(date, F.col("period.period_to")).alias("period_to"),
    )


def explode_detectors(periods: DataFrame) -> DataFrame:
    """One row per period and detector."""
    kept = [c for c in periods.columns if c != "period"]
    times = [] if "period_from" in kept else ["period.period_from", "period.period_to"]
    return periods.select(*kept, *times, F.explode("period.detectors.detector").alias("detector"))


def explode_lanes(detectors: DataFrame) -> DataFrame:
    """One row per period, detector and lane."""
    kept = [c for c in detectors.columns if c != "detector"]
    return detectors.select(
        *kept, "detector.detector_id", "detector.direction",
        F.explode("detector.lanes.lane").alias("lane"),
    )


def type_lanes(lanes: DataFrame) -> DataFrame:
    """Cast once, here: a value that is no number becomes NULL and the row stays."""
    def number(source, name):
        return F.col(f"lane.`{source}`").try_cast(schemas.READINGS[name].dataType).alias(name)

    return lanes.select(
        "detector_id", "direction", "lane.lane_id",
        number("occupancy", "occupancy"), number("speed", "speed"), number("volume", "volume"),
        number("s.d.", "standard_deviation"),
        "lane.valid", "period_from", "period_to", "date",
        *[c for c in ("source_file",) if c in lanes.columns],
    )


def flatten_periods(periods: DataFrame) -> DataFrame:
    """Periods to one typed row per detector and lane."""
    return type_lanes(explode_lanes(explode_detectors(time_periods(periods))))


def flatten_readings(docs: DataFrame) -> DataFrame:
    """Documents to one typed row per detector, lane and period. No shuffle."""
    return flatten_periods(explode_periods(docs))


def _size(array: Column) -> Column:
    return F.greatest(F.coalesce(F.size(array), F.lit(0)), F.lit(0)).cast("long")


def _sum_over(array: Column, weight) -> Column:
    none = F.lit(0).cast("long")
    return F.coalesce(F.aggregate(array, none, lambda total, item: total + weight(item)), none)


def fanout_counts(docs: DataFrame) -> DataFrame:
    """Rows after every explode, added up from array sizes in one pass without exploding."""
    def lanes_of(detectors):
        return _sum_over(detectors, lambda detector: _size(detector["lanes"]["lane"]))

    periods = F.col("periods.period")
    levels = {
        "periods": _size(periods),
        "detectors": _sum_over(periods, lambda period: _size(period["detectors"]["detector"])),
        "lanes": _sum_over(periods, lambda period: lanes_of(period["detectors"]["detector"])),
    }
    return docs.agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(level) for level, n in levels.items()],
    )


def canonical_district(district: Column) -> Column:
    """One spelling per district."""
    spelled = district
    for variant, name in V.DISTRICT_SPELLING.items():
        spelled = F.when(district == variant, name).otherwise(spelled)
    return spelled


def canonical_locations(locations: DataFrame) -> DataFrame:
    return locations.withColumn("District", canonical_district(F.col("District")))


def join_locations(readings: DataFrame, locations: DataFrame, salts: int = 1) -> DataFrame:
    """Left join on the detector; readings without a location keep NULLs.

    Spark broadcasts the locations if their size in bytes allows it, else it shuffles and
    adaptive execution splits a hot detector's readings. ``salts`` spreads every detector over
    so many join keys, for clusters without adaptive execution. A detector that is listed
    twice doubles its readings: see ``repeated_locations``.
    """
    kept = [c for c in schemas.LOCATION_COLUMNS if c in locations.columns]
    places = locations.select("AID_ID_Number", *kept)
    same = F.col("detector_id") == F.col("AID_ID_Number")
    if salts == 1:
        return readings.join(places, same, "left").drop("AID_ID_Number")

    salt = F.pmod(F.xxhash64(*readings.columns), F.lit(salts)).cast("int")
    copies = places.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return readings.withColumn("_salt", salt).join(
        copies, same & (F.col("_salt") == F.col("_copy")), "left"
    ).drop("AID_ID_Number", "_salt", "_copy")


def repeated_locations(locations: DataFrame) -> DataFrame:
    """Detectors that the location table lists more than once, with how often."""
    return locations.groupBy("AID_ID_Number").agg(F.count(F.lit(1)).alias("entries")).filter(F.col("entries") > 1)


def unmatched_detectors(readings: DataFrame, locations: DataFrame) -> DataFrame:
    """Detectors that no location names. Distinct first, so the join sees one row each."""
    detectors = readings.select("detector_id").distinct()
    return detectors.join(
        locations.select("AID_ID_Number"), F.col("detector_id") == F.col("AID_ID_Number"), "left_anti"
    )
