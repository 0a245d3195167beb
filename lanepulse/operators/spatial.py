"""Hotspots, lanes, directions, congestion severity, detector map."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanepulse.functions import columns as C
from lanepulse.functions import fixed_values as V
from lanepulse.functions.measures import ROWS, measures, need_cells, three_means

ROAD = ("Road_EN", "District")


# --- hotspots ---------------------------------------------------------------

def top10_slowest_roads(clean: DataFrame, k: int = 10) -> DataFrame:
    m = measures(clean)
    roads = clean.groupBy(*ROAD).agg(*three_means(m), m.records().alias("observation_count"))
    return C.top(roads, k, F.asc("avg_speed"), *ROAD)


def top10_busiest_roads(clean: DataFrame, k: int = 10) -> DataFrame:
    m = measures(clean)
    roads = clean.groupBy(*ROAD).agg(
        m.total("volume").alias("total_volume"), m.mean("speed").alias("avg_speed"),
        m.mean("occupancy").alias("avg_occupancy"), m.records().alias("observation_count"),
    )
    return C.top(roads, k, F.desc("total_volume"), *ROAD)


def congestion_ranking(clean: DataFrame, *keys: str) -> DataFrame:
    """Congestion figures per group, with the index the rankings sort by."""
    m = measures(clean)
    return clean.groupBy(*keys).agg(
        m.mean("speed").alias("avg_speed"), m.mean("occupancy").alias("avg_occupancy"),
        m.total("volume").alias("total_volume"), m.records().alias("observation_count"),
        m.flagged("severe").alias("severe_congestion_events"),
    ).withColumn("congestion_index", C.congestion_index())


def top10_most_congested_roads(clean: DataFrame, k: int = 10) -> DataFrame:
    return C.top(congestion_ranking(clean, *ROAD), k, F.desc("congestion_index"), *ROAD)


def district_rankings(clean: DataFrame) -> DataFrame:
    return C.top(congestion_ranking(clean, "District"), None, F.desc("congestion_index"), "District")


# --- lanes ---------------------------------------------------------------

def lane_speed(clean: DataFrame) -> DataFrame:
    m = measures(clean)
    lanes = clean.groupBy("lane_id").agg(
        m.mean("speed").alias("avg_speed"), m.spread("speed").alias("std_speed"),
        m.low("speed").alias("min_speed"), m.high("speed").alias("max_speed"),
        m.records().alias("record_count"),
    )
    return C.top(lanes, None, F.desc("avg_speed"), "lane_id")


def lane_volume(clean: DataFrame) -> DataFrame:
    m = measures(clean)
    lanes = clean.groupBy("lane_id").agg(
        m.total("volume").alias("total_volume"), m.mean("volume").alias("avg_volume"),
        m.records().alias("record_count"),
    )
    return C.top(lanes, None, F.desc("total_volume"), "lane_id")


def lane_occupancy(clean: DataFrame) -> DataFrame:
    m = measures(clean)
    lanes = clean.groupBy("lane_id").agg(
        m.mean("occupancy").alias("avg_occupancy"), m.spread("occupancy").alias("std_occupancy"),
        m.records().alias("record_count"),
    )
    return C.top(lanes, None, F.desc("avg_occupancy"), "lane_id")


def _usage(obs, key):
    m = measures(obs)
    return obs.groupBy(key).agg(
        m.mean("speed").alias("avg_speed"), m.total("volume").alias("total_volume"),
        m.mean("occupancy").alias("avg_occupancy"), m.records().alias("record_count"),
    ).orderBy(key)


def lane_statistics(clean: DataFrame) -> DataFrame:
    return _usage(clean, "lane_id")


def peak_lane_stats(clean: DataFrame) -> DataFrame:
    """Lanes during the morning or the evening rush."""
    m = measures(clean)
    rush = C.with_hour(clean).filter(C.in_either_rush())
    return rush.groupBy("lane_id").agg(
        m.mean("speed").alias("avg_speed_peak"), m.mean("occupancy").alias("avg_occupancy_peak"),
        m.records().alias("record_count"),
    ).orderBy("lane_id")


# --- directions ---------------------------------------------------------------

def rush_direction(clean: DataFrame, window) -> DataFrame:
    return _usage(C.with_hour(clean).filter(C.in_window(window)), "direction")


def morning_direction(clean: DataFrame) -> DataFrame:
    return rush_direction(clean, V.MORNING)


def evening_direction(clean: DataFrame) -> DataFrame:
    return rush_direction(clean, V.EVENING)


def road_direction_comparison(clean: DataFrame, more_than: int = V.MIN_OBSERVATIONS) -> DataFrame:
    m = measures(clean)
    return clean.groupBy("Road_EN", "direction").agg(
        m.mean("speed").alias("avg_speed"), m.mean("occupancy").alias("avg_occupancy"),
        m.records().alias("observation_count"),
    ).filter(F.col("observation_count") > more_than)


def morning_district_flow(clean: DataFrame) -> DataFrame:
    m = measures(clean)
    rush = C.with_hour(clean).filter(C.in_window(V.MORNING))
    flow = rush.groupBy("District", "direction").agg(
        m.total("volume").alias("total_volume"), m.mean("speed").alias("avg_speed")
    )
    return flow.orderBy("District", F.desc("total_volume"), "direction")


# --- congestion ---------------------------------------------------------------

def traffic_regime_distribution(clean: DataFrame) -> DataFrame:
    need_cells(clean, "traffic_regime_distribution")
    m = measures(clean)
    regime = F.col("traffic_regime") if ROWS in clean.columns else C.regime().alias("traffic_regime")
    regimes = clean.groupBy(regime).agg(
        m.records().alias("record_count"), m.mean("speed").alias("avg_speed"),
        m.mean("occupancy").alias("avg_occupancy"),
    ).withColumn("pct", C.percent_of_total("record_count"))
    return C.top(regimes, None, F.desc("record_count"), "traffic_regime")


def road_congestion_severity(clean: DataFrame, k: int = 20) -> DataFrame:
    m = measures(clean)
    roads = clean.groupBy(*ROAD).agg(
        m.records().alias("total_observations"), m.flagged("free_flow").alias("free_flow_count"),
        m.flagged("synchronized").alias("synch_flow_count"), m.flagged("jam").alias("jam_count"),
        m.mean("speed").alias("avg_speed"), m.mean("occupancy").alias("avg_occupancy"),
    )
    rate = C.percent(F.col("jam_count"), F.col("total_observations"))
    return C.top(roads.withColumn("congestion_rate", rate), k, F.desc("congestion_rate"), *ROAD)


def speed_variability(clean: DataFrame, k: int = 20, more_than: int = V.MIN_OBSERVATIONS) -> DataFrame:
    m = measures(clean)
    roads = clean.groupBy(*ROAD).agg(
        m.mean("speed").alias("avg_speed"), m.spread("speed").alias("std_speed"),
        m.records().alias("observation_count"),
    ).filter(F.col("observation_count") > more_than)
    variation = F.try_divide(F.col("std_speed"), F.col("avg_speed"))
    return C.top(
        roads.withColumn("coefficient_of_variation", variation), k,
        F.desc("coefficient_of_variation"), *ROAD,
    )


def geospatial_data(clean: DataFrame) -> DataFrame:
    """One row per detector position, for a heat map."""
    m = measures(clean)
    place = ("detector_id", *ROAD, "GeometryEasting", "GeometryNorthing")
    return clean.groupBy(*place).agg(
        m.mean("speed").alias("avg_speed"), m.mean("occupancy").alias("avg_occupancy"),
        m.total("volume").alias("total_volume"), m.records().alias("observation_count"),
    ).withColumn("congestion_index", C.congestion_index())
