"""The analysis suite: clean once, roll up four times, answer every report."""

from pyspark.sql import DataFrame, SparkSession

from lanepulse.operators import descriptive, flow, quality, rush, spatial, temporal
from lanepulse.plans.rollup import flow_rollup, hourly_rollup
from lanepulse.plans.sketches import sketch_rollup
from lanepulse.sinks.tables import export_summaries
from lanepulse.sources.tables import read_or_compute, version_of

# Reports that need only sums, counts and squares: answered from the roll-up.
FROM_ROLLUP = {
    "district_statistics": descriptive.district_statistics,
    "lane_statistics_by_speed": descriptive.lane_statistics_by_speed,
    "direction_statistics": descriptive.direction_statistics,
    "hourly_profile": temporal.hourly_profile,
    "morning_peak_hour": temporal.morning_peak_hour,
    "evening_peak_hour": temporal.evening_peak_hour,
    "hourly_direction_profile": temporal.hourly_direction_profile,
    "hourly_lane_profile": temporal.hourly_lane_profile,
    "daily_statistics": temporal.daily_statistics,
    "weekday_weekend_comparison": temporal.weekday_weekend_comparison,
    "hourly_weekday_weekend": temporal.hourly_weekday_weekend,
    "monday_effect": temporal.monday_effect,
    "friday_evening": temporal.friday_evening,
    "monthly_statistics": temporal.monthly_statistics,
    "seasonal_statistics": temporal.seasonal_statistics,
    "month_trend": temporal.month_trend,
    "morning_rush_weekend": temporal.morning_rush_weekend,
    "evening_rush_weekend": temporal.evening_rush_weekend,
    "morning_rush_top10_congested": temporal.morning_rush_top10_congested,
    "top10_slowest_roads": spatial.top10_slowest_roads,
    "top10_busiest_roads": spatial.top10_busiest_roads,
    "top10_most_congested_roads": spatial.top10_most_congested_roads,
    "district_rankings": spatial.district_rankings,
    "lane_speed": spatial.lane_speed,
    "lane_volume": spatial.lane_volume,
    "lane_occupancy": spatial.lane_occupancy,
    "lane_statistics": spatial.lane_statistics,
    "peak_lane_stats": spatial.peak_lane_stats,
    "morning_direction": spatial.morning_direction,
    "evening_direction": spatial.evening_direction,
    "road_direction_comparison": spatial.road_direction_comparison,
    "morning_district_flow": spatial.morning_district_flow,
    "road_congestion_severity": spatial.road_congestion_severity,
    "speed_variability": spatial.speed_variability,
    "geospatial_data": spatial.geospatial_data,
    "clean_coverage": quality.clean_coverage,
}

# Reports over all valid readings, cleaned or not: answered from their own roll-up.
FROM_VALID_ROLLUP = {
    "district_stats": descriptive.district_stats,
    "road_stats": descriptive.road_stats,
    "road_slowest20": descriptive.road_slowest,
    "road_busiest20": descriptive.road_busiest,
    "road_fastest20": descriptive.road_fastest,
    "lane_stats": descriptive.lane_stats,
    "hourly_stats": descriptive.hourly_stats,
    "dow_stats": descriptive.dow_stats,
    "weekday_weekend": descriptive.weekday_weekend,
    "direction_stats": descriptive.direction_stats,
    "busy_roads_morning": rush.busy_roads_morning,
    "busy_roads_evening": rush.busy_roads_evening,
    "congestion_morning": rush.congestion_morning,
    "congestion_evening": rush.congestion_evening,
}

# Reports by measured value (bins, regimes): answered from the flow roll-up.
FROM_FLOW_ROLLUP = {
    "traffic_regime_distribution": spatial.traffic_regime_distribution,
    "speed_volume_relationship": flow.speed_volume_relationship,
    "volume_occupancy_relationship": flow.volume_occupancy_relationship,
    "speed_occupancy_relationship": flow.speed_occupancy_relationship,
    "fundamental_diagram": flow.fundamental_diagram,
    "flow_regime_stats": flow.flow_regime_stats,
    "lane_flow_regimes": flow.lane_flow_regimes,
    "hourly_flow_regimes": flow.hourly_flow_regimes,
}

# Reports with percentiles: from the sketches within their rank error, or, where exact ones are
# asked for, from the readings.
FROM_SKETCHES = {
    "overall_wide": descriptive.overall_wide,
    "road_capacity_estimates": flow.road_capacity_estimates,
    "lane_capacity_estimates": flow.lane_capacity_estimates,
}

# Reports that must see the readings (correlation, sample).
FROM_READINGS = {
    "correlations": flow.correlations,
    "scatter_sample": flow.scatter_sample,
}


def prepare(spark: SparkSession, obs: DataFrame, root: str) -> tuple[DataFrame, ...]:
    """Write (or find) the cleaned table, its three roll-ups and that of all valid readings. They are ordinary tables, so
    a lost executor costs a re-read and a restarted job goes on from what is finished. Other
    input files, or changed ones, are another version and are computed anew."""
    version = version_of(obs)
    clean = read_or_compute(spark, f"{root}/cleaned", lambda: quality.clean_observations(obs), version)
    by_hour = read_or_compute(spark, f"{root}/rollup", lambda: hourly_rollup(clean), version)
    by_flow = read_or_compute(spark, f"{root}/flow_rollup", lambda: flow_rollup(clean), version)
    by_valid = read_or_compute(
        spark, f"{root}/valid_rollup", lambda: hourly_rollup(quality.valid_only(obs)), version)
    by_sketch = read_or_compute(spark, f"{root}/sketches", lambda: sketch_rollup(clean), version)
    return clean, by_hour, by_flow, by_valid, by_sketch


def reports(clean: DataFrame, by_hour: DataFrame, by_flow: DataFrame, by_valid: DataFrame, by_sketch: DataFrame,
            exact: bool = False) -> dict[str, DataFrame]:
    sources = (
        (FROM_ROLLUP, by_hour), (FROM_FLOW_ROLLUP, by_flow), (FROM_VALID_ROLLUP, by_valid),
        (FROM_SKETCHES, clean if exact else by_sketch), (FROM_READINGS, clean))
    return {name: report(table) for group, table in sources for name, report in group.items()}


def run_suite(spark: SparkSession, obs: DataFrame, root: str, exact: bool = False) -> dict[str, DataFrame]:
    """All reports over one data set, exported as CSV below ``root``. ``exact`` percentiles
    scan the cleaned readings again."""
    results = reports(*prepare(spark, obs, root), exact=exact)
    export_summaries(results, f"{root}/reports")
    return results
