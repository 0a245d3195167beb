"""SQL that recomputes every registered query on the given tables."""

VIEWS = """
readings AS (
  SELECT user_id AS detector_id,
         CASE event_id % 5 WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'East' WHEN 3 THEN 'West' END AS direction,
         event_type AS lane_id,
         CAST(json_extract_string(props, '$.k') AS INT)
           + CASE WHEN event_id % 307 = 0 THEN 100 ELSE 0 END AS occupancy,
         floor(value * 4) / 4 AS speed,
         CAST(event_id % 131 - CASE WHEN event_id % 211 = 0 THEN 200 ELSE 0 END AS INT) AS volume,
         CASE WHEN event_id % 53 = 0 THEN NULL ELSE (event_id % 17) * CAST(0.5 AS DOUBLE) END AS standard_deviation,
         CASE WHEN event_id % 67 = 0 THEN 'N' ELSE 'Y' END AS valid,
         ts AS period_from, ts + INTERVAL 30 SECOND AS period_to, CAST(ts AS DATE) AS date,
         concat('file-', CAST(event_id % 20 AS VARCHAR)) AS source_file
  FROM events),
locations AS (
  SELECT s_suppkey AS AID_ID_Number, n_name AS Road_EN, r_name AS District,
         s_suppkey * CAST(10 AS DOUBLE) AS GeometryEasting, s_suppkey * CAST(7 AS DOUBLE) AS GeometryNorthing
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
obs AS (
  SELECT r.*, District, Road_EN, GeometryEasting, GeometryNorthing
  FROM readings r LEFT JOIN locations l ON r.detector_id = l.AID_ID_Number),
valid_obs AS (SELECT * FROM obs WHERE valid = 'Y'),
clean AS (
  SELECT *, CAST(hour(period_from) AS INT) AS hour, CAST(dayofweek(date) + 1 AS INT) AS dow,
         CASE WHEN dayofweek(date) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS is_weekend,
         CASE WHEN speed > 60 AND occupancy < 20 THEN 'Free Flow'
              WHEN speed >= 30 AND speed <= 60 AND occupancy >= 20 AND occupancy <= 40 THEN 'Synchronized Flow'
              WHEN speed < 30 AND occupancy > 40 THEN 'Wide Moving Jam' ELSE 'Transitional' END AS regime_a,
         CASE WHEN speed > 60 AND occupancy < 20 THEN 'Free Flow'
              WHEN speed >= 30 AND speed <= 60 THEN 'Synchronized Flow'
              WHEN speed < 30 AND occupancy > 40 THEN 'Congested Flow' ELSE 'Transitional' END AS regime_b
  FROM valid_obs
  WHERE speed >= 0 AND speed <= 200 AND volume >= 0 AND occupancy >= 0 AND occupancy <= 100
    AND Road_EN IS NOT NULL),
long_obs AS (
  SELECT l_suppkey AS detector_id, l_linestatus AS direction, l_returnflag AS lane_id,
         CAST(l_orderkey % 101 AS INT) AS occupancy,
         CAST((l_partkey * 7 + l_linenumber) % 121 AS INT) AS speed,
         CAST(l_quantity AS INT) AS volume, CAST(l_shipdate AS DATE) AS date, Road_EN, District,
         CAST(month(l_shipdate) AS INT) AS month, CAST(year(l_shipdate) AS INT) AS year
  FROM lineitem JOIN locations ON l_suppkey = AID_ID_Number)
"""


def _with(body: str, extra: str = "") -> str:
    head = f"WITH {VIEWS}" + (f", {extra}" if extra else "")
    return f"{head}\n{body}"


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


def _avg(column: str, name: str | None = None) -> str:
    return _r(f"avg({column})", name or f"avg_{column}")


def _std(column: str, name: str | None = None) -> str:
    return _r(f"stddev_samp({column})", name or f"std_{column}")


N = "count(*)"
VOLUME = "CAST(sum(volume) AS BIGINT) AS total_volume"
THREE = ", ".join(_avg(c) for c in ("speed", "volume", "occupancy"))
FIVE = (
    f"{N} AS Records, {_avg('speed', 'Avg_Speed')}, {_avg('volume', 'Avg_Volume')}, "
    f"{_avg('occupancy', 'Avg_Occupancy')}, CAST(sum(volume) AS BIGINT) AS Total_Volume"
)
INDEX = "avg(occupancy) * 0.5::DOUBLE + (100 - avg(speed)) * 0.5::DOUBLE"
SEVERE = "count(*) FILTER (occupancy > 50 AND speed < 40)"
MODERATE = "count(*) FILTER (occupancy > 30 AND speed < 60)"
TIES = "Road_EN NULLS FIRST, District NULLS FIRST"


def _group(source: str, keys: str, figures: str, tail: str = "", where: str = "") -> str:
    condition = f" WHERE {where}" if where else ""
    return _with(f"SELECT {keys}, {figures} FROM {source}{condition} GROUP BY ALL {tail}")


def _overall(column: str, percentiles: bool = True) -> str:
    figures = [
        _avg(column, "Mean"), f"quantile_disc({column}, 0.5) AS Median", _std(column, "Std_Dev"),
        f"min({column}) AS Min", f"max({column}) AS Max",
    ]
    if percentiles:
        figures += [f'quantile_disc({column}, 0.{p}) AS "{p}th_Percentile"' for p in (25, 75, 95)]
    return _with(f"SELECT {', '.join(figures)} FROM valid_obs")


def _road_top(order: str) -> str:
    figures = f"{FIVE}, count(DISTINCT detector_id) AS Num_Detectors"
    return _group("valid_obs", "Road_EN, District", figures, f"ORDER BY {order}, {TIES} LIMIT 20")


def _bins(column: str, rules, name: str) -> str:
    label = " ".join(f"WHEN {column} {s} {b} THEN '{t}'" for t, s, b in rules[:-1])
    order = " ".join(f"WHEN {column} {s} {b} THEN {i}" for i, (t, s, b) in enumerate(rules[:-1], 1))
    return (
        f"CASE {order} ELSE {len(rules)} END AS {name}_order, "
        f"CASE {label} ELSE '{rules[-1][0]}' END AS {name}"
    )


def _upper(sign: str, *pairs):
    return [(label, sign, bound) for label, bound in pairs]


VOLUME_BINS = [("0-Empty", "=", 0)] + _upper(
    "<=", ("1-5", 5), ("6-10", 10), ("11-20", 20), ("21-30", 30), ("31-40", 40), ("41-50", 50),
    ("51-75", 75), ("76-100", 100)) + [("100+", None, None)]
OCCUPANCY_BINS = _upper("<", *[(f"{b - 10}-{b}%", b) for b in range(10, 90, 10)]) + [("80%+", None, None)]
FINE_BINS = _upper(
    "<", *[(f"{b - 5}-{b}%", b) for b in range(5, 55, 5)], *[(f"{b - 10}-{b}%", b) for b in (60, 70, 80)]
) + [("80%+", None, None)]
DENSITY_BINS = _upper(
    "<", ("Low (<20%)", 20), ("Medium (20-40%)", 40), ("High (40-60%)", 60)) + [("Very High (60%+)", None, None)]
FLOW_BINS = _upper(
    "<=", ("Low (0-10)", 10), ("Medium (11-30)", 30), ("High (31-50)", 50)) + [("Very High (50+)", None, None)]


def _congestion(start: int, end: int) -> str:
    score = (
        "avg(occupancy) * 0.4::DOUBLE + (100 - avg(speed)) * 0.3::DOUBLE "
        f"+ ({SEVERE}::DOUBLE / count(*) * 100) * 0.3::DOUBLE"
    )
    figures = (
        f"{VOLUME}, {_avg('occupancy')}, {_avg('speed')}, {N} AS observation_count, "
        f"{SEVERE} AS severe_congestion_count, {MODERATE} AS moderate_congestion_count, "
        + _r(score, "congestion_score")
    )
    where = f"Road_EN IS NOT NULL AND hour(period_from) >= {start} AND hour(period_from) < {end}"
    return _group("valid_obs", "Road_EN, District", figures, f"ORDER BY {score} DESC, {TIES} LIMIT 10", where)


def _busy(start: int, end: int) -> str:
    where = f"Road_EN IS NOT NULL AND hour(period_from) >= {start} AND hour(period_from) < {end}"
    figures = f"{VOLUME}, CAST(sum(occupancy) AS BIGINT) AS total_occupancy"
    return _group("valid_obs", "Road_EN, District", figures, f"ORDER BY total_volume DESC, {TIES} LIMIT 10", where)


HIGH_OCCUPANCY = _with(
    f"SELECT Road_EN, District, {VOLUME}, "
    "round(sum(occupancy)::DOUBLE / nullif(sum(volume), 0) * 100, 6) AS avg_occupancy_pct "
    "FROM valid_obs WHERE Road_EN IS NOT NULL AND occupancy IS NOT NULL AND volume IS NOT NULL "
    "GROUP BY ALL HAVING sum(occupancy)::DOUBLE / nullif(sum(volume), 0) * 100 > 50 "
    f"ORDER BY sum(occupancy)::DOUBLE / nullif(sum(volume), 0) DESC, {TIES} LIMIT 20"
)

OBS_COLUMNS = (
    "detector_id direction lane_id occupancy speed volume standard_deviation valid period_from period_to "
    "date source_file District Road_EN GeometryEasting GeometryNorthing"
).split()
ROW = (
    "detector_id, direction, lane_id, occupancy, round(speed, 6) AS speed, volume, "
    "round(standard_deviation, 6) AS standard_deviation, valid, "
    "strftime(period_from, '%Y-%m-%d %H:%M:%S') AS period_from, "
    "strftime(period_to, '%Y-%m-%d %H:%M:%S') AS period_to, strftime(date, '%Y-%m-%d') AS date, source_file"
)
OBS_ROW = f"{ROW}, District, Road_EN, GeometryEasting, GeometryNorthing"


def _day(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d') AS {name}"


def _descriptive() -> dict[str, str]:
    day_names = "dayname(date) AS day_name"
    return {
        "validity_distribution": _with(
            "SELECT valid, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) "
            "AS percentage FROM obs GROUP BY valid"),
        "null_counts": _with(
            "SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in OBS_COLUMNS) + " FROM obs"),
        "temporal_coverage": _with(
            f"SELECT {_day('min(date)', 'Start_Date')}, {_day('max(date)', 'End_Date')}, "
            "count(DISTINCT date) AS Unique_Days FROM obs"),
        "spatial_coverage": _with(
            "SELECT count(DISTINCT detector_id) AS Unique_Detectors, count(DISTINCT District) AS Unique_Districts, "
            "count(DISTINCT Road_EN) AS Unique_Roads FROM obs"),
        "overall_speed": _overall("speed"),
        "overall_volume": _overall("volume"),
        "overall_occupancy": _overall("occupancy"),
        "overall_speed_sd": _overall("standard_deviation", percentiles=False),
        "district_stats": _group("valid_obs", "District", FIVE),
        "road_stats": _group(
            "valid_obs", "Road_EN, District", f"{FIVE}, count(DISTINCT detector_id) AS Num_Detectors"),
        "road_slowest20": _road_top("avg(speed)"),
        "road_busiest20": _road_top("sum(volume) DESC"),
        "road_fastest20": _road_top("avg(speed) DESC"),
        "lane_stats": _group("valid_obs", "lane_id", FIVE),
        "hourly_stats": _group("valid_obs", "CAST(hour(period_from) AS INT) AS hour", FIVE),
        "dow_stats": _group("valid_obs", f"CAST(dayofweek(date) + 1 AS INT) AS day_of_week, {day_names}", FIVE),
        "weekday_weekend": _group(
            "valid_obs", "CASE WHEN dayofweek(date) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS is_weekend",
            FIVE.rsplit(", ", 1)[0]),
        "direction_stats": _group("valid_obs", "direction", FIVE),
    }


def _quality() -> dict[str, str]:
    def gap(c):
        return (
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing_count, "
            f"round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 6) AS missing_pct FROM valid_obs"
        )

    gaps = " UNION ALL ".join(gap(c) for c in OBS_COLUMNS if c != "valid")
    report = ("Road_EN", "District", "volume", "occupancy", "period_from")
    clean_if = (
        "valid = 'Y' AND speed BETWEEN 0 AND 200 AND volume >= 0 AND occupancy BETWEEN 0 AND 100 "
        "AND Road_EN IS NOT NULL"
    )
    valid_n, clean_n = "count(*) FILTER (valid = 'Y')", f"count(*) FILTER ({clean_if})"
    return {
        "missing_report": _with(f"SELECT * FROM ({gaps}) WHERE missing_count > 0"),
        "outlier_report": _with(
            "SELECT count(*) FILTER (speed < 0 OR speed > 200) AS speed_outliers, "
            "count(*) FILTER (volume < 0) AS volume_outliers, "
            "count(*) FILTER (occupancy < 0 OR occupancy > 100) AS occupancy_outliers FROM valid_obs"),
        "clean_observations": _with(f"SELECT {OBS_ROW} FROM clean"),
        "cleaning_summary": _with(
            f"SELECT count(*) AS total_records, {valid_n} AS valid_records, {clean_n} AS clean_records, "
            f"{valid_n} - {clean_n} AS removed_records, "
            f"round(({valid_n} - {clean_n}) * 100.0::DOUBLE / {valid_n}, 6) AS removed_pct FROM obs"),
        "clean_coverage": _with(
            f"SELECT {_day('min(date)', 'min_date')}, {_day('max(date)', 'max_date')}, "
            "count(DISTINCT date) AS distinct_dates, count(DISTINCT detector_id) AS distinct_detectors, "
            "count(DISTINCT Road_EN) AS distinct_roads, count(DISTINCT District) AS distinct_districts FROM clean"),
        "overall_wide": _with(
            f"SELECT {_avg('speed')}, {_std('speed')}, min(speed) AS min_speed, max(speed) AS max_speed, "
            + ", ".join(f"quantile_disc(speed, 0.{p}) AS speed_p{p}" for p in (25, 50, 75, 95))
            + f", {_avg('volume')}, {_std('volume')}, {VOLUME}, min(volume) AS min_volume, "
            f"max(volume) AS max_volume, {_avg('occupancy')}, {_std('occupancy')}, "
            "min(occupancy) AS min_occupancy, max(occupancy) AS max_occupancy, "
            f"{_avg('standard_deviation', 'avg_speed_std')} FROM clean"),
        "district_statistics": _group("clean", "District", f"{N} AS record_count, {THREE}, {VOLUME}"),
        "lane_statistics_by_speed": _group("clean", "lane_id", f"{N} AS record_count, {THREE}"),
        "direction_statistics": _group("clean", "direction", f"{N} AS record_count, {THREE}, {VOLUME}"),
        "data_quality_report": _with(
            "SELECT count(*) AS total_records, "
            + ", ".join(
                f"count(*) FILTER ({c} IS NULL) AS null_{c}, "
                f"round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 6) AS null_{c}_pct"
                for c in report)
            + ", count(DISTINCT Road_EN) + max(CAST(Road_EN IS NULL AS BIGINT)) AS distinct_roads, "
            "count(DISTINCT District) + max(CAST(District IS NULL AS BIGINT)) AS distinct_districts FROM obs"),
        "fastest_roads_top10": _group(
            "obs", "Road_EN, District", _avg("speed"), f"ORDER BY avg(speed) DESC, {TIES} LIMIT 10",
            "Road_EN IS NOT NULL AND speed IS NOT NULL"),
        "district_counts": _group("obs", "District", "count(*) AS count", where="Road_EN IS NOT NULL"),
        "unmatched_detectors": _with(
            "SELECT DISTINCT detector_id FROM readings "
            "WHERE detector_id NOT IN (SELECT AID_ID_Number FROM locations)"),
        "ingest_statistics": _with(
            "SELECT count(*) AS total_records, count(DISTINCT detector_id) AS unique_detectors FROM obs"),
        "distinct_dates": _with(f"SELECT DISTINCT {_day('date', 'date')} FROM obs"),
        "distinct_lanes": _with("SELECT DISTINCT lane_id FROM obs"),
        "speed_by_detector_lane": _group("obs", "detector_id, lane_id", _avg("speed")),
        "volume_by_hour": _group("obs", "CAST(hour(period_from) AS INT) AS hour", VOLUME),
        "slowest_roads_by_name": _group(
            "obs", "Road_EN", _avg("speed"), "ORDER BY avg(speed), Road_EN NULLS FIRST LIMIT 10"),
        "busiest_roads_by_name": _group(
            "obs", "Road_EN", VOLUME, "ORDER BY total_volume DESC, Road_EN NULLS FIRST LIMIT 10"),
        "records_per_file": _with(
            "SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS total_records, "
            "round(avg(n), 6) AS avg_records_per_file, CAST(floor(count(*) * avg(n)) AS BIGINT) AS projected_records, "
            "round(CAST(floor(count(*) * avg(n)) AS BIGINT) * 200 / 1024 / 1024, 6) AS projected_mb "
            "FROM (SELECT source_file, count(*) AS n FROM obs GROUP BY source_file)"),
        "invalid_readings": _with(f"SELECT {OBS_ROW} FROM obs WHERE valid = 'N'"),
    }


def _temporal() -> dict[str, str]:
    profile = f"{THREE}, {N} AS record_count, {_std('speed')}"
    flow = f"{_avg('speed')}, {VOLUME}, {_avg('occupancy')}"
    peak = "ORDER BY avg(speed), hour LIMIT 1"
    month = "month, strftime(date, '%B') AS month_name"
    season = (
        "CASE WHEN month BETWEEN 3 AND 5 THEN 'Spring' WHEN month BETWEEN 6 AND 8 THEN 'Summer' "
        "WHEN month BETWEEN 9 AND 11 THEN 'Autumn' ELSE 'Winter' END AS season"
    )
    monthly = f"{THREE}, {VOLUME}, {N} AS record_count, {_std('speed')}"

    def trend(order, keys):
        return _with(
            f"SELECT arg_min(name, o) AS first_month, arg_max(name, o) AS last_month, "
            "round((arg_max(s, o) - arg_min(s, o)) / arg_min(s, o) * 100, 6) AS speed_change_pct, "
            "round((arg_max(v, o) - arg_min(v, o)) / arg_min(v, o) * 100, 6) AS volume_change_pct "
            "FROM m HAVING count(*) > 1",
            f"m AS (SELECT {order} AS o, strftime(min(date), '%B') AS name, avg(speed) AS s, "
            f"sum(volume)::DOUBLE AS v FROM long_obs GROUP BY {keys})")

    return {
        "hourly_profile": _group("clean", "hour", profile),
        "morning_peak_hour": _group("clean", "hour", profile, peak, "hour BETWEEN 6 AND 10"),
        "evening_peak_hour": _group("clean", "hour", profile, peak, "hour BETWEEN 17 AND 21"),
        "hourly_direction_profile": _group("clean", "hour, direction", flow),
        "hourly_lane_profile": _group("clean", "hour, lane_id", flow),
        "daily_statistics": _group(
            "clean", "dow AS day_of_week, dayname(date) AS day_name", f"{THREE}, {VOLUME}, {N} AS record_count"),
        "weekday_weekend_comparison": _group("clean", "is_weekend", f"{THREE}, {VOLUME}, {_std('speed')}"),
        "hourly_weekday_weekend": _group("clean", "hour, is_weekend", THREE),
        "monday_effect": _group(
            "clean", "CASE WHEN dow = 2 THEN 'Monday' ELSE 'Other Weekdays' END AS is_monday", THREE,
            where="is_weekend = 'Weekday'"),
        "friday_evening": _group("clean", "hour", THREE, where="dow = 6 AND hour BETWEEN 17 AND 21"),
        "monthly_statistics": _group("long_obs", month, monthly),
        "monthly_statistics_by_year": _group("long_obs", f"year, {month}", monthly),
        "seasonal_statistics": _group("long_obs", season, f"{THREE}, {VOLUME}"),
        "month_trend": trend("month", "month"),
        "month_trend_chronological": trend("year * 12 + month", "year, month"),
        "morning_rush_weekend": _group(
            "clean", "is_weekend", f"{THREE}, {N} AS record_count", where="hour >= 6 AND hour < 10"),
        "evening_rush_weekend": _group(
            "clean", "is_weekend", f"{THREE}, {N} AS record_count", where="hour >= 17 AND hour < 21"),
        "morning_rush_top10_congested": _group(
            "clean", "Road_EN, District",
            f"{_avg('speed')}, {_avg('occupancy')}, {VOLUME}, {_r(INDEX, 'congestion_score')}",
            f"ORDER BY {INDEX} DESC, {TIES} LIMIT 10", "hour >= 6 AND hour < 10 AND is_weekend = 'Weekday'"),
    }


def _spatial() -> dict[str, str]:
    ranking = (
        f"{_avg('speed')}, {_avg('occupancy')}, {VOLUME}, {N} AS observation_count, "
        f"{SEVERE} AS severe_congestion_events, {_r(INDEX, 'congestion_index')}"
    )
    usage = f"{_avg('speed')}, {VOLUME}, {_avg('occupancy')}, {N} AS record_count"
    jams = "count(*) FILTER (regime_a = 'Wide Moving Jam')"
    cv = "stddev_samp(speed) / avg(speed)"
    return {
        "top10_slowest_roads": _group(
            "clean", "Road_EN, District", f"{THREE}, {N} AS observation_count",
            f"ORDER BY avg(speed), {TIES} LIMIT 10"),
        "top10_busiest_roads": _group(
            "clean", "Road_EN, District",
            f"{VOLUME}, {_avg('speed')}, {_avg('occupancy')}, {N} AS observation_count",
            f"ORDER BY total_volume DESC, {TIES} LIMIT 10"),
        "top10_most_congested_roads": _group(
            "clean", "Road_EN, District", ranking, f"ORDER BY {INDEX} DESC, {TIES} LIMIT 10"),
        "district_rankings": _group("clean", "District", ranking),
        "lane_speed": _group(
            "clean", "lane_id",
            f"{_avg('speed')}, {_std('speed')}, min(speed) AS min_speed, max(speed) AS max_speed, {N} AS record_count"),
        "lane_volume": _group("clean", "lane_id", f"{VOLUME}, {_avg('volume')}, {N} AS record_count"),
        "lane_occupancy": _group(
            "clean", "lane_id", f"{_avg('occupancy')}, {_std('occupancy')}, {N} AS record_count"),
        "lane_statistics": _group("clean", "lane_id", usage),
        "peak_lane_stats": _group(
            "clean", "lane_id",
            f"{_avg('speed', 'avg_speed_peak')}, {_avg('occupancy', 'avg_occupancy_peak')}, {N} AS record_count",
            where="(hour >= 6 AND hour < 10) OR (hour >= 17 AND hour < 21)"),
        "morning_direction": _group("clean", "direction", usage, where="hour >= 6 AND hour < 10"),
        "evening_direction": _group("clean", "direction", usage, where="hour >= 17 AND hour < 21"),
        "road_direction_comparison": _group(
            "clean", "Road_EN, direction", f"{_avg('speed')}, {_avg('occupancy')}, {N} AS observation_count",
            "HAVING count(*) > 100"),
        "morning_district_flow": _group(
            "clean", "District, direction", f"{VOLUME}, {_avg('speed')}", where="hour >= 6 AND hour < 10"),
        "traffic_regime_distribution": _with(
            f"SELECT regime_a AS traffic_regime, {N} AS record_count, {_avg('speed')}, {_avg('occupancy')}, "
            "round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM clean GROUP BY regime_a"),
        "road_congestion_severity": _group(
            "clean", "Road_EN, District",
            f"{N} AS total_observations, count(*) FILTER (regime_a = 'Free Flow') AS free_flow_count, "
            "count(*) FILTER (regime_a = 'Synchronized Flow') AS synch_flow_count, "
            f"{jams} AS jam_count, {_avg('speed')}, {_avg('occupancy')}, "
            f"round({jams}::DOUBLE / count(*) * 100, 6) AS congestion_rate",
            f"ORDER BY {jams}::DOUBLE / count(*) DESC, {TIES} LIMIT 20"),
        "speed_variability": _group(
            "clean", "Road_EN, District",
            f"{_avg('speed')}, {_std('speed')}, {N} AS observation_count, "
            + _r(cv, "coefficient_of_variation"),
            f"HAVING count(*) > 100 ORDER BY {cv} DESC, {TIES} LIMIT 20"),
        "geospatial_data": _group(
            "clean", "detector_id, Road_EN, District, GeometryEasting, GeometryNorthing",
            f"{_avg('speed')}, {_avg('occupancy')}, {VOLUME}, {N} AS observation_count, "
            + _r(INDEX, "congestion_index")),
    }


def _flow() -> dict[str, str]:
    speed_volume = f"{N} AS record_count, {_avg('speed')}, {_std('speed')}, "
    capacity = f"{_avg('volume')}, max(volume) AS max_volume, quantile_disc(volume, 0.95) AS volume_95th, "
    return {
        "speed_volume_relationship": _group(
            "clean", _bins("volume", VOLUME_BINS, "volume_bin"), speed_volume + _avg("occupancy")),
        "correlations": _with(
            f"SELECT {_r('corr(speed, volume)', 'speed_volume_corr')}, "
            f"{_r('corr(speed, occupancy)', 'speed_occupancy_corr')}, "
            f"{_r('corr(volume, occupancy)', 'volume_occupancy_corr')} FROM clean"),
        "volume_occupancy_relationship": _group(
            "clean", _bins("occupancy", OCCUPANCY_BINS, "occupancy_bin"),
            f"{N} AS record_count, {_avg('volume')}, {_avg('speed')}, {_std('volume')}"),
        "speed_occupancy_relationship": _group(
            "clean", _bins("occupancy", FINE_BINS, "occupancy_bin"), speed_volume + _avg("volume")),
        "fundamental_diagram": _group(
            "clean", _bins("occupancy", DENSITY_BINS, "density_bin") + ", " + _bins("volume", FLOW_BINS, "flow_bin"),
            f"{N} AS record_count, {THREE}"),
        "road_capacity_estimates": _group(
            "clean", "Road_EN, District, lane_id", f"{capacity}{N} AS observation_count, {_avg('speed')}",
            f"HAVING count(*) > 100 ORDER BY max_volume DESC, {TIES}, lane_id LIMIT 20"),
        "lane_capacity_estimates": _group(
            "clean", "lane_id",
            f"{capacity}quantile_disc(volume, 0.90) AS volume_90th, {N} AS observation_count"),
        "scatter_sample": _with(
            "SELECT volume, occupancy, speed FROM clean WHERE CAST('0x' || substr(md5(concat_ws('|', detector_id::VARCHAR, "
            "lane_id, occupancy::VARCHAR, volume::VARCHAR)), 1, 8) AS BIGINT) % 10000 < 1000"),
        "flow_regime_stats": _group(
            "clean", "regime_b AS flow_regime", f"{N} AS record_count, "
            + ", ".join(f"{_avg(c)}, {_std(c)}" for c in ("speed", "volume", "occupancy"))),
        "lane_flow_regimes": _group("clean", "lane_id, regime_b AS flow_regime", f"{N} AS record_count"),
        "hourly_flow_regimes": _group("clean", "hour, regime_b AS flow_regime", f"{N} AS record_count"),
    }


def _rush() -> dict[str, str]:
    forms = {
        "busy_roads_morning": _busy(6, 10),
        "busy_roads_evening": _busy(17, 21),
        "congestion_morning": _congestion(6, 10),
        "congestion_evening": _congestion(17, 21),
        "high_occupancy_roads": HIGH_OCCUPANCY,
    }
    return forms | {f"{name}_sql": text for name, text in forms.items()}


LANES = """
doc_periods AS (SELECT *, 0 AS p FROM events UNION ALL SELECT *, 1 AS p FROM events WHERE event_id % 5 = 0),
doc_detectors AS (SELECT *, 0 AS d FROM doc_periods
                  UNION ALL SELECT *, 1 AS d FROM doc_periods WHERE event_id % 4 = 0),
doc_lanes AS (SELECT *, 'Fast Lane' AS lane_id FROM doc_detectors
              UNION ALL SELECT *, 'Slow Lane' AS lane_id FROM doc_detectors WHERE d = 0 AND event_id % 3 = 0),
k AS (SELECT *, json_extract_string(props, '$.k') AS k, strftime(ts, '%Y-%m-%d') AS day,
             strftime(ts + p * INTERVAL 30 SECOND, '%H:%M:%S') AS time_from,
             strftime(ts + p * INTERVAL 30 SECOND + INTERVAL 30 SECOND, '%H:%M:%S') AS time_to,
             concat('AID', lpad(CAST(user_id + 1000 * d AS VARCHAR), 5, '0')) AS detector_id FROM doc_lanes),
flat AS (SELECT detector_id, event_type AS direction, lane_id, CAST(k AS INT) AS occupancy,
                CASE WHEN lane_id = 'Fast Lane' THEN CAST(floor(value) AS INT)
                     WHEN event_id % 9 <> 0 THEN CAST(k AS INT) END AS speed,
                CAST(event_id % 131 AS INT) AS volume,
                (event_id % 17) * CAST(0.5 AS DOUBLE) AS standard_deviation,
                CASE WHEN event_id % 67 = 0 THEN 'N' ELSE 'Y' END AS valid,
                day || ' ' || time_from AS period_from, day || ' ' || time_to AS period_to, day AS date FROM k),
places AS (SELECT concat('AID', lpad(CAST(s_suppkey AS VARCHAR), 5, '0')) AS AID_ID_Number,
                  concat('Road ', CAST(s_nationkey AS VARCHAR)) AS Road_EN,
                  CASE WHEN s_nationkey % 2 = 0 THEN 'Central and Western' ELSE 'Southern' END AS District
           FROM supplier)
"""


def _lanes(body: str) -> str:
    return f"WITH {LANES}\n{body}"


def _ingest() -> dict[str, str]:
    located = _lanes("SELECT flat.*, District, Road_EN FROM flat LEFT JOIN places ON detector_id = AID_ID_Number")
    times = "day AS date, time_from AS period_from, time_to AS period_to"
    return {
        "exploded_periods": _lanes(f"SELECT {times} FROM k WHERE d = 0 AND lane_id = 'Fast Lane'"),
        "exploded_detectors": _lanes(
            f"SELECT {times}, detector_id, event_type AS direction FROM k WHERE lane_id = 'Fast Lane'"),
        "flatten_readings": _lanes("SELECT * FROM flat"),
        "fanout_counts": _lanes(
            "SELECT (SELECT count(*) FROM events) AS documents, (SELECT count(*) FROM doc_periods) AS periods, "
            "(SELECT count(*) FROM doc_detectors) AS detectors, (SELECT count(*) FROM doc_lanes) AS lanes"),
        "xml_readings": _lanes("SELECT * FROM flat"),
        "xml_split_readings": _lanes("SELECT * FROM flat"),
        "xml_period_rows": _lanes(
            "SELECT time_from AS period_from, time_to AS period_to, detector_id, event_type AS direction, lane_id, "
            "CASE WHEN lane_id = 'Fast Lane' THEN CAST(CAST(floor(value) AS INT) AS VARCHAR) "
            "WHEN event_id % 9 = 0 THEN 'abc' ELSE k END AS speed FROM k"),
        "locations_csv": _lanes("SELECT AID_ID_Number, Road_EN, District, NULL::DOUBLE AS Rotation FROM places"),
        "located_readings": located,
        "streamed_readings": located,
        "ingested_folder": _lanes("SELECT count(*) AS good_rows, true AS has_files, 2::BIGINT AS quarantined FROM flat"),
        "two_stream_ingest": f"{located} CROSS JOIN (VALUES (1), (2)) twice(n)",
        "located_observations": _with(f"SELECT {OBS_ROW} FROM obs"),
    }


def _storage() -> dict[str, str]:
    key = "concat_ws('|', detector_id::VARCHAR, lane_id, occupancy::VARCHAR, volume::VARCHAR)"
    descriptive = _descriptive()
    k = "json_extract_string(props, '$.k')"
    return {
        "csv_good_rows": (
            f"SELECT event_id, event_type, CAST({k} AS INT) AS occupancy FROM events WHERE event_id % 101 <> 0"),
        "csv_quarantine": (
            "SELECT concat(event_id::VARCHAR, ',', event_type, ',many') AS line FROM events "
            "WHERE event_id % 101 = 0"),
        "text_line_count": "SELECT count(*) AS lines FROM events",
        "parquet_by_month": (
            "SELECT l_suppkey AS detector_id, l_returnflag AS lane_id, "
            "CAST((l_partkey * 7 + l_linenumber) % 121 AS INT) AS speed, CAST(l_quantity AS INT) AS volume, "
            f"{_day('l_shipdate', 'date')}, CAST(hour(l_shipdate) AS INT) AS hour, "
            "strftime(l_shipdate, '%Y%m') AS month FROM lineitem WHERE year(l_shipdate) = 1996"),
        "csv_by_date": _with(
            f"SELECT detector_id, lane_id, occupancy, speed, volume, {_day('date', 'date')} FROM readings"),
        "month_boundary_ingest": (
            "SELECT l_suppkey AS detector_id, l_returnflag AS lane_id, "
            "CAST((l_partkey * 7 + l_linenumber) % 121 AS INT) AS speed, CAST(l_quantity AS INT) AS volume, "
            "CASE WHEN l_suppkey % 7 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS date, "
            "CAST(hour(l_shipdate) AS INT) AS hour FROM lineitem"),
        "date_boundary_ingest": _with(
            f"SELECT detector_id, lane_id, speed, volume, {_day('date', 'date')}, source_file FROM readings"),
        "compacted_by_date": _with(f"SELECT {ROW} FROM readings"),
        "exported_summary": descriptive["district_stats"],
        "stored_lane_stats": descriptive["lane_stats"],
        "readings_in_period": _with(
            f"SELECT {ROW} FROM readings WHERE period_from >= TIMESTAMP '2024-01-10 06:00:00' "
            "AND period_to <= TIMESTAMP '2024-01-12 18:00:00'"),
        "dataset_rows": "SELECT count(*) AS total_records, true AS has_bytes FROM lineitem",
        "key_sample": _with(
            f"SELECT {ROW} FROM readings WHERE CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % 10000 < 1000"),
    }


TIMING_ROWS = """
timings AS (
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, concat(CAST(user_id % 4 + 1 AS VARCHAR), '_month') AS dataset_size,
         user_id * 1000 AS data_size_bytes, event_id AS total_records, event_type AS tool,
         CASE event_id % 6 WHEN 0 THEN 'Initialize' WHEN 1 THEN 'Read Data' WHEN 2 THEN 'Clean Data'
              WHEN 3 THEN 'Execute Analysis' WHEN 4 THEN 'Cleanup' ELSE 'Total Execution' END AS phase,
         floor(value * 4) / 4 AS duration_seconds, event_id % 1000 AS records_processed,
         CASE WHEN event_id % 97 = 0 THEN 'FAILED: lost task' ELSE 'done' END AS details
  FROM events),
totals AS (SELECT * FROM timings WHERE phase = 'Total Execution')
"""


def _timings() -> dict[str, str]:
    def over(body):
        return f"WITH {TIMING_ROWS}\n{body}"

    mean = _avg("duration_seconds", "avg_seconds")
    everything = over("SELECT * FROM timings")
    tools = ("click", "error", "purchase", "signup", "view")
    pivot = ", ".join(f"round(avg(duration_seconds) FILTER (tool = '{t}'), 6) AS {t}" for t in tools)
    return {
        "timing_average_by_tool": over(f"SELECT tool, {mean} FROM totals GROUP BY tool"),
        "timing_average_by_phase": over(
            f"SELECT tool, phase, {mean} FROM timings WHERE phase <> 'Total Execution' GROUP BY ALL"),
        "timing_recent_totals": over(
            "SELECT timestamp, tool, duration_seconds FROM totals "
            "WHERE CAST(timestamp AS DATE) >= DATE '2024-01-31' - INTERVAL 7 DAY"),
        "timing_dataset_by_tool": over(f"SELECT dataset_size, {pivot} FROM totals GROUP BY dataset_size"),
        "timing_phase_share": over(
            "SELECT t.*, total_seconds, round(duration_seconds / total_seconds * 100, 6) AS percentage FROM "
            "(SELECT dataset_size, tool, phase, sum(duration_seconds) AS duration_seconds FROM timings "
            "WHERE phase <> 'Total Execution' GROUP BY ALL) t LEFT JOIN "
            "(SELECT dataset_size, tool, sum(duration_seconds) AS total_seconds FROM totals GROUP BY ALL) "
            "USING (dataset_size, tool)"),
        "timing_speedup": over(
            "SELECT dataset_size, tool, round(s, 6) AS avg_seconds, "
            "first(tool) OVER w AS fastest_tool, round(s / first(s) OVER w, 6) AS times_fastest "
            "FROM (SELECT dataset_size, tool, avg(duration_seconds) AS s FROM totals GROUP BY ALL) "
            "WINDOW w AS (PARTITION BY dataset_size ORDER BY s, tool "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
        "timing_failed_runs": over(
            "SELECT tool, dataset_size, details FROM timings WHERE contains(details, 'FAILED')"),
        "timing_run_phases": over(
            "SELECT phase, duration_seconds, details FROM timings WHERE tool = 'view' "
            "AND dataset_size = '2_month' AND phase <> 'Total Execution'"),
        "timing_parquet": everything,
        "timing_csv": everything,
    }


def _rollup() -> dict[str, str]:
    keys = (
        f"{_day('date', 'date')}, hour, detector_id, direction, lane_id, Road_EN, District, "
        "GeometryEasting, GeometryNorthing"
    )
    figures = ["count(*) AS n_rows"]
    for c in ("speed", "volume", "occupancy"):
        total = f"sum({c})" if c == "speed" else f"CAST(sum({c}) AS BIGINT)"
        figures += [
            f"count({c}) AS {c}_n", f"{total} AS {c}_sum", _r(f"var_pop({c}) * count({c})", f"{c}_m2"),
            f"min({c}) AS {c}_min", f"max({c}) AS {c}_max",
        ]
    figures += [
        f"{SEVERE} AS severe_n", f"{MODERATE} AS moderate_n",
        "count(*) FILTER (regime_a = 'Free Flow') AS free_flow_n",
        "count(*) FILTER (regime_a = 'Synchronized Flow') AS synchronized_n",
        "count(*) FILTER (regime_a = 'Wide Moving Jam') AS jam_n",
    ]
    base = _temporal() | _spatial() | _flow() | _descriptive() | _rush() | _quality()
    same = (
        "district_stats", "road_stats", "road_slowest20", "road_busiest20", "road_fastest20", "lane_stats", "hourly_stats",
        "dow_stats", "weekday_weekend", "direction_stats", "busy_roads_morning", "busy_roads_evening",
        "congestion_morning", "congestion_evening",
        "hourly_profile", "weekday_weekend_comparison", "road_congestion_severity", "lane_speed",
        "top10_most_congested_roads", "geospatial_data", "flow_regime_stats", "fundamental_diagram",
        "traffic_regime_distribution",
    )
    cells = "hour, lane_id, volume_cell, occupancy_cell, regime_a AS traffic_regime, regime_b AS flow_regime"
    source = (
        f"(SELECT *, {_bins('volume', VOLUME_BINS, 'v')}, {_bins('occupancy', FINE_BINS, 'o')} FROM clean)"
    )
    by_flow = _group(
        source, cells.replace("volume_cell", "v_order AS volume_cell").replace(
            "occupancy_cell", "o_order AS occupancy_cell"), ", ".join(figures))
    rollup = _group("clean", keys, ", ".join(figures))
    return {"hourly_rollup": rollup, "located_rollup": rollup, "flow_rollup": by_flow} | {
        f"{name}_from_rollup": base[name] for name in same
    } | {  # distinct counts; percentiles from sketches have a rank error and no SQL twin
        f"{name}_from_sketches": base[name] for name in ("road_stats", "spatial_coverage", "clean_coverage")
    }


HOURS = (
    "hours AS (SELECT detector_id, date, hour, avg(speed) AS s, avg(occupancy) AS o, date_diff('day', DATE '1970-01-01', date) * 24 "
    "+ hour AS clock FROM clean GROUP BY ALL)"
)


ROAD_HOURS = (
    "road_hours AS (SELECT Road_EN, District, date_diff('day', DATE '1970-01-01', date) * 24 + hour AS at, avg(speed) AS s "
    "FROM clean WHERE Road_EN IS NOT NULL AND District IS NOT NULL AND speed IS NOT NULL GROUP BY ALL)"
)


def _outlook() -> dict[str, str]:
    day = _day("date", "date")
    road = "Road_EN, District"
    heat = ", ".join(f"round(avg(speed) FILTER (dow = {d}), 6) AS dow_{d}" for d in range(1, 8))
    profile = ", ".join(
        f"round(coalesce(max(s) FILTER (hour = {h}), avg(s)), 6) AS h{h}" for h in range(24))
    clock = "OVER (PARTITION BY detector_id ORDER BY clock RANGE BETWEEN {} PRECEDING AND {} PRECEDING)"
    back = lambda a, b, name: f"round(avg(s) {clock.format(a, b)}, 6) AS {name}"
    return {
        "hour_dow_heatmap": _with(
            f"SELECT hour, {heat} FROM (SELECT *, CAST(dayofweek(date) + 1 AS INT) AS d2 FROM clean) GROUP BY hour"),
        "volume_rollups": _with(
            f"SELECT month, {day}, CAST(sum(v) AS BIGINT) AS total_volume, round(avg(v), 6) AS avg_hourly_volume "
            "FROM (SELECT strftime(date, '%Y-%m') AS month, date, hour, sum(volume) AS v FROM clean GROUP BY ALL) "
            "GROUP BY ROLLUP (month, date)"),
        "regime_share": _with(
            f"SELECT {road}, regime_a AS traffic_regime, count(*) AS record_count, "
            f"round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY {road}), 6) AS share_pct FROM clean GROUP BY {road}, regime_a"),
        "sd_speed_relation": _with(
            "SELECT round(corr(standard_deviation, speed), 6) AS sd_speed_corr, "
            "round(avg(standard_deviation / nullif(speed, 0)), 6) AS avg_cv FROM clean"),
        "congestion_index_banded": _with(
            f"SELECT {road}, round(i, 6) AS congestion_index, CASE WHEN i < 25 THEN 'Low' WHEN i < 50 THEN 'Moderate' "
            "WHEN i < 75 THEN 'High' WHEN i IS NOT NULL THEN 'Severe' END AS band FROM ("
            "SELECT *, (100 - percent_rank() OVER (ORDER BY s) * 100) * 0.4 + percent_rank() OVER (ORDER BY o) * 100 * 0.4 "
            f"+ sd / nullif(s, 0) * 100 * 0.2 AS i FROM (SELECT {road}, avg(speed) AS s, avg(occupancy) AS o, "
            "stddev_samp(speed) AS sd FROM clean GROUP BY ALL))"),
        "congestion_episodes": _with(
            f"SELECT detector_id, lane_id, strftime(start, '%Y-%m-%d') AS date, "
            "row_number() OVER (PARTITION BY detector_id, lane_id, CAST(start AS DATE) ORDER BY start) AS episode, "
            "strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(stop, '%Y-%m-%d %H:%M:%S') AS stop, readings FROM ("
            "SELECT detector_id, lane_id, run, min(period_from) AS start, max(period_to) AS stop, count(*) AS readings FROM ("
            "SELECT *, sum(CAST(first AS INT)) OVER lane AS run FROM ("
            "SELECT *, on_ AND (NOT coalesce(lag(on_) OVER lane, false) "
            "OR epoch(period_from)::BIGINT - lag(epoch(period_from)::BIGINT) OVER lane > 3600) AS first "
            "FROM (SELECT *, occupancy > 30 AND speed < 60 AS on_ FROM clean) "
            "WINDOW lane AS (PARTITION BY detector_id, lane_id ORDER BY period_from, period_to, on_)) "
            "WINDOW lane AS (PARTITION BY detector_id, lane_id ORDER BY period_from, period_to, on_)) "
            "WHERE on_ GROUP BY detector_id, lane_id, run)"),
        "delay_cost": _with(
            f"SELECT {road}, round(h, 3) AS delay_hours, round(h * 100, 3) AS delay_cost FROM (SELECT {road}, "
            "sum(greatest((60 - speed) / 60::DOUBLE, 0) * (30 / 3600::DOUBLE) * volume) AS h FROM clean GROUP BY ALL)"),
        "threshold_incidents": _with(
            f"SELECT detector_id, {day}, hour, slow, full_ AS \"full\" FROM (SELECT *, "
            "s < 0.5 * avg(s) OVER (PARTITION BY detector_id, hour) AS slow, "
            "o > 1.5 * avg(o) OVER (PARTITION BY detector_id, hour) AS full_ FROM hours) WHERE slow OR full_", HOURS),
        "calendar_lag_features": _with(
            f"SELECT detector_id, {day}, hour, round(s, 6) AS avg_speed, {back(1, 1, 'speed_1h')}, {back(2, 2, 'speed_2h')}, "
            f"{back(24, 24, 'speed_24h')}, {back(168, 1, 'speed_7d')}, "
            "round(avg(s) OVER (PARTITION BY detector_id, hour, dayofweek(date)), 6) AS speed_alike, "
            "CAST(dayofweek(date) + 1 AS INT) AS dow, dayofweek(date) IN (0, 6) AS is_weekend FROM hours", HOURS),
        "next_period_label": _with(
            f"SELECT detector_id, {day}, hour, round(s, 6) AS avg_speed, avg(s) OVER (PARTITION BY detector_id ORDER BY clock "
            "RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) < 40 AS next_congested FROM hours", HOURS),
        "road_profiles": _with(
            f"SELECT {road}, {profile} FROM (SELECT {road}, hour, avg(speed) AS s FROM clean GROUP BY ALL) GROUP BY ALL"),
        "month_growth": _with(
            "SELECT month, CAST(v AS BIGINT) AS total_volume, round(s, 6) AS avg_speed, "
            "round((v - lag(v) OVER m) * 100.0::DOUBLE / lag(v) OVER m, 6) AS volume_growth_pct, "
            "round((s - lag(s) OVER m) * 100.0::DOUBLE / lag(s) OVER m, 6) AS speed_growth_pct FROM ("
            "SELECT strftime(date, '%Y-%m') AS month, sum(volume) AS v, avg(speed) AS s FROM long_obs GROUP BY ALL) "
            "WINDOW m AS (ORDER BY month)"),
        "missing_days": _with(
            "SELECT strftime(d, '%Y-%m-%d') AS date FROM (SELECT CAST(unnest(generate_series(min(date), max(date), "
            "INTERVAL 1 DAY)) AS DATE) AS d FROM long_obs) WHERE d NOT IN (SELECT date FROM long_obs)"),
        "coverage_gaps": _with(
            "SELECT * FROM (SELECT detector_id, count(DISTINCT date) AS days_seen, "
            "(SELECT count(DISTINCT date) FROM obs) - count(DISTINCT date) AS days_missing FROM obs GROUP BY ALL) "
            "WHERE days_missing > 0"),
        "holiday_effect": _with(
            "SELECT CASE WHEN date IN (SELECT date FROM off) THEN 'holiday' WHEN date + 1 IN (SELECT date FROM off) "
            "OR date - 1 IN (SELECT date FROM off) THEN 'next to one' ELSE 'normal' END AS day_kind, "
            f"{_avg('speed')}, {VOLUME}, {N} AS record_count FROM clean GROUP BY ALL",
            "off AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE dayofyear(CAST(ts AS DATE)) % 10 = 0)"),
        "detector_congestion_index": _with(
            "SELECT detector_id, round(i, 6) AS congestion_index, CASE WHEN i < 25 THEN 'Low' WHEN i < 50 THEN 'Moderate' "
            "WHEN i < 75 THEN 'High' WHEN i IS NOT NULL THEN 'Severe' END AS band FROM ("
            "SELECT *, (100 - percent_rank() OVER (ORDER BY s) * 100) * 0.4 + percent_rank() OVER (ORDER BY o) * 100 * 0.4 "
            "+ sd / nullif(s, 0) * 100 * 0.2 AS i FROM (SELECT detector_id, avg(speed) AS s, avg(occupancy) AS o, "
            "stddev_samp(speed) AS sd FROM clean GROUP BY ALL))"),
        "delay_against_own_speed": _with(
            f"SELECT {road}, round(h, 3) AS delay_hours, round(h * 100, 3) AS delay_cost, round(free, 6) AS free_speed FROM ("
            f"SELECT {road}, free, sum(greatest((free - speed) / free, 0) * (30 / 3600::DOUBLE) * volume) AS h FROM ("
            f"SELECT *, quantile_disc(speed, 0.85) OVER (PARTITION BY {road}) AS free FROM clean) GROUP BY ALL)"),
        "road_speed_correlation": _with(
            "SELECT Road_EN, District, partner_Road_EN, partner_District, CAST(place AS INT) AS place, "
            "round(c, 6) AS correlation, n AS hours FROM (SELECT *, row_number() OVER (PARTITION BY Road_EN, District "
            "ORDER BY c DESC, partner_Road_EN, partner_District) AS place FROM ("
            "SELECT a.Road_EN, a.District, b.Road_EN AS partner_Road_EN, b.District AS partner_District, "
            "corr(a.s, b.s) AS c, count(*) AS n FROM road_hours a JOIN road_hours b ON a.at = b.at "
            "AND (a.Road_EN, a.District) <> (b.Road_EN, b.District) GROUP BY ALL HAVING count(*) >= 24)) WHERE place <= 10",
            ROAD_HOURS),
        "shifted_correlation": _with(
            "SELECT Road_EN, District, follower_Road_EN, follower_District, CAST(place AS INT) AS place, "
            "lag AS lag_hours, round(c, 6) AS correlation, n AS hours FROM (SELECT *, row_number() OVER (PARTITION BY "
            "Road_EN, District ORDER BY c DESC, follower_Road_EN, follower_District) AS place FROM (SELECT * FROM ("
            "SELECT a.Road_EN, a.District, b.Road_EN AS follower_Road_EN, b.District AS follower_District, lag, "
            "corr(a.s, b.s) AS c, count(*) AS n FROM road_hours a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS lag) "
            "JOIN road_hours b ON a.at + lag = b.at AND (a.Road_EN, a.District) <> (b.Road_EN, b.District) "
            "GROUP BY ALL HAVING count(*) >= 24) QUALIFY row_number() OVER (PARTITION BY Road_EN, District, "
            "follower_Road_EN, follower_District ORDER BY c DESC, lag) = 1)) WHERE place <= 10",
            ROAD_HOURS),
        "forecast_rows": _with(
            f"SELECT detector_id, {day}, hour, clock AS \"at\", round(s, 6) AS avg_speed, "
            "round(coalesce(avg(s) OVER (PARTITION BY detector_id ORDER BY clock RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), s), 6) AS speed_1h, "
            "round(coalesce(avg(s) OVER (PARTITION BY detector_id ORDER BY clock RANGE BETWEEN 24 PRECEDING AND 24 PRECEDING), s), 6) AS speed_24h, "
            "round(coalesce(avg(s) OVER (PARTITION BY detector_id ORDER BY clock RANGE BETWEEN 168 PRECEDING AND 1 PRECEDING), s), 6) AS speed_7d, "
            "round(coalesce(avg(f) OVER (PARTITION BY detector_id, clock % 168 ORDER BY clock RANGE BETWEEN UNBOUNDED PRECEDING "
            "AND 1 PRECEDING), s), 6) AS speed_alike, round(coalesce(o, 0), 6) AS avg_occupancy, "
            "round(sin(hour * pi() / 12), 6) AS hour_sin, round(cos(hour * pi() / 12), 6) AS hour_cos, "
            "CAST(dayofweek(date) IN (0, 6) AS INT) AS is_weekend, f < 40 AS next_congested FROM ("
            "SELECT *, avg(s) OVER (PARTITION BY detector_id ORDER BY clock RANGE BETWEEN 1 FOLLOWING AND "
            "1 FOLLOWING) AS f FROM hours WHERE s IS NOT NULL)", HOURS),
        "streamed_windows": _with(
            "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, detector_id, "
            f"{N} AS record_count, {_avg('speed')}, {SEVERE} AS severe_count FROM ("
            "SELECT a.*, time_bucket(INTERVAL 5 MINUTE, period_from) AS w, seen FROM arrivals a LEFT JOIN marks m ON a.part = m.part) "
            "WHERE (seen IS NULL OR w + INTERVAL 5 MINUTE > seen - INTERVAL 10 MINUTE) "
            "AND w + INTERVAL 5 MINUTE <= (SELECT max(period_from) - INTERVAL 10 MINUTE FROM arrivals) GROUP BY w, detector_id",
            "arrivals AS (SELECT *, least((day(period_from) - 1) // 10, 2) + CASE CAST(floor(epoch(period_from)) AS BIGINT) % 20 WHEN 0 THEN 2 "
            "WHEN 10 THEN 1 ELSE 0 END AS part FROM readings), "
            "marks AS (SELECT p.part, (SELECT max(period_from) FROM arrivals b WHERE b.part < p.part) AS seen "
            "FROM (SELECT DISTINCT part FROM arrivals) p)"),
        "streamed_congestion": _with(
            "SELECT strftime(time_bucket(INTERVAL 5 MINUTE, period_from), '%Y-%m-%d %H:%M:%S') AS window_start, detector_id, "
            f"{N} AS record_count, {_avg('speed')}, {SEVERE} AS severe_count FROM readings GROUP BY ALL"),
    }


def oracle_sql() -> dict[str, str]:
    return (
        _descriptive() | _quality() | _temporal() | _spatial() | _flow() | _rush() | _ingest() | _storage()
        | _timings() | _rollup() | _outlook()
    )
