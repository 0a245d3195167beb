"""Every registered query, run on the traffic-shaped views of the test tables."""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanepulse.functions import columns as C
from lanepulse.functions import fixed_values as V
from lanepulse.operators import (
    descriptive, flow, forecast, ingest, network, outlook, quality, rush, sampling, spatial, temporal, timings,
)
from lanepulse.plans.ingest_folder import ingest_folder
from lanepulse.plans.rollup import flow_rollup, hourly_rollup, located_rollup
from lanepulse.plans.sketches import sketch_rollup
from lanepulse.plans.suite import FROM_FLOW_ROLLUP, FROM_ROLLUP, FROM_VALID_ROLLUP
from lanepulse.sinks import tables as sinks
from lanepulse.sources import shared, xml
from lanepulse.sources import tables as sources
from lanepulse.streaming import live
from lanepulse.streaming.ingest import ingest_new_files
from lanepulse.testbed import documents, tables

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Comparable output: rounded doubles, dates and times as text."""
    def shown(field):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        return column.alias(field.name)

    return df.select(*[shown(field) for field in df.schema.fields])


def _on(source, report, **options) -> Query:
    return lambda spark, sf_dir: plain(report(source(spark, sf_dir), **options))


def _all_on(source, module, names: str) -> dict[str, Query]:
    return {name: _on(source, getattr(module, name)) for name in names.split()}


def _descriptive() -> dict[str, Query]:
    return (
        _all_on(tables.observations, quality,
                "validity_distribution null_counts temporal_coverage spatial_coverage")
        | _all_on(tables.valid_observations, descriptive,
                  "overall_speed overall_volume overall_occupancy overall_speed_sd district_stats road_stats "
                  "lane_stats hourly_stats dow_stats weekday_weekend direction_stats")
        | {
            "road_slowest20": _on(tables.valid_observations, descriptive.road_slowest),
            "road_busiest20": _on(tables.valid_observations, descriptive.road_busiest),
            "road_fastest20": _on(tables.valid_observations, descriptive.road_fastest),
        }
    )


def _quality() -> dict[str, Query]:
    return (
        _all_on(tables.valid_observations, quality, "missing_report outlier_report")
        | _all_on(tables.observations, quality,
                  "clean_observations cleaning_summary data_quality_report district_counts ingest_statistics "
                  "distinct_dates distinct_lanes records_per_file invalid_readings")
        | _all_on(tables.clean, quality, "clean_coverage")
        | _all_on(tables.clean, descriptive,
                  "overall_wide district_statistics lane_statistics_by_speed direction_statistics")
        | _all_on(tables.observations, descriptive,
                  "speed_by_detector_lane volume_by_hour slowest_roads_by_name busiest_roads_by_name")
        | {
            "fastest_roads_top10": _on(tables.observations, descriptive.fastest_roads),
            "unmatched_detectors": lambda spark, sf_dir: ingest.unmatched_detectors(
                tables.readings(spark, sf_dir), tables.locations(spark, sf_dir)),
        }
    )


def _temporal() -> dict[str, Query]:
    return (
        _all_on(tables.clean, temporal,
                "hourly_profile morning_peak_hour evening_peak_hour hourly_direction_profile "
                "hourly_lane_profile daily_statistics weekday_weekend_comparison hourly_weekday_weekend "
                "monday_effect friday_evening morning_rush_weekend evening_rush_weekend "
                "morning_rush_top10_congested")
        | _all_on(tables.clean_long_span, temporal, "monthly_statistics seasonal_statistics month_trend")
        | {
            "monthly_statistics_by_year": _on(
                tables.clean_long_span, temporal.monthly_statistics, by_year=True),
            "month_trend_chronological": _on(
                tables.clean_long_span, temporal.month_trend, chronological=True),
        }
    )


def _spatial() -> dict[str, Query]:
    return _all_on(
        tables.clean, spatial,
        "top10_slowest_roads top10_busiest_roads top10_most_congested_roads district_rankings lane_speed "
        "lane_volume lane_occupancy lane_statistics peak_lane_stats morning_direction evening_direction "
        "morning_district_flow traffic_regime_distribution road_congestion_severity geospatial_data",
    ) | {
        "road_direction_comparison": _on(tables.clean, spatial.road_direction_comparison),
        "speed_variability": _on(tables.clean, spatial.speed_variability),
    }


def _flow() -> dict[str, Query]:
    return _all_on(
        tables.clean, flow,
        "speed_volume_relationship correlations volume_occupancy_relationship speed_occupancy_relationship "
        "fundamental_diagram lane_capacity_estimates flow_regime_stats lane_flow_regimes "
        "hourly_flow_regimes",
    ) | {
        "road_capacity_estimates": _on(tables.clean, flow.road_capacity_estimates),
        "scatter_sample": _on(tables.clean, flow.scatter_sample, fraction=0.1,
                              keys=("detector_id", "lane_id", "occupancy", "volume")),
    }


def _rush() -> dict[str, Query]:
    def in_sql(form, *arguments) -> Query:
        return lambda spark, sf_dir: plain(
            form(spark, tables.valid_observations(spark, sf_dir), *arguments))

    return _all_on(
        tables.valid_observations, rush,
        "busy_roads_morning busy_roads_evening congestion_morning congestion_evening high_occupancy_roads",
    ) | {
        "busy_roads_morning_sql": in_sql(rush.busy_roads_sql, V.MORNING),
        "busy_roads_evening_sql": in_sql(rush.busy_roads_sql, V.EVENING),
        "congestion_morning_sql": in_sql(rush.congestion_sql, V.MORNING),
        "congestion_evening_sql": in_sql(rush.congestion_sql, V.EVENING),
        "high_occupancy_roads_sql": in_sql(rush.high_occupancy_sql),
    }


# --- ingest ---------------------------------------------------------------

TYPED = (
    "detector_id", "direction", "lane_id", "occupancy", "speed", "volume", "standard_deviation", "valid",
    "period_from", "period_to", "date",
)


# Fixed value: documents of a packed file. One task reads a whole gzip file, here some 15 MB of XML.
PACKED_DOCUMENTS = 10_000


def _xml_files(spark, sf_dir, **options) -> str:
    """The documents as XML files in the shared folder."""
    path = shared.new_path(spark, "xml")
    rows = documents.documents(spark, sf_dir)
    rows.write.format("xml").option("rowTag", xml.ROW_TAG).option("rootTag", "readings").options(**options).save(path)
    return path


def exploded_periods(spark, sf_dir):
    periods = ingest.explode_periods(documents.documents(spark, sf_dir))
    return periods.select("date", "period.period_from", "period.period_to")


def exploded_detectors(spark, sf_dir):
    periods = ingest.explode_periods(documents.documents(spark, sf_dir))
    return ingest.explode_detectors(periods).select(
        "date", "period_from", "period_to", "detector.detector_id", "detector.direction")


def flatten_readings(spark, sf_dir):
    return plain(ingest.flatten_readings(documents.documents(spark, sf_dir)))


def xml_readings(spark, sf_dir):
    good, _ = xml.good_and_corrupt(xml.read_documents(spark, _xml_files(spark, sf_dir)))
    return plain(ingest.flatten_readings(good).select(*TYPED))


def xml_period_rows(spark, sf_dir):
    good, _ = xml.good_and_corrupt(xml.read_periods(spark, _xml_files(spark, sf_dir)))
    lanes = ingest.explode_lanes(ingest.explode_detectors(good))
    return lanes.select("period_from", "period_to", "detector_id", "direction", "lane.lane_id", "lane.speed")


def xml_split_readings(spark, sf_dir):
    """The same from text splits: one file may be read by many tasks."""
    good, _ = xml.good_and_corrupt(xml.read_split_periods(spark, _xml_files(spark, sf_dir)))
    return plain(ingest.flatten_periods(good).select(*TYPED))


def ingested_folder(spark, sf_dir):
    """Rows and files of one folder's ingest, good and quarantined. The folder holds its documents
    in gzip files: plain, their XML takes some 70 times the space of the events."""
    table, quarantine = shared.new_path(spark, "table"), shared.new_path(spark, "quarantine")
    folder = _xml_files(spark, sf_dir, compression="gzip", maxRecordsPerFile=PACKED_DOCUMENTS)
    # Two files that are no readable documents: cut short within a tag, and not XML.
    cut_short = f"<{xml.ROW_TAG}><date>2024-01-01</date><periods><period></{xml.ROW_TAG}>"
    for broken in (cut_short, f"<{xml.ROW_TAG}>< & ></{xml.ROW_TAG}>"):
        spark.createDataFrame([(broken,)], "value string").write.mode("append").option("extension", "xml").csv(folder)
    places = ingest.canonical_locations(documents.detector_locations(spark, sf_dir))
    for _ in range(2):  # a rerun of the unit leaves its rows once
        ingest_folder(spark, folder, places, table, quarantine, "folder-1", xml.PACKED)
    bad = spark.read.schema(f"{xml.CORRUPT} string, source_file string").parquet(quarantine)
    return spark.read.parquet(table).agg(
        F.count(F.lit(1)).alias("good_rows"), (F.countDistinct("source_file") > 0).alias("has_files"),
        F.lit(bad.count()).alias("quarantined"))


def located_readings(spark, sf_dir):
    readings = ingest.flatten_readings(documents.documents(spark, sf_dir))
    places = ingest.canonical_locations(documents.detector_locations(spark, sf_dir))
    return plain(ingest.join_locations(readings, places))


def locations_csv(spark, sf_dir):
    path = shared.new_path(spark, "locations")
    documents.detector_locations(spark, sf_dir).write.csv(path, header=True)
    places = ingest.canonical_locations(xml.read_locations(spark, path))
    return places.select("AID_ID_Number", "Road_EN", "District", "Rotation")


def streamed_readings(spark, sf_dir):
    table, quarantine, checkpoint = (shared.new_path(spark, n) for n in ("table", "quarantine", "stream"))
    places = ingest.canonical_locations(documents.detector_locations(spark, sf_dir))
    ingest_new_files(spark, _xml_files(spark, sf_dir), places, table, quarantine, checkpoint, 4)
    return plain(spark.read.parquet(table).select(*TYPED, "District", "Road_EN"))


def two_stream_ingest(spark, sf_dir):
    """Two streams with checkpoints of their own into one table."""
    table, quarantine, first = (shared.new_path(spark, n) for n in ("table", "quarantine", "stream"))
    places = ingest.canonical_locations(documents.detector_locations(spark, sf_dir))
    files = _xml_files(spark, sf_dir)
    for checkpoint in (first, shared.new_path(spark, "stream"), first):
        ingest_new_files(spark, files, places, table, quarantine, checkpoint, 4)
    return plain(spark.read.parquet(table).select(*TYPED, "District", "Road_EN"))


def _ingest() -> dict[str, Query]:
    return {
        "exploded_periods": exploded_periods,
        "exploded_detectors": exploded_detectors,
        "flatten_readings": flatten_readings,
        "fanout_counts": lambda spark, sf_dir: ingest.fanout_counts(documents.documents(spark, sf_dir)),
        "xml_readings": xml_readings,
        "xml_period_rows": xml_period_rows,
        "xml_split_readings": xml_split_readings,
        "locations_csv": locations_csv,
        "located_readings": located_readings,
        "ingested_folder": ingested_folder,
        "streamed_readings": streamed_readings,
        "two_stream_ingest": two_stream_ingest,
        "located_observations": _on(tables.observations, lambda obs: obs),
    }


# --- sources and sinks ---------------------------------------------------------------

CSV_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("occupancy", T.IntegerType()),
])
ONE_YEAR = sources.months_back("199612", 12)


def _csv_lines_file(spark, sf_dir) -> str:
    path = shared.new_path(spark, "lines")
    documents.csv_lines(spark, sf_dir).write.text(path)
    return path


def csv_good_rows(spark, sf_dir):
    return sources.read_csv(spark, _csv_lines_file(spark, sf_dir), CSV_SCHEMA, header=False)[0]


def csv_quarantine(spark, sf_dir):
    _, bad = sources.read_csv(spark, _csv_lines_file(spark, sf_dir), CSV_SCHEMA, header=False)
    return bad.select(F.col(xml.CORRUPT).alias("line"))


def parquet_by_month(spark, sf_dir):
    path = shared.new_path(spark, "months")
    sinks.write_by_month(tables.long_span(spark, sf_dir), path, "all")
    year = sources.read_months(spark, path, ONE_YEAR)
    return plain(year.select("detector_id", "lane_id", "speed", "volume", "date", "hour",
                             F.col("month").cast("string").alias("month")))


def csv_by_date(spark, sf_dir):
    path = shared.new_path(spark, "dates")
    sinks.write_csv_by_date(tables.readings(spark, sf_dir).select(
        "detector_id", "lane_id", "occupancy", "speed", "volume", "date"), path)
    schema = "detector_id long, lane_id string, occupancy int, speed double, volume int, date date"
    return plain(spark.read.schema(schema).csv(path, header=True))


def compacted_by_date(spark, sf_dir):
    loose, dense = shared.new_path(spark, "loose"), shared.new_path(spark, "dense")
    sinks.write_by_date(tables.readings(spark, sf_dir), loose, "all")
    sinks.compact(spark.read.parquet(loose), dense)
    return plain(spark.read.parquet(dense).select(*tables.readings(spark, sf_dir).columns))


def month_boundary_ingest(spark, sf_dir):
    """Two ingest units whose months overlap, with undated rows in both; the second runs twice."""
    path = shared.new_path(spark, "units")
    rows = tables.long_span(spark, sf_dir).withColumn(
        "date", F.when(F.col("detector_id") % 7 != 0, F.col("date")))
    early = F.col("period_from") < "1996-06-20"
    sinks.write_by_month(rows.filter(early), path, "1996a")
    for _ in range(2):
        sinks.write_by_month(rows.filter(~early), path, "1996b")
    return plain(spark.read.parquet(path).select("detector_id", "lane_id", "speed", "volume", "date", "hour"))


def date_boundary_ingest(spark, sf_dir):
    """Units by file, twenty in all, which hold rows of every day; one runs twice."""
    path = shared.new_path(spark, "units")
    rows = tables.readings(spark, sf_dir)
    for unit in [f"file-{i}" for i in range(20)] + ["file-1"]:
        sinks.write_by_date(rows.filter(F.col("source_file") == unit), path, unit)
    return plain(spark.read.parquet(path).select("detector_id", "lane_id", "speed", "volume", "date", "source_file"))


def exported_summary(spark, sf_dir):
    path = shared.new_path(spark, "export")
    sinks.export_summaries({"district_stats": descriptive.district_stats(
        tables.valid_observations(spark, sf_dir))}, path)
    read = sources.peek_csv(spark, f"{path}/district_stats")
    types = {"Records": "long", "Total_Volume": "long", "District": "string"}
    return plain(read.select(*[F.col(c).cast(types.get(c, "double")).alias(c) for c in read.columns]))


def stored_lane_stats(spark, sf_dir):
    path = shared.new_path(spark, "lanes")
    for _ in range(2):  # the second call finds the table
        stored = sources.read_or_compute(
            spark, path, lambda: descriptive.lane_stats(tables.valid_observations(spark, sf_dir)))
    return plain(stored)


def dataset_rows(spark, sf_dir):
    size = sources.dataset_size(tables.table(spark, sf_dir, "lineitem"))
    return size.select("total_records", (F.col("data_size_bytes") > 0).alias("has_bytes"))


def key_sample(spark, sf_dir):
    return plain(sampling.key_sample(
        tables.readings(spark, sf_dir), 0.1, "detector_id", "lane_id", "occupancy", "volume"))


def text_line_count(spark, sf_dir):
    lines = sources.read_text(spark, _csv_lines_file(spark, sf_dir))
    return lines.agg(F.count(F.lit(1)).alias("lines"))


def _storage() -> dict[str, Query]:
    return {
        "csv_good_rows": csv_good_rows,
        "csv_quarantine": csv_quarantine,
        "text_line_count": text_line_count,
        "parquet_by_month": parquet_by_month,
        "csv_by_date": csv_by_date,
        "month_boundary_ingest": month_boundary_ingest,
        "date_boundary_ingest": date_boundary_ingest,
        "compacted_by_date": compacted_by_date,
        "exported_summary": exported_summary,
        "stored_lane_stats": stored_lane_stats,
        "dataset_rows": dataset_rows,
        "readings_in_period": lambda spark, sf_dir: plain(tables.readings(spark, sf_dir).filter(
            C.in_period(datetime(2024, 1, 10, 6), datetime(2024, 1, 12, 18)))),
        "key_sample": key_sample,
    }


# --- timings ---------------------------------------------------------------

TOOLS = ["click", "error", "purchase", "signup", "view"]


def stored_timings(fmt: str) -> Query:
    def query(spark, sf_dir):
        path = shared.new_path(spark, "timings")
        sinks.write_timings(documents.timings(spark, sf_dir), path, fmt)
        return plain(sources.read_timings(spark, path, fmt))

    return query


def _timings() -> dict[str, Query]:
    rows = documents.timings
    return {
        "timing_average_by_tool": _on(rows, timings.average_by_tool),
        "timing_average_by_phase": _on(rows, timings.average_by_phase),
        "timing_recent_totals": _on(rows, timings.recent_totals, today="2024-01-31"),
        "timing_dataset_by_tool": _on(rows, timings.dataset_by_tool, tools=TOOLS),
        "timing_phase_share": _on(rows, timings.phase_share),
        "timing_speedup": _on(rows, timings.speedup),
        "timing_failed_runs": _on(rows, timings.failed_runs),
        "timing_run_phases": _on(rows, timings.run_phases, tool="view", dataset_size="2_month"),
        "timing_parquet": stored_timings("parquet"),
        "timing_csv": stored_timings("csv"),
    }


# --- roll-up ---------------------------------------------------------------

# Reports checked against the same SQL when they read the roll-up instead of the readings.
ROLLED_UP = (
    "hourly_profile", "weekday_weekend_comparison", "road_congestion_severity", "lane_speed",
    "top10_most_congested_roads", "geospatial_data",
)


ROLLED_UP_BY_FLOW = ("flow_regime_stats", "fundamental_diagram", "traffic_regime_distribution")


def _rollup() -> dict[str, Query]:
    def source(spark, sf_dir):
        return hourly_rollup(tables.clean(spark, sf_dir))

    def joined_late(spark, sf_dir):
        return plain(located_rollup(
            tables.readings(spark, sf_dir), tables.locations(spark, sf_dir)))

    def by_valid(spark, sf_dir):
        return hourly_rollup(tables.valid_observations(spark, sf_dir))

    def by_flow(spark, sf_dir):
        return flow_rollup(tables.clean(spark, sf_dir))

    def sketched(source):
        return lambda spark, sf_dir: sketch_rollup(source(spark, sf_dir))

    return {
        "hourly_rollup": _on(source, lambda rollup: rollup),
        "located_rollup": joined_late,
        "flow_rollup": _on(by_flow, lambda rollup: rollup),
    } | {
        f"{name}_from_rollup": _on(source, FROM_ROLLUP[name]) for name in ROLLED_UP
    } | {
        f"{name}_from_rollup": _on(by_valid, report) for name, report in FROM_VALID_ROLLUP.items()
    } | {
        f"{name}_from_rollup": _on(by_flow, FROM_FLOW_ROLLUP[name]) for name in ROLLED_UP_BY_FLOW
    } | {
        f"{report.__name__}_from_sketches": _on(sketched(table), report) for table, report in (
            (tables.valid_observations, descriptive.overall_speed),
            (tables.valid_observations, descriptive.overall_volume),
            (tables.valid_observations, descriptive.overall_occupancy),
            (tables.valid_observations, descriptive.road_stats),
            (tables.observations, quality.spatial_coverage),
            (tables.clean, quality.clean_coverage),
            (tables.clean, descriptive.overall_wide),
            (tables.clean, flow.road_capacity_estimates),
            (tables.clean, flow.lane_capacity_estimates))
    }


# --- outlook ---------------------------------------------------------------

def _holidays(spark, sf_dir):
    """Every tenth day of the year stands for a holiday."""
    days = tables.table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date")).distinct()
    return days.filter(F.dayofyear("date") % 10 == 0)


def streamed_congestion(spark, sf_dir):
    """The live view of a stored table read as a stream, as it stands when all is read."""
    source, out = shared.new_path(spark, "readings"), shared.new_path(spark, "live")
    rows = tables.readings(spark, sf_dir)
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    outlook.live_congestion(stream).writeStream.outputMode("complete").foreachBatch(
        lambda batch, number: batch.write.mode("overwrite").parquet(out)
    ).option("checkpointLocation", shared.new_path(spark, "live")).trigger(availableNow=True).start().awaitTermination()
    return plain(spark.read.parquet(out))


def _arrivals(spark, sf_dir):
    """Readings with the drop they arrive in: by thirds of the month, every tenth row one drop
    late and every twentieth two drops."""
    third = F.least(F.floor((F.dayofmonth("period_from") - 1) / 10), F.lit(2))
    n = F.unix_seconds(F.col("period_from").cast("timestamp")) % 20
    return tables.readings(spark, sf_dir).drop("source_file").withColumn(
        "drop", (third + F.when(n == 0, 2).when(n == 10, 1).otherwise(0)).cast("int"))


def streamed_windows(spark, sf_dir):
    """The windows that the live view has written after five drops, the stream started anew for
    each, and once more with nothing new."""
    source, out, checkpoint = (shared.new_path(spark, n) for n in ("drops", "windows", "stream"))
    rows = _arrivals(spark, sf_dir)
    for drop in range(5):
        arrived = rows.where(F.col("drop") == drop).drop("drop")
        arrived.write.mode("append").parquet(source)
        live.drain(spark.readStream.schema(arrived.schema).parquet(source), out, checkpoint)
    live.drain(spark.readStream.schema(arrived.schema).parquet(source), out, checkpoint)
    return plain(spark.read.parquet(out))


def _outlook() -> dict[str, Query]:
    return _all_on(
        tables.clean, outlook,
        "hour_dow_heatmap volume_rollups regime_share sd_speed_relation congestion_index_banded congestion_episodes "
        "threshold_incidents calendar_lag_features next_period_label road_profiles",
    ) | {
        "delay_cost": _on(tables.clean, lambda obs: outlook.delay_cost(obs).withColumns(
            {c: F.round(c, 3) for c in ("delay_hours", "delay_cost")})),
        "month_growth": _on(tables.clean_long_span, outlook.month_growth),
        "missing_days": _on(tables.clean_long_span, outlook.missing_days),
        "coverage_gaps": _on(tables.observations, outlook.coverage_gaps),
        "holiday_effect": lambda spark, sf_dir: plain(
            outlook.holiday_effect(tables.clean(spark, sf_dir), _holidays(spark, sf_dir))),
        "detector_congestion_index": _on(tables.clean, outlook.congestion_index_banded, keys=("detector_id",)),
        "delay_against_own_speed": _on(tables.clean, lambda obs: outlook.delay_against_own_speed(obs).withColumns(
            {c: F.round(c, 3) for c in ("delay_hours", "delay_cost")})),
        "road_clusters": _on(tables.clean, outlook.road_clusters),
        "road_speed_correlation": _on(tables.clean, network.road_speed_correlation),
        "shifted_correlation": _on(tables.clean, network.shifted_correlation),
        "forecast_rows": _on(tables.clean, forecast.forecast_rows),
        "next_hour_forecast": _on(tables.clean, forecast.next_hour_forecast),
        "streamed_congestion": streamed_congestion,
        "streamed_windows": streamed_windows,
    }


def queries() -> dict[str, Query]:
    return (
        _descriptive() | _quality() | _temporal() | _spatial() | _flow() | _rush() | _ingest() | _storage()
        | _timings() | _rollup() | _outlook()
    )
