"""Invariants and edge cases of the reports."""

import datetime
import math
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from lanepulse.functions import columns as C
from lanepulse.functions import fixed_values as V
from lanepulse.operators import descriptive, flow, quality, rush, sampling, spatial, temporal
from lanepulse.operators.distribution import describe_column
from lanepulse.plans.rollup import flow_rollup, hourly_rollup
from lanepulse.plans.suite import FROM_FLOW_ROLLUP, FROM_READINGS, FROM_ROLLUP, FROM_SKETCHES, FROM_VALID_ROLLUP, run_suite
from lanepulse.testbed import tables

READING = (
    "detector_id string, direction string, lane_id string, occupancy int, speed double, volume int, "
    "standard_deviation double, valid string, period_from timestamp, date date, Road_EN string, District string, "
    "GeometryEasting double, GeometryNorthing double"
)


def reading(speed=50.0, occupancy=10, volume=5, hour=8, day=3, month=6, valid="Y", road="A", district="D",
            direction="North", lane="Fast Lane", detector="AID1", sd=1.0, year=2025):
    at = datetime.datetime(year, month, day, hour, 0, 30)
    return (detector, direction, lane, occupancy, speed, volume, sd, valid, at, at.date(), road, district, 1.0, 2.0)


@pytest.fixture
def frame(spark):
    return lambda *readings: spark.createDataFrame(list(readings), READING)


@pytest.fixture(scope="module")
def obs(spark, sf_dir):
    return tables.observations(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def clean(spark, sf_dir):
    return tables.clean(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def rollups(clean):
    return hourly_rollup(clean).cache(), flow_rollup(clean).cache()


# --- invariants ---------------------------------------------------------------

GROUPED = [
    (descriptive.district_stats, "Records"), (descriptive.road_stats, "Records"),
    (descriptive.lane_stats, "Records"), (descriptive.hourly_stats, "Records"),
    (descriptive.dow_stats, "Records"), (descriptive.direction_stats, "Records"),
    (temporal.hourly_profile, "record_count"), (temporal.monthly_statistics, "record_count"),
    (spatial.traffic_regime_distribution, "record_count"), (flow.speed_volume_relationship, "record_count"),
    (flow.volume_occupancy_relationship, "record_count"), (flow.speed_occupancy_relationship, "record_count"),
    (flow.fundamental_diagram, "record_count"), (flow.lane_flow_regimes, "record_count"),
    (flow.hourly_flow_regimes, "record_count"), (spatial.geospatial_data, "observation_count"),
]


@pytest.mark.parametrize("report, count", GROUPED, ids=lambda v: getattr(v, "__name__", v))
def test_groups_cover_every_row(clean, report, count):
    assert report(clean).agg(F.sum(count)).first()[0] == clean.count()


def test_percentages_add_up(obs, clean):
    for shares, column in (
        (quality.validity_distribution(obs), "percentage"), (spatial.traffic_regime_distribution(clean), "pct"),
    ):
        assert math.isclose(shares.agg(F.sum(column)).first()[0], 100)


def test_cleaning(obs, clean):
    total, valid, kept, removed, _ = quality.cleaning_summary(obs).first()
    assert valid + quality.invalid_readings(obs).count() == total == obs.count()
    assert kept == clean.count() and kept + removed == valid
    assert clean.exceptAll(obs).count() == 0


def test_severe_is_part_of_moderate(obs):
    for r in rush.congestion(obs, V.MORNING).collect():
        assert r.severe_congestion_count <= r.moderate_congestion_count <= r.observation_count


def test_percentiles_are_ordered(obs):
    r = descriptive.overall_speed(obs).first()
    assert r["Min"] <= r["25th_Percentile"] <= r["Median"] <= r["75th_Percentile"] <= r["95th_Percentile"] <= r["Max"]


# --- edge cases ---------------------------------------------------------------

def test_hour_windows(frame):
    day = frame(*[reading(hour=h) for h in range(24)])
    hours = lambda condition: [r.hour for r in C.with_hour(day).filter(condition).orderBy("hour").collect()]
    assert hours(C.in_window(V.MORNING)) == [6, 7, 8, 9]
    assert hours(C.in_window_inclusive(V.MORNING)) == [6, 7, 8, 9, 10]
    assert hours(C.in_either_rush()) == [6, 7, 8, 9, 17, 18, 19, 20]
    assert [r.hour for r in temporal.friday_evening(frame(*[reading(hour=h, day=6) for h in range(24)])).collect()] \
        == [17, 18, 19, 20, 21]


def test_stored_hour_is_used(frame):
    stored = frame(reading(hour=3)).withColumn("hour", F.lit(8))
    assert rush.busy_roads_morning(stored).count() == 1


def test_week_labels(frame):
    week = frame(*[reading(day=d) for d in range(1, 8)])  # 1 June 2025 is a Sunday
    got = [tuple(r) for r in week.select(C.day_of_week(), C.day_name(), C.weekend_label()).orderBy("date").collect()]
    assert [g[0] for g in got] == list(range(1, 8))
    assert [g[1] for g in got] == list(V.DAY_NAMES)
    assert [g[2] for g in got] == ["Weekend"] + ["Weekday"] * 5 + ["Weekend"]


def test_seasons_in_order(frame):
    year = frame(*[reading(month=m) for m in range(1, 13)])
    assert [(r.season, r.total_volume) for r in temporal.seasonal_statistics(year).collect()] == [
        ("Spring", 15), ("Summer", 15), ("Autumn", 15), ("Winter", 15)]


@pytest.mark.parametrize("strict", [True, False])
def test_regimes(frame, strict):
    cases = [(61, 19, "Free Flow"), (60, 19, "Transitional" if strict else "Synchronized Flow"),
             (30, 20, "Synchronized Flow"), (60, 40, "Synchronized Flow"),
             (45, 41, "Transitional" if strict else "Synchronized Flow"),
             (29, 41, "Wide Moving Jam" if strict else "Congested Flow"), (29, 40, "Transitional"),
             (61, 20, "Transitional")]
    got = frame(*[reading(speed=float(s), occupancy=o) for s, o, _ in cases]).select(
        "speed", "occupancy", C.regime(strict).alias("r"))
    assert rows(got) == sorted([(float(s), o, r) for s, o, r in cases], key=repr)


def test_bin_edges(frame):
    volumes = [0, 1, 5, 6, 10, 11, 100, 101]
    got = flow.speed_volume_relationship(frame(*[reading(volume=v) for v in volumes]))
    assert [(r.volume_bin, r.record_count) for r in got.collect()] == [
        ("0-Empty", 1), ("1-5", 2), ("6-10", 2), ("11-20", 1), ("76-100", 1), ("100+", 1)]
    got = flow.volume_occupancy_relationship(frame(*[reading(occupancy=o) for o in (0, 9, 10, 79, 80, 100)]))
    assert [(r.occupancy_bin, r.record_count) for r in got.collect()] == [
        ("0-10%", 2), ("10-20%", 1), ("70-80%", 1), ("80%+", 2)]


def test_missing_value_has_no_bin(frame):
    got = flow.speed_volume_relationship(frame(reading(volume=None), reading(volume=3)))
    assert [(r.volume_bin_order, r.volume_bin) for r in got.collect()] == [(None, None), (2, "1-5")]


def test_missing_measures_are_not_plausible(frame):
    assert quality.clean_observations(frame(
        reading(), reading(speed=None), reading(volume=None), reading(occupancy=None), reading(road=None),
        reading(speed=-1.0), reading(speed=201.0), reading(volume=-1), reading(occupancy=101), reading(valid="N"),
    )).count() == 1


def test_missing_report_sees_nan(frame):
    got = quality.missing_report(frame(reading(speed=float("nan")), reading(direction=None), reading(), reading()))
    assert rows(got) == [("direction", 1, 25.0), ("speed", 1, 25.0)]


def test_roads_without_vehicles_have_no_ratio(frame):
    got = rush.high_occupancy_roads(frame(
        reading(road="Empty", volume=0, occupancy=60), reading(road="Full", volume=10, occupancy=60)))
    assert [r.Road_EN for r in got.collect()] == ["Full"]


def test_single_row_has_no_deviation(frame):
    one = frame(reading())
    assert spatial.lane_speed(one).first().std_speed is None
    assert descriptive.overall_speed(one).first().Std_Dev is None
    assert spatial.lane_speed(hourly_rollup(one)).first().std_speed is None


def test_no_rows(frame):
    none = frame()
    assert rows(quality.cleaning_summary(none)) == [(0, 0, 0, 0, None)]
    assert descriptive.overall_speed(none).first()[:] == (None,) * 8
    assert rush.congestion_morning(none).count() == 0
    assert temporal.month_trend(none).count() == 0
    assert quality.clean_coverage(none).first().distinct_roads == 0
    assert quality.data_quality_report(none).first().total_records == 0
    assert quality.records_per_file(none.withColumn("source_file", F.lit("x"))).first().files == 0


def test_month_trend_needs_two_months(frame):
    assert temporal.month_trend(frame(reading(month=3), reading(month=3))).count() == 0
    r = temporal.month_trend(frame(reading(month=3, speed=50.0, volume=10), reading(month=9, speed=25.0, volume=15)))
    assert r.first()[:] == ("March", "September", -50.0, 50.0)


def test_month_trend_by_date(frame):
    span = frame(reading(month=12, year=2024, speed=40.0), reading(month=1, year=2025, speed=80.0))
    assert temporal.month_trend(span).first().first_month == "January"
    r = temporal.month_trend(span, chronological=True).first()
    assert (r.first_month, r.last_month, r.speed_change_pct) == ("December", "January", 100.0)


def test_ties_are_settled_by_name(frame):
    tied = frame(*[reading(road=f"R{i:02d}") for i in range(30)])
    assert [r.Road_EN for r in spatial.top10_slowest_roads(tied).collect()] == [f"R{i:02d}" for i in range(10)]


def test_significance_limit(frame):
    many = frame(*[reading(road="Many") for _ in range(101)], *[reading(road="Few") for _ in range(100)])
    for report in (spatial.road_direction_comparison, spatial.speed_variability, flow.road_capacity_estimates):
        assert [r.Road_EN for r in report(many).collect()] == ["Many"]


def test_records_per_file_projects(frame):
    files = frame(reading(lane="a"), reading(lane="b"), reading(lane="b")).withColumn(
        "source_file", F.col("lane_id"))
    r = quality.records_per_file(files, total_files=100).first()
    assert (r.avg_records_per_file, r.projected_records) == (1.5, 150)


# --- SQL form ---------------------------------------------------------------

def test_sql_form_equals_dataframe_form(spark, obs):
    for frame_form, sql_form in (
        (rush.busy_roads(obs, V.MORNING), rush.busy_roads_sql(spark, obs, V.MORNING)),
        (rush.busy_roads(obs, V.EVENING), rush.busy_roads_sql(spark, obs, V.EVENING)),
        (rush.congestion(obs, V.MORNING), rush.congestion_sql(spark, obs, V.MORNING)),
        (rush.congestion(obs, V.EVENING), rush.congestion_sql(spark, obs, V.EVENING)),
        (rush.high_occupancy_roads(obs), rush.high_occupancy_sql(spark, obs)),
    ):
        assert frame_form.exceptAll(sql_form).count() == 0 == sql_form.exceptAll(frame_form).count()


def test_sql_form_reads_its_own_table_in_every_thread(spark, obs):
    halves = [obs.filter(F.col("detector_id") % 2 == k) for k in (0, 1)] * 3
    with ThreadPoolExecutor(6) as pool:
        answers = list(pool.map(lambda o: rows(rush.congestion_sql(spark, o, V.MORNING)), halves))
    assert answers == [rows(rush.congestion(o, V.MORNING)) for o in halves] and answers[0] != answers[1]


# --- percentiles against brute force ---------------------------------------------

def brute(values, share):
    known = sorted(v for v in values if v is not None)
    return known[max(0, math.ceil(round(share * len(known), 9)) - 1)] if known else None


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(
    st.none(), st.integers(-2**31, 2**31 - 1), st.integers(0, 3))), min_size=1, max_size=60))
def test_whole_number_percentiles(spark, data):
    df = spark.createDataFrame(data, "k string, v int")
    got = {r.k: r for r in describe_column(df, "v", {"p50": 0.5, "p95": 0.95}, ("k",)).collect()}
    assert set(got) == {k for k, _ in data}
    for key, r in got.items():
        values = [v for k, v in data if k == key]
        known = [v for v in values if v is not None]
        assert (r.rows, r.n) == (len(values), len(known))
        assert (r.p50, r.p95) == (brute(values, 0.5), brute(values, 0.95))
        assert r.total == (sum(known) if known else None)
        if len(known) > 1:
            mean = sum(known) / len(known)
            std = math.sqrt(sum((v - mean) ** 2 for v in known) / (len(known) - 1))
            assert math.isclose(r["std"], std, rel_tol=1e-9, abs_tol=1e-6)


@pytest.mark.parametrize("spread", [1e-9, 250, 1e12, 1e300])
def test_fractional_percentiles_with_a_hot_value(spark, spread):
    random.seed(7)
    values = [spread / 7] * 700 + [random.uniform(-spread / 5, spread) for _ in range(1300)] + [None] * 20
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p100": 1.0}
    r = describe_column(df, "v", shares).first()
    assert [r[s] for s in shares] == [brute(values, share) for share in shares.values()]
    assert (r.rows, r.n) == (2020, 2000)
    sketched = describe_column(df, "v", shares, accuracy=1_000_000).first()
    assert [sketched[s] for s in shares] == [r[s] for s in shares]
    assert spread > 1e100 or math.isclose(sketched["std"], r["std"])


def test_nan_sorts_last(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    r = describe_column(df, "v", {"p50": 0.5, "p100": 1.0}).first()
    assert r.p50 == 2.0 and math.isnan(r.p100)


# --- sampling ---------------------------------------------------------------

def test_bernoulli_rate(spark):
    n = flow.scatter_sample(spark.range(200_000).select(
        *[F.col("id").alias(c) for c in ("volume", "occupancy", "speed")])).count()
    assert abs(n - 2000) < 300


def test_key_sample_does_not_depend_on_partitions(spark):
    ids = spark.range(50_000)
    sample = sampling.key_sample(ids, 0.3, "id")
    assert abs(sample.count() - 15_000) < 600
    assert rows(sample) == rows(sampling.key_sample(ids.repartition(3), 0.3, "id"))
    ladder = sampling.subset_ladder(ids, "id")
    assert sorted(ladder) == list(range(10, 100, 10))
    assert ladder[10].exceptAll(ladder[20]).count() == 0


# --- roll-up ---------------------------------------------------------------

def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("name", sorted(FROM_ROLLUP | FROM_FLOW_ROLLUP))
def test_roll_up_gives_the_same_report(clean, rollups, name):
    report = (FROM_ROLLUP | FROM_FLOW_ROLLUP)[name]
    direct, merged = report(clean), report(rollups[0] if name in FROM_ROLLUP else rollups[1])
    assert direct.columns == merged.columns
    pairs = zip(direct.collect(), merged.collect(), strict=True)
    left_right = [(tuple(a), tuple(b)) for a, b in pairs]
    if not name.endswith(("comparison", "data", "effect", "weekend")):  # ordered reports, row by row
        assert all(close(x, y) for a, b in left_right for x, y in zip(a, b))
    else:
        key = lambda row: repr([v for v in row if not isinstance(v, float)])
        for a, b in zip(sorted([a for a, _ in left_right], key=key), sorted([b for _, b in left_right], key=key)):
            assert all(close(x, y) for x, y in zip(a, b))


def test_reports_on_single_readings_refuse_a_roll_up(clean):
    for report in (flow.correlations, flow.flow_regime_stats, spatial.traffic_regime_distribution,
                   descriptive.overall_wide, rush.high_occupancy_roads):
        with pytest.raises(ValueError, match="roll-up"):
            report(hourly_rollup(clean))


def test_suite(spark, obs, tmp_path):
    root = str(tmp_path / "suite")
    results = run_suite(spark, obs, root)
    assert set(results) == set(FROM_ROLLUP | FROM_FLOW_ROLLUP | FROM_READINGS | FROM_SKETCHES | FROM_VALID_ROLLUP)
    exported = spark.read.csv(f"{root}/reports/hourly_profile", header=True)
    assert exported.count() == results["hourly_profile"].count() == 24
    cleaned = spark.read.parquet(f"{root}/cleaned/*/rows")
    assert cleaned.count() == quality.clean_observations(obs).count()
    assert isinstance(cleaned.schema["speed"].dataType, T.DoubleType)
