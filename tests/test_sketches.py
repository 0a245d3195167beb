import math

import pytest
from lanepulse.operators import descriptive, flow, quality
from lanepulse.operators.distribution import describe_column
from lanepulse.plans.sketches import K, rank_error, sketch_rollup
from lanepulse.testbed import tables
from pyspark.sql import functions as F

SHARES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


@pytest.fixture(scope="module")
def many(spark):
    """200,000 readings, a third on one road, many values; months, lanes and districts."""
    n = F.col("id")
    x = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(1 << 20)
    return spark.range(200_000).select(
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), n % 40)).alias("Road_EN"), F.lit("D").alias("District"),
        F.concat(F.lit("l"), n % 4).alias("lane_id"), (n % 9_000).alias("detector_id"),
        F.when(n % 97 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n % 150).cast("int"))).alias("date"),
        (x * x * 150).alias("speed"), F.floor(x * 3000).cast("int").alias("volume"),
        F.when(n % 11 > 0, F.floor(F.sqrt(x) * 100).cast("int")).alias("occupancy"), (x * 7).alias("standard_deviation"),
        F.lit(8).alias("hour"))


def rank_of(df, column, value, share):
    """How far `share` lies outside the ranks that the value covers."""
    below, upto, n = df.agg(F.count_if(F.col(column) < value), F.count_if(F.col(column) <= value), F.count(column)).first()
    return max(0.0, below / n - share, share - upto / n)


@pytest.mark.parametrize("column", ["speed", "volume", "occupancy"])
def test_percentiles_keep_their_rank_error(many, column):
    rollup = sketch_rollup(many).persist()
    whole = describe_column(rollup, column, SHARES).first()
    exact = describe_column(many, column, SHARES).first()
    assert describe_column(rollup, column, SHARES).schema[-1].dataType == many.schema[column].dataType
    assert all(rank_of(many, column, whole[name], share) <= rank_error(K) for name, share in SHARES.items())
    for name in ("rows", "n", "mean", "std", "min", "max", "total"):
        assert math.isclose(whole[name], exact[name], rel_tol=1e-9)
    hot = describe_column(rollup.where("Road_EN = 'hot'"), column, SHARES, ["lane_id"]).collect()
    for row in hot:
        lane = many.where((F.col("Road_EN") == "hot") & (F.col("lane_id") == row.lane_id))
        assert all(rank_of(lane, column, row[name], share) <= rank_error(K) for name, share in SHARES.items())
    rollup.unpersist()


def test_distinct_counts_within_a_hundredth(many):
    rollup = sketch_rollup(many)
    exact, merged = quality.spatial_coverage(many).first(), quality.spatial_coverage(rollup).first()
    assert exact["Unique_Detectors"] == 9_000
    assert all(abs(a - b) <= 0.01 * a for a, b in zip(exact, merged, strict=True))
    exact, merged = quality.clean_coverage(many).first(), quality.clean_coverage(rollup).first()
    assert exact.asDict().keys() == merged.asDict().keys() and merged["distinct_dates"] == exact["distinct_dates"] == 151
    roads = {r.Road_EN: r.Num_Detectors for r in descriptive.road_stats(rollup).collect()}
    for r in descriptive.road_stats(many).collect():
        assert abs(roads[r.Road_EN] - r.Num_Detectors) <= max(1, 0.01 * r.Num_Detectors)


@pytest.mark.parametrize("report", [quality.spatial_coverage, quality.clean_coverage, descriptive.road_stats])
def test_distinct_counts_are_exact(many, report):
    """9,000 detectors: more than a distinct-count sketch holds one by one."""
    exact, merged = report(many), report(sketch_rollup(many))
    counts = [c for c, t in exact.dtypes if t == "bigint"]
    assert exact.dtypes == merged.dtypes
    assert sorted(map(tuple, exact.select(counts).collect())) == sorted(map(tuple, merged.select(counts).collect()))


@pytest.mark.parametrize("report", [
    descriptive.overall_speed, descriptive.overall_volume, descriptive.overall_occupancy, descriptive.overall_wide,
    descriptive.overall_speed_sd, flow.road_capacity_estimates, flow.lane_capacity_estimates])
def test_reports_equal_the_exact_ones_while_sketches_hold_every_value(spark, sf_dir, report):
    clean = tables.clean(spark, sf_dir)
    exact, merged = report(clean), report(sketch_rollup(clean, k=8000))
    assert exact.dtypes == merged.dtypes
    for a, b in zip(exact.collect(), merged.collect(), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or math.isclose(x, y, rel_tol=1e-9)


def test_no_readings(spark, sf_dir):
    none = sketch_rollup(tables.clean(spark, sf_dir).limit(0))
    assert quality.spatial_coverage(none).first() == quality.spatial_coverage(tables.clean(spark, sf_dir).limit(0)).first()
    assert descriptive.overall_speed(none).first()["Median"] is None
