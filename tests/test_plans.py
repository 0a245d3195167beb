"""What the plans look like: pruned and pushed scans, no Python, no cross joins."""

import re

import pytest
from pyspark.sql import functions as F

from lanepulse.functions import columns as C
from lanepulse.functions.measures import MEASURES
from lanepulse.operators import descriptive, flow, quality, rush, spatial, temporal
from lanepulse.plans.rollup import hourly_rollup, located_rollup
from lanepulse.sinks import tables as sinks
from lanepulse.testbed import queries, tables

# Queries that write files when they are built.
WRITING = re.compile("xml|csv|text|parquet|compacted|exported|stored|stream|boundary|ingested")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """Cleaned observations in the stored layout: month partitions and an hour column."""
    path = str(tmp_path_factory.mktemp("plans") / "cleaned")
    sinks.write_by_month(tables.clean(spark, sf_dir), path, "all")
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", [q for q in sorted(queries.queries()) if not WRITING.search(q)])
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    plan = physical(queries.queries()[name](spark, sf_dir))
    forbidden = "Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin"
    if not name.endswith("_from_sketches"):  # sketches are objects, of a bounded size
        forbidden += "|ObjectHashAggregate"
    assert not re.search(forbidden, plan)


def test_hour_filter_reaches_the_scan(stored):
    plan = physical(rush.busy_roads_morning(stored))
    assert "GreaterThanOrEqual(hour,6)" in plan and "LessThan(hour,10)" in plan
    assert "IsNotNull(Road_EN)" in plan
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"hour", "Road_EN", "District", "volume", "occupancy"}


def test_cleaning_filter_reaches_the_scan(stored):
    plan = physical(quality.clean_observations(stored).select("speed"))
    for pushed in ("EqualTo(valid,Y)", "GreaterThanOrEqual(speed,0.0)", "LessThanOrEqual(occupancy,100)"):
        assert pushed in plan


@pytest.mark.parametrize("report, columns", [
    (spatial.top10_slowest_roads, {"Road_EN", "District", *MEASURES}),
    (temporal.hourly_profile, {"hour", *MEASURES}),
    (flow.correlations, set(MEASURES)),
    (descriptive.overall_speed, {"speed"}),
    (flow.lane_capacity_estimates, {"lane_id", "volume"}),
])
def test_scans_read_only_what_is_used(stored, report, columns):
    for read in re.findall(r"ReadSchema: struct<([^>]*)>", physical(report(stored))):
        assert {c.split(":")[0] for c in read.split(",")} == columns


def test_rankings_do_not_sort_everything(stored):
    plan = physical(spatial.top10_busiest_roads(stored))
    assert "TakeOrderedAndProject(limit=10" in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("report", [
    descriptive.overall_volume, flow.road_capacity_estimates, flow.lane_capacity_estimates])
def test_percentiles_scan_once(stored, report):
    result = report(stored)
    result.collect()
    final = physical(result).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_several_distinct_counts_do_not_expand_the_input(stored):
    plan = physical(quality.spatial_coverage(stored))
    expand = plan.index("Expand")
    assert "HashAggregate(keys=[detector_id" in plan[expand:]  # combinations first, then expand


def test_unlocated_readings_are_rolled_up_before_the_join(spark, sf_dir):
    plan = physical(located_rollup(
        tables.readings(spark, sf_dir), tables.locations(spark, sf_dir)))
    assert plan.index("Join") < plan.index("HashAggregate")  # printed top down


def test_late_and_early_join_agree(spark, sf_dir):
    late = located_rollup(tables.readings(spark, sf_dir), tables.locations(spark, sf_dir))
    early = hourly_rollup(tables.clean(spark, sf_dir))
    assert set(late.columns) == set(early.columns)
    late = late.select(*early.columns)
    assert late.exceptAll(early).count() == 0 == early.exceptAll(late).count()


def test_one_partial_aggregation_before_each_shuffle(stored):
    plan = physical(stored.groupBy("lane_id").agg(F.count_if(C.severe())))
    assert "partial_count" in plan
