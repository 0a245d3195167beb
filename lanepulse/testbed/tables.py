"""Traffic-shaped views over the generic test tables (events, lineitem, supplier ...).

They stand in for a city's detector data: ``events`` rows become lane readings,
``supplier`` rows become detector locations.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanepulse.operators import ingest, quality

_schemas = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane readings without a location, with some invalid and implausible rows."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS detector_id",
        "CASE event_id % 5 WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'East' WHEN 3 THEN 'West' END "
        "AS direction",
        "event_type AS lane_id",
        "cast(get_json_object(props, '$.k') AS int) + if(event_id % 307 = 0, 100, 0) AS occupancy",
        # quarter km/h: sums are exact in binary, so no engine's summation order shows
        "floor(value * 4) / 4 AS speed",
        "cast(event_id % 131 - if(event_id % 211 = 0, 200, 0) AS int) AS volume",
        "if(event_id % 53 = 0, NULL, event_id % 17 * 0.5D) AS standard_deviation",
        "if(event_id % 67 = 0, 'N', 'Y') AS valid",
        "ts AS period_from",
        "ts + INTERVAL 30 SECOND AS period_to",
        "cast(ts AS date) AS date",
        "concat('file-', event_id % 20) AS source_file",
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per detector; every third detector has none."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = table(spark, sf_dir, "supplier").join(nation, F.expr("s_nationkey = n_nationkey"))
    return places.join(region, F.expr("n_regionkey = r_regionkey")).selectExpr(
        "s_suppkey AS AID_ID_Number",
        "n_name AS Road_EN",
        "r_name AS District",
        "s_suppkey * 10.0D AS GeometryEasting",
        "s_suppkey * 7.0D AS GeometryNorthing",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.join_locations(readings(spark, sf_dir), locations(spark, sf_dir))


def valid_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.valid_only(observations(spark, sf_dir))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_observations(observations(spark, sf_dir))


def long_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings over several years, for the month and season reports."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS detector_id",
        "l_linestatus AS direction",
        "l_returnflag AS lane_id",
        "cast(l_orderkey % 101 AS int) AS occupancy",
        "cast((l_partkey * 7 + l_linenumber) % 121 AS int) AS speed",
        "cast(l_quantity AS int) AS volume",
        "l_tax * 100 AS standard_deviation",
        "'Y' AS valid",
        "l_shipdate AS period_from",
        "l_shipdate + INTERVAL 30 SECOND AS period_to",
        "cast(l_shipdate AS date) AS date",
    )
    return ingest.join_locations(rows, locations(spark, sf_dir))


def clean_long_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_observations(long_span(spark, sf_dir))
