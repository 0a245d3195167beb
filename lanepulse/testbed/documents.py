"""Nested reading documents, CSV lines and timing rows made from the events table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanepulse import schemas
from lanepulse.functions import fixed_values as V
from lanepulse.testbed.tables import table

PHASES = ("Initialize", "Read Data", "Clean Data", "Execute Analysis", "Cleanup", V.TOTAL_PHASE)


def _every(n: int) -> Column:
    return F.col("event_id") % n == 0


def _list(first: Column, second: Column, condition: Column) -> Column:
    return F.when(condition, F.array(first, second)).otherwise(F.array(first))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per event: one or two periods, detectors and lanes; every ninth has a
    speed that is no number."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")

    def lane(name, speed):
        return F.struct(
            F.lit(name).alias("lane_id"), speed.alias("speed"), k.alias("occupancy"),
            (F.col("event_id") % 131).cast("string").alias("volume"),
            ((F.col("event_id") % 17) * 0.5).cast("string").alias("s.d."),
            F.when(_every(67), "N").otherwise("Y").alias("valid"),
        )

    def detector(number, lanes):
        code = F.concat(F.lit("AID"), F.lpad(number.cast("string"), 5, "0"))
        return F.struct(
            code.alias("detector_id"), F.col("event_type").alias("direction"),
            F.struct(lanes.alias("lane")).alias("lanes"),
        )

    def period(later):
        start = F.col("ts") + F.expr(f"INTERVAL {later} SECOND")
        return F.struct(
            F.date_format(start, "HH:mm:ss").alias("period_from"),
            F.date_format(start + F.expr("INTERVAL 30 SECOND"), "HH:mm:ss").alias("period_to"),
            F.struct(detectors.alias("detector")).alias("detectors"),
        )

    fast = lane("Fast Lane", F.floor("value").cast("string"))
    slow = lane("Slow Lane", F.when(_every(9), "abc").otherwise(k))
    detectors = _list(
        detector(F.col("user_id"), _list(fast, slow, _every(3))),
        detector(F.col("user_id") + 1000, F.array(fast)),
        _every(4),
    )
    return events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.struct(_list(period(0), period(30), _every(5)).alias("period")).alias("periods"),
    )


def detector_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations for the text detector ids of ``documents``."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("AID"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("AID_ID_Number"),
        F.concat(F.lit("Road "), F.col("s_nationkey").cast("string")).alias("Road_EN"),
        F.when(F.col("s_nationkey") % 2 == 0, "Central & Western").otherwise("Southern").alias("District"),
    )


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as CSV text; every 101st line has text where a number belongs."""
    occupancy = F.when(_every(101), "many").otherwise(F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select(
        F.concat_ws(",", F.col("event_id").cast("string"), "event_type", occupancy).alias("value")
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.element_at(F.array(*map(F.lit, PHASES)), (F.col("event_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.concat((F.col("user_id") % 4 + 1).cast("string"), F.lit("_month")).alias("dataset_size"),
        (F.col("user_id") * 1000).alias("data_size_bytes"),
        F.col("event_id").alias("total_records"),
        F.col("event_type").alias("tool"),
        phase.alias("phase"),
        (F.floor(F.col("value") * 4) / 4).alias("duration_seconds"),
        (F.col("event_id") % 1000).alias("records_processed"),
        F.when(_every(97), "FAILED: lost task").otherwise("done").alias("details"),
    )
    return rows.select(*schemas.TIMINGS.names)
