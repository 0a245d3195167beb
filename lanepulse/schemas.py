"""Canonical table schemas."""

from pyspark.sql import types as T

_S = T.StringType()


def _strings(*names):
    return [T.StructField(n, _S) for n in names]


LANE = T.StructType(_strings("lane_id", "speed", "occupancy", "volume", "s.d.", "valid"))
DETECTOR = T.StructType(
    _strings("detector_id", "direction")
    + [T.StructField("lanes", T.StructType([T.StructField("lane", T.ArrayType(LANE))]))]
)
PERIOD = T.StructType(
    _strings("period_from", "period_to")
    + [T.StructField("detectors", T.StructType([T.StructField("detector", T.ArrayType(DETECTOR))]))]
)

# One reading file. Leaves stay text, so one bad number costs one cell, not one
# file; the arrays are explicit, so an element that occurs once is still an array.
READING_DOCUMENT = T.StructType(
    _strings("date")
    + [T.StructField("periods", T.StructType([T.StructField("period", T.ArrayType(PERIOD))]))]
)

READINGS = T.StructType(
    _strings("detector_id", "direction", "lane_id")
    + [
        T.StructField("occupancy", T.IntegerType()),
        T.StructField("speed", T.IntegerType()),
        T.StructField("volume", T.IntegerType()),
        T.StructField("standard_deviation", T.DoubleType()),
        T.StructField("valid", _S),
        T.StructField("period_from", T.TimestampType()),
        T.StructField("period_to", T.TimestampType()),
        T.StructField("date", T.DateType()),
    ]
)

LOCATIONS = T.StructType(
    [T.StructField("OBJECTID", T.IntegerType())]
    + _strings("AID_ID_Number", "Location", "District", "Road_EN", "Road_TC", "Road_SC", "Direction")
    + [
        T.StructField("Rotation", T.DoubleType()),
        T.StructField("GeometryEasting", T.DoubleType()),
        T.StructField("GeometryNorthing", T.DoubleType()),
    ]
)

# Columns the location join adds to a reading.
LOCATION_COLUMNS = (
    "District", "Road_EN", "Road_TC", "Road_SC", "Rotation", "GeometryEasting", "GeometryNorthing",
)

OBSERVATIONS = T.StructType(
    READINGS.fields
    + [T.StructField(n, LOCATIONS[n].dataType) for n in LOCATION_COLUMNS]
    + _strings("source_file")
)

TIMINGS = T.StructType(
    _strings("timestamp", "dataset_size")
    + [
        T.StructField("data_size_bytes", T.LongType()),
        T.StructField("total_records", T.LongType()),
        T.StructField("tool", _S),
        T.StructField("phase", _S),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("records_processed", T.LongType()),
        T.StructField("details", _S),
    ]
)
