"""Will a detector's next hour be slow? A logistic model on calendar and lag features.

A row looks back only: at its own hour and at hours before it. The rows are split by time, the
first part teaches and the rest is predicted, so no later hour tells of an earlier one.
"""

from math import pi

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.functions import columns as C
from lanepulse.sources import shared

FEATURES = (
    "avg_speed", "speed_1h", "speed_24h", "speed_7d", "speed_alike", "avg_occupancy", "hour_sin", "hour_cos", "is_weekend",
)


def forecast_rows(clean: DataFrame, below: float = 40.0) -> DataFrame:
    """Hourly features per detector with the label `next_congested`, NULL where the next hour
    has no readings. A lag without readings takes the present hour's speed. `speed_alike` is
    the mean of earlier hours that come before the same hour and day of week as the next one.
    Hours without a date or a speed are left out."""
    hours = C.with_hour(clean).where("date IS NOT NULL").groupBy("detector_id", "date", "hour").agg(
        F.avg("speed").alias("avg_speed"), F.avg("occupancy").alias("avg_occupancy")).where("avg_speed IS NOT NULL")
    clocked = hours.withColumn("at", F.unix_date("date").cast("long") * 24 + F.col("hour")).withColumn("week_hour", F.col("at") % 168)
    clock = Window.partitionBy("detector_id").orderBy("at")
    mean = lambda a, b: F.avg("avg_speed").over(clock.rangeBetween(a, b))
    following = mean(1, 1)
    labelled = clocked.withColumn("following", following)
    alike = Window.partitionBy("detector_id", "week_hour").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    lag = lambda a, b: F.coalesce(mean(a, b), "avg_speed")
    angle = F.col("hour") * (2 * pi / 24)
    return labelled.select(
        "detector_id", "date", "hour", "at", "avg_speed", lag(-1, -1).alias("speed_1h"), lag(-24, -24).alias("speed_24h"),
        lag(-168, -1).alias("speed_7d"), F.coalesce(F.avg("following").over(alike), "avg_speed").alias("speed_alike"),
        F.coalesce("avg_occupancy", F.lit(0.0)).alias("avg_occupancy"), F.sin(angle).alias("hour_sin"),
        F.cos(angle).alias("hour_cos"), F.dayofweek("date").isin(1, 7).cast("int").alias("is_weekend"),
        (F.col("following") < below).alias("next_congested"))


def next_hour_forecast(clean: DataFrame, below: float = 40.0, taught_share: float = 0.8) -> DataFrame:
    """Predictions for the hours after the first `taught_share` of the time span, with the
    probability of a slow next hour. The model is fitted without randomness; a label that
    is not known yet does not keep an hour from being predicted. ValueError if no hour before
    the cut has a label."""
    rows = shared.stored(forecast_rows(clean, below), "forecast")
    cut = rows.agg(F.min("at") + (F.max("at") - F.min("at")) * taught_share).scalar()
    # The last hour before the cut has its label from beyond it.
    taught = rows.where((F.col("at") + 1 < cut) & F.col("next_congested").isNotNull()).withColumn(
        "label", F.col("next_congested").cast("double"))
    if taught.isEmpty():
        raise ValueError("no hour before the cut has a known next hour")
    model = Pipeline(stages=[
        VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
        LogisticRegression(maxIter=50, regParam=0.001),
    ]).fit(taught)
    scored = model.transform(rows.where(F.col("at") >= cut))
    return scored.select(
        "detector_id", "date", "hour", "next_congested", (F.col("prediction") == 1).alias("predicted"),
        vector_to_array("probability")[1].alias("probability"))


def forecast_quality(predictions: DataFrame) -> DataFrame:
    """Hours per actual and predicted class, where the actual one is known."""
    return predictions.where("next_congested IS NOT NULL").groupBy("next_congested", "predicted").agg(
        F.count(F.lit(1)).alias("hours"), F.avg("probability").alias("mean_probability"))
