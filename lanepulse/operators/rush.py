"""Rush-hour rankings, as DataFrame code and as SQL text. Both give the same plan."""

from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanepulse.functions import columns as C
from lanepulse.functions import fixed_values as V
from lanepulse.functions.measures import measures, need_observations

ROAD = ("Road_EN", "District")
VIEW = "traffic_data"


def _on_known_roads(obs, window):
    return C.with_hour(obs.filter(F.col("Road_EN").isNotNull())).filter(C.in_window(window))


def busy_roads(obs: DataFrame, window, k: int = 10) -> DataFrame:
    m = measures(obs)
    roads = _on_known_roads(obs, window).groupBy(*ROAD).agg(
        m.total("volume").alias("total_volume"), m.total("occupancy").alias("total_occupancy")
    )
    return C.top(roads, k, F.desc("total_volume"), *ROAD)


def busy_roads_morning(obs: DataFrame) -> DataFrame:
    return busy_roads(obs, V.MORNING)


def busy_roads_evening(obs: DataFrame) -> DataFrame:
    return busy_roads(obs, V.EVENING)


def congestion(obs: DataFrame, window, k: int = 10) -> DataFrame:
    m = measures(obs)
    roads = _on_known_roads(obs, window).groupBy(*ROAD).agg(
        m.total("volume").alias("total_volume"),
        m.mean("occupancy").alias("avg_occupancy"),
        m.mean("speed").alias("avg_speed"),
        m.records().alias("observation_count"),
        m.flagged("severe").alias("severe_congestion_count"),
        m.flagged("moderate").alias("moderate_congestion_count"),
    )
    scored = roads.withColumn("congestion_score", C.congestion_score())
    return C.top(scored, k, F.desc("congestion_score"), *ROAD)


def congestion_morning(obs: DataFrame) -> DataFrame:
    return congestion(obs, V.MORNING)


def congestion_evening(obs: DataFrame) -> DataFrame:
    return congestion(obs, V.EVENING)


def high_occupancy_roads(obs: DataFrame, k: int = 20, above: float = V.HIGH_OCCUPANCY_PCT) -> DataFrame:
    """Roads whose occupancy per vehicle exceeds a percentage; roads without vehicles
    have no ratio and drop out."""
    need_observations(obs, "high_occupancy_roads")
    m = measures(obs)
    known = obs.dropna(subset=["Road_EN", "occupancy", "volume"])
    roads = known.groupBy(*ROAD).agg(
        m.total("volume").alias("total_volume"),
        C.percent(m.total("occupancy"), m.total("volume")).alias("avg_occupancy_pct"),
    ).filter(F.col("avg_occupancy_pct") > above)
    return C.top(roads, k, F.desc("avg_occupancy_pct"), *ROAD)


# --- SQL form ---------------------------------------------------------------

def register_view(obs: DataFrame, name: str = VIEW) -> None:
    """Name the observations for SQL, with their hour as a column to filter on."""
    C.with_hour(obs).createOrReplaceTempView(name)


def query_text(name: str) -> str:
    return resources.files("lanepulse.sql").joinpath(f"{name}.sql").read_text()


def run_sql(spark: SparkSession, text: str, **parameters) -> DataFrame:
    """Run SQL text with named parameters (``:start_hour`` and so on)."""
    return spark.sql(text, args=parameters or None)


def over(spark: SparkSession, obs: DataFrame, name: str, **parameters) -> DataFrame:
    """A packaged query over these observations: ``{obs}`` in its text is the frame itself, so
    queries of several threads never share a name."""
    return spark.sql(query_text(name), args=parameters, obs=C.with_hour(obs))


def busy_roads_sql(spark: SparkSession, obs: DataFrame, window) -> DataFrame:
    return over(spark, obs, "busy_roads", start_hour=window[0], end_hour=window[1], k=10)


def congestion_sql(spark: SparkSession, obs: DataFrame, window) -> DataFrame:
    return over(
        spark, obs, "congestion", start_hour=window[0], end_hour=window[1], k=10,
        severe_occupancy=V.SEVERE["occupancy_above"], severe_speed=V.SEVERE["speed_below"],
        moderate_occupancy=V.MODERATE["occupancy_above"], moderate_speed=V.MODERATE["speed_below"])


def high_occupancy_sql(spark: SparkSession, obs: DataFrame,
                       above: float = V.HIGH_OCCUPANCY_PCT) -> DataFrame:
    return over(spark, obs, "high_occupancy", above=above, k=20)
