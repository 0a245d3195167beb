"""Flow theory: speed, volume and occupancy against each other; capacity; regimes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanepulse.functions import columns as C
from lanepulse.functions import fixed_values as V
from lanepulse.functions.measures import (
    MEASURES, ROWS, measures, need_cells, need_observations, need_quantiles, three_means,
)
from lanepulse.operators.distribution import describe_column
from lanepulse.operators.sampling import bernoulli_sample, key_sample


def _by_bins(clean, bins, *figures):
    """Group by one or more (name, column, rules) bins, in bin order.

    All values in a cell of a flow roll-up share their bin, so its smallest one names it.
    """
    need_cells(clean, "binned relation")
    suffix = "_min" if ROWS in clean.columns else ""
    keys = []
    for name, column, rules in bins:
        value = column + suffix
        keys += [C.bin_order(value, rules).alias(f"{name}_order"), C.bin_label(value, rules).alias(name)]
    orders = [f"{name}_order" for name, _, _ in bins]
    records = measures(clean).records().alias("record_count")
    return clean.groupBy(*keys).agg(records, *figures).orderBy(*orders)


def speed_volume_relationship(clean: DataFrame) -> DataFrame:
    m = measures(clean)
    return _by_bins(
        clean, [("volume_bin", "volume", V.VOLUME_BINS)],
        m.mean("speed").alias("avg_speed"), m.spread("speed").alias("std_speed"),
        m.mean("occupancy").alias("avg_occupancy"),
    )


def volume_occupancy_relationship(clean: DataFrame) -> DataFrame:
    m = measures(clean)
    return _by_bins(
        clean, [("occupancy_bin", "occupancy", V.OCCUPANCY_BINS)],
        m.mean("volume").alias("avg_volume"), m.mean("speed").alias("avg_speed"),
        m.spread("volume").alias("std_volume"),
    )


def speed_occupancy_relationship(clean: DataFrame) -> DataFrame:
    m = measures(clean)
    return _by_bins(
        clean, [("occupancy_bin", "occupancy", V.FINE_OCCUPANCY_BINS)],
        m.mean("speed").alias("avg_speed"), m.spread("speed").alias("std_speed"),
        m.mean("volume").alias("avg_volume"),
    )


def fundamental_diagram(clean: DataFrame) -> DataFrame:
    """Density against flow."""
    return _by_bins(
        clean,
        [("density_bin", "occupancy", V.DENSITY_BINS), ("flow_bin", "volume", V.FLOW_BINS)],
        *three_means(measures(clean)),
    )


def correlations(clean: DataFrame) -> DataFrame:
    need_observations(clean, "correlations")
    pairs = (("speed", "volume"), ("speed", "occupancy"), ("volume", "occupancy"))
    return clean.agg(*[F.corr(a, b).alias(f"{a}_{b}_corr") for a, b in pairs])


def scatter_sample(clean: DataFrame, fraction: float = 0.01, seed: int = 42, keys=()) -> DataFrame:
    """Points for a scatter plot: a random sample of rows, or with `keys` the rows whose keys
    hash below the fraction, the same on every run."""
    columns = ("volume", "occupancy", "speed")
    if keys:
        return key_sample(clean, fraction, *keys).select(*columns)
    return bernoulli_sample(clean.select(*columns), fraction, seed)


# --- capacity ---------------------------------------------------------------

def road_capacity_estimates(clean: DataFrame, k: int = 20, more_than: int = V.MIN_OBSERVATIONS,
                            **options) -> DataFrame:
    """Largest and 95th-percentile volume per road and lane."""
    need_quantiles(clean, "volume", "road_capacity_estimates")
    keys = ("Road_EN", "District", "lane_id")
    lanes = describe_column(
        clean, "volume", {"volume_95th": 0.95}, keys, carry={"speed": "avg_speed"}, **options
    ).filter(F.col("rows") > more_than)
    named = lanes.select(
        *keys, F.col("mean").alias("avg_volume"), F.col("max").alias("max_volume"), "volume_95th",
        F.col("rows").alias("observation_count"), "avg_speed",
    )
    return C.top(named, k, F.desc("max_volume"), *keys)


def lane_capacity_estimates(clean: DataFrame, **options) -> DataFrame:
    need_quantiles(clean, "volume", "lane_capacity_estimates")
    lanes = describe_column(
        clean, "volume", {"volume_95th": 0.95, "volume_90th": 0.90}, ("lane_id",), **options
    )
    named = lanes.select(
        "lane_id", F.col("mean").alias("avg_volume"), F.col("max").alias("max_volume"),
        "volume_95th", "volume_90th", F.col("rows").alias("observation_count"),
    )
    return C.top(named, None, F.desc("max_volume"), "lane_id")


# --- regimes ---------------------------------------------------------------

def _with_regime(clean):
    need_cells(clean, "flow regimes")
    return clean if ROWS in clean.columns else clean.withColumn("flow_regime", C.regime(strict=False))


def flow_regime_stats(clean: DataFrame) -> DataFrame:
    m = measures(clean)
    figures = [
        figure
        for name in MEASURES
        for figure in (m.mean(name).alias(f"avg_{name}"), m.spread(name).alias(f"std_{name}"))
    ]
    regimes = _with_regime(clean).groupBy("flow_regime").agg(m.records().alias("record_count"), *figures)
    return C.top(regimes, None, F.desc("record_count"), "flow_regime")


def _regimes_by(df, key):
    counts = df.groupBy(key, "flow_regime").agg(measures(df).records().alias("record_count"))
    return counts.orderBy(key, F.desc("record_count"), "flow_regime")


def lane_flow_regimes(clean: DataFrame) -> DataFrame:
    return _regimes_by(_with_regime(clean), "lane_id")


def hourly_flow_regimes(clean: DataFrame) -> DataFrame:
    return _regimes_by(C.with_hour(_with_regime(clean)), "hour")
