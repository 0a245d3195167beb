"""Column builders: small named expressions shared by the reports."""

import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.functions import fixed_values as V

_COMPARE = {"==": operator.eq, "<=": operator.le, "<": operator.lt}


# --- time --------------------------------------------------------------------

def with_hour(df: DataFrame) -> DataFrame:
    """Use the stored hour where the table has one (its filters then reach the scan)."""
    return df if "hour" in df.columns else df.withColumn("hour", F.hour("period_from"))


def in_window(window) -> Column:
    """Half-open hour window: start <= hour < end."""
    start, end = window
    return (F.col("hour") >= start) & (F.col("hour") < end)


def in_window_inclusive(window) -> Column:
    """Hour window with both ends: start <= hour <= end."""
    return F.col("hour").between(*window)


def in_either_rush() -> Column:
    return in_window(V.MORNING) | in_window(V.EVENING)


def in_period(start, end) -> Column:
    """Readings that lie wholly between two points in time."""
    return (F.col("period_from") >= F.lit(start)) & (F.col("period_to") <= F.lit(end))


def day_of_week() -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek("date")


def day_name() -> Column:
    return F.element_at(F.array(*map(F.lit, V.DAY_NAMES)), day_of_week())


def is_weekend_day() -> Column:
    return day_of_week().isin(1, 7)


def weekend_label() -> Column:
    return F.when(is_weekend_day(), "Weekend").otherwise("Weekday")


def season_label(month: Column) -> Column:
    *named, (rest, _) = V.SEASONS
    label = F
    for name, months in named:
        label = label.when(month.isin(*months), name)
    return label.otherwise(rest)


def season_order(season: Column) -> Column:
    return F.array_position(F.array(*[F.lit(name) for name, _ in V.SEASONS]), season)


# --- conditions ----------------------------------------------------------------

def is_valid() -> Column:
    return F.col("valid") == "Y"


def speed_outlier() -> Column:
    return ~F.col("speed").between(*V.SPEED_RANGE)


def volume_outlier() -> Column:
    return F.col("volume") < V.VOLUME_MIN


def occupancy_outlier() -> Column:
    return ~F.col("occupancy").between(*V.OCCUPANCY_RANGE)


def in_range() -> Column:
    """All measures present and within their limits."""
    return (
        F.col("speed").between(*V.SPEED_RANGE)
        & (F.col("volume") >= V.VOLUME_MIN)
        & F.col("occupancy").between(*V.OCCUPANCY_RANGE)
    )


def road_known() -> Column:
    return F.col("Road_EN").isNotNull()


def plausible() -> Column:
    """Measures in range and road known; a missing measure is not plausible."""
    return in_range() & road_known()


def _congested(limits) -> Column:
    return (F.col("occupancy") > limits["occupancy_above"]) & (F.col("speed") < limits["speed_below"])


def severe() -> Column:
    return _congested(V.SEVERE)


def moderate() -> Column:
    """Includes the severe readings."""
    return _congested(V.MODERATE)


def free_flow() -> Column:
    return (F.col("speed") > V.FREE_SPEED_ABOVE) & (F.col("occupancy") < V.FREE_OCCUPANCY_BELOW)


def synchronized(strict: bool = True) -> Column:
    """Middle speeds; the strict form also wants middle occupancy."""
    speed = F.col("speed").between(*V.SYNC_SPEED)
    return speed & F.col("occupancy").between(*V.SYNC_OCCUPANCY) if strict else speed


def jam() -> Column:
    return (F.col("speed") < V.JAM_SPEED_BELOW) & (F.col("occupancy") > V.JAM_OCCUPANCY_ABOVE)


def regime(strict: bool = True) -> Column:
    """Flow regime. The two reports that use it differ in the synchronized rule
    and in the name of the slow class; ``strict`` picks the one with both bounds."""
    slow = V.WIDE_JAM if strict else V.CONGESTED
    return (
        F.when(free_flow(), V.FREE_FLOW)
        .when(synchronized(strict), V.SYNCHRONIZED)
        .when(jam(), slow)
        .otherwise(V.TRANSITIONAL)
    )


# --- bins ------------------------------------------------------------------------

def _pick(value: Column, rules, outputs) -> Column:
    chain = F.when(value.isNull(), F.lit(None))
    for (_, sign, bound), out in zip(rules, outputs):
        if sign is None:
            return chain.otherwise(out)
        chain = chain.when(_COMPARE[sign](value, bound), out)
    return chain


def bin_label(name: str, rules) -> Column:
    """Label of the first rule that holds; a missing value has no bin."""
    return _pick(F.col(name), rules, [label for label, _, _ in rules])


def bin_order(name: str, rules) -> Column:
    """Position of the bin, so results sort by size and not by label text."""
    return _pick(F.col(name), rules, range(1, len(rules) + 1))


# --- scores ------------------------------------------------------------------------

def congestion_index(speed="avg_speed", occupancy="avg_occupancy") -> Column:
    """Half occupancy, half missing speed."""
    return F.col(occupancy) * 0.5 + (100 - F.col(speed)) * 0.5


def congestion_score(speed="avg_speed", occupancy="avg_occupancy",
                     severe_count="severe_congestion_count", records="observation_count") -> Column:
    """40 % occupancy, 30 % missing speed, 30 % share of severe readings."""
    severe_pct = F.try_divide(F.col(severe_count), F.col(records)) * 100
    return F.col(occupancy) * 0.4 + (100 - F.col(speed)) * 0.3 + severe_pct * 0.3


def percent_of_total(name: str) -> Column:
    """Share of a grouped (so few-row) result's own total, in percent."""
    return F.col(name) / F.sum(name).over(Window.partitionBy()) * 100


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


# --- shape ---------------------------------------------------------------------------

def top(df: DataFrame, k: int | None, order, *keys: str) -> DataFrame:
    """First k rows in the given order; the keys settle ties, so reruns agree."""
    ranked = df.orderBy(order, *[F.col(key).asc_nulls_first() for key in keys])
    return ranked if k is None else ranked.limit(k)
