"""Aggregate expressions that read either observations or their roll-up.

A report asks for ``mean("speed")``; on observations that is ``avg(speed)``, on a
roll-up it is the merged sum over the merged count. One report definition then
serves both, and a set of reports costs one scan of the large table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse.functions import columns as C

MEASURES = ("speed", "volume", "occupancy")
ROWS = "n_rows"
# Endings of a roll-up's columns of sketches, and of values to count, after the column's name.
QUANTILES, DISTINCT = "_kll", "_seen"

# Keys of a flow roll-up: bin numbers of the finest bins in use, and both regimes.
CELLS = ("volume_cell", "occupancy_cell", "traffic_regime", "flow_regime")

# Conditions a roll-up keeps counts of.
FLAGS = {
    "severe": C.severe,
    "moderate": C.moderate,
    "free_flow": C.free_flow,
    "synchronized": C.synchronized,
    "jam": C.jam,
}


class Observed:
    """Aggregates over single observations."""

    def records(self) -> Column:
        return F.count(F.lit(1))

    def mean(self, name: str) -> Column:
        return F.avg(name)

    def total(self, name: str) -> Column:
        return F.sum(name)

    def low(self, name: str) -> Column:
        return F.min(name)

    def high(self, name: str) -> Column:
        return F.max(name)

    def spread(self, name: str) -> Column:
        return F.stddev(name)

    def flagged(self, flag: str) -> Column:
        return F.count_if(FLAGS[flag]())

    def distinct(self, name: str) -> Column:
        return F.count_distinct(name)


class RolledUp:
    """The same aggregates, merged from the parts a roll-up stores."""

    def records(self) -> Column:
        return F.sum(ROWS)

    def mean(self, name: str) -> Column:
        return F.try_divide(self.total(name).cast("double"), F.sum(f"{name}_n"))

    def total(self, name: str) -> Column:
        return F.sum(f"{name}_sum")

    def low(self, name: str) -> Column:
        return F.min(f"{name}_min")

    def high(self, name: str) -> Column:
        return F.max(f"{name}_max")

    def spread(self, name: str) -> Column:
        n, total = F.sum(f"{name}_n"), F.sum(f"{name}_sum").cast("double")
        part_sum, part_n = F.col(f"{name}_sum").cast("double"), F.col(f"{name}_n")
        between = F.sum(F.try_divide(part_sum * part_sum, part_n)) - F.try_divide(total * total, n)
        within = F.sum(f"{name}_m2")
        variance = F.try_divide(within + F.greatest(between, F.lit(0.0)), n - 1)
        return F.sqrt(variance)

    def flagged(self, flag: str) -> Column:
        return F.sum(f"{flag}_n")

    def distinct(self, name: str) -> Column:
        """Exact, from the values that the roll-up lists."""
        return F.count_distinct(name + DISTINCT)


def additive_parts(name: str) -> list[Column]:
    n = F.count(name)
    return [
        n.alias(f"{name}_n"),
        F.sum(name).alias(f"{name}_sum"),
        (F.var_pop(name) * n).alias(f"{name}_m2"),
        F.min(name).alias(f"{name}_min"),
        F.max(name).alias(f"{name}_max"),
    ]


def rollup_parts() -> list[Column]:
    """What a roll-up must store for ``RolledUp`` to work."""
    parts = [F.count(F.lit(1)).alias(ROWS), *[part for name in MEASURES for part in additive_parts(name)]]
    return parts + [F.count_if(flag()).alias(f"{key}_n") for key, flag in FLAGS.items()]


def measures(df: DataFrame) -> Observed | RolledUp:
    return RolledUp() if ROWS in df.columns else Observed()


def need_observations(df: DataFrame, what: str) -> None:
    if ROWS in df.columns:
        raise ValueError(f"{what} needs single observations, not a roll-up")


def need_quantiles(df: DataFrame, column: str, what: str) -> None:
    """Percentiles also come from a roll-up that keeps quantile sketches."""
    if column + QUANTILES not in df.columns:
        need_observations(df, what)


def need_cells(df: DataFrame, what: str) -> None:
    """Reports by measured value also take a roll-up whose rows never mix bins or regimes."""
    if ROWS in df.columns and not set(CELLS) <= set(df.columns):
        raise ValueError(f"{what} needs single observations or a flow roll-up, not this roll-up")


# Column sets most reports share.

def three_means(m) -> list[Column]:
    return [m.mean(name).alias(f"avg_{name}") for name in ("speed", "volume", "occupancy")]


def five_metrics(m) -> list[Column]:
    """The capitalised set of the descriptive summaries."""
    return [
        m.records().alias("Records"),
        m.mean("speed").alias("Avg_Speed"),
        m.mean("volume").alias("Avg_Volume"),
        m.mean("occupancy").alias("Avg_Occupancy"),
        m.total("volume").alias("Total_Volume"),
    ]
