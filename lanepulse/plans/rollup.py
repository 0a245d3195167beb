"""Two roll-ups that most reports share: one by hour and place, one by measured value.

The reports differ in what they group by, not in what they add up. One pass over the
observations stores the additive parts per hour and place; at two readings a minute that
is about a hundredth of the rows. Reports then read the roll-up: a year of 100 TB is
scanned once, not once per report.
"""

from pyspark.sql import DataFrame

from lanepulse.functions import columns as C
from lanepulse.functions import fixed_values as V
from lanepulse.functions.measures import rollup_parts
from lanepulse.operators.ingest import join_locations

READING_KEYS = ("date", "hour", "detector_id", "direction", "lane_id")
KEYS = READING_KEYS + ("Road_EN", "District", "GeometryEasting", "GeometryNorthing")


def hourly_rollup(obs: DataFrame, keys=KEYS) -> DataFrame:
    """Additive parts per key. The keys are fine-grained, so even a road or district with
    a third of all rows spreads over many groups, each pre-aggregated before the shuffle."""
    return C.with_hour(obs).groupBy(*keys).agg(*rollup_parts())


def located_rollup(readings: DataFrame, locations: DataFrame, salts: int = 1) -> DataFrame:
    """The roll-up of the cleaned observations, straight from readings without a location.

    The readings are cleaned and added up first, and only the roll-up's rows meet the
    locations: where those are not broadcast, a hundredth of the rows is shuffled.
    """
    usable = readings.filter(C.is_valid()).filter(C.in_range())
    located = join_locations(hourly_rollup(usable, READING_KEYS), locations, salts)
    return located.filter(C.road_known())


def flow_rollup(clean: DataFrame) -> DataFrame:
    """Additive parts per hour, lane, bin and regime: some ten thousand rows, whatever the
    input. The bins are the finest in use; every coarser edge is also an edge of theirs."""
    cells = {
        "volume_cell": C.bin_order("volume", V.VOLUME_BINS),
        "occupancy_cell": C.bin_order("occupancy", V.FINE_OCCUPANCY_BINS),
        "traffic_regime": C.regime(),
        "flow_regime": C.regime(strict=False),
    }
    return C.with_hour(clean).groupBy(
        "hour", "lane_id", *[cell.alias(name) for name, cell in cells.items()]
    ).agg(*rollup_parts())
