"""Roads whose hourly speeds go together, at once or some hours later.

All pairs of roads are too many, so each road is compared with those near it in several sorted
lists. A road's standardised series becomes 64 random projections; a bit says on which side of
all roads' mean a projection lies, so a daily pattern that all roads share does not count. Each
list sorts the bits from another start, and a road's candidates are the `reach` roads on either
side: a fixed number for every road, however many are alike. Candidates get their exact Pearson
correlation over the hours both have. Tables of up to `reach` + 1 roads are searched whole. On
larger ones the share of true partners found falls with the number of roads, and `lists` raises
it: for roads in groups of 12, eight lists with a reach of 16 find 95 % among 300 (a test holds
90 %), and 16 lists with a reach of 32 find 92 % among 3,000 (simulated).

Roads without a name and without any change of speed take no part.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.functions import columns as C
from lanepulse.operators.ranking import value_ranks
from lanepulse.sources import shared

ROAD = ("Road_EN", "District")
BITS = 64
#: An order value holds the list's number, 32 bits of the signature and 23 of the road's hash.
SIGN_BITS, TIE_BITS, MOST_LISTS = 32, 23, 255


def _hourly(clean: DataFrame, keys) -> DataFrame:
    named = clean.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    at = F.unix_date("date").cast("long") * 24 + F.col("hour")
    return C.with_hour(named.where("date IS NOT NULL AND speed IS NOT NULL")).groupBy(
        F.struct(*keys).alias("road"), at.alias("at")).agg(F.avg("speed").alias("speed"))


def _signatures(hours: DataFrame, longest_lag: int) -> DataFrame:
    """`road`, `lag` and `sign`: the bits of the road's series `lag` hours on."""
    moments = hours.groupBy("road").agg(F.avg("speed").alias("mean"), F.stddev_pop("speed").alias("sd")).where("sd > 0")
    z = (F.col("speed") - F.col("mean")) / F.col("sd")
    lags = F.explode(F.sequence(F.lit(0), F.lit(longest_lag))).alias("lag")
    moved = hours.join(moments, "road").select("road", "at", z.alias("z"), lags).withColumn(
        "code", F.xxhash64(F.col("at") - F.col("lag")))

    def bit(column, j):
        return F.shiftrightunsigned(column, j).bitwiseAND(F.lit(1).cast("long"))

    sums = [F.sum(F.when(bit(F.col("code"), j) == 1, F.col("z")).otherwise(-F.col("z"))).alias(f"p{j}") for j in range(BITS)]
    projected = shared.stored(moved.groupBy("road", "lag").agg(*sums), "projections")
    middle = projected.where("lag = 0").agg(F.array(*[F.avg(f"p{j}") for j in range(BITS)])).scalar()
    signs = projected.withColumn("middle", middle)
    sides = [F.shiftleft((F.col(f"p{j}") > F.col("middle")[j]).cast("long"), j) for j in range(BITS)]
    return signs.select("road", "lag", reduce(Column.bitwiseOR, sides).alias("sign"))


def _candidates(hours: DataFrame, longest_lag: int, lists: int, reach: int) -> DataFrame:
    """Distinct ordered pairs of roads `a` and `b`, near each other in some list; for lags the
    bits of `a` lie near those of `b` moved."""
    if lists * (longest_lag + 1) > MOST_LISTS or min(lists, reach) < 1 or longest_lag < 0:
        raise ValueError(f"lists * (lags + 1) is up to {MOST_LISTS}, lists and reach at least 1")
    signs = _signatures(hours, longest_lag)
    still = signs.where("lag = 0").select(
        "road", "sign", F.lit(False).alias("moved"), F.explode(F.sequence(F.lit(0), F.lit(longest_lag))).alias("lag"))
    rows = still.unionByName(signs.where("lag > 0").withColumn("moved", F.lit(True)))
    turns = F.explode(F.array(*[
        F.struct(F.lit(n).alias("n"), F.expr(f"shiftleft(sign, {s}) | shiftrightunsigned(sign, {BITS - s})" if s else "sign").alias("bits"))
        for n, s in ((n, n * BITS // lists) for n in range(lists))])).alias("turn")
    listed = rows.select("road", "moved", "lag", turns).select(
        "road", "moved", "lag", (F.col("lag") * lists + F.col("turn.n")).cast("long").alias("list"), "turn.bits")
    order = F.shiftleft("list", SIGN_BITS + TIE_BITS).bitwiseOR(
        F.shiftleft(F.shiftrightunsigned("bits", BITS - SIGN_BITS), TIE_BITS)).bitwiseOR(
        F.shiftrightunsigned(F.xxhash64("road", "list"), BITS - TIE_BITS))
    placed = shared.stored(listed.select("road", "moved", "lag", "list", order.alias("order")), "lists")
    width = F.when(F.col("lag") > 0, 2 * reach).otherwise(reach)  # half of a moved list is of the other kind
    ranked = placed.join(value_ranks(placed, "order"), "order").select(
        "road", "moved", "list", "below", width.alias("width")).withColumn("block", F.expr("below div width"))
    left = ranked.alias("l")
    right = ranked.withColumn("block", F.explode(F.array("block", F.col("block") - 1))).alias("r")
    near = left.join(right, F.expr(
        "l.list = r.list AND l.block = r.block AND r.below >= l.below AND r.below - l.below <= l.width "
        "AND l.road != r.road AND (l.width = %d OR l.moved != r.moved)" % reach))
    first, second = F.col("l.road"), F.col("r.road")
    ends = F.when(F.col("l.moved"), F.array(F.struct(second.alias("a"), first.alias("b")))).when(
        F.col("r.moved"), F.array(F.struct(first.alias("a"), second.alias("b")))).otherwise(
        F.array(F.struct(first.alias("a"), second.alias("b")), F.struct(second.alias("a"), first.alias("b"))))
    return near.select(F.explode(ends).alias("p")).select("p.a", "p.b").distinct()


def _measured(pairs: DataFrame, hours: DataFrame, fewest: int) -> DataFrame:
    """`a`, `b`, `lag` with the correlation of a's hours and b's `lag` hours on, and their number."""
    x = hours.select(F.col("road").alias("a"), F.col("at").alias("x_at"), F.col("speed").alias("x"))
    y = hours.select(F.col("road").alias("b"), F.col("at").alias("y_at"), F.col("speed").alias("y"))
    both = pairs.join(x, "a").withColumn("y_at", F.col("x_at") + F.col("lag")).join(y, ["b", "y_at"])
    return both.groupBy("a", "b", "lag").agg(
        F.corr("x", "y").alias("correlation"), F.count(F.lit(1)).alias("hours")).where(
        (F.col("hours") >= fewest) & F.col("correlation").isNotNull())


def _best(measured: DataFrame, keys, partners: int, left: str, right: str, *columns: str) -> DataFrame:
    """The best partners of each `a`; a road has at most 2 * reach per list to choose from."""
    best = Window.partitionBy("a").orderBy(F.desc("correlation"), "b")
    kept = measured.withColumn("place", F.row_number().over(best)).where(F.col("place") <= partners)
    return kept.select(*[F.col(f"a.{k}").alias(left + k) for k in keys], *[F.col(f"b.{k}").alias(right + k) for k in keys],
                       "place", *columns, "correlation", "hours")


def road_speed_correlation(clean: DataFrame, partners: int = 10, keys=ROAD, lists: int = 16, reach: int = 32,
                           fewest: int = 24) -> DataFrame:
    """Each road's `partners` best correlated others, over at least `fewest` common hours; equal
    ones by name. Two roads are measured once."""
    hours = shared.stored(_hourly(clean, keys), "hours")
    pairs = _candidates(hours, 0, lists, reach).where("a < b").withColumn("lag", F.lit(0))
    once = _measured(pairs, hours, fewest)
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    both = once.select(ways, "correlation", "hours").select("way.a", "way.b", "correlation", "hours")
    return _best(both, keys, partners, "", "partner_")


def shifted_correlation(clean: DataFrame, longest_lag: int = 3, partners: int = 10, keys=ROAD, lists: int = 16,
                        reach: int = 32, fewest: int = 24) -> DataFrame:
    """Roads that follow each road, with the lag from 0 to `longest_lag` hours at which they do
    best (the shortest of equal ones); a pair near each other at any lag is measured at all."""
    hours = shared.stored(_hourly(clean, keys), "hours")
    pairs = _candidates(hours, longest_lag, lists, reach).withColumn(
        "lag", F.explode(F.sequence(F.lit(0), F.lit(longest_lag))))
    measured = _measured(pairs, hours, fewest)
    top = F.max_by(F.struct("lag", "correlation", "hours"), F.struct("correlation", -F.col("lag"))).alias("top")
    best = measured.groupBy("a", "b").agg(top).select(
        "a", "b", F.col("top.lag").alias("lag_hours"), "top.correlation", "top.hours")
    return _best(best, keys, partners, "", "follower_", "lag_hours")
