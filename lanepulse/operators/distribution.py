"""Exact percentiles and moments of a column, from its value counts.

Detector measures take few distinct values, so counting values first shrinks the
data on the map side, and what meets in one task is at most the distinct values of a bucket:

1. count rows per (keys, value): ordinary partial + final aggregation, so a value
   or key that holds a third of all rows arrives pre-counted;
2. add the counts up per coarse bucket of the value, and run over the buckets to
   learn how many rows lie before each one;
3. run inside each bucket only, add the bucket's offset, and keep the value whose
   running count crosses the wanted rank.

Buckets are even steps of log(1 + |value|), so no column has more than about 1.5 million
of them, whatever its range, and neighbouring values of a wide column share one.
``accuracy`` switches to Spark's mergeable percentile sketch instead, and a roll-up with
quantile sketches (plans/sketches.py) is answered from those.
"""

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.functions.measures import QUANTILES, ROWS, RolledUp

STEPS = 1024


def _bucket(value: str) -> Column:
    """Bucket number; never falls while the value grows. NaN comes last, as in Spark."""
    number = F.col(value).cast("double")
    bucket = F.floor(F.signum(number) * F.log1p(F.abs(number)) * STEPS)
    return F.when(F.isnan(number), F.lit(2**63 - 1)).otherwise(bucket)


def _rank(share: float, total: str) -> Column:
    """ceil(share * total) in whole numbers."""
    exact = Fraction(str(share))
    return F.expr(f"({total} * {exact.numerator} + {exact.denominator - 1}) div {exact.denominator}")


def describe_column(df: DataFrame, value: str, shares: dict[str, float], keys=(), carry=None,
                    accuracy: int | None = None) -> DataFrame:
    """One row per key: rows, n, mean, std, min, max, total and the named percentiles.

    A percentile is the smallest value whose running count reaches ceil(share * n).
    ``carry`` maps a column to keep the mean of, from the same scan, to its output name.
    """
    keys, carry = list(keys), dict(carry or {})
    if ROWS in df.columns:
        return _describe_merged(df, value, shares, keys, carry)
    if accuracy is not None:
        return _describe_sketched(df, value, shares, keys, carry, accuracy)

    counts = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[agg for c in carry for agg in (F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))],
    ).withColumn("_bucket", _bucket(value))
    known = F.when(F.col(value).isNotNull(), F.col("_rows")).otherwise(0)
    sums = [f"_{kind}_{c}" for c in carry for kind in "sn"]

    per_key = Window.partitionBy(*[f"_k_{k}" for k in keys])
    earlier = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        counts.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"))
        .agg(F.sum(known).alias("_bn"), F.sum(F.col(value) * known).alias("_bs"),
             *[F.sum(c).alias(f"_b{c}") for c in sums])
        .withColumn("_before", F.coalesce(F.sum("_bn").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_bn").over(per_key))
        .withColumn("_mean", F.try_divide(F.sum("_bs").over(per_key).cast("double"), F.col("_total")))
    )
    for c in sums:
        buckets = buckets.withColumn(f"_t{c}", F.sum(f"_b{c}").over(per_key))

    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counts.join(buckets, same).withColumn("_n", known).withColumn(
        "_upto", F.col("_before") + F.sum("_n").over(inside)
    )

    def at(share):
        rank = _rank(share, "_total")
        crossing = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank) & (F.col("_n") > 0)
        return F.max(F.when(crossing, F.col(value)))

    def sum_of(column):
        # Known on both sides of the join. Asking both keeps their columns alike, so Spark
        # shuffles the value counts once and reuses them, and the input is scanned once.
        return F.coalesce(F.max(f"_t{column}"), F.sum(column))

    squares = F.sum(F.col("_n") * F.pow(F.col(value) - F.col("_mean"), 2))
    return ranked.groupBy(*keys).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.max("_mean").alias("mean"),
        F.sqrt(F.try_divide(squares, F.sum("_n") - 1)).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.sum(F.col(value) * F.col("_n")).alias("total"),
        *[at(share).alias(name) for name, share in shares.items()],
        *[F.try_divide(sum_of(f"_s_{c}").cast("double"), sum_of(f"_n_{c}")).alias(out)
          for c, out in carry.items()],
    )


def _describe_merged(rollup, value, shares, keys, carry):
    """The same row per key from stored parts and sketches. A percentile is a value that was
    seen, of the column's own type."""
    m, own_type = RolledUp(), rollup.schema[f"{value}_min"].dataType
    merged = rollup.groupBy(*keys).agg(
        m.records().alias("rows"), F.sum(f"{value}_n").alias("n"), m.mean(value).alias("mean"),
        m.spread(value).alias("std"), m.low(value).alias("min"), m.high(value).alias("max"),
        m.total(value).alias("total"), F.kll_merge_agg_double(value + QUANTILES).alias("_sketch"),
        *[m.mean(c).alias(out) for c, out in carry.items()],
    )

    def at(share):
        quantile = F.kll_sketch_get_quantile_double("_sketch", F.lit(float(share)))
        return F.when(F.col("n") > 0, quantile).cast(own_type)

    figures = ["rows", "n", "mean", "std", "min", "max", "total"]
    return merged.select(
        *keys, *figures, *[at(share).alias(name) for name, share in shares.items()], *carry.values())


def _describe_sketched(df, value, shares, keys, carry, accuracy):
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.sum(value).alias("total"),
        *[F.percentile_approx(value, share, accuracy).alias(name) for name, share in shares.items()],
        *[F.avg(c).alias(out) for c, out in carry.items()],
    )
