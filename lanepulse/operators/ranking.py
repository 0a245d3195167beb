"""Ranks over a whole column without one task that sorts it.

The column is cut at approximate quantiles into blocks, which need not be even to be right:
a value's rank is the rows of the blocks before its own plus those before it inside. Only the
cuts and one count per block, 256 of each at most, are ever in one place. Rows are counted per
value first, so a value that a third of all rows share is one row of its block.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 256


def value_ranks(rows: DataFrame, value: str) -> DataFrame:
    """One row per value of a numeric column: `value`, `below` (rows with a smaller one) and
    `total` (rows with one). NULL is no value. Reads `rows` three times, twice at once for the
    cuts and the sizes of blocks; store it first if it is dear."""
    known = rows.where(F.col(value).isNotNull()).select(value)
    cuts = known.approxQuantile(value, [i / BLOCKS for i in range(1, BLOCKS)], 1 / (8 * BLOCKS))
    block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= F.col(value))) if cuts else F.lit(0)
    sizes = {r["_block"]: r["count"] for r in known.groupBy(block.alias("_block")).count().collect()}
    before = [sum(n for b, n in sizes.items() if b < i) for i in range(BLOCKS)]
    counts = known.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", block)
    inside = F.sum("_n").over(Window.partitionBy("_block").orderBy(value)) - F.col("_n")
    offset = F.array(*[F.lit(n).cast("long") for n in before])[F.col("_block")]
    return counts.select(value, (offset + inside).alias("below"), F.lit(sum(sizes.values())).cast("long").alias("total"))


def with_percent_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """`rows` with the share, from 0 to 1, of the other values that are smaller. NULL has none
    and is not counted; a lone value has 0."""
    ranks = value_ranks(rows, value).select(
        F.col(value).alias("_value"), F.coalesce(F.try_divide("below", F.col("total") - 1), F.lit(0.0)).alias(name))
    return rows.join(ranks, F.col(value) == F.col("_value"), "left").drop("_value")
