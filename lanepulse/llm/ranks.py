"""Places in an order, without gathering a group in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.llm.stored import stored

PART_BITS = 33


def with_places(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """`rows` with `place` (from 0 within its group, in `order`) and `size` (rows of the group).

    Rows are range-partitioned and sorted, numbered within their partition and stored, so
    that a lost executor cannot number them anew. One row per group and partition then says
    how many rows of the group lie before the partition: partitions and groups in number,
    never rows. Ties end in the order of the input's rows, so even a third of all rows that
    are equal spreads over several partitions. Null groups are a group; nulls come where
    `order` puts them. An empty table stays empty.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*[F.col(g) for g in groups], *order, F.col("_tie")]
    spread = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    placed = stored(spread.withColumn("_at", F.monotonically_increasing_id()), "places")
    part = F.shiftrightunsigned("_at", PART_BITS)
    heads = placed.groupBy(*groups, part.alias("_part")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("size"))
    same = part == F.col("_part")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    found = placed.join(heads, same)
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_at") + F.col("_shift")).alias("place"), "size")
