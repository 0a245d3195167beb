"""Connected components of a link table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanepulse.llm.stored import held


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in `links` (a, b): the component is its least node.

    Two star steps per round: each node hands its larger neighbours to the least of its
    neighbourhood, then its smaller ones. Both are a grouped minimum and a join, so no
    neighbourhood is gathered anywhere and a hub is split like any skewed join key; the
    number of rounds grows with the logarithm of the longest chain. Rounds end when the
    links no longer change, judged by their count and sum of hashes. Each round is written
    to the shared folder. Null ends are ignored; nodes without links are not returned.
    """

    def tidy(df):
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = held(tidy(links.where("a IS NOT NULL AND b IS NOT NULL")))
    before, after = None, mark(now)
    while before != after:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = tidy(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = held(tidy(small.unionByName(least.select("a", F.col("m").alias("b")))))
        before, after = after, mark(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("b").alias("component")))
