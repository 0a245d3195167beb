"""Row sampling: a seeded Bernoulli sample, and one that depends on keys only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLOTS = 10_000


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Each row kept with the given probability, without replacement."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def key_sample(df: DataFrame, fraction: float, *keys: str) -> DataFrame:
    """Rows whose keys hash below the fraction: the same rows on every run, however
    the data is partitioned, and no shuffle."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    slot = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % _SLOTS
    return df.filter(slot < int(round(fraction * _SLOTS)))


def subset_ladder(df: DataFrame, *keys: str, steps=range(1, 10)) -> dict[int, DataFrame]:
    """Nested subsets of 10 % ... 90 %, by percentage: each one contains the smaller ones."""
    return {step * 10: key_sample(df, step / 10, *keys) for step in steps}
