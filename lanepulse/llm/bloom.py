"""Blocked Bloom filters made of built-in expressions.

One block of eight 32-bit words per key, one bit set in each word. A filter has at most
`MAX_BLOCKS` blocks, so the table that is broadcast is bounded (40 bytes a block) whatever the
number of keys; more keys make it fuller and so let more through, never less.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, WORD_BITS = 8, 32
KEYS_PER_BLOCK = 16
MAX_BLOCKS = 1 << 17


def _probe(key: list[Column]) -> tuple[Column, list[Column]]:
    """Two hashes: one picks the block, eight five-bit fields of the other the bits."""
    bits = F.xxhash64(*key, F.lit(1))
    return F.xxhash64(*key), [
        F.call_function("shiftleft", F.lit(1), F.shiftright(bits, 5 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int"))
        for i in range(WORDS)
    ]


def block_count(keys: int, most: int = MAX_BLOCKS) -> int:
    return min(most, 1 << (max(1, keys // KEYS_PER_BLOCK) - 1).bit_length())


def bloom_blocks(keys: DataFrame, key: list[str], blocks: int) -> DataFrame:
    """(_block, _w0.._w7): the filter of some columns, combined before the shuffle."""
    hashed, bits = _probe([F.col(k) for k in key])
    return (
        keys.select(F.pmod(hashed, F.lit(blocks)).alias("_block"), *[b.alias(f"_w{i}") for i, b in enumerate(bits)])
        .groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])
    )


def with_hits(rows: DataFrame, key: list[str], keys: DataFrame, keys_key: list[str], most: int = MAX_BLOCKS) -> DataFrame:
    """`rows` with `_hit`: false only where the key is surely not among `keys`."""
    blocks = block_count(keys.count(), most)
    bloom = F.broadcast(bloom_blocks(keys, keys_key, blocks))
    hashed, bits = _probe([F.col(k) for k in key])
    probed = rows.join(bloom, F.pmod(hashed, F.lit(blocks)) == F.col("_block"), "left")
    hit = F.lit(True)
    for i, bit in enumerate(bits):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(bit) != 0)
    return probed.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(hit, F.lit(False)).alias("_hit"))
