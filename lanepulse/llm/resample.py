"""Importance resampling towards a target: hashed n-gram counts, weights, Gumbel draw.

Features are runs of one to three words, hashed into `BUCKETS` buckets. A feature's gain is the
scaled log ratio of its bucket's smoothed share in the target to that in the corpus; a
document's weight is the sum of its features' gains. Each document's weight plus Gumbel noise
from its id is its score, and the highest scores are drawn: sampling without replacement in
proportion to the weights.

Texts are worked on in blocks of at most `BLOCK_BYTES` (or one text): their bytes are joined
with sentinels that no word holds, one regular expression finds all words and sentinels,
`searchsorted` on the sentinels' places tells each word's document, and n-grams whose ends lie
in two documents are masked before `bincount`. A block is the bound of memory beside the
longest text. The checksum of a run of words is combined from those of its words: appending n
bytes is a linear map of the bits, kept as a table per n.

The corpus is read twice: for the counts (one row per bucket and task is shuffled, and
`BUCKETS` rows reach the driver), and for the weights. Ranks come from a range sort of the ids
and scores (`ranks.with_places`).

Defined results: a null or wordless text has no features and weight 0. Texts with fewer than
`MIN_WORDS` words are never drawn. Equal scores: the smaller id first, null ids last, then any
order. A null id draws its noise from an empty id. Repeated rows are weighed and drawn each.
An empty target or corpus counts as all zeros. Empty tables give empty results. Other columns
pass through; those this operator adds replace equally named ones.
"""

import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse.llm.ranks import with_places
from lanepulse.llm.stored import stored

BUCKETS, LONGEST = 10_000, 3
MIN_WORDS, PERCENT, SEED = 20, 5, 42
BLOCK_BYTES = 4 << 20
SENTINEL = b"\x00"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")  # bytes after lower-casing; letters beyond ASCII whole
MOST_BYTES = 64  # words of fewer bytes take the tables
ADDED = ("n_features", "weight", "score", "rank")


def _blocks(texts: pd.Series) -> Iterator[list[bytes]]:
    """The texts as lower-cased bytes, in lists of at most BLOCK_BYTES or one text."""
    block, size = [], 0
    for text in texts:
        data = (text or "").encode().lower().replace(SENTINEL, b" ")
        if block and size + len(data) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(data)
        size += len(data) + 1
    if block:
        yield block


def _appended() -> np.ndarray:
    """[n, byte of the checksum, its value]: the checksum's share after n more zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    tables = [np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    for _ in range(MOST_BYTES):
        tables.append(tables[-1] >> 8 ^ step[tables[-1] & 255])
    return np.stack(tables)


APPENDED = _appended()
SPACE_CRC = np.uint32(zlib.crc32(b" "))


def _moved(crc: np.ndarray | np.uint32, n: np.ndarray) -> np.ndarray:
    """Checksums after n more zero bytes, without the checksum of what follows."""
    return (APPENDED[n, 0, crc & 255] ^ APPENDED[n, 1, crc >> 8 & 255]
            ^ APPENDED[n, 2, crc >> 16 & 255] ^ APPENDED[n, 3, crc >> 24])


def features(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and text number and bucket of every feature of a block."""
    found = WORD.findall(SENTINEL.join(block))
    breaks = np.flatnonzero(np.fromiter(map(SENTINEL.__eq__, found), bool, len(found)))
    of = np.searchsorted(breaks, np.arange(len(found)))
    is_word = np.ones(len(found), bool)
    is_word[breaks] = False
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    crcs = np.fromiter(map(zlib.crc32, found), np.uint32, len(found))
    reach = np.minimum(sizes, MOST_BYTES - 1)
    spaced = _moved(SPACE_CRC, reach) ^ crcs  # of a space and the word
    owners, buckets, run, plain = [of[is_word]], [crcs[is_word] % BUCKETS], crcs, is_word
    for n in range(2, LONGEST + 1):
        count = len(found) - n + 1
        if count <= 0:
            break
        run = _moved(run[:count], reach[n - 1:] + 1) ^ spaced[n - 1:]
        for at in np.flatnonzero(sizes >= MOST_BYTES).tolist():  # words too long for the tables
            for i in range(max(0, at - n + 1), min(at, count - 1) + 1):
                run[i] = zlib.crc32(b" ".join(found[i: i + n]))
        plain = plain[:count] & is_word[n - 1:]
        whole = plain & (of[:count] == of[n - 1:])
        owners.append(of[:count][whole])
        buckets.append(run[whole] % BUCKETS)
    return (np.bincount(of[is_word], minlength=len(block)), np.concatenate(owners),
            np.concatenate(buckets).astype(np.int64))


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of the whole table fall into each bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for block in _blocks(batch.iloc[:, 0]):
                total += np.bincount(features(block)[2], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used.astype(np.int32), "n": total[used]})

    counts = docs.select(F.col(f"`{text}`")).mapInPandas(count, "bucket int, n long")
    result = np.zeros(BUCKETS, np.int64)
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        result[row["bucket"]] = row["n"]
    return result


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of the smoothed shares of each bucket, rounded down."""
    all_corpus, all_target = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([
        math.floor(1000 * math.log((float(t) + 1) * all_corpus / ((float(s) + 1) * all_target)))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(texts: pd.Series, gain: np.ndarray) -> pd.DataFrame:
    """Words, features and weight of each text."""
    parts = []
    for block in _blocks(texts):
        words, owners, buckets = features(block)
        weight = np.bincount(owners, weights=gain[buckets], minlength=len(block)).astype(np.int64)  # exact below 2^53
        parts.append(pd.DataFrame({
            "n_words": words, "n_features": np.bincount(owners, minlength=len(block)), "weight": weight}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(
        {c: np.zeros(0, np.int64) for c in ("n_words", "n_features", "weight")})


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * F.lit(-1000.0))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id",
             target_text: str = "text", percent: int = PERCENT, seed: int = SEED,
             keep: Sequence[str] | None = None) -> DataFrame:
    """Documents with n_features, weight, score and rank; rank numbers the drawn ones from 1 and
    is null for the others. `percent` of the documents with enough words are drawn. `keep` names
    the columns to pass through (all, if None); they are written once and sorted by score."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield weighed(texts, gain)

    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"),
                         F.col(f"`{doc_id}`").alias("_id"), weigh(F.col(f"`{text}`")).alias("_w"))
    rows = stored(judged.select(
        "_doc", "_id", "_w.n_words", "_w.n_features", "_w.weight",
        (F.col("_w.weight") + noise(F.col("_id"), seed)).alias("score")), "weighed")
    able = rows.where(F.col("n_words") >= MIN_WORDS)
    placed = with_places(able, [], [F.desc("score"), F.asc_nulls_last("_id")])
    drawn = F.expr(f"place < ({int(percent)} * size) div 100")
    shown = [*[F.col(f"_doc.`{c}`").alias(c) for c in kept], "n_features", "weight", "score"]
    ranked = placed.select(*shown, F.when(drawn, F.col("place") + 1).alias("rank"))
    rest = rows.where(F.col("n_words") < MIN_WORDS).select(*shown, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)
