"""SimHash near-duplicates: fingerprints, pigeonring candidates, components.

A fingerprint is cut into eight ring segments of eight bits. If two fingerprints differ in at
most three bits, some segment starts a chain in which the first l segments together differ in
at most floor(3 l / 8) bits, for every l: none in the first two, at most one in the first
five, two in the first seven, three in all. A chain of five with at most one bit has four
segments that agree, among them the first two, so (start, which of the other three may
differ, the four segments) is an exact key of 32 bits. Each distinct fingerprint has 24 such
keys. Fingerprints that share a key are tested by their chains of six and seven, then by the
full distance.

A key shared by more than `LIMIT` fingerprints is cut further instead of compared: its other
32 bits are eight groups of four, of which at least five agree between linked fingerprints,
so each fingerprint gets a key for each choice of five (56). Such a key fixes 52 bits, so at
most 4,096 fingerprints share it. No group is ever compared beyond that bound, none is
dropped, and a group yields a spanning set of links instead of its pairs.

Equal fingerprints are grouped first, so copies cost nothing here.

Defined results: a null or wordless text has fingerprint zero and links like any other. Rows
with the same doc_id stay separate rows with the same component. A null doc_id never names a
component unless all members are null. Empty tables give empty results.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.llm.bloom import with_hits
from lanepulse.llm.links import components
from lanepulse.llm.stored import held

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 3
SEGMENTS, SEGMENT_BITS = 8, 8
LIMIT = 4096
BLOCK = 1 << 16
NIBBLES = [np.uint64(0xF << (4 * i)) for i in range(8)]


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII space are meant
    if not words:
        return 0
    n, joined = max(1, len(words) - width + 1), b" ".join(words)
    if len(words) <= width:
        starts, ends = [0], [len(joined)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(lengths + 1) - 1
        starts, ends = (stop - lengths)[:n].tolist(), stop[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        part = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)],
            np.uint64,
        )
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit column."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return of(docs[text])


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    return (fp >> np.uint64(SEGMENT_BITS * (i % SEGMENTS))) & np.uint64(0xFF)


def _ring_keys(fp: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, free segment, the four segments that must agree) for all 24 choices."""
    for start in range(SEGMENTS):
        for free in (2, 3, 4):
            key = np.zeros(len(fp), np.uint64)
            for step in (0, 1, 2, 3, 4):
                if step != free:
                    key = (key << np.uint64(8)) | _segment(fp, start + step)
            yield start, free, key


def _ring_filter(diff: np.ndarray, start: int) -> np.ndarray:
    """Chains of six and seven from `start` differ in two bits at most, the whole in three."""
    turned = (diff >> np.uint64(8 * start)) | (diff << np.uint64((64 - 8 * start) % 64)) if start else diff
    chains = np.bitwise_count(turned & np.uint64((1 << 48) - 1)) <= 2
    chains &= np.bitwise_count(turned & np.uint64((1 << 56) - 1)) <= 2
    return chains & (np.bitwise_count(diff) <= DISTANCE)


def _spanning(fps: np.ndarray, start: int) -> tuple[list[int], list[int]]:
    """Links that connect whatever is linked inside one group: each fingerprint still unseen is
    compared with the group at once, and only links to unseen ones are kept."""
    left, right, unseen = [], [], np.ones(len(fps), bool)
    for first in range(len(fps)):
        if not unseen[first]:
            continue
        unseen[first] = False
        queue = [first]
        while queue:
            at = queue.pop()
            others = np.flatnonzero(unseen)
            near = others[_ring_filter(fps[others] ^ fps[at], start)] if start >= 0 else others[
                np.bitwise_count(fps[others] ^ fps[at]) <= DISTANCE]
            unseen[near] = False
            left += [fps[at]] * len(near)
            right += list(fps[near])
            queue += near.tolist()
    return left, right


def _cut(slot: int, fps: np.ndarray) -> Iterator[pd.DataFrame]:
    """The 56 finer keys of each fingerprint of a large group, one key of all at a time."""
    start, free = divmod(slot, 3)
    turned = fps if not start else (fps >> np.uint64(8 * start)) | (fps << np.uint64(64 - 8 * start))
    open_steps = [2 + free, 5, 6, 7]
    groups = [(turned >> np.uint64(8 * s + 4 * half)) & np.uint64(0xF) for s in open_steps for half in (0, 1)]
    for number, chosen in enumerate(combinations(range(8), 5)):
        key = np.zeros(len(fps), np.uint64)
        for c in chosen:
            key = (key << np.uint64(4)) | groups[c]
        yield pd.DataFrame({"a": fps.view(np.int64), "b": key.view(np.int64), "cut": np.int32(number)})


def _runs(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Rows sorted by `names`, one batch at a time; a run that goes on in the next batch is
    handed over with the rest of it, or alone and marked as unfinished once it is too long."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        same = np.ones(len(batch), bool)
        for n in names:
            same &= (batch[n] == batch[n].iloc[-1]).to_numpy()
        cut = len(batch) - int(same[::-1].argmin() if not same.all() else len(batch))
        if cut:
            yield batch.iloc[:cut], False
        rest = batch.iloc[cut:]
        if len(rest) > LIMIT:
            yield rest, True
            rest = rest.iloc[:0]
    if rest is not None and len(rest):
        yield rest, False


def _bounds(frame: pd.DataFrame, names: list[str]) -> np.ndarray:
    values = [frame[n].to_numpy() for n in names]
    change = np.zeros(len(frame) - 1, bool)
    for v in values:
        change |= v[1:] != v[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [len(frame)]))


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of ordinary groups, finer keys (cut >= 0) of large ones."""
    names, long_run = ["slot", "key"], None
    for frame, unfinished in _runs(batches, names):
        at = _bounds(frame, names)
        slots, keys = frame["slot"].to_numpy(), frame["key"].to_numpy()
        fps = frame["fp"].to_numpy().view(np.uint64)
        left, right = [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a < 2 and long_run is None:
                continue
            here = (slots[a], keys[a])
            if unfinished or b - a > LIMIT or here == long_run:
                for i in range(a, b, LIMIT):
                    for finer in _cut(int(slots[a]), fps[i : min(b, i + LIMIT)]):
                        yield finer.assign(slot=np.int32(slots[a]), key=keys[a])
                long_run = here
            elif b - a == 2:
                if _ring_filter(fps[a : a + 1] ^ fps[a + 1 : b], int(slots[a]) // 3)[0]:
                    left.append(fps[a])
                    right.append(fps[a + 1])
            elif b - a > 2:
                x, y = _spanning(fps[a:b], int(slots[a]) // 3)
                left += x
                right += y
        if left:
            yield pd.DataFrame({"a": np.array(left, np.uint64).view(np.int64),
                                "b": np.array(right, np.uint64).view(np.int64),
                                "cut": np.int32(-1), "slot": np.int32(-1), "key": 0})


def _compare_cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["slot", "key", "cut", "b"]
    held_back = None
    for batch in batches:
        frame = batch if held_back is None else pd.concat([held_back, batch], ignore_index=True)
        if not len(frame):
            continue
        at = _bounds(frame, names)
        held_back = frame.iloc[at[-2] :]
        yield from _links_of(frame, at[:-1])
    if held_back is not None and len(held_back):
        yield from _links_of(held_back, np.array([0, len(held_back)]))


def _links_of(frame: pd.DataFrame, at: np.ndarray) -> Iterator[pd.DataFrame]:
    fps, left, right = frame["a"].to_numpy().view(np.uint64), [], []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a > 1:
            x, y = _spanning(fps[a:b], -1)
            left += x
            right += y
    if left:
        yield pd.DataFrame({"a": np.array(left, np.uint64).view(np.int64), "b": np.array(right, np.uint64).view(np.int64)})


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fp = batch["fp"].to_numpy().view(np.uint64)
        for start, free, key in _ring_keys(fp):
            yield pd.DataFrame({"slot": np.int32(3 * start + free - 2), "key": key.view(np.int64), "fp": batch["fp"]})


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct `fp` at three bits or fewer."""
    keyed = prints.select("fp").mapInPandas(_keys, "slot int, key long, fp long")
    spread = keyed.repartition("slot", "key").sortWithinPartitions("slot", "key")
    found = held(spread.mapInPandas(_compare, "a long, b long, cut int, slot int, key long"))
    finer = found.where("cut >= 0").repartition("slot", "key", "cut", "b").sortWithinPartitions("slot", "key", "cut", "b")
    return found.where("cut < 0").select("a", "b").unionByName(finer.mapInPandas(_compare_cut, "a long, b long"))


def _grouped(docs: DataFrame, text: str, doc_id: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows as (doc_id, hash of the text, fp), and per fingerprint its group's root and least doc_id."""
    own = held(docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("hash"), fingerprints(docs, text, width).alias("fp")))
    prints = held(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = components(fingerprint_links(prints)).withColumnsRenamed({"node": "fp"})
    grouped = nodes.join(prints, "fp")
    heads = grouped.groupBy("component").agg(F.min("least").alias("head"))
    linked = grouped.join(heads, "component").select("fp", "component", "head")
    return own, prints.join(linked, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("root"), F.coalesce("head", "least").alias("component_id"))


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the least doc_id reachable over links of at
    most three bits."""
    own, known = _grouped(docs, text, doc_id, width)
    return own.join(known, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """Documents with one row left of each group: the least doc_id, then the least fingerprint
    and text hash; rows without an id come last."""
    own, known = _grouped(docs, text, doc_id, width)
    # The least row of a fingerprint, then of a group: no row meets another but in an aggregate.
    least = own.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "hash")).alias("r"))
    heads = least.join(known, "fp").groupBy("root").agg(F.min(F.struct("r.late", "r.doc_id", "fp", "r.hash")).alias("s"))
    heads = held(heads.select(F.col("s.doc_id").alias("_id"), F.col("s.hash").alias("_head")))
    # A row that surely is the only one of its id and text and heads its group stays where it is.
    rows = own.groupBy("doc_id", "hash").count()
    heading = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_head"))
    asked = held(rows.where("count > 1").select("doc_id", "hash").unionByName(
        rows.where("count = 1").join(heads, heading, "left_anti").select("doc_id", "hash")))
    texts = docs.select(F.struct("*").alias("_doc"), F.col(doc_id).alias("_own"), F.xxhash64(text).alias("_hash"))
    probed = with_hits(texts, ["_own", "_hash"], asked, ["doc_id", "hash"])
    kept = probed.where("_hit").join(
        heads, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_head")), "left_semi")
    kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_own", "_hash").orderBy("_hash"))).where("_n = 1")
    kept = probed.where("NOT _hit").select("_doc").unionByName(kept.select("_doc"))
    return kept.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
