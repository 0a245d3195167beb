"""Substring dedup by anchored windows.

A passage is shared where a window of WORDS = 51 words, compared as it stands, occurs in another
document. Consecutive windows that others share are joined to a span, which is thus exact: each
span is over 50 words long, and each of its stretches of 51 words occurs in another document.

Windows are compared in groups. A window's anchor is the GRAM words of least hash (of equal ones
the last) that begin MARGIN words from its edges or further inside, so equal windows have their
anchor at the same place. Some 14 windows in a row have one anchor. The words that all windows
of any such group hold are the group's core, and its extent is all that its windows cover.
Whoever shares a window shares the core of its group, so:

1. A group whose core no other document holds has no shared window.
2. A core that is always found with the same extent stands for all windows of its group: whoever
   has the core has each of them.
3. Only where a core is shared by groups of different extents, at the edges of passages, are
   windows compared one by one, by the digest of their bytes.

Digests are counted with map-side combining, then flag groups and windows by joins whose hot
keys are split; only flagged ones are grouped by document. No two documents are paired.

The number of chunks of a span counts the places where a text may be cut by content: where the
hash of GRAM words is the least of some REACH hashes in a row, so cuts depend on nearby words only.

Words are what white space (ASCII) parts. Defined results: null, empty and short texts have no
spans. Repeats inside one document do not count. Rows with the same doc_id are one document. A
document without an id is known by its text, so its copies without an id are one document; it
comes after all that have one, and its id stays null in results. Ids lie below 2 ** 62. Empty
tables give empty results.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.llm.stored import stored

WORDS, GRAM, REACH, MARGIN = 51, 4, 12, 10
#: Grams among which a window's anchor is chosen.
CENTRE = WORDS - GRAM + 1 - 2 * MARGIN
#: Texts are joined up to so many characters, so that numpy works on many at once.
TOGETHER = 300_000
BASE = 0x9E3779B97F4A7C15
#: Documents without an id are numbered from here on, by the hash of their text.
NO_ID = 1 << 62
GROUP_FIELDS = "who long, row long, span long, core long, extent long"
PIECE_FIELDS = "who long, row long, no int, last int, start int, stop int, low int, high int, digest long, least long"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: 256 fixed numbers from a mixing rule.
GEAR = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
INVERSE = pow(BASE, -1, 1 << 64)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, in bytes."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = (data != 0x20) & ~((data >= 0x09) & (data <= 0x0D))
    return np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1


def gram_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers = np.cumprod(np.full(len(data), BASE, np.uint64))
    sums = np.append(np.uint64(0), np.cumsum(GEAR[data] * powers))
    first, last = begins[: len(begins) - GRAM + 1], ends[GRAM - 1 :]
    back = np.cumprod(np.full(len(data), INVERSE, np.uint64))
    return mixed((sums[last] - sums[first]) * back[first])


def least_of(hashes: np.ndarray, reach: int) -> np.ndarray:
    """Where the least of each `reach` hashes in a row is; of equal ones the last. Rows double in
    length until two that overlap make one of `reach`."""
    least, at, size = hashes, np.arange(len(hashes)), 1
    while size < reach:
        step = min(size, reach - size)
        if len(least) <= step:
            return np.zeros(0, np.int64)
        later = least[step:] <= least[:-step]
        least, at, size = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step]), size + step
    return at


def cuts(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Numbers of the words that begin a chunk."""
    if len(begins) < GRAM + reach - 1:
        return np.zeros(0, np.int64)
    return np.unique(least_of(gram_hashes(data, begins, ends), reach))


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    found = (digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.fromiter(found, np.uint64, len(starts)).view(np.int64)


def chunks(text: str) -> tuple[np.ndarray, ...]:
    """start, stop (code points), words that begin inside, digest of each chunk."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    begins, word_ends = word_bounds(data)
    at = cuts(data, begins, word_ends)
    at = at[begins[at] > 0]
    starts, ends = np.append(0, begins[at]), np.append(begins[at], len(data))
    points, words = np.append(0, np.cumsum((data & 0xC0) != 0x80)), np.append(0, at)
    return points[starts], points[ends], np.diff(np.append(words, len(begins))), digests(raw, starts, ends)


class Joined:
    """Many texts as one array of bytes, parted by line breaks, so that no word crosses. `starts`:
    where texts begin (bytes); `words`: the number of each text's first word."""

    def __init__(self, texts: list[str]):
        raws = [t.encode() for t in texts]
        self.raw = b"\n".join(raws)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.starts = np.cumsum([0] + [len(r) + 1 for r in raws[:-1]])
        self.begins, self.ends = word_bounds(self.data)
        self.words = np.searchsorted(self.begins, self.starts)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(np.append(self.words, len(self.begins))))
        self.hashes = gram_hashes(self.data, self.begins, self.ends) if len(self.begins) >= GRAM else np.zeros(0, np.uint64)

    def inside(self, words: int) -> np.ndarray:
        """The first words of all rows of so many words that lie in one text."""
        return np.flatnonzero(self.owner[: max(len(self.owner) - words + 1, 0)] == self.owner[words - 1 :])

    def cuts(self) -> np.ndarray:
        return np.unique(least_of(self.hashes, REACH)[self.inside(GRAM + REACH - 1)])


def joined(texts: list[str]) -> Iterator[tuple[int, Joined]]:
    """The texts in groups of about TOGETHER characters, each with the number of its first text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= TOGETHER or i == len(texts) - 1:
            yield first, Joined(texts[first : i + 1])
            first, size = i + 1, 0


def groups(texts: Joined, words: int = WORDS) -> tuple[np.ndarray, ...]:
    """Text, first and last window of each group of windows with one anchor, digests of core and extent."""
    begins, ends, at = texts.begins, texts.ends, texts.inside(words)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    # Windows of different texts differ in their anchors, as an anchor lies inside its windows.
    anchor = MARGIN + least_of(texts.hashes[MARGIN:], CENTRE)[at]
    edge = np.append(0, np.flatnonzero(np.diff(anchor)) + 1)
    first, last, anchor = at[edge], at[np.append(edge[1:], len(at)) - 1], anchor[edge]
    core = digests(texts.raw, begins[anchor - MARGIN], ends[anchor - MARGIN - CENTRE + words])
    extent = digests(texts.raw, begins[first], ends[last + words - 1])
    # Equal extents are the same windows only if the anchor is at the same place in them.
    extent = extent ^ mixed((begins[anchor] - begins[first] + 1).astype(np.uint64)).view(np.int64)
    own = texts.owner[first]
    return own, first - texts.words[own], last - texts.words[own], core, extent


def pieces(texts: Joined, own: np.ndarray, span: np.ndarray, least: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, ...]:
    """Text, first and last window, start, stop (code points), cuts before and up to the end, digest
    and least holder: a run of windows known to be shared has a holder, a window to be compared a
    digest. Groups of windows: their text, first window and how many follow, least holder or -1."""
    begins, ends = texts.begins, texts.ends
    first = texts.words[own] + (span >> 32)
    order = np.argsort(first)
    first, least, last = first[order], least[order], (first + (span & 0x7FFFFFFF))[order]
    shared = least >= 0
    at, to, holder = first[shared], last[shared], least[shared]
    new = np.flatnonzero(np.append(True, at[1:] != to[:-1] + 1)[: len(at)])
    begin, count = first[~shared], (last - first + 1)[~shared]
    single = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
    no = np.concatenate((at[new], single))
    last = np.concatenate((to[np.append(new[1:], len(at)) - 1] if len(new) else to, single))
    least = np.concatenate((np.minimum.reduceat(holder, new) if len(new) else holder, np.full(len(single), -1)))
    digest = np.zeros(len(no), np.int64)
    digest[len(new) :] = digests(texts.raw, begins[single], ends[single + words - 1])
    points, cut, own = np.append(0, np.cumsum((texts.data & 0xC0) != 0x80)), texts.cuts(), texts.owner[no]
    from_word, from_point, from_cut = texts.words[own], points[texts.starts[own]], np.searchsorted(cut, texts.words)[own]
    end = np.minimum(last + words, np.append(texts.words[1:], len(begins))[own] - 1)  # the next text's cuts are not its own
    return (own, no - from_word, last - from_word, points[begins[no]] - from_point, points[ends[last + words - 1]] - from_point,
            np.searchsorted(cut, no) - from_cut, np.searchsorted(cut, end, "right") - from_cut, digest, least)


def _who(doc_id: str, row: Column) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), row.bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))


def _shown(who: str) -> Column:
    return F.when(F.col(who) < F.lit(NO_ID), F.col(who))


def _known(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Documents as who; row tells rows of one document apart."""
    row = F.xxhash64(text)
    return docs.where(F.col(text).isNotNull()).select(
        _who(doc_id, row).alias("who"), row.alias("row"), F.col(text).alias("text"))


def group_table(known: DataFrame, min_words: int) -> DataFrame:
    """One row per group of windows (GROUP_FIELDS); span holds its first window and how many follow."""
    names = [x.split()[0] for x in GROUP_FIELDS.split(", ")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            who, row = batch["who"].to_numpy(), batch["row"].to_numpy()
            for at, texts in joined(batch["text"].tolist()):
                own, first, last, core, extent = groups(texts, min_words)
                values = who[at + own], row[at + own], first << 32 | last - first, core, extent
                yield pd.DataFrame(dict(zip(names, values, strict=True)))

    return known.mapInPandas(of, GROUP_FIELDS)


def _holders(table: DataFrame, digest: str, *more: Column) -> DataFrame:
    """The least holder of each digest that several documents hold."""
    seen = table.groupBy(digest).agg(F.min("who").alias("least"), F.max("who").alias("most"), *more)
    return seen.where("least < most").drop("most")


def piece_table(known: DataFrame, min_words: int) -> DataFrame:
    """One row per run of windows that others share and per window to be compared (PIECE_FIELDS)."""
    table = stored(group_table(known, min_words), "groups")
    cores = _holders(table, "core", F.min("extent").alias("one"), F.max("extent").alias("other")).select(
        "core", F.when(F.col("one") == F.col("other"), F.col("least")).otherwise(F.lit(-1)).alias("least"))
    flagged = table.select("who", "row", "span", "core").join(cores, "core").groupBy("who", "row").agg(
        F.collect_set(F.struct("span", "least")).alias("flagged"))
    names = [x.split()[0] for x in PIECE_FIELDS.split(", ")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            who, row, spans, leasts = (batch[c].to_numpy() for c in ("who", "row", "span", "least"))
            for at, texts in joined(batch["text"].tolist()):
                mine = slice(at, at + len(texts.starts))
                own = np.repeat(np.arange(len(texts.starts)), [len(x) for x in spans[mine]])
                found = pieces(texts, own, np.concatenate(spans[mine]), np.concatenate(leasts[mine]), min_words)
                for i in range(0, len(own := found[0]), 100_000):
                    part = slice(i, i + 100_000)
                    values = who[at + own[part]], row[at + own[part]], *(x[part] for x in found[1:])
                    yield pd.DataFrame(dict(zip(names, values, strict=True)))

    both = known.join(flagged, ["who", "row"]).select(
        "who", "row", "text", F.col("flagged.span").alias("span"), F.col("flagged.least").alias("least"))
    return both.mapInPandas(of, PIECE_FIELDS)


def _spans(docs: DataFrame, text: str, doc_id: str, min_words: int) -> DataFrame:
    if min_words < WORDS:
        raise ValueError(f"spans of fewer than {WORDS} words are not searched")
    table = stored(piece_table(_known(docs, text, doc_id), min_words), "pieces")
    alone = table.where("least < 0").drop("least")
    shared = alone.join(_holders(alone, "digest"), "digest").unionByName(table.where("least >= 0")).drop("digest")
    # A row that is repeated lists its pieces again, so a piece may begin inside the ones before.
    inside = Window.partitionBy("who", "row").orderBy("no")
    before = F.max("last").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    begun = shared.withColumn("begins", F.when(F.col("no") <= before + 1, 0).otherwise(1))
    return begun.withColumn("run", F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0))).groupBy(
        "who", "row", "run").agg(
        F.min("start").cast("long").alias("start"), F.max("stop").cast("long").alias("stop"),
        (F.max("last") - F.min("no") + min_words).cast("long").alias("n_words"),
        (F.max("high") - F.min("low") - 1).cast("long").alias("n_chunks"), F.min("least").alias("first_doc_id"),
        (F.min("least") >= F.col("who")).alias("is_first"))


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = WORDS) -> DataFrame:
    """(doc_id, start, stop, n_words, n_chunks, first_doc_id, is_first) for every span of
    windows that other documents share; is_first: no window of it occurs in an earlier one."""
    return _spans(docs, text, doc_id, min_words).select(
        _shown("who").alias("doc_id"), "start", "stop", "n_words", "n_chunks",
        _shown("first_doc_id").alias("first_doc_id"), "is_first")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = WORDS) -> DataFrame:
    """Documents whose later copies of shared spans are cut out; the first document keeps its."""
    spans = _spans(docs, text, doc_id, min_words).where("NOT is_first").groupBy("who", "row").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cut"))
    row = F.xxhash64(text)
    own = docs.select(F.struct("*").alias("_doc"), _who(doc_id, row).alias("who"), row.alias("row"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, cut: pd.Series) -> pd.Series:
        out = []
        for value, spans in zip(texts, cut, strict=True):
            at, kept = 0, []
            for s in spans:
                kept.append(value[at : s["start"]])
                at = s["stop"]
            out.append("".join([*kept, value[at:]]))
        return pd.Series(out, dtype=object)

    both = own.join(spans, ["who", "row"], "left")
    value = F.col(f"_doc.`{text}`")
    columns = lambda changed: [(changed if c == text else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns]
    same = both.where(F.col("cut").isNull()).select(*columns(value))
    return same.unionByName(both.where(F.col("cut").isNotNull()).select(*columns(without(value, F.col("cut")))))
