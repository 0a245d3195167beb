"""Quality rules on repetition: how much of a text stands in repeated word runs and lines.

For each n of `NGRAMS`, rolling hashes of all n-word windows are made in numpy and sorted;
windows with equal hashes are grouped by their words, so a hash collision cannot count. A
character (code point of a word) is covered if some window over its word occurs elsewhere in
the text, too; lines count likewise. A longer window can only repeat where its first shorter
window does, so longer ones are hashed at those places alone, and texts without repeats are
done after the first length.

One text is one row: nothing is shuffled, and work and memory follow the text's own length.

Defined results: a null or wordless text has zero counts and no coverage; with fewer than ten
words it fails the base rules. Repeated rows are measured each. Columns of the documents pass
through; columns of this operator replace equally named ones.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NGRAMS = (5, 7, 10)
#: Largest share of characters inside repeated windows of n words, and lines.
MOST_COVERED = {5: 0.30, 7: 0.26, 10: 0.22}
MOST_IN_LINES = 0.30
MIN_WORDS, MOST_REPEATED_PERCENT = 10, 20
SYMBOLS = "#*$%&|<>"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered array<double>, line_coverage double, base_failed boolean, kept boolean"
)
SPACE = "\t\n\x0b\x0c\r "


def repeated_starts(words: list[bytes], ids: np.ndarray, n: int, starts: np.ndarray | None) -> np.ndarray:
    """Starts of n-word windows that occur twice or more, among `starts` (None: all).
    `ids` are hashes of the words; the words themselves decide."""
    count = len(ids) - n + 1
    starts = np.arange(max(count, 0)) if starts is None else starts[starts < count]
    if len(starts) < 2:
        return starts[:0]
    rolled = np.zeros(len(starts), np.uint64)
    for k in range(n):
        rolled = (rolled + ids[starts + k]) * MULTIPLIER
        rolled ^= rolled >> np.uint64(29)
    in_order = np.sort(rolled)
    if not (in_order[1:] == in_order[:-1]).any():
        return starts[:0]
    order = np.argsort(rolled, kind="stable")
    at, hashed = starts[order].tolist(), rolled[order]
    cuts = np.concatenate(([0], np.flatnonzero(hashed[1:] != hashed[:-1]) + 1, [len(at)]))
    twice = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a > 1:
            by_words: dict[tuple, list[int]] = {}
            for i in at[a:b]:
                by_words.setdefault(tuple(words[i : i + n]), []).append(i)
            twice += [i for same in by_words.values() if len(same) > 1 for i in same]
    return np.sort(np.array(twice, np.int64))


def _under(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words that stand in one of the windows."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The values of FIELDS for one text."""
    text = text or ""
    words = text.encode().split()  # bytes: only ASCII white space separates
    chars = len(text) - sum(map(text.count, SPACE))
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    starts, covered, repeat_words = None, [], 0
    for n in NGRAMS:
        starts = repeated_starts(words, ids, n, starts)
        if not len(starts):
            covered.append(0.0)
            continue
        inside = np.flatnonzero(_under(starts, n, len(words))).tolist()
        if n == NGRAMS[0]:
            repeat_words = len(inside)
        covered.append(sum(len(words[i].decode()) for i in inside) / chars)
    seen, dup_lines, dup_chars, line_chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            line_chars += len(line)
            if line in seen:
                dup_lines, dup_chars = dup_lines + 1, dup_chars + len(line)
            else:
                seen.add(line)
    in_lines = dup_chars / line_chars if line_chars else 0.0
    failed = len(words) < MIN_WORDS or 100 * repeat_words > MOST_REPEATED_PERCENT * len(words)
    bad = in_lines > MOST_IN_LINES or any(c > MOST_COVERED[n] for n, c in zip(NGRAMS, covered, strict=True))
    symbols = sum(map(text.count, SYMBOLS))
    return (len(words), chars, symbols, dup_lines, repeat_words, covered, in_lines, failed, not (failed or bad))


def repetition_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with the measures and verdict of FIELDS."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def rules(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([measure(t) for t in part], columns=names)

    judged = docs.select(F.struct("*").alias("_doc"), rules(F.col(text)).alias("_rules"))
    return judged.select(
        *[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in names],
        *[F.col(f"_rules.{n}").alias(n) for n in names],
    )
