"""Packing token pieces into as few sequences as possible, by linear grouping.

Only how many pieces have each length matters for a packing, and there are at most `capacity`
lengths. That table of counts is all that reaches the driver, whatever the number of
documents. On it:

1. Long lengths are sorted and cut into groups of equal cardinality; each group counts as its
   longest member.
2. For these few sizes, the best mix of configurations (how many of each size share a
   sequence) is found by column generation: a linear programme over the configurations met so
   far, and a knapsack over its prices that proposes the next one. Whole copies are kept.
3. Real lengths take the slots of their group, runs of equal lengths at a time, so the room
   that rounding left is free again. Sequences that stay too loose are opened again; how loose
   is too loose is what gives the fewest sequences in all.
4. What is left over and all short lengths go where they fit best, longest first, many equal
   ones at a time.

The result is a list of sequence kinds with their number. Each piece then finds its place by
its rank among the pieces of its length. Ranks are counted per partition and added up, so no
length, however common, is gathered anywhere.

Defined results: a null or empty text is one piece of only the end token. Repeated rows are
packed each. A text of more than `capacity` tokens is cut so that all its pieces but the first
are full. An empty table gives no pieces.
"""

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.llm.bpe import codec
from lanepulse.llm.stored import held

CAPACITY, END = 1024, 2
#: Entries of a worker's tables, which are smaller than the encoder's own as texts come
#: in groups here; texts taken out of a batch at a time; what the encoder returns for a text.
MAX_WORDS, MAX_PIECES, ROWS = 250_000, 30_000, 100
PIECES = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
GROUPS, SMALL = 128, 1 / 4
MOST_ROUNDS = 2000
#: Most free tokens a filled configuration may keep, tried in turn; the fewest sequences win.
LOOSE = (0, 1, 2, 4, 8, 16, 32, 1 << 30)


def texts_of(part: pa.Array) -> Iterator[str | None]:
    """The texts of a batch, few of them as Python strings at a time."""
    for at in range(0, len(part), ROWS):
        yield from part.slice(at, ROWS).to_pylist()


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) per piece, with the partition that made it."""

    @F.arrow_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def cut(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, last = codec(path, MAX_WORDS, MAX_PIECES), end.to_bytes(4, "little")
        for part in parts:
            out = []
            for packed in own.packed_all(texts_of(part)):
                packed += last
                n = len(packed) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                out.append([(i, a, b - a, zlib.crc32(packed[4 * a : 4 * b]))
                            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
            yield pa.array(out, PIECES)

    return docs.select("doc_id", F.explode(cut("text")).alias("p")).select(
        "doc_id", "p.*", F.spark_partition_id().alias("dealt"))


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes_up, prices_up = sizes[order], prices[order]
    fit = np.searchsorted(sizes_up, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fit[c]:
            value = best[c - sizes_up[: fit[c]]] + prices_up[: fit[c]]
            k = int(value.argmax())
            if value[k] > best[c] + 1e-12:
                best[c], take[c] = value[k], k
    count, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            count[order[take[c]]] += 1
            c -= int(sizes_up[take[c]])
    return float(best[capacity]), count


def configurations(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(copies, how many of each size) from the linear programme, rounded down."""
    m = len(sizes)
    columns = [np.eye(m)[g] * (capacity // sizes[g]) for g in range(m)]
    cost = np.ones(m)
    inverse = np.diag(1.0 / np.array([capacity // s for s in sizes], float))
    amount = inverse @ wanted
    for _ in range(MOST_ROUNDS):
        prices = cost @ inverse
        if prices.min() < -1e-9:  # some size is served beyond need: let it be
            column, price = -np.eye(m)[int(prices.argmin())], 0.0
        else:
            value, column = _knapsack(sizes, prices, capacity)
            if value <= 1 + 1e-7:
                break
            price = 1.0
        step = inverse @ column
        ratio = np.where(step > 1e-10, np.maximum(amount, 0) / np.where(step > 1e-10, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        amount = amount - ratio[out] * step
        amount[out] = ratio[out]
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        columns[out], cost[out] = column, price
    return [(int(a + 1e-9), c) for a, c, p in zip(amount, columns, cost, strict=True) if p > 0 and a >= 1 - 1e-9]


def _grouped(lengths: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Runs [length, count], longest first, cut into groups of equal cardinality."""
    total = sum(n for _, n in lengths)
    per = max(1, -(-total // groups))
    out, room = [[]], per
    for length, n in lengths:
        while n:
            if not room:
                out.append([])
                room = per
            k = min(n, room)
            out[-1].append([length, k])
            n, room = n - k, room - k
    return [g for g in out if g]


def _filled(copies: int, column: np.ndarray, groups: list[list[list[int]]]) -> Counter:
    """Kinds of sequences after `copies` of a configuration took real lengths off the groups."""
    slots = [g for g, k in enumerate(column) for _ in range(int(k))]
    blocks = []
    for g in slots:
        block, need = [], copies
        while need and groups[g]:
            length, n = groups[g][0]
            k = min(n, need)
            block.append((length, k))
            groups[g][0][1] -= k
            need -= k
            if not groups[g][0][1]:
                groups[g].pop(0)
        if need:
            block.append((0, need))
        blocks.append(block)
    edges = sorted({0, *(int(e) for b in blocks for e in np.cumsum([k for _, k in b]))})
    kinds = Counter()
    ends = [np.cumsum([k for _, k in b]) for b in blocks]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        kind = tuple(sorted((blk[int(np.searchsorted(e, a, side="right"))][0] for blk, e in zip(blocks, ends, strict=True)),
                            reverse=True))
        if kind := tuple(x for x in kind if x):
            kinds[kind] += b - a
    return kinds


def best_fit(kinds: Counter, lengths: list[tuple[int, int]], capacity: int) -> Counter:
    """Adds lengths, longest first, to the fullest sequences that still have room."""
    free: dict[int, Counter] = {}
    for kind, n in kinds.items():
        free.setdefault(capacity - sum(kind), Counter())[kind] += n
    for length, n in lengths:
        while n:
            room = min((w for w, c in free.items() if w >= length and c), default=capacity)
            own = free.setdefault(room, Counter())
            kind, count = next(iter(own.items()), ((), n))
            per = room // length
            full = min(count, n // per)
            used, last = (full, 0) if full == count or not n % per or n // per > full else (full + 1, n % per)
            if full:
                free.setdefault(room - per * length, Counter())[kind + (length,) * per] += full
            if last:
                free.setdefault(room - last * length, Counter())[kind + (length,) * last] += 1
            n -= full * per + last
            if kind or own:
                own[kind] -= used
                if own[kind] <= 0:
                    del own[kind]
    return sum(free.values(), Counter())


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Counter:
    """Kinds of sequences (their lengths) and how many of each, for counts per length."""
    lengths = sorted(counts.items(), reverse=True)
    long = [x for x in lengths if x[0] > capacity * SMALL]
    parts, kinds = _grouped(long, groups), Counter()
    sizes: dict[int, list[list[int]]] = {}
    for p in parts:  # groups that count as the same size are one
        sizes.setdefault(p[0][0], []).extend(p)
    rounded = list(sizes.values())
    if rounded:
        wanted = np.array([sum(n for _, n in p) for p in rounded], float)
        found = configurations(np.array(list(sizes)), wanted, capacity)
        for copies, column in sorted(found, key=lambda f: -f[0]):
            kinds.update(_filled(copies, column, rounded))
    small = Counter({length: n for length, n in lengths if length <= capacity * SMALL})
    for p in rounded:
        for length, n in p:
            small[length] += n
    tried = []
    for loose in LOOSE:
        kept, rest = Counter(), small.copy()
        for kind, n in kinds.items():
            if capacity - sum(kind) <= loose:
                kept[kind] = n
            else:
                for length in kind:
                    rest[length] += n
        tried.append(best_fit(kept, sorted(rest.items(), reverse=True), capacity))
    return min(tried, key=lambda found: sum(found.values()))


def _places(kinds: Counter) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, pieces per sequence, first sequence and offset of each kind."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks, sequence = Counter(), 0
    for kind, n in sorted(kinds.items(), reverse=True):
        offset = 0
        for length, k in Counter(kind).items():
            rows.setdefault(length, []).append((ranks[length], k, sequence, offset))
            ranks[length] += n * k
            offset += length * k
        sequence += n
    return {length: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for length, r in rows.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, groups: int = GROUPS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for documents with
    `doc_id` and `text`."""
    pieces = held(token_pieces(docs, path, capacity, end))
    dealt = pieces.groupBy("length", "dealt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan(counts, capacity, groups))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        length, rank = lengths.to_numpy(), ranks.to_numpy()
        out = np.zeros((2, len(rank)), np.int64)
        for value in np.unique(length):
            at = np.flatnonzero(length == value)
            first, per, sequence, offset = places[int(value)]
            k = np.searchsorted(first, rank[at], side="right") - 1
            nth = rank[at] - first[k]
            out[:, at] = sequence[k] + nth // per[k], offset[k] + nth % per[k] * value
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    before = Window.partitionBy("length").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.select("length", "dealt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "dealt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(within) - 1).join(base, ["length", "dealt"])
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        placed("length", (F.col("nth") + F.col("base")).cast("long")).alias("place"),
    ).select("doc_id", "piece", "start", "length", "ids_crc32", "place.*")
