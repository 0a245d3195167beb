"""MinHash near-duplicates: multi-index join of b-bit signatures, exact links, components.

A document is the set of its five-word shingles; two are linked at a Jaccard similarity of
0.85 or more.

1. Equal sets form a class; classes are what is compared, so copies cost nothing later.
2. A class has a signature of 32 minima, 16 bits each, cut into 8 chunks of 4. Two signatures
   that differ in at most 15 minima differ in at most one of some chunk (pigeonhole). Each
   chunk is therefore entered four times, once for each minimum that may be in error: 32 keys
   a class, and every pair within that distance shares a key. At a similarity of 0.85, two
   signatures share no key with probability 2e-8 (each chunk fails with 0.11).
3. The classes of a key are not paired with each other. Each is compared, on full sets, with
   the key's first class, its leader: at most 32 comparisons a class.
4. With d(x) the symmetric difference of x and their leader, that of x and y is the one of
   d(x) and d(y): so a link asks for 37 |d(x) ^ d(y)| <= 3 (|x| + |y|). Classes linked with
   the leader are in one component. A link with a class x that is not needs common elements in
   d(x) and d(y), in number at least the larger of 1, |d| - 3/17 of the set's size for either,
   and 17/37 |d(y)|. So rarest-first prefixes of the differences, the length filter and the
   positional filter find the remaining candidates in an equi-join, each pair of keys sharing
   a rare element; they are decided on the differences, which is as exact as the full sets.
5. Links give components (`links.components`); the least doc_id of a component names it.

Shingles are compared by their 64-bit XXH64, classes by two of the sorted set. Signatures and
keys are numpy in tasks; the comparisons are built-in joins and array functions. Hot keys are
met once by each of their classes and split like any skewed join key.

Defined results: a null, empty or wordless text has an empty set and links with nothing; its
own doc_id is its component. With fewer words than a shingle's, the whole sequence is the one
shingle. Rows of one doc_id stay rows of their own. A null doc_id names a component only if
all members are null; `kept` holds where doc_id and component_id are equal or both null. Other
columns are not needed and not returned. Empty tables give empty results.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse.llm.bloom import with_hits
from lanepulse.llm.links import components
from lanepulse.llm.stored import held, stored

WIDTH = 5
#: Jaccard similarity of links, as the largest share of |x| + |y| that may differ: 3 / 37.
DIFFER, OF = 3, 37
CHUNKS, CHUNK = 8, 4
MINIMA = CHUNKS * CHUNK
SMALLEST = 6  # smaller sets can only be linked with equal ones
BLOCK = 1 << 15
PART = 1 << 20
BUCKETS = 1 << 14
_rng = np.random.default_rng(20_11)
FACTORS = _rng.integers(1 << 62, 1 << 63, (2, MINIMA)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
FIELDS = "n long, h1 long, h2 long, signature binary, shingles array<long>"


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII space are meant
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(sizes + 1) - 1
    runs = map(slice, (stop - sizes)[: len(words) - width + 1].tolist(), stop[width - 1:].tolist())
    count = len(words) - width + 1
    return np.unique(np.fromiter(map(digest, map(joined.__getitem__, runs)), np.uint64, count))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minimum under each of the permutations."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        mixed = shingles[at: at + BLOCK, None] * FACTORS[0]
        mixed ^= mixed >> np.uint64(32)
        mixed *= FACTORS[1]
        np.minimum(least, mixed.min(axis=0), out=least)
    return least.astype(np.uint16)


def _parts(texts: pd.Series) -> Iterator[pd.Series]:
    """Runs of texts of about `PART` characters: a task never holds the sets of a whole batch."""
    sizes = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PART)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
        yield texts.iloc[a:b]


def _measured(texts: pd.Series, width: int) -> pd.DataFrame:
    out = []
    for text in texts:
        s = shingle_set(text, width)
        data = s.tobytes()
        ids = np.array([xxhash.xxh64_intdigest(data, 1), xxhash.xxh64_intdigest(data, 2)], np.uint64).view(np.int64)
        mark = signature(s).tobytes() if len(s) >= SMALLEST else None
        out.append((len(s), int(ids[0]), int(ids[1]), mark, s.view(np.int64)))
    return pd.DataFrame(out, columns=["n", "h1", "h2", "signature", "shingles"])


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(row, doc_id) and FIELDS of every document, stored; `row` numbers the stored rows."""

    @F.pandas_udf(FIELDS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for part in _parts(texts):
                yield _measured(part, width)

    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), of(F.col(f"`{text}`")).alias("_m"))
    return stored(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "_m.*"), "shingles")


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each chunk once for every minimum that may be in error."""
    for batch in batches:
        marks = np.frombuffer(b"".join(batch["signature"]), np.uint16).reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
        for chunk in range(CHUNKS):
            for error in range(CHUNK):
                key = np.full(len(batch), chunk * CHUNK + error, np.uint64)
                for at in range(CHUNK):
                    if at != error:
                        key = (key << np.uint64(16)) | marks[:, chunk, at]
                yield pd.DataFrame({"key": key.view(np.int64), "node": batch["node"].to_numpy()})


def _leaders(classes: DataFrame) -> DataFrame:
    """(node, leader): each class with the first class of each of its keys."""
    keyed = classes.where("signature IS NOT NULL").select("node", "signature").mapInPandas(_keys, "key long, node long")
    first = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    return keyed.join(first.select("key", "leader"), "key").where("node <> leader").select("node", "leader").distinct()


def _linked(differ: Column, sizes: Column) -> Column:
    return OF * differ <= DIFFER * sizes


def _differences(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(leader, node, n, nl, d) with d the symmetric difference of the two sets."""
    wanted = held(pairs.select("node").union(pairs.select("leader")).distinct())
    near = with_hits(rows.select(F.col("row").alias("node"), "n", "shingles"), ["node"], wanted, ["node"]).where("_hit")
    sets = near.drop("_hit").join(wanted, "node")
    leads = sets.select(F.col("node").alias("leader"), F.col("n").alias("nl"), F.col("shingles").alias("of_leader"))
    both = pairs.join(sets, "node").join(leads, "leader")
    differ = F.concat(F.array_except("shingles", "of_leader"), F.array_except("of_leader", "shingles"))
    return stored(both.select("leader", "node", "n", "nl", differ.alias("d")), "differences")


def _rarity(differences: DataFrame) -> list[int]:
    """How often the elements of each hash bucket occur: one order of all elements, rarest
    first, of a fixed size. Any order keeps the prefixes exact."""
    counts = differences.select(F.explode("d").alias("e")).groupBy(F.pmod("e", F.lit(BUCKETS)).alias("b")).count()
    often = [0] * BUCKETS
    for r in counts.collect():  # at most BUCKETS rows
        often[r["b"]] = r["count"]
    return often


def _prefixes(differences: DataFrame) -> DataFrame:
    """(leader, node, n, nd, far, i, e, long): prefix elements with their places. `far` classes
    are not linked with their leader; rows with `long` only serve to meet those that are."""
    often = _rarity(differences)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = np.array(often)
        for batch in batches:
            out = []
            for leader, node, n, nl, d in batch.itertuples(index=False):
                d = np.asarray(d, np.int64)
                nd = len(d)
                far = OF * nd > DIFFER * (n + nl)
                short = nd - max(1, nd - 3 * n // 17, -(-17 * nd // 37)) + 1
                reach = nd - max(1, nd - 3 * n // 17) + 1 if far else short
                order = np.lexsort((d, rank[d % BUCKETS]))[:reach]
                out.append(pd.DataFrame({
                    "leader": leader, "node": node, "n": n, "nd": nd, "far": far,
                    "i": np.arange(len(order)), "e": d[order], "long": np.arange(len(order)) >= short}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return differences.where(F.size("d") > 0).select("leader", "node", "n", "nl", "d").mapInPandas(
        cut, "leader long, node long, n long, nd long, far boolean, i long, e long, long boolean")


def _candidates(differences: DataFrame) -> DataFrame:
    """(leader, x, y): pairs of one leader, x not linked with it, that pass all filters."""
    rows = stored(_prefixes(differences), "prefixes")
    x = rows.where("far").alias("x")
    y = rows.where("NOT long").alias("y")
    filters = F.expr(
        f"x.leader = y.leader AND x.e = y.e AND x.node <> y.node AND NOT (x.long AND y.far)"
        f" AND NOT (y.far AND y.node < x.node)"
        f" AND {OF} * abs(x.nd - y.nd) <= {DIFFER} * (x.n + y.n)"
        f" AND {OF} * (x.nd + y.nd - 2 * least(x.nd - x.i, y.nd - y.i)) <= {DIFFER} * (x.n + y.n)")
    return x.join(y, filters).select("x.leader", F.col("x.node").alias("x"), F.col("y.node").alias("y")).distinct()


def class_links(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) that connect all classes of similarity 0.85 or more."""
    differences = _differences(held(_leaders(classes)), rows)
    direct = differences.where(_linked(F.size("d"), F.col("n") + F.col("nl"))).select(
        F.col("node").alias("a"), F.col("leader").alias("b"))
    one = differences.select("leader", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("d").alias("dx"))
    two = differences.select("leader", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("d").alias("dy"))
    met = held(_candidates(differences)).join(one, ["leader", "x"]).join(two, ["leader", "y"])
    differ = F.size("dx") + F.size("dy") - 2 * F.size(F.array_intersect("dx", "dy"))
    further = met.where(_linked(differ, F.col("nx") + F.col("ny"))).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return direct.unionByName(further)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = measured(docs, text, doc_id)
    full = rows.where("n > 0")
    classes = stored(full.groupBy("h1", "h2").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least"), F.max("signature").alias("signature")), "classes")
    nodes = components(class_links(classes, rows))
    grouped = nodes.join(classes.select("node", "least"), "node")
    heads = grouped.groupBy("component").agg(F.min("least").alias("head"))
    linked = grouped.join(heads, "component").select("node", "head")
    named = classes.join(linked, "node", "left").select("h1", "h2", F.coalesce("head", "least").alias("component_id"))
    found = full.join(named, ["h1", "h2"]).select("doc_id", "n", "component_id").unionByName(
        rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
