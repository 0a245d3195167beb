"""Line dedup by an exact set-similarity join of lines, in built-in expressions.

A line is the set of its words; lines of similarity (Jaccard) 0.8 or more match, and a line is
removed if an earlier line of the table matches it. Earlier means a smaller (doc_id, line).

1. Word frequencies are counted into a table of 16,384 hash buckets. It gives one order of all
   words, rarest first, at a bounded size; any such order keeps the join exact.
2. Lines with equal sets are grouped; the first of each stands for it. Sets of fewer than four
   words can only match equal ones, so they end here.
3. Two matching sets share a word among their first n - ceil(0.8 n) + 1 in that order. A pair
   that shares one must also pass the length filter, the positional filter (what can still be
   common after that word) and a bound by 128 parity bits of the words.
4. Large groups of near copies would meet pairwise. So each set first meets only the earliest
   set of two of its prefix words, and of four pairs of minima of its hashed words, which near
   copies mostly share; those matched there are settled. Then every set still open meets all
   earlier ones that share a prefix word. The result is that of all pairs.
5. Candidates are verified on the words themselves, read again for the lines concerned only.

No text is shuffled but that of candidates; hot words are split by the skew handling of joins.

Defined results: null, empty and wordless lines are never removed and match nothing; a null
text stays null. A null doc_id counts as the largest. Rows with equal doc_id and equal text
share their places, so neither is later than the other. Columns pass through. Empty tables
give empty results.
"""

import json
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse.llm.bloom import with_hits
from lanepulse.llm.stored import held, stored

BUCKETS = 1 << 14
LEAD_WORDS = 2
#: Each pair of masks reorders the hashed words twice; the two least words name a lead.
_draw = random.Random(3)
LEAD_MASKS = [(_draw.getrandbits(63), _draw.getrandbits(63)) for _ in range(4)]
LAST_ID = (1 << 63) - 1
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def _split(line: Column) -> Column:
    """Words and empty strings. Only where white space other than blanks occurs is a pattern needed."""
    other = F.lit(False)
    for c in "\t\n\x0b\x0c\r":
        other = other | F.contains(line, F.lit(c))
    return F.when(other, F.split(line, SPACE)).otherwise(F.split(line, " "))


def _words(line: Column) -> Column:
    return F.array_remove(F.array_distinct(_split(line)), "")


def _placed_lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(d, place, line): place orders lines of one document and tells texts of one id apart."""
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("d"),
        F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).alias("h"),
        F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"),
    ).select("d", (F.col("at").cast("long") * F.lit(1 << 31) + F.col("h")).alias("place"), "line")


def word_frequencies(docs: DataFrame, text: str = "text") -> Column:
    """A constant array: how often the words of each hash bucket occur in the whole table, on
    a logarithmic scale. Its size is fixed, so it may pass through the driver."""
    counts = (
        docs.select(F.replace(F.col(text), F.lit("\n"), F.lit(" ")).alias("t")).select(F.explode(_split(F.col("t"))).alias("w"))
        .groupBy(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).count()
    )
    scale = [0] * BUCKETS
    for r in counts.select("b", F.floor(4 * F.log2(F.col("count") + 1)).alias("s")).collect():
        scale[r["b"]] = r["s"]
    return F.from_json(F.lit(json.dumps(scale, separators=(",", ":"))), "array<int>")


def _parity(flips: Callable[[Column], Column]) -> Column:
    """64 bits: each word of `w` for which `flips` is one, not zero, flips the bit that its last six bits name."""
    name = lambda w: w.bitwiseAND(F.lit(63)).cast("int")
    return F.aggregate("w", F.lit(0).cast("long"), lambda bits, w: bits.bitwiseXOR(
        F.call_function("shiftleft", flips(w), name(w))))


def line_sets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(d, place, k, k2, n, low, high, bands, prefix) of every line with a word; k, k2 name its set."""
    often = word_frequencies(docs, text)
    # A filter on the number of words would be pushed down and split every line a second time.
    lines = _placed_lines(docs, text, doc_id).where(F.col("line").rlike(WORD))
    # Numbers are told apart faster than words.
    hashed = lines.select("d", "place", F.array_remove(F.array_distinct(
        F.transform(_split(F.col("line")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit(""))).alias("w"))
    least = lambda mask: F.array_min(F.transform("w", lambda w: w.bitwiseXOR(F.lit(mask))))
    bands = F.array(*[F.hash(F.lit(i), least(a), least(b)) for i, (a, b) in enumerate(LEAD_MASKS)])
    ranked = hashed.select("d", "place", bands.alias("bands"), F.sort_array(F.transform("w", lambda w: (
        F.get(often, F.pmod(w, F.lit(BUCKETS)).cast("int")) * F.lit(1 << 43) + w.bitwiseAND(F.lit((1 << 43) - 1))
    ))).alias("w"))
    n = F.size("w")
    return ranked.select(
        "d", "place", F.xxhash64("w").alias("k"), F.hash("w").alias("k2"), n.alias("n"),
        _parity(lambda w: F.lit(1).cast("long")).alias("low"),
        _parity(lambda w: F.shiftright(w, 6).bitwiseAND(F.lit(1).cast("long"))).alias("high"), "bands",
        F.transform(F.slice("w", 1, n - F.floor((4 * n + 4) / 5).cast("int") + 1), lambda w: F.hash(w)).alias("prefix"))


def _can_match(x: str, y: str) -> Column:
    """Length, positional and parity filters for two exploded prefix rows."""
    return F.expr(
        "5 * least({nx}, {ny}) >= 4 * greatest({nx}, {ny})"
        # Some words flip a bit of `high` too; what is left of `low` are 64 further bits.
        " AND 9 * (bit_count({x}.low ^ {y}.low ^ {x}.high ^ {y}.high) + bit_count({x}.high ^ {y}.high)) <= {nx} + {ny}"
        " AND 9 * least({nx} - {ix}, {ny} - {iy}) >= 4 * ({nx} + {ny})".format(
            x=x, y=y, nx=f"shiftright({x}.ni, 32)", ny=f"shiftright({y}.ni, 32)",
            ix=f"({x}.ni & 2147483647)", iy=f"({y}.ni & 2147483647)"))


def _earlier(x: str, y: str) -> Column:
    return F.expr(f"{x}.d < {y}.d OR ({x}.d = {y}.d AND {x}.place < {y}.place)")


PAIR = ("y.d AS d", "y.place AS place", "x.d AS xd", "x.place AS xplace")


def _verified(pairs: DataFrame, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One verified earlier match per line of `pairs` (d, place, xd, xplace)."""
    pairs = held(pairs)
    wanted = held(pairs.select("d", "place").union(pairs.select("xd", "xplace")).distinct())
    lines = with_hits(_placed_lines(docs, text, doc_id), ["d", "place"], wanted, ["d", "place"]).where("_hit")
    words = lines.join(wanted, ["d", "place"]).dropDuplicates(["d", "place"])
    words = words.select("d", "place", _words(F.col("line")).alias("w"))
    both = pairs.join(words, ["d", "place"]).join(
        words.select(F.col("d").alias("xd"), F.col("place").alias("xplace"), F.col("w").alias("xw")), ["xd", "xplace"])
    shared = F.size(F.array_intersect("w", "xw"))
    passed = both.where(9 * shared >= 4 * (F.size("w") + F.size("xw")))
    return passed.groupBy("d", "place").agg(F.min(F.struct("xd", "xplace")).alias("match"))


def matched_sets(sets: DataFrame, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(d, place, match): sets, by their first line, with an earlier line that matches it."""
    large = sets.where("n >= 4")
    fields = [F.col("d"), F.col("place"), F.col("low"), F.col("high")]
    packed = lambda i: (F.shiftleft(F.col("n").cast("long"), 32) + i).alias("ni")

    keys = F.concat(F.slice(F.array_sort("prefix"), 1, LEAD_WORDS), "bands")
    lead = large.select(*fields, "n", "prefix", F.explode(keys).alias("t")).select(
        *fields, "t", packed(F.greatest(F.array_position(F.col("prefix"), F.col("t")) - 1, F.lit(0))))
    first = lead.groupBy("t").agg(F.min(F.struct("d", "place", "low", "high", "ni")).alias("f")).select("t", "f.*")
    near = lead.alias("y").join(first.alias("x"), "t").where(_earlier("x", "y") & _can_match("x", "y")).selectExpr(*PAIR)
    settled = held(_verified(near.distinct(), docs, text, doc_id))

    # Only sets that the Bloom filter of settled ones lets through are asked exactly.
    flagged = with_hits(large, ["d", "place"], settled, ["d", "place"])
    asked = flagged.where("_hit").join(settled.select("d", "place", F.lit(True).alias("done")), ["d", "place"], "left")
    columns = ["d", "place", "n", "low", "high", "prefix"]
    flagged = flagged.where("NOT _hit").select(*columns, F.lit(False).alias("done")).unionByName(
        asked.select(*columns, F.coalesce("done", F.lit(False)).alias("done")))
    rows = flagged.select(*fields, "done", "n", F.posexplode("prefix").alias("i", "t")).select(
        *fields, "done", packed(F.col("i")), "t")
    # The order of a pair decides which of the two must be open, so both sides are one exchange.
    met = rows.alias("x").join(rows.alias("y"), "t").where(
        _earlier("x", "y") & _can_match("x", "y") & F.expr("NOT if(x.d <= y.d, y.done, x.done)"))
    return settled.unionByName(_verified(met.selectExpr(*PAIR).distinct(), docs, text, doc_id))


def removed_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(d, place, line, first_d, first_line, match_d, match_line): every line to remove, the
    first line with the same words, and an earlier matching line of other words, if any."""
    lines = stored(line_sets(docs, text, doc_id), "lines", "zstd")
    best = lines.groupBy("k", "k2").agg(F.min(F.struct("d", "place", "n", "low", "high", "bands", "prefix")).alias("s"),
                                           F.count("*").alias("copies"))
    sets = stored(best.select("k", "k2", "copies", "s.*"), "line-sets", "zstd")
    matched = held(matched_sets(sets, docs, text, doc_id))
    # Only sets of several lines or with a match lose lines; the rest is not shuffled again.
    probed = with_hits(sets.select("k", "k2", "copies", "d", "place"), ["d", "place"], matched, ["d", "place"])
    alone = probed.where("NOT _hit").withColumn("match", F.lit(None).cast(matched.schema["match"].dataType))
    either = alone.unionByName(probed.where("_hit").join(matched, ["d", "place"], "left"))
    classes = held(either.where("copies > 1 OR match IS NOT NULL").select(
        "k", "k2", F.col("d").alias("fd"), F.col("place").alias("fplace"), "match"))
    # A third of all lines may be equal: the set is one row, and the join splits their lines.
    some = with_hits(lines.select("d", "place", "k", "k2"), ["k", "k2"], classes, ["k", "k2"]).where("_hit")
    every = some.join(classes, ["k", "k2"])
    gone = every.where(F.col("match").isNotNull() | (F.col("d") != F.col("fd")) | (F.col("place") != F.col("fplace")))
    at = lambda c: F.floor(c / F.lit(1 << 31)).cast("int")
    return gone.select(
        "d", "place", at(F.col("place")).alias("line"), F.col("fd").alias("first_d"), at(F.col("fplace")).alias("first_line"),
        F.col("match.xd").alias("match_d"), at(F.col("match.xplace")).alias("match_line"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents without the removed lines. A text may become empty; the row stays."""
    gone = removed_lines(docs, text, doc_id).select("d", F.pmod("place", F.lit(1 << 31)).alias("h"), "line").distinct()
    gone = held(gone.groupBy("d", "h").agg(F.collect_set("line").alias("gone")))
    own = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("d"),
                      F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).alias("h"))
    # Texts that surely lose no line stay where they are.
    probed = with_hits(own, ["d", "h"], gone, ["d", "h"])
    both = probed.where("_hit").join(gone, ["d", "h"], "left")
    parts = F.split(F.col(f"_doc.`{text}`"), "\n")
    kept = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("gone", i)), "\n")
    value = F.when(F.col("gone").isNull(), F.col(f"_doc.`{text}`")).otherwise(kept)
    return probed.where("NOT _hit").select("_doc.*").unionByName(
        both.select(*[(value if c == text else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns]))
