"""Secret scans: fixed patterns, and a battery of randomness tests under a false-discovery bound.

Patterns find assigned values, access keys and hexadecimal runs. Beside them every run of 20
or more key characters is a candidate. Its encoding is inferred (hexadecimal, letters of one case, base32 or base36 of
either case, base64)
and three tests ask whether it could be random in that alphabet: chi-squared uniformity of the
symbols, Wald-Wolfowitz runs about the middle of the alphabet, and serial correlation. A
candidate that one of them refuses is not random. The same three kinds of statistic then
give p-values under the other hypothesis, ordinary writing, for those left standing:

* uniformity: the sum of squared counts (chi-squared, up to scale) of the letters without
  their case is at least that of ordinary writing, `COINCIDENCE` of all pairs;
* runs: the kind of character (lower, upper, digit, other) changes between neighbours with
  probability `CHANGE` at most;
* serial dependence: in letters alone, vowels and consonants take turns with probability
  `TURNS` at least.

Each is a Chernoff or normal bound, so short candidates need relatively more; Fisher's method
makes one p-value of the three. P-values of all candidates of the whole table are judged
together per length class by the Benjamini-Hochberg rule, so the share of false finds stays
below `FALSE_SHARE` in each class however large the table is. Random letters of one case are
unlike writing by the first and third alone, and need some 60 characters.

Everything is built-in expressions. The first pass leaves counts per length class and p-value
step (a few thousand rows at most); the second is a scan with the found thresholds as a map
literal. No text is shuffled. Positions come from the lengths between matches, added up in
blocks, so a text with very many matches costs time in proportion.

Defined results: a null or empty text has no spans. Repeated rows are scanned each. Columns of
the documents pass through; the added columns replace equally named ones. Empty tables give
empty results.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the patterns find, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 12
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
CHANGE, FALSE_SHARE, MOST_Z = 0.1, 0.01, 3.7
#: Share of equal pairs of letters in ordinary writing, the variance of that share
#: times the length, and how often vowels and consonants take turns.
COINCIDENCE, SPREAD, TURNS = 0.062, 0.0044, 0.55
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789+/-_="
VOWELS = "aeiou"
STEPS, STEP = 400, 0.25
BLOCK = 256
MASK = "[REDACTED]"
ADDED = ("n_assign", "n_access", "n_hex", "base_spans", "spans")
NO_SPANS = "array<struct<start:int,order:int,stop:int>>"


def _ends(gaps: Column, found: Column) -> Column:
    """array<struct<start, stop>> of matches from the texts between them, in blocks."""
    sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found,
                       lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")),
                         lambda i: F.slice(sizes, i * BLOCK + 1, BLOCK))
    bases = F.aggregate(
        blocks, F.array(F.lit(0)),
        lambda all_, b: F.concat(all_, F.array(F.element_at(all_, -1) + F.aggregate(
            b, F.lit(0), lambda s, x: s + x["gap"] + x["size"]))))

    def placed(block, i):
        start = F.struct(F.get(bases, i).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

        def step(acc, x):
            first = acc["at"] + x["gap"]
            return F.struct((first + x["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct(
                first.alias("start"), (first + x["size"]).alias("stop")))).alias("out"))

        return F.aggregate(block, start, step)["out"]

    return F.flatten(F.transform(blocks, placed))


def _spans(text: str, kind: int, pattern: str, keep=None) -> Column:
    """Sorted spans of one pattern; keep(i) may refuse the i-th match."""
    order, found = KINDS[kind], F.col(f"_{KINDS[kind]}")
    spans = F.transform(_ends(F.split(F.col(text), pattern, -1), found), lambda s, i: F.struct(
        s["start"].alias("start"), F.lit(kind).alias("order"), s["stop"].alias("stop"),
        (keep(i) if keep else F.lit(True)).alias("kept")))
    spans = F.transform(F.filter(spans, lambda s: s["kept"]), lambda s: s.dropFields("kept"))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(NO_SPANS)).alias(f"_{order}_spans")


def _kind_of(c: Column) -> Column:
    return F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3)


def _encoding(token: Column) -> Column:
    """The alphabet of the inferred encoding, in order, as a string."""
    return (
        F.when(token.rlike("^[0-9a-f]+$"), "0123456789abcdef")
        .when(token.rlike("^[0-9A-F]+$"), "0123456789ABCDEF")
        .when(token.rlike("^[a-z]+$"), "abcdefghijklmnopqrstuvwxyz")
        .when(token.rlike("^[A-Z]+$"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        .when(token.rlike("^[A-Z2-7]+$"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
        .when(token.rlike("^[a-z2-7]+$"), "abcdefghijklmnopqrstuvwxyz234567")
        .when(token.rlike("^[a-z0-9]+$"), "0123456789abcdefghijklmnopqrstuvwxyz")
        .when(token.rlike("^[A-Z0-9]+$"), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        .when(token.rlike("^[A-Za-z0-9_-]+$"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
        .otherwise("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    )


def _let(value: Column, then) -> Column:
    """`then` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _changes(kinds: Column) -> Column:
    """Share of neighbours of different kinds."""
    pairs = F.zip_with(F.slice(kinds, 1, F.size(kinds) - 1), F.slice(kinds, 2, F.size(kinds) - 1), lambda a, b: a != b)
    return F.size(F.filter(pairs, lambda x: x)).cast("double") / (F.size(kinds) - 1).cast("double")


def _bound(share: Column, null: float, pairs: Column) -> Column:
    """Minus the log of the Chernoff bound on a share of `pairs` that lies off its null."""
    part = lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0)
    return pairs * (part(share, null) + part(1 - share, 1 - null))


def _word_unlikeness(token: Column) -> Column:
    """Minus the log of the p-value under ordinary writing: Fisher's combination of the bounds
    on runs, uniformity and serial dependence."""
    n = F.length(token).cast("double")
    runs = _let(F.transform(F.split(token, ""), _kind_of), lambda kinds: _let(_changes(kinds), lambda share: F.when(
        share > CHANGE, _bound(share, CHANGE, n - 1)).otherwise(0.0)))

    low = F.lower(token)
    squares = F.aggregate(F.split(F.lit(SYMBOLS), ""), F.lit(0.0), lambda s, c: s + F.pow(
        (F.length(low) - F.length(F.replace(low, c, F.lit("")))).cast("double"), F.lit(2.0)))
    spread = F.sqrt(SPREAD / n + 2 * COINCIDENCE * (1 - COINCIDENCE) / (n * n))
    z = F.greatest((COINCIDENCE - (squares - n) / (n * (n - 1))) / spread, F.lit(0.0))
    uniform = _let(z, lambda z: z * z / 2)

    vowels = F.transform(F.split(low, ""), lambda c: F.call_function("instr", F.lit(VOWELS), c) > 0)
    serial = F.when(low.rlike("^[a-z]+$"), _let(vowels, lambda kinds: _let(_changes(kinds), lambda share: F.when(
        share < TURNS, _bound(share, TURNS, n - 1)).otherwise(0.0)))).otherwise(0.0)
    return _let(runs + uniform + serial, lambda total: total - F.log(1 + total + total * total / 2))


def _looks_random(token: Column) -> Column:
    """None of the three tests refuses randomness in the inferred alphabet."""
    bare = F.regexp_replace(token, "=+$", "")
    alphabet = _encoding(bare)
    cells, n = F.length(alphabet).cast("double"), F.length(bare).cast("double")
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda s, c: s + F.pow(
        (F.length(bare) - F.length(F.replace(bare, c, F.lit("")))).cast("double"), F.lit(2.0)))
    chi, free = squares * cells / n - n, cells - 1
    # Wilson and Hilferty: the cube root of chi-squared over its degrees is nearly normal.
    chi_z = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    at = F.transform(F.split(bare, ""), lambda c: F.call_function("instr", alphabet, c).cast("double") - (cells + 1) / 2)
    first, second = F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    high = total(F.transform(at, lambda x: F.when(x > 0, 1.0).otherwise(0.0)))
    low = n - high
    runs = 1 + total(F.zip_with(first, second, lambda a, b: F.when((a > 0) != (b > 0), 1.0).otherwise(0.0)))
    expected = 2 * high * low / n + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    runs_z = F.when((high > 0) & (low > 0), (runs - expected) / spread).otherwise(99.0)
    mean = total(at) / n
    variance = total(F.transform(at, lambda x: (x - mean) * (x - mean)))
    serial = total(F.zip_with(first, second, lambda a, b: (a - mean) * (b - mean)))
    serial_z = F.when(variance > 0, serial / variance * F.sqrt(n)).otherwise(99.0)
    return (F.abs(chi_z) <= MOST_Z) & (F.abs(runs_z) <= MOST_Z) & (F.abs(serial_z) <= MOST_Z)


def _scored(tokens: Column) -> Column:
    """array<struct<size, step>>: length class and p-value step of each candidate; step 0 for
    those that are no different from words or not random."""

    def score(token):
        steps = F.least(F.floor(_word_unlikeness(token) / STEP).cast("int"), F.lit(STEPS))
        step = _let(steps, lambda step: F.when(step == 0, 0).when(_looks_random(token), step).otherwise(0))
        return F.struct(F.floor(F.log2(F.length(token).cast("double"))).cast("int").alias("size"), step.alias("step"))

    return F.transform(tokens, score)


def thresholds(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """Least p-value step that counts as a find, per length class of the whole table."""
    tokens = docs.select(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CANDIDATE), F.lit(0)).alias("t"))
    counts = tokens.where(F.size("t") > 0).select(F.explode(_scored(F.col("t"))).alias("s")).groupBy("s.size", "s.step").count()
    better = Window.partitionBy("size").orderBy(F.desc("step"))
    judged = counts.select("size", "step", F.sum("count").over(better).alias("found"),
                           F.sum("count").over(Window.partitionBy("size")).alias("all"))
    # Benjamini and Hochberg: the largest p-value p with p * all <= share * found.
    passed = judged.where((F.col("step") > 0) & (F.exp(-F.col("step") * STEP) * F.col("all") <= FALSE_SHARE * F.col("found")))
    return {r["size"]: r["least"] for r in passed.groupBy("size").agg(F.min("step").alias("least")).collect()}


def _scan(docs: DataFrame, text: str, least: dict[int, int]) -> DataFrame:
    """_doc, and the spans of each kind."""
    found = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE)
    found = found.select("*", *[
        F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"_{k}") for k, p in zip(KINDS, patterns, strict=True)])
    values = F.when(F.size("_assign") > 0, F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2)))
    limits = F.create_map(*[F.lit(x) for pair in (least or {-1: STEPS + 1}).items() for x in pair])
    found = found.select("*", values.alias("_values"), F.when(F.size("_random") > 0, _scored(F.col("_random"))).alias("_scores"))

    def is_find(i):
        score = F.get(F.col("_scores"), i)
        return score["step"] >= F.coalesce(F.try_element_at(limits, score["size"]), F.lit(STEPS + 1))

    found = found.select(
        "_doc", "_text",
        _spans("_text", 0, ASSIGN, lambda i: F.length(F.get(F.col("_values"), i)) >= LEAST_VALUE),
        _spans("_text", 1, ACCESS), _spans("_text", 2, HEX), _spans("_text", 3, CANDIDATE, is_find))
    base = F.array_sort(F.concat("_assign_spans", "_access_spans", "_hex_spans"))
    found = found.select("*", base.alias("_base"))
    apart = F.filter("_random_spans", lambda r: ~F.exists(
        "_base", lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"])))
    return found.withColumn("_random_spans", apart)


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(spans, lambda s: F.struct(
        F.get(names, s["order"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with counts per kind, `base_spans` of the patterns, and all `spans`; a span is
    (kind, start, stop) in code points, sorted by start, then kind."""
    found = _scan(docs, text, thresholds(docs, text))
    return found.select(
        *[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in ADDED],
        F.size("_assign_spans").cast("long").alias("n_assign"), F.size("_access_spans").cast("long").alias("n_access"),
        F.size("_hex_spans").cast("long").alias("n_hex"),
        _named(F.col("_base")).alias("base_spans"),
        _named(F.array_sort(F.concat("_base", "_random_spans"))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:stop of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def mask_secrets(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """Documents with every found span replaced; overlapping spans by one mask. Columns keep
    their order and a null text stays null."""
    found = _scan(docs, text, thresholds(docs, text))
    spans = F.array_sort(F.concat("_base", "_random_spans"))
    merged = F.aggregate(
        spans, F.array().cast("array<struct<start:int,stop:int>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.coalesce(F.get(out, F.size(out) - 1)["stop"], F.lit(0)) > s["start"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(
                F.get(out, F.size(out) - 1)["start"].alias("start"),
                F.greatest(F.get(out, F.size(out) - 1)["stop"], s["stop"]).alias("stop"))))
        ).otherwise(F.concat(out, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))))
    found = found.select("_doc", "_text", merged.alias("_merged"))
    starts = F.concat(F.array(F.lit(0)), F.transform("_merged", lambda s: s["stop"]))
    stops = F.concat(F.transform("_merged", lambda s: s["start"]), F.array(F.length("_text")))
    masked = F.array_join(F.zip_with(starts, stops, lambda a, b: F.substr(F.col("_text"), a + 1, b - a)), mask)
    value = F.when(F.size("_merged") > 0, masked).otherwise(F.col(f"_doc.`{text}`"))
    return found.select(*[(value if c == text else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
