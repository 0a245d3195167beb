"""Merkle manifest of a dataset: digests, proofs and their verification.

A leaf is the digest of a row's fields. Leaves of one partition value (a language) ascend by
id; runs of eight become the digest of their members until one node, the subroot, is left.
Subroots, ordered by partition value, form the root in the same way.

Every node is labelled with the interval [lo, hi) of leaf ranks that it covers:

1. leaves are ranked within their partition value (`ranks.with_places`), so a value that holds
   all rows is no single task;
2. each level groups eight neighbours: node, level by level, an eighth of the rows each time;
3. downwards, a node finds its parent among those of the next level by the bucket its interval
   starts in and containment of the intervals (at most eight rows a bucket), and inherits the
   parent's siblings; its own siblings are the parent's children outside its own interval.

The number of levels is the logarithm of the largest group. Only that size reaches the driver.
All work is built-in expressions.

Defined results: a null field is `-` and so unlike an empty one. Null partition values are a
group of their own, the first; null ids come first in it. Rows of one id are ordered by their
digest; equal rows take neighbouring ranks and each has a proof of its own. A row whose id is
null counts as untampered. A lone leaf is its group's subroot, with no siblings below it.
Columns other than those named do not enter digests. An empty table has no rows and no root.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse.llm.ranks import with_places
from lanepulse.llm.stored import stored

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: `-` for null, else byte length, a colon and the value, per field."""
    def written(field):
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*[written(f) for f in fields])


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def grown(leaves: DataFrame) -> list[DataFrame]:
    """Levels of nodes (g, size, lo, hi, digest; children above the leaves), leaves first.
    `leaves` hold g, place, size, digest and may hold more."""
    levels = [leaves.withColumn("lo", F.col("place")).withColumn("hi", F.col("place") + 1)]
    largest, span = leaves.agg(F.max("size")).first()[0] or 0, 1
    while span < largest:
        child = F.struct("lo", "hi", "digest")
        parents = (
            levels[-1].where(F.col("size") > span)
            .groupBy("g", F.expr(f"lo div {span * ARITY}").alias("bucket"))
            .agg(F.max("size").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                 F.sort_array(F.collect_list(child)).alias("children"))  # at most ARITY
        )
        levels.append(stored(parents.select(
            "g", "size", "lo", "hi", "children",
            digest(_joined(F.transform("children", lambda c: c["digest"]))).alias("digest")), "merkle"))
        span *= ARITY
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(g, digest) of the node that is left of each group."""
    found = [nodes.where(F.col("size").between(ARITY ** k // ARITY + 1 if k else 0, ARITY ** k)).select("g", "digest")
             for k, nodes in enumerate(levels)]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def descended(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with `path`: per level, from theirs to the root, the digests of the siblings
    left and right of them. `above` holds (g, path) of each group's own top, and may hold more."""
    extra = [c for c in above.columns if c not in ("g", "path")]
    above = above.select(F.col("g").alias("_g"), "path", *extra)
    prev = None
    for k in reversed(range(len(levels))):
        span, nodes = ARITY ** k, levels[k]
        here = nodes.where(F.col("size") <= span).join(above, F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
        if prev is not None:
            parents = prev.select(
                F.col("g").alias("_g"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                F.expr(f"lo div {span * ARITY}").alias("_bucket"), "children", F.col("path").alias("_path"), *extra)
            inside = (F.col("g").eqNullSafe(F.col("_g")) & (F.expr(f"lo div {span * ARITY}") == F.col("_bucket"))
                      & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
            below = nodes.where(F.col("size") > span)
            if k:
                below = below.withColumnRenamed("children", "own")
            met = below.join(parents, inside)

            def siblings(keep):
                return _joined(F.transform(F.filter("children", keep), lambda c: c["digest"]))

            step = F.struct(siblings(lambda c: c["hi"] <= F.col("lo")).alias("left"),
                            siblings(lambda c: c["lo"] >= F.col("hi")).alias("right"))
            met = met.withColumn("path", F.concat(F.array(step), "_path")).drop(
                "_g", "_lo", "_hi", "_bucket", "_path", "children")
            if k:
                met = met.withColumnRenamed("own", "children")
            here = here.unionByName(met)
        prev = here
    return prev


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(_joined(F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id",
             tampered: dict[str, Column] | None = None, suspect: Column | None = None) -> DataFrame:
    """(order column, leaf, seen, subroot, root, path) per row. `seen` is the leaf as found at
    verification: rows where `suspect` holds have the fields of `tampered` replaced."""
    plain = leaf_digest([F.col(f"`{f}`") for f in fields])
    seen = plain
    if tampered:
        changed = leaf_digest([tampered.get(f, F.col(f"`{f}`")) for f in fields])
        seen = F.when(F.coalesce(suspect, F.lit(False)), changed).otherwise(plain)
    rows = docs.select(
        F.col(f"`{group}`").alias("g"), F.col(f"`{order}`").alias("key"), plain.alias("digest"), seen.alias("seen"))
    leaves = with_places(stored(rows, "leaves"), ["g"], [F.col("key"), F.col("digest")])
    levels = grown(stored(leaves, "leaves"))

    subroots = tops(levels).select(F.col("g").alias("lang"), F.lit(0).alias("g"), F.col("digest"))
    upper = grown(stored(with_places(subroots, ["g"], [F.col("lang")]), "subroots"))
    root = tops(upper).select(F.col("g").alias("_one"), F.col("digest").alias("root"))
    no_path = F.array().cast(NO_PATH)
    above = descended(upper, root.select(F.col("_one").alias("g"), no_path.alias("path"), "root"))
    above = stored(above.select(F.col("lang").alias("g"), "path", F.col("digest").alias("subroot"), "root"), "subroots")
    return descended(levels, above).select(
        F.col("key").alias(order), F.col("digest").alias("leaf"), "seen", "subroot", "root", "path")
