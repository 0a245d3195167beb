import zlib
from hashlib import sha256

import pytest
from compare import compare, connect
from lanepulse.llm import merkle, queries, sql
from lanepulse.llm.ranks import with_places
from pyspark.sql import functions as F

NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def up(nodes):
    """The top, and per node its steps (left, right) to it."""
    paths, ranks, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, at in enumerate(ranks):
            first = at - at % 8
            paths[i].append(("".join(level[first:at]), "".join(level[at + 1: first + 8])))
        level = [h(*level[k: k + 8]) for k in range(0, len(level), 8)]
        ranks = [r // 8 for r in ranks]
    return level[0], paths


def plain(rows):
    """Result rows; row: the five fields."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        found[g] = up([leaf(r) for r in groups[g]])
    root, above = up([found[g][0] for g in order])
    out = []
    for g, more in zip(order, above, strict=True):
        top, paths = found[g]
        for row, path in zip(groups[g], paths, strict=True):
            steps, node = path + more, row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                node = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            node = leaf(node)
            for left, right in steps:
                node = h(left, node, right)
            out.append((row[0], leaf(row), top, root, h(*[s for step in steps for s in step]), node, node == root))
    return sorted(out, key=str)


def ours(spark, rows, monkeypatch, **more):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, leaf int, g string")
    monkeypatch.setattr(queries, "_table", lambda *_: docs)
    return sorted(map(tuple, queries.op13_manifest(spark, "").collect()), key=str)


def test_odd_rows(spark, monkeypatch):
    rows = [(i, "s", "en", 3, f"Text {i}") for i in range(75)]  # three levels
    rows += [(i, None, None, None, None if i % 2 else "É A") for i in range(9)]
    rows += [(1, "s", "de", 1, "lone"), (2, "s", "", 1, ""), (7, "a:b", "é", 1, "-")]
    rows += [(5, "s", "fr", 1, "Same")] * 5 + [(5, "s", "fr", 1, "Other"), (None, "s", "fr", 1, "No Id")]
    rows += [(3, "s", f"l{i}", 1, "X" * 200_000) for i in range(12)]  # two levels of groups
    got = ours(spark, rows, monkeypatch)
    assert got == plain(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_sizes(spark, monkeypatch, n):
    rows = [(i, "s", "en", 1, "T") for i in range(n)]
    assert ours(spark, rows, monkeypatch) == (plain(rows) if rows else [])


def test_documents(spark, sf_dir):
    rows = [tuple(r[n] for n in NAMES) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op13_manifest(spark, sf_dir).collect()), key=str)
    assert got == plain(rows)
    ok, n, why = compare(spark, connect(sf_dir), sf_dir, "op13", queries.op13_manifest, sql.oracle_sql()["op13_manifest"])
    assert ok and n == len(rows), why


def test_places_of_equal_rows(spark):
    """A group of equal rows fills several partitions and is numbered without gaps."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, "a").alias("g"), F.lit(1).alias("v"))
    placed = with_places(rows.repartition(7), ["g"], [F.col("v")])
    got = {r.g: r for r in placed.groupBy("g").agg(
        F.count("*").alias("n"), F.countDistinct("place").alias("d"), F.min("place").alias("a"), F.max("place").alias("b"),
        F.max("size").alias("s")).collect()}
    assert {g: (r.n, r.d, r.a, r.b, r.s) for g, r in got.items()} == {
        "a": (20_000, 20_000, 0, 19_999, 20_000), None: (10_000, 10_000, 0, 9_999, 10_000)}
