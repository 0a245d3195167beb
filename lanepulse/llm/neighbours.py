"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by a pseudo-random rotation (three rounds of random signs and a fast
Hadamard transform, padded to a power of two) and falls into the cell of its nearest signed
axis. Each of `tables` rotations makes one table; a query looks into the `probes` share of
cells whose axes are nearest to it, in every table. Cells go by direction alone, so no norm
can crowd the other vectors together.

Whether that share is enough is measured on the data: a fixed sample of the queries is compared
with every vector, which costs one pass, and tells how far each true neighbour's cell is down
the query's order. Where the sample's recall at `probes` is below RECALL, or one of its queries
finds fewer than LEAST of its own, the share is raised; once that many cells in all tables
would be more than the whole table, the whole is compared once. Queries that still have fewer
than `k` results are compared with every vector, so all candidates come back where there are
no more than `k`.

Every vector is indexed. Cells are cut into blocks of about `block` rows by the hash of their
id, so a cell that holds a third of all vectors is many blocks, and small cells share one. A
task sorts its rows so that a block's vectors come first and then the queries that probe it,
which stream by in batches: memory is one block and one batch. Candidates are ranked by their
exact inner product in double precision, and only a query's best `k` of a block go on.

Random vectors of 64 dimensions have no near neighbours to speak of (the 20th of 50,000 lies
at a cosine of 0.4), so the default share of probes is large: three tables of 0.4 reach a
recall of 0.97 and more on such data. Lower `probes` where data cluster.

Defined results: vectors that are null, zero, of another dimension than most, or that hold
null or non-finite components take no part, as queries neither. Rows that share a query's id
count as its own. Repeated rows count once; different vectors of one id count as one, with
the score of the best of them, and queries of one id likewise. Ties go to the smaller id.
Empty tables give empty results.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.llm.stored import held

K, TABLES, PROBES, BLOCK, BATCH, SEED = 20, 3, 0.4, 20_000, 256, 7
SAMPLE, RECALL, LEAST = 128, 0.97, 0.7


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def axes(vectors: np.ndarray, table: int) -> np.ndarray:
    """Signed coordinates of the directions after the table's rotation: a column per cell."""
    size = 1 << (vectors.shape[1] - 1).bit_length()
    x = np.zeros((len(vectors), size))
    x[:, : vectors.shape[1]] = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares stay in range
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(SEED + table)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], size))
    return np.concatenate((x, -x), axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _probed(vectors: np.ndarray, table: int, share: float) -> np.ndarray:
    """Boolean (query, cell)."""
    signed = axes(vectors, table)
    n = max(1, round(share * signed.shape[1]))
    out = np.zeros(signed.shape, bool)
    np.put_along_axis(out, np.argpartition(-signed, n - 1, axis=1)[:, :n], True, axis=1)
    return out


def _share_needed(base: DataFrame, asked: DataFrame, k: int, tables: int) -> list[list[float]]:
    """For each query of a sample, the share of cells at which each of its true `k` nearest is met."""
    sample = asked.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()
    if not sample:
        return []
    ids, m = np.array([r["id"] for r in sample]), np.array([r["v"] for r in sample])
    order = np.stack([np.argsort(np.argsort(-axes(m, t), axis=1), axis=1) for t in range(tables)])  # places from 0

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, v, cells = batch["id"].to_numpy(), _matrix(batch["v"]), np.stack(batch["cells"].to_numpy())
            if not len(own):
                continue
            everywhere = np.ones((len(m), 1), bool)
            q, r, exact = _best_rows(m, ids, own, v, np.zeros(len(own), int), everywhere, k)
            place = np.min([order[t, q, cells[r, t]] for t in range(tables)], axis=0)
            yield pd.DataFrame({"q": q, "id": own[r], "score": exact, "need": (place + 1) / order.shape[2]})

    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    met = base.select("id", "v", "cells").mapInPandas(nearest, "q long, id long, score double, need double")
    met = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q", "need").collect()
    needs = [[] for _ in sample]
    for r in met:
        needs[r["q"]].append(r["need"])
    return [sorted(x) for x in needs if x]


def enough(needs: list[list[float]], probes: float, tables: int) -> float:
    """The least share from `probes` on with the sample's recall; 1 if that costs less."""
    if not needs:
        return probes
    together = sorted(x for own in needs for x in own)
    need = max(together[int(np.ceil(RECALL * len(together))) - 1], *(x[int(np.ceil(LEAST * len(x))) - 1] for x in needs))
    return probes if need <= probes else 1.0 if need * tables >= 1 else float(need)


def _best_rows(queries, ids, own, vectors, cells, probed, k):
    """Exact best `k` ids of one block for a batch of queries: (query's place, vector's place, score) rows."""
    scores = queries @ vectors.T
    scores[~probed[:, cells]] = -np.inf
    scores[ids[:, None] == own[None, :]] = -np.inf
    names, name = np.unique(own, return_inverse=True)
    slack = 1e-9 * np.maximum(1.0, np.where(np.isfinite(scores), np.abs(scores), 0).max(axis=1, initial=0))[:, None]
    chosen, best = np.isfinite(scores), scores
    if len(names) < len(own):  # several vectors of one id: the best of them speaks for it
        order = np.argsort(name, kind="stable")
        best = np.maximum.reduceat(scores[:, order], np.searchsorted(name[order], np.arange(len(names))), axis=1)
        chosen &= scores >= best[:, name] - slack
    if len(names) > k:
        chosen &= scores >= np.partition(best, -k, axis=1)[:, -k][:, None] - slack
    q, r = np.nonzero(chosen)
    exact = (queries[q] * vectors[r]).sum(axis=1)  # one order of addition, wherever a pair is met
    order = np.lexsort((own[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    if len(names) < len(own):
        first = np.sort(np.unique(np.stack([q, own[r]]), axis=1, return_index=True)[1])
        q, r, exact = q[first], r[first], exact[first]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], r[keep], exact[keep]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = K, tables: int = TABLES, probes: float = PROBES,
    block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) for every query."""
    def tidy(df):
        v = F.col(embedding)
        sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.where(F.col(vec_id).isNotNull() & sound).select(
            F.col(vec_id).cast("long").alias("id"), v.cast("array<double>").alias("v")).dropDuplicates()

    base, asked = tidy(vectors), tidy(queries)
    found = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = found["n"]

    @F.pandas_udf("array<int>")
    def cells_of(column: pd.Series) -> pd.Series:
        m = _matrix(column)
        return pd.Series(list(np.stack([axes(m, t).argmax(axis=1) for t in range(tables)], axis=1).astype(np.int32)))

    base = held(base.where(F.size("v") == dims).select("id", "v", cells_of("v").alias("cells")))
    asked = asked.where(F.size("v") == dims)
    share = probes if probes >= 1 else enough(_share_needed(base, asked, k, tables), probes, tables)
    placed = base.select("id", "v", F.posexplode("cells").alias("t", "cell"))
    counts = {(r["t"], r["cell"]): r["count"] for r in placed.groupBy("t", "cell").count().collect()}
    width = 2 * (1 << (dims - 1).bit_length())
    first, parts, at, room = np.zeros((tables, width), np.int64), np.ones((tables, width), np.int64), -1, 0
    for t in range(tables):
        room = 0
        for cell in range(width):  # small cells share a block, large ones are cut
            n = counts.get((t, cell), 0)
            if n > block:
                parts[t, cell], room = -(-n // block), 0
                first[t, cell], at = at + 1, at + parts[t, cell]
            else:
                if n > room or at < 0:
                    at, room = at + 1, block
                first[t, cell], room = at, room - n

    @F.pandas_udf("long")
    def block_of(ts: pd.Series, cells: pd.Series, salt: pd.Series) -> pd.Series:
        t, c = ts.to_numpy(), cells.to_numpy()
        return pd.Series(first[t, c] + salt.to_numpy() % parts[t, c])

    rows = placed.select("t", block_of("t", "cell", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("b"),
                         F.lit(0).alias("kind"), "id", "v", "cell")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(asked: DataFrame, share: float) -> DataFrame:
        """One table is enough where all cells are probed."""
        over = 1 if share >= 1 else tables

        @F.pandas_udf("array<struct<t:int,b:long>>")
        def asked_blocks(column: pd.Series) -> pd.Series:
            m, out = _matrix(column), [[] for _ in range(len(column))]
            for t in range(over):
                probed = _probed(m, t, share)
                for i in range(len(m)):
                    own = np.flatnonzero(probed[i])
                    blocks = {int(f) + j for f, p in zip(first[t, own], parts[t, own], strict=True) for j in range(int(p))}
                    out[i] += [(t, b) for b in sorted(blocks)]
            return pd.Series(out)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            here, parts_of, block_rows = None, [], None
            for batch in batches:
                for (b, t, kind), part in batch.groupby(["b", "t", "kind"], sort=True):
                    if b != here:
                        here, parts_of, block_rows = b, [], None
                    if kind == 0:
                        parts_of.append((part["id"].to_numpy(), _matrix(part["v"]), part["cell"].to_numpy()))
                        continue
                    if parts_of:
                        block_rows = [np.concatenate([p[i] for p in parts_of]) for i in range(3)]
                        parts_of = []
                    if block_rows is None:
                        continue
                    for i in range(0, len(part), BATCH):
                        batch_of = part.iloc[i : i + BATCH]
                        m, ids = _matrix(batch_of["v"]), batch_of["id"].to_numpy()
                        q, r, exact = _best_rows(m, ids, *block_rows, _probed(m, int(t), share), k)
                        yield pd.DataFrame({"query_id": ids[q], "vec_id": block_rows[0][r], "score": exact})

        asks = asked.select("id", "v", F.explode(asked_blocks("v")).alias("p"))
        asks = asks.select("p.t", "p.b", F.lit(1).alias("kind"), "id", "v", F.lit(-1).alias("cell"))
        together = rows.where(F.col("t") < over).unionByName(asks).repartition("b").sortWithinPartitions("b", "kind")
        candidates = together.mapInPandas(score, "query_id long, vec_id long, score double").groupBy(
            "query_id", "vec_id").agg(F.max("score").alias("score"))
        return candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score")

    if share >= 1:
        return ranked(asked, 1.0)
    near = held(ranked(asked, share))
    full = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = held(asked.join(full, "id", "left_anti"))
    if short.isEmpty():
        return near
    return near.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").select(
        near.columns).unionByName(ranked(short, 1.0))
