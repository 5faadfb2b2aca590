"""Exact top-k search by inner product over vectors in the order of their length.

The scaled integer vectors are sorted by descending length and packed into blocks.  A rotation from
the singular vectors of the whole table (its Gram matrix is summed up over all rows) moves most of a
vector's weight into its first components, so that the partial product over these, plus the product
of the two remainders' lengths (Cauchy-Schwarz), bounds the score closely.  Pairs whose bound lies
below a query's k-th best score are dropped; the others are scored exactly in integers.

Work is a grid: blocks are dealt in turn to block groups, so that each has long and short vectors, and
queries to query groups; a cell holds a bounded number of both and walks its blocks from long to
short, stopping where no query can gain.  A cell returns k rows a query, which are then merged.

Vectors that are null or hold null or non-finite components, and rows without an id, take no part.
Shorter vectors count as filled up with zeros.  Scores are exact while they fit in 63 bits; beyond
that they are cut to the range of a long.  Rows that repeat an id are candidates each; a repeated
query is answered once, for the least of its vectors.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facsimile.llm.store import checked, keep, typed
from facsimile.operators.ordered import running

# Vectors in a block, vectors in a cell, and queries in a cell, at most (about).
BLOCK_ROWS = 1024
CELL_ROWS = 32768
CELL_QUERIES = 2048
# Blocks are numbered anew in each task, at this distance.
TASK_BLOCKS = 1 << 32
#: Shares of the components summed up before a pair is first tested against its bound.
HEAD = 0.25


def scaled(vectors: pd.Series, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each vector, as doubles, filled up to ``dims``."""
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return np.floor(out * scale)


def rotation(rows: DataFrame, dims: int, scale: float) -> np.ndarray:
    """Right singular vectors of all rows, from the Gram matrix that the tasks sum up."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for rows in batches:
            x = scaled(rows.v, dims, scale)
            total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(dims * dims), "value": total.ravel()})

    cells = rows.select("v").mapInPandas(gram, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    sums = np.zeros(dims * dims)
    for r in cells.collect():  # dims * dims rows
        sums[r["cell"]] = r["value"]
    sums = sums.reshape(dims, dims)
    peak = np.abs(sums).max(initial=0.0)
    if not np.isfinite(peak) or peak == 0:
        return np.eye(dims)
    return np.linalg.eigh(sums / peak)[1][:, ::-1].copy()


def packed(rows: DataFrame, parts: int, dims: int, scale: float, by_length: bool) -> DataFrame:
    """Rows (id, v) as blocks: block, longest, ids and vectors (as bytes)."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + F.floor(e * scale).cast("double") ** 2))
    rows = rows.withColumn("length", length)
    dealt = rows.repartitionByRange(parts, F.desc("length"), "id") if by_length else rows.repartition(parts, F.xxhash64("id"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = 0  # blocks of the task, over all its batches
        for rows in batches:
            for k in range(0, len(rows), BLOCK_ROWS):
                some = rows.iloc[k:k + BLOCK_ROWS]
                x = scaled(some.v, dims, scale)
                yield pd.DataFrame({"block": some.block.iloc[:1] * TASK_BLOCKS + done, "longest": [some.length.max()],
                                    "ids": [some.id.to_numpy("int64").tobytes()], "vectors": [x.tobytes()]})
                done += 1

    ordered = dealt.sortWithinPartitions(F.desc("length"), "id") if by_length else dealt
    return ordered.select(F.spark_partition_id().cast("long").alias("block"), "id", "v", "length") \
        .mapInPandas(pack, "block long, longest double, ids binary, vectors binary")


class Best:
    """The k best (score, id) of every query of a cell."""

    def __init__(self, n: int, k: int, exact: type):
        self.k, self.score = k, np.full((n, k), -np.inf, dtype=exact)
        self.id = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score > self.score[query, -1]) | ((score == self.score[query, -1]) & (ids < self.id[query, -1]))
        query, score, ids = query[better], score[better], ids[better]
        if not len(query):
            return
        touched = np.unique(query)
        q = np.concatenate([np.repeat(touched, self.k), query])
        s = np.concatenate([self.score[touched].ravel(), score])
        i = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.score[q[top], place[top]] = s[top]
        self.id[q[top], place[top]] = i[top]


def search_cell(q_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[float, np.ndarray, np.ndarray]], turn: np.ndarray, k: int,
                exact: type = np.float64) -> Best:
    """``blocks``: (longest, ids, vectors) from long to short.  ``exact`` is a float type that holds
    every score."""
    head = max(1, int(queries.shape[1] * HEAD))
    q_turned = queries @ turn
    q_length = np.sqrt((queries ** 2).sum(axis=1))
    q_rest = np.sqrt((q_turned[:, head:] ** 2).sum(axis=1))
    best = Best(len(queries), k, exact)
    whole = queries.astype(exact)
    for longest, ids, x in blocks:
        slack = 1e-9 * q_length * longest + 1e-6
        live = np.flatnonzero(q_length * longest + slack >= best.worst())
        if not len(live):
            break
        turned = x @ turn
        rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
        bound = q_turned[live, :head] @ turned[:, :head].T + q_rest[live, None] * rest + slack[live, None]
        open_pairs = bound >= best.worst()[live, None]
        if open_pairs.mean() > 0.1:
            score = whole[live] @ x.T.astype(exact)
            score[queries_own(q_ids[live], ids)] = -np.inf
            if x.shape[0] > k:  # what lies below the block's own k-th best can't matter either
                floor = np.maximum(best.worst()[live], np.partition(score, -k, axis=1)[:, -k])
            else:
                floor = best.worst()[live]
            a, b = np.nonzero(open_pairs & (score >= floor[:, None]) & np.isfinite(score))
            got = score[a, b]
        else:
            a, b = np.nonzero(open_pairs & ~queries_own(q_ids[live], ids))
            got = (whole[live[a]] * x[b]).sum(axis=1)
        best.add(live[a], got, ids[b])
    return best


def queries_own(q_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return q_ids[:, None] == ids[None, :]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """For each row of ``vectors(vec_id, embedding)`` whose id is divisible by ``every``: its ``k``
    highest integer inner products with all other rows, as query_id, rank, vec_id, score."""
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = keep(typed(vectors, vec_id="long", embedding="array<double>").toDF("id", "v")
                .where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine), "vectors")
    spark = rows.sparkSession
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.array_max(
        F.transform("v", lambda e: F.abs(e)))).alias("peak"), F.sum((F.col("id") % every == 0).cast("long")).alias("asked")).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not size["asked"] or not size["dims"]:
        return spark.createDataFrame([], out)
    dims = size["dims"]
    exact = np.float64 if dims * (scale * size["peak"] + 1) ** 2 < 2 ** 53 else np.longdouble  # 53 and 64 bits
    turn = rotation(rows, dims, scale)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_groups = max(-(-size["n"] // CELL_ROWS), min(tasks, -(-size["n"] // BLOCK_ROWS)))
    query_groups = -(-size["asked"] // CELL_QUERIES)
    blocks = keep(packed(rows, -(-size["n"] // BLOCK_ROWS), dims, scale, by_length=True), "vector-blocks")
    queries = keep(packed(asked, query_groups, dims, scale, by_length=False), "query-blocks")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    numbered = running(blocks.select("block", (-F.col("longest")).alias("shortness")), ["shortness", "block"], row_number="turn")
    dealt = numbered.select("block", F.pmod("turn", F.lit(block_groups)).cast("int").alias("bg"))
    left = blocks.join(checked(dealt), "block").withColumn("qg", spread(query_groups))
    right = queries.withColumn("qg", F.pmod(F.xxhash64("block"), F.lit(query_groups)).cast("int")).withColumn("bg", spread(block_groups))

    def cell(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(some) or not len(asked):
            return pd.DataFrame({n: np.empty(0, dtype="int64") for n in names})
        some = some.sort_values(["longest", "block"], ascending=[False, True])
        q_ids = np.concatenate([np.frombuffer(b, dtype="int64") for b in asked.ids])
        queries = np.concatenate([np.frombuffer(b).reshape(-1, dims) for b in asked.vectors])
        parts = [(r.longest, np.frombuffer(r.ids, dtype="int64"), np.frombuffer(r.vectors).reshape(-1, dims)) for r in some.itertuples()]
        best = search_cell(q_ids, queries, parts, turn, k, exact)
        a, b = np.nonzero(np.isfinite(best.score))
        scores = best.score[a, b]
        if exact is not np.float64:
            scores = np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in scores], dtype="int64")
        return pd.DataFrame(dict(zip(names, (q_ids[a], best.id[a, b], scores.astype("int64")))))

    found = left.groupBy("qg", "bg").cogroup(right.groupBy("qg", "bg")).applyInPandas(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
