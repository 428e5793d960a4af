"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of distinct vectors. A vector is represented by its nearest pivots in order. Vectors are
dealt evenly to blocks; a block posts its vectors in an inverted file for each pivot, with the pivot's place in the
vector's order. A query goes through the files of its own nearest pivots and adds up the footrule distance: how far the
places of a pivot lie apart, and the length of the orders for a pivot that isn't in both. The vectors of a block with the
least sum, a fixed share of it at every size, are reranked by exact distance; nothing else is measured exactly.

Of equal vectors only those that can be among a query's neighbours are posted, so copies don't crowd the share that is
reranked. A vector is moved once, a query once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

#: Pivots: one for so many vectors, and at most so many. Share of the pivots that an order holds.
VECTORS_PER_PIVOT, MOST_PIVOTS, ORDER = 2, 256, 0.5
#: Share of a block that is reranked by exact distance.
RERANK = 0.2
#: Vectors that a task holds as a block.
BLOCK = 8_192


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x to y, in double precision."""
    return np.sqrt(((x - y) ** 2).sum(1))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct (id, v): no null id, no null, empty or zero vector, no null or non-finite component."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    return out.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)).distinct()


def orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    d = ((x * x).sum(1)[:, None] - 2 * x @ pivots.T) + (pivots * pivots).sum(1)[None]
    return np.argsort(d, axis=1, kind="stable")[:, :length].astype(np.int16)


class Files:
    """The inverted files of a block: for each pivot the rows whose order holds it, and its place there."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, pivots: int):
        self.ids, self.vectors, self.length, self.measured = ids, vectors, order.shape[1], 0
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.starts = np.searchsorted(order.ravel()[by_pivot], np.arange(pivots + 1))
        self.rows, self.places = by_pivot // self.length, (by_pivot % self.length).astype(np.int32)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of each row's order to a query's, but for a constant: a pivot that both hold saves the most
        that it could cost."""
        out = np.zeros(len(self.ids), np.int32)
        for place, p in enumerate(order.tolist()):
            own = slice(self.starts[p], self.starts[p + 1])
            out[self.rows[own]] += np.abs(self.places[own] - place) - (self.length - place) - (self.length - self.places[own])
        return out

    def nearest(self, query: int, vector: np.ndarray, order: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest of what is reranked, which is k rows at least; the query's own row isn't."""
        at = np.flatnonzero(self.ids != query)
        take = max(k, int(np.ceil(share * len(at))))
        if len(at) > take:
            at = at[np.argpartition(self.footrule(order)[at], take - 1)[:take]]
        self.measured += len(at)
        d = distances(self.vectors[at], vector)
        best = np.lexsort((self.ids[at], d))[:k]
        return self.ids[at][best], d[best]


def nearest(vectors: DataFrame, query_ids, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", rerank: float = RERANK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for each query, nearest first, ties to the smaller id.

    query_ids: a condition on a column id, the id cast to long, that says which rows are queries. Rows with a null id,
    and null, empty, zero or non-finite vectors, take no part; nor do vectors of another dimension than most have. Rows
    that repeat an id and a vector count once. Other columns are not read, so their names can't clash. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    table = stored(usable(vectors, id_col, vec_col), "ann-vectors")
    dims = table.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim, total = (dims[0]["d"], dims[0]["count"]) if dims else (1, 0)
    table = table.where(F.size("v") == dim)
    sample = table.groupBy("v").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id"), "id", "v").limit(int(max(1, min(MOST_PIVOTS, total // VECTORS_PER_PIVOT)))).collect()
    n_pivots = max(1, len(sample))
    pivots = spark.sparkContext.broadcast(np.array([r["v"] for r in sample], float).reshape(-1, dim))
    length, blocks = max(1, round(ORDER * n_pivots)), max(1, -(-total // block))

    def ordered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                yield pdf[["b", "q", "id"]].assign(v=[r.tobytes() for r in x], o=[r.tobytes() for r in orders(x, pivots.value, length)])

    # Of equal vectors no query has others than these among its k.
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    posted = table.withColumn("copy", copy).where(F.col("copy") <= k + 1).select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("b"), F.lit(False).alias("q"), "id", "v")
    asked = table.where(F.coalesce(query_ids, F.lit(False))).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(True).alias("q"), "id", "v")
    schema = "b int, q boolean, id long, v binary, o binary"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, files, now = [], None, None

        def opened() -> Files:
            ids, v, o = zip(*waiting, strict=True) if waiting else ([np.zeros(0, np.int64)], [b""], [b""])
            waiting.clear()
            return Files(np.concatenate(ids), np.frombuffer(b"".join(v)).reshape(-1, dim), np.frombuffer(b"".join(o), np.int16).reshape(-1, length), n_pivots)

        for batch in batches:  # sorted: the vectors of a block, then the queries
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            found = []
            for b, q, i, v, o in rows:
                if b != now:
                    waiting.clear()
                    files, now = None, b
                if not q:
                    waiting.append((np.array([i]), v, o))
                    continue
                files = files or opened()
                ids, d = files.nearest(i, np.frombuffer(v), np.frombuffer(o, np.int16), k, rerank)
                found.append((np.full(len(ids), i), ids, d))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    index = posted.unionByName(asked).mapInPandas(ordered, schema)
    found = index.repartition("b").sortWithinPartitions("b", "q").mapInArrow(search, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
