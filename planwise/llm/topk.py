"""Exact top-k by inner product, without random access.

Every dimension is a list of a block's vectors sorted by their component; a query reads the lists of
its dimensions in sequence, from the top where its own component is positive and from the bottom where
it is negative, a window of every list a round. What has been read of a vector adds up to its sum; what
has not lies between the list's far end and its reading position, so each vector has a lower and an
upper bound. Windows double until few vectors can still reach the k-th lower bound; all others, those that
no list has shown included, cannot qualify. Only the few have their scores resolved. A task carries
each query's k-th score from block to block, so later blocks start with a threshold.

Values are integers; sums stay exact in doubles below 2^53. Blocks whose products might pass that are
scored whole in 64-bit integers.

Vectors that are null, empty, or hold null or non-finite components take no part; vectors meet only
those of their own length. A query's own row is every row with its vec_id. Rows that repeat are
candidates as often as they come. Ties go to the smaller vec_id. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block; queries that one pass carries; bytes of queries that one broadcast may hold.
BLOCK, QUERIES, BROADCAST_BYTES = 2048, 256, 32 << 20
#: The first window's share of a list; so many times k candidates are few.
FIRST_WINDOW, FEW = 1 / 16, 4


def usable(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """vec_id and vec, an array of floor(scale * x) as doubles."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return vectors.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select(F.col(key).cast("long").alias("vec_id"), whole.alias("vec"))


class Running:
    """Each query's best k so far: scores and ids, best first."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.best: list[np.ndarray] = [np.empty((0, 2), np.int64) for _ in ids]
        self.floor = np.full(len(ids), -np.inf)
        self.read = self.resolved = 0  # entries of lists, and scores

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.best[q], np.stack([scores, ids], 1)])
        rows = rows[np.lexsort((rows[:, 1], -rows[:, 0]))[: self.k]]
        self.best[q] = rows
        if len(rows) == self.k:
            self.floor[q] = rows[-1, 0]


def fits(block: np.ndarray, query: np.ndarray) -> bool:
    """Whether every sum of products is exact in doubles."""
    return float(np.abs(block).max(initial=0)) * float(np.abs(query).sum()) < 1 << 53


def exact(block: np.ndarray, query: np.ndarray) -> np.ndarray:
    if fits(block, query):
        return (block @ query).astype(np.int64)
    return block.astype(np.int64) @ query.astype(np.int64)


class Lists:
    """A block's vectors by falling and by rising component, one list a dimension."""

    def __init__(self, block: np.ndarray):
        order = np.argsort(block, axis=0, kind="stable")
        values = np.take_along_axis(block, order, 0)
        self.falling, self.rising = (order[::-1], values[::-1]), (order, values)

    def of(self, query: np.ndarray):
        """The lists that a query reads: (rows, components, dimensions), the best contributions first."""
        return [(*lists, dims) for lists, dims in ((self.falling, np.flatnonzero(query > 0)), (self.rising, np.flatnonzero(query < 0))) if len(dims)]


def candidates(lists: Lists, query: np.ndarray, own: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, int]:
    """Rows of the block that may belong to the query's best k, all others cannot; and how many entries were read."""
    n, width = len(own), len(query)
    sums, seen = np.zeros(n), np.zeros((n, width))
    frontier, least = np.zeros(width), np.zeros(width)
    read = lists.of(query)
    for rows, values, dims in read:
        least[dims] = values[-1, dims] * query[dims]
    at, window = 0, max(k + 1, int(n * FIRST_WINDOW))
    while True:
        end = min(n, at + window)
        for rows, values, dims in read:
            shown, gains = rows[at:end][:, dims], values[at:end][:, dims] * query[dims]
            sums += np.bincount(shown.ravel(), gains.ravel(), n)
            seen[shown, dims] = 1.0
            frontier[dims] = gains[-1]
        if end == n:
            lower = upper = sums
        else:
            upper = sums + (frontier.sum() - seen @ frontier)
            lower = sums + (least.sum() - seen @ least)
        others = lower[~own]
        if len(others) >= k:
            floor = max(floor, np.partition(others, len(others) - k)[len(others) - k])
        chosen = np.flatnonzero((upper >= floor) & ~own)
        if end == n or len(chosen) <= FEW * k:
            return chosen, end * sum(len(dims) for *_, dims in read)
        at, window = end, end  # depth doubles


def read_lists(ids: np.ndarray, block: np.ndarray, run: Running) -> None:
    """Adds the block's vectors that belong to each query's best k."""
    lists = Lists(block)
    for q, query in enumerate(run.matrix):
        own = ids == run.ids[q]
        if len(ids) <= FEW * run.k or not fits(block, query):
            chosen = np.flatnonzero(~own)
        else:
            chosen, read = candidates(lists, query, own, run.floor[q], run.k)
            run.read += read
        run.resolved += len(chosen)
        if len(chosen):
            run.add(q, exact(block[chosen], query), ids[chosen])


def search(queries, k: int):
    """A function over Arrow batches of (vec_id, vec): (query_id, score, vec_id) of each task's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: dict[int, list[Running]] = {}
        for size, (ids, matrix) in queries.value.items():
            running[size] = [Running(ids[i : i + QUERIES], matrix[i : i + QUERIES], k) for i in range(0, len(ids), QUERIES)]
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes):
                if int(size) not in running:
                    continue
                rows = np.flatnonzero(sizes == size)
                for i in range(0, len(rows), BLOCK):
                    part = rows[i : i + BLOCK]
                    block = lists.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), size)
                    for r in running[int(size)]:
                        read_lists(ids[part], block, r)
        for rs in running.values():
            for r in rs:
                found = [(np.full(len(b), q), b[:, 0], b[:, 1]) for q, b in zip(r.ids, r.best) if len(b)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names=["query_id", "score", "vec_id"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score.

    Queries travel to the data in parts whose size is bounded by BROADCAST_BYTES; each part is one
    pass over the vectors, without a shuffle of them. Only each task's best k a query are shuffled.
    """
    spark = vectors.sparkSession
    data = usable(vectors, key, vector, scale)
    asked = usable(vectors.where(is_query), key, vector, scale).dropDuplicates(["vec_id", "vec"])
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    passes = max(1, -(-n * (8 * width + 8) // BROADCAST_BYTES))
    found = None
    for i in range(passes):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i) if passes > 1 else asked
        rows = part.toArrow()  # at most about BROADCAST_BYTES
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        frame = pd.DataFrame({"id": rows.column(0).to_numpy(), "vec": rows.column(1).to_pylist()})
        for size, group in frame.groupby(frame["vec"].map(len)):
            by_size[int(size)] = (group["id"].to_numpy(np.int64), np.array(group["vec"].to_list(), np.float64))
        best = data.mapInArrow(search(spark.sparkContext.broadcast(by_size), k), "query_id long, score long, vec_id long")
        found = best if found is None else found.union(best)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
