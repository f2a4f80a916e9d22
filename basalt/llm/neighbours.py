"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors get one more coordinate that makes all norms equal, so the largest inner product is the smallest distance. Each
table hashes to the cell numbers of a few random directions. A query visits in every table its own bucket and those that
differ by one step in some directions, in the order of their estimated success, and ranks all rows found in any table by
their exact product. Tables are added until a bounded sample of the rows reaches the wanted recall.

Rows are dealt to shards by a hash of their id, each with its own tables, and every block of queries visits the tables of
each shard; products are computed for the candidates that the visited buckets hold, and for no other row. A bucket that
holds most of the rows is spread over all shards.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


@lru_cache
def probe_order(directions: int, probes: int) -> tuple[tuple[int, ...], ...]:
    """The ``probes`` sets of steps with the best expected scores, the empty one first.

    A step's number is its rank among the distances from a query to the borders of its cell, both sides of each
    direction; of equally many queries the squared distances have known expectations. Sets with both sides of one
    direction are left out.
    """
    m = directions
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap: list[tuple[float, tuple[int, ...]]] = [(expected[0], (0,))]
    while heap and len(out) < probes:
        score, steps = heapq.heappop(heap)
        if all(2 * m - 1 - j not in steps for j in steps):
            out.append(steps)
        last = steps[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*steps[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*steps, last + 1)))
    return tuple(out)


@dataclass(frozen=True)
class Tables:
    """Everything that hashing needs; each table's directions follow from the seed and its number."""

    width: float
    count: int
    directions: int
    probes: int
    norm: float
    seed: int

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.column_stack((x, rest))

    def _table(self, t: int, dimension: int):
        rng = np.random.default_rng((self.seed, t))
        return rng.normal(size=(dimension, self.directions)), rng.uniform(0, self.width, self.directions), rng.integers(1, 1 << 62, self.directions)

    def buckets(self, t: int, x: np.ndarray) -> np.ndarray:
        a, b, mix = self._table(t, x.shape[1])
        return (np.floor((x @ a + b) / self.width).astype(np.int64) * mix).sum(axis=1)

    def visits(self, t: int, q: np.ndarray) -> np.ndarray:
        """(n, probes) buckets that queries visit."""
        a, b, mix = self._table(t, q.shape[1])
        at = (q @ a + b) / self.width
        cell = np.floor(at).astype(np.int64)
        low = at - cell
        ranked = np.argsort(np.hstack((low, 1 - low)), axis=1, kind="stable")
        step = np.where(ranked < self.directions, -mix[ranked % self.directions], mix[ranked % self.directions])
        home = (cell * mix).sum(axis=1)
        return np.column_stack([home + step[:, list(steps)].sum(axis=1) for steps in probe_order(self.directions, self.probes)])

    def index(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per table: the names of its buckets, where each one's rows begin and end, and the rows in that order."""
        out = []
        for t in range(self.count):
            own = self.buckets(t, x)
            order = np.argsort(own, kind="stable")
            names, first = np.unique(own[order], return_index=True)
            out.append((names, np.r_[first, len(x)], order))
        return out


def met(index: list[tuple[np.ndarray, np.ndarray, np.ndarray]], visits: list[np.ndarray], rows: int) -> np.ndarray:
    """(queries, rows) whether a row lies in a bucket that the query visits in some table: the merged candidates."""
    seen = np.zeros((len(visits[0]) if visits else 0, rows), bool)
    for (names, ends, order), asked in zip(index, visits):
        at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
        query, probe = np.nonzero(names[at] == asked)
        bucket = at[query, probe]
        size = ends[bucket + 1] - ends[bucket]
        place = np.repeat(ends[bucket] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        seen[np.repeat(query, size), order[place]] = True
    return seen


def fit(sample: np.ndarray, rows: int, k: int, norm: float, recall: float = 0.95, directions: int = 5, probes: int = 80, most_tables: int = 400, seed: int = 42) -> Tables:
    """Tables that reach ``recall`` on the sample: its first rows look for those nearest in it.

    Of a sample of m of n rows the nearest k·m/n, at least one, stand for the nearest k of all. Where ``most_tables``
    don't reach the recall the cells are widened, and tables are counted anew: the wanted recall is always reached.
    """
    queries = min(128, len(sample))
    near = min(len(sample) - 1, max(1, -(-k * len(sample) // max(rows, 1))))
    product = sample[:queries] @ sample.T
    product[np.arange(queries), np.arange(queries)] = -np.inf
    wanted = np.argpartition(-product, near - 1, axis=1)[:, :near]
    base = Tables(1.0, 0, directions, probes, norm, seed)
    lifted = base.lifted(sample)
    asked = np.column_stack((sample[:queries], np.zeros(queries)))
    distance = np.sqrt(np.maximum(((asked[:, None, :] - lifted[wanted]) ** 2).sum(axis=2), 0))
    width = 0.65 * float(np.median(distance)) or 1e-6 * norm
    while True:
        got = np.zeros((queries, near), bool)
        for count in range(1, most_tables + 1):
            tables = Tables(width, count, directions, probes, norm, seed)
            bucket, asks = tables.buckets(count - 1, lifted), np.sort(tables.visits(count - 1, asked), axis=1)
            for i in range(queries):
                own = bucket[wanted[i]]
                got[i] |= asks[i, np.minimum(np.searchsorted(asks[i], own), asks.shape[1] - 1)] == own
            if got.mean() >= recall:
                return tables
        width *= 1.5


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _meet(fitted: dict[int, Tables], k: int):
    """Best ``k`` candidates of one shard's rows for each query of a block; only candidates' products are computed."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and queries.num_rows:
            x, ids = _matrix(rows["v"]), rows["vec_id"].to_numpy()
            q, own = _matrix(queries["v"]), queries["vec_id"].to_numpy()
            tables = fitted.get(x.shape[1])  # a space of no more than k + 1 rows has none: all of them are wanted
            index = tables.index(tables.lifted(x)) if tables else []
            repeats = len(np.unique(ids)) < len(ids)  # rows of one id are always in one shard
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                asked = np.column_stack((part, np.zeros(len(part))))
                seen = met(index, [tables.visits(t, asked) for t in range(tables.count)], len(x)) if tables else np.ones((len(part), len(x)), bool)
                seen &= own[at : at + 256, None] != ids[None, :]
                for i in range(len(part)):
                    found = np.flatnonzero(seen[i])
                    if (len(np.unique(ids[found])) if repeats else len(found)) < k:
                        found = np.flatnonzero(ids != own[at + i])
                    product = x[found] @ part[i]
                    if len(found) > k and not repeats:
                        least = np.partition(product, len(found) - k)[len(found) - k]
                        found = found[product >= least - 1e-9 * max(1.0, abs(least))]
                    exact = (x[found] * part[i]).sum(axis=1)
                    order = np.lexsort((ids[found], -exact))
                    if repeats:
                        order = order[np.sort(np.unique(ids[found][order], return_index=True)[1])]
                    order = order[:k]
                    out.append((np.full(len(order), own[at + i]), ids[found][order], exact[order]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) with vectors as doubles: without nulls, zero vectors and components that are null or not finite."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    real = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & real & F.exists("v", lambda c: c != 0))


def sampled(vectors: DataFrame, n: int, rows: int, seed: int) -> np.ndarray:
    """About ``rows`` of ``n`` vectors, twice as many at most, in the order of a seeded hash of their ids."""
    chosen = vectors.withColumn("h", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 40)))
    some = [r["v"] for r in chosen.where(F.col("h") < int(min(1.0, rows / n) * (1 << 40))).orderBy("h", "vec_id", "v").limit(2 * rows).collect()]
    return np.array(some if len(some) > 1 else [r["v"] for r in chosen.orderBy("h", "vec_id", "v").limit(rows).collect()])


def nearest(embeddings: DataFrame, asks, k: int = 20, recall: float = 0.95, sample_rows: int = 8192, shard_rows: int = 16384, block_queries: int = 512, seed: int = 42) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found rows of each row for which the condition ``asks`` holds.

    The fit reads about ``sample_rows`` rows at most; every row is indexed, in the tables of its shard. Unusable vectors
    take no part; vectors of different lengths have no product, so each length is a space with tables of its own; of rows
    with one id the nearest counts; a row is never its own neighbour; equal scores go to the smaller id; an empty table
    gives no rows; other columns are ignored. A query whose buckets in a shard hold fewer than ``k`` rows visits all of the
    shard's, so none gets fewer than ``k`` where there are as many. Only spaces of at most ``k + 1`` usable rows have no tables, as a query
    wants all of their rows.
    """
    vectors = usable(embeddings).withColumn("d", F.size("v"))
    spaces = vectors.groupBy("d").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("square")).collect()
    fitted = {r["d"]: fit(sampled(vectors.where(F.col("d") == r["d"]), r["n"], sample_rows, seed), r["n"], k, float(r["square"]) ** 0.5, recall, seed=seed) for r in spaces if r["n"] > k + 1}
    n = sum(r["n"] for r in spaces)
    shards = max(1, -(-n // shard_rows))
    asked = vectors.where(asks)
    sides = max(1, -(-asked.count() // block_queries))
    place = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = vectors.select("vec_id", "v", "d", place(shards).alias("shard"), every(sides).alias("side"))
    right = asked.select("vec_id", "v", "d", every(shards).alias("shard"), place(sides).alias("side"))
    keys = ("d", "shard", "side")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(fitted, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
