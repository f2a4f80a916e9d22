"""Sets of word shingles and their exact comparison: what near-copy operators share.

Sets are numpy arrays of 64-bit hashes. Parities rule pairs out that are too far apart; runs of an inverted list pair only
rows that earlier links have left in different groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored
from .simhash import _LOWER

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a lower-cased text; a shorter text is one shingle."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _MIX[0] + hashes[i : i + n])
    return np.unique(out)


def shared_at_least(n: int | np.ndarray, least: float):
    """Shingles that a set of ``n`` shares with any set of similarity ``least``."""
    return np.ceil(np.asarray(n) * least - 1e-9).astype(np.int64)


def majority_bits(own: np.ndarray) -> int:
    """SimHash of a set of 64-bit hashes, as a signed number; 0 of an empty one."""
    ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(own), bitorder="little").view(np.int64)[0])


def parities(own: np.ndarray, bits: int = 1024) -> bytes:
    """Whether an even or odd number of a set's hashes falls into each of ``bits`` bins.

    Sets that differ in d elements have parities that differ in d bins at most.
    """
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _lists(sets: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def _pairs(least: float, small: int = 64):
    """Pairs of rows with one key and different roots, and how often a similar pair meets at least.

    Of a partition sorted by key and size. In a run of more than ``small`` rows only those that are ``apart`` from its
    most frequent root look for the others: it costs their number times its length.
    """

    def told(size_a: np.ndarray, size_b: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
        can = np.bitwise_count(p ^ q).sum(axis=1) <= (size_a + size_b) * (1 - least) / (1 + least) + 1e-9
        need = np.maximum(1, shared_at_least(low + high, least / (1 + least)) - shared_at_least(high, least) + 1)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[can]), pa.array(np.maximum(a, b)[can]), pa.array(need[can])], names=["a", "b", "need"])

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(x, y) >= shared_at_least(np.maximum(x, y), least)

    def settle(key: np.ndarray, size: np.ndarray, own: np.ndarray, root: np.ndarray, apart: np.ndarray, home: np.ndarray, parity: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[starts, len(key)])
        mixed = np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts)
        short = np.repeat(mixed & (length <= small), length)
        k, z, o, r, h, p = key[short], size[short], own[short], root[short], home[short], parity[short]
        for step in range(1, small):
            if step >= len(k):
                break
            at = np.flatnonzero((k[step:] == k[:-step]) & (r[step:] != r[:-step]) & near(z[step:], z[:-step]) & (h[step:] | h[:-step]))
            if len(at):
                yield told(z[at], z[at + step], o[at], o[at + step], p[at], p[at + step])
        for run in np.flatnonzero(mixed & (length > small)):
            s = slice(starts[run], starts[run] + length[run])
            z, o, r, h, p = size[s], own[s], root[s], home[s], parity[s]
            for i in np.flatnonzero(apart[s]):
                at = np.flatnonzero((r != r[i]) & near(z, z[i]) & h)
                if len(at):
                    yield told(z[at], np.full(len(at), z[i]), o[at], np.full(len(at), o[i]), p[at], p[i])

    return _by_key(settle, 7)


def _by_key(settle, columns: int):
    """``settle`` on the arrays of whole runs of a partition sorted by key; only a run that crosses batches is carried over."""

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]]
        rows[1] = rows[1].astype(np.int64)
        if columns > 6:
            rows.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(batch.num_rows, -1))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = arrays(batch)
            if kept and kept[-1][0][-1] == rows[0][-1]:
                kept.append(rows)
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from settle(*(np.concatenate([*(k[i] for k in kept), rows[i][:cut]]) for i in range(columns)))
            kept = [[x[cut:] for x in rows]]
        if kept:
            yield from settle(*(np.concatenate([k[i] for k in kept]) for i in range(columns)))

    return run


def in_runs(keys: DataFrame, limit: int) -> DataFrame:
    """Rows (key, size, digest, root) of keys with more than one root, dealt to runs, with ``apart`` and ``home``.

    A row is ``apart`` when its root isn't the key's most frequent one. Of a key with more than ``limit`` rows each row has
    its home in one of several runs, and only rows that are apart also visit the others.
    """
    roots = keys.groupBy("key", "root").count().groupBy("key").agg(F.count("*").alias("roots"), F.sum("count").alias("n"), F.max_by("root", F.struct("count", "root")).alias("usual"))
    mixed = stored(roots.where("roots > 1").select("key", "n", "usual"), "mixed")
    dealt = keys.join(broadcast_if_small(mixed, mixed.count(), 200_000), "key").withColumn("apart", F.col("root") != F.col("usual"))
    chunks = F.ceil(F.col("n") / limit).cast("int")
    chunk = F.pmod(F.xxhash64("digest"), chunks).cast("int")
    cells = F.when(chunks <= 1, F.array(F.lit(0))).when(F.col("apart"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(chunk))
    dealt = dealt.withColumn("own_cell", F.when(chunks <= 1, 0).otherwise(chunk)).withColumn("cell", F.explode(cells))
    run = F.when(F.col("n") > limit, F.xxhash64("key", "cell")).otherwise(F.col("key"))
    return dealt.select(run.alias("key"), "size", "digest", "root", "apart", (F.col("cell") == F.col("own_cell")).alias("home"))
