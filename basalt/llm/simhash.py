"""Near-duplicate groups by SimHash fingerprints, found through Golay-code fuzzy keys.

A fingerprint's 64 bits are cut into three segments. Two fingerprints that differ in at most four bits either differ by
at most one bit in each of two segments, or agree exactly in one segment. The first kind meets on a pair of Golay keys:
the perfect [23,12,7] code decodes every segment to the one codeword within three bits; the side that looks asks also
for the five codewords at distance four when its own is at distance three, and so reaches the codeword of every word one
bit away. The second kind meets on the segment itself. Rows that meet are verified, and a task keeps of its links only a
spanning forest, so a large group of near copies costs links in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import forgotten
from .common import broadcast_if_small, stored, table

#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@lru_cache
def _golay() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes of the three bytes of a word, and for each syndrome the error patterns that lead to its keys."""
    unit = []
    for bit in range(23):
        rest = 1 << bit
        for high in range(22, 10, -1):
            if rest >> high & 1:
                rest ^= GOLAY << (high - 11)
        unit.append(rest)
    parts = []
    for byte in range(3):
        values = np.zeros(256, np.int32)
        for bit in range(8):
            if 8 * byte + bit < 23:
                values[np.arange(256) >> bit & 1 == 1] ^= unit[8 * byte + bit]
        parts.append(values)
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = e = 0
            for b in bits:
                s ^= unit[b]
                e |= 1 << b
            if weight < 4 or bin(patterns[s][0]).count("1") == 3:
                patterns[s].append(e)
    out = np.array([p + [p[0]] * (6 - len(p)) for p in patterns], np.int32)
    return parts, out


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit words: first the decoded one, then its neighbours (repeats where there are fewer)."""
    parts, patterns = _golay()
    words = words.astype(np.int32)
    syndrome = parts[0][words & 255] ^ parts[1][words >> 8 & 255] ^ parts[2][words >> 16]
    return (words[:, None] ^ patterns[syndrome]) >> 11


def fingerprint(text: str, shingle: int = 4) -> int:
    """SimHash of the word shingles of a lower-cased text; 0 where there are no words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t or "", shingle) for t in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(bits.view(np.int64))], names=[*batch.schema.names[1:], "bits"])

    return run


def with_fingerprints(docs: DataFrame, shingle: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` and ``bits``, the fingerprint of the whole text (null: empty) as a signed long."""
    kept = docs.select(F.col("text").cast("string").alias("text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(_fingerprints(shingle), f"{schema}, bits long")


def fuzzy_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, asks) of fingerprints: a pair of rows is verified where keys are equal and at least one side holds.

    A key's low bit says whether it pairs Golay keys; rows with ``asks`` 0 hold, rows with 1 only look.
    """
    u = bits.view(np.uint64)
    n = np.arange(len(u))
    segment = [(u >> np.uint64(a) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    golay = [golay_keys(s).astype(np.int64) for s in segment]
    rows, keys, asks = [], [], []
    for k, s in enumerate(segment):
        rows.append(n)
        keys.append((s << 3 | k) << 1)
        asks.append(np.zeros(len(n), np.int8))
    for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        pair = ((golay[a][:, :, None] << 12 | golay[b][:, None, :]).reshape(len(n), 36) << 3 | k) << 1 | 1
        rows.append(np.repeat(n, 36))
        keys.append(pair.ravel())
        asks.append(np.tile(np.r_[np.int8(0), np.ones(35, np.int8)], len(n)))
    row, key, ask = np.concatenate(rows), np.concatenate(keys), np.concatenate(asks)
    order = np.lexsort((ask, key, row))
    row, key, ask = row[order], key[order], ask[order]
    first = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])] if len(row) else np.zeros(0, bool)
    return row[first], key[first], ask[first]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column(0).to_numpy()
        for at in range(0, len(every), 2048):
            bits = every[at : at + 2048]
            row, key, ask = fuzzy_keys(bits)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ask), pa.array(bits[row])], names=["key", "asks", "bits"])


class Forest:
    """Union-find over fingerprints; keeps the links that joined two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def link(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.links.append((a, b))


def link_run(held: np.ndarray, asking: np.ndarray, forest: Forest, max_bits: int = MAX_BITS) -> None:
    """Link the pairs of one key's rows, one of them held, that differ in at most ``max_bits`` bits.

    Every held row is compared with all; of what it reaches, one row of each tree not yet joined is linked.
    """
    every = np.concatenate((held, asking)).view(np.uint64)
    tree = np.arange(len(every))
    for i in range(len(held)):
        near = np.nonzero(np.bitwise_count(every ^ every[i]) <= max_bits)[0]
        trees, first = np.unique(tree[near], return_index=True)
        if len(trees) > 1:
            for j in near[first].tolist():
                if every[i] != every[j]:
                    forest.link(int(every[i]), int(every[j]))
            tree[np.isin(tree, trees)] = trees[0]


def link_small(key: np.ndarray, ask: np.ndarray, bits: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of runs of up to ``most`` rows, by comparing each row with its next, second next ... of the same key."""
    u = bits.view(np.uint64)
    for step in range(1, most):
        if step >= len(key):
            return
        same = (key[step:] == key[:-step]) & ((ask[step:] == 0) | (ask[:-step] == 0))
        if not (key[step:] == key[:-step]).any():
            return
        at = np.nonzero(same)[0]
        near = at[np.bitwise_count(u[at] ^ u[at + step]) <= MAX_BITS]
        yield bits[near], bits[near + step]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forest of the links of a partition sorted by key. Only a run that crosses batches is carried over."""
    forest = Forest()
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle(key: np.ndarray, ask: np.ndarray, bits: np.ndarray) -> None:
        ends = np.r_[np.nonzero(key[1:] != key[:-1])[0] + 1, len(key)]
        starts = np.r_[0, ends[:-1]]
        small = np.repeat(ends - starts <= 64, ends - starts)
        for a, b in link_small(key[small], ask[small], bits[small], 64):
            for x, y in zip(a.tolist(), b.tolist()):
                forest.link(x & (2**64 - 1), y & (2**64 - 1))
        for k in np.nonzero(ends - starts > 64)[0]:
            s, e = starts[k], ends[k]
            link_run(bits[s:e][ask[s:e] == 0], bits[s:e][ask[s:e] == 1], forest)

    def drained() -> Iterator[pa.RecordBatch]:
        if forest.links:
            pair = np.array(forest.links, np.uint64).view(np.int64)
            forest.links.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, ask, bits = (batch.column(i).to_numpy() for i in range(3))
        if kept and kept[-1][0][-1] == key[0] == key[-1]:
            kept.append((key, ask, bits))
            continue
        if kept:
            cut = int(np.searchsorted(key, kept[-1][0][-1], side="right"))
            settle(*(np.concatenate([*(k[i] for k in kept), x[:cut]]) for i, x in enumerate((key, ask, bits))))
            key, ask, bits = key[cut:], ask[cut:], bits[cut:]
        last = int(np.searchsorted(key, key[-1]))
        if last:
            settle(key[:last], ask[:last], bits[:last])
        kept = [(key[last:], ask[last:], bits[last:])]
        yield from drained()
    if kept:
        settle(*(np.concatenate([k[i] for k in kept]) for i in range(3)))
    yield from drained()
    yield from drained()


def near_links(distinct: DataFrame, limit: int = 20_000) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in ``bits`` that keep exactly the groups of all near pairs.

    A key with more than ``limit`` rows is cut into chunks, and each pair of chunks becomes a run of its own. Such keys
    are looked for only in the hash bins that hold more rows than that.
    """
    keys = stored(distinct.select("bits").mapInArrow(_keys, "key long, asks byte, bits long"), "keys").withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(1 << 16)))
    bins = stored(keys.groupBy("bin").count().where(F.col("count") > limit).select("bin"), "bins")
    if bins.isEmpty():
        runs = keys.select("key", "asks", "bits")
    else:
        hot = keys.join(bins, "bin", "left_semi").groupBy("key").count().where(F.col("count") > limit)
        hot = stored(hot.select(F.col("key").alias("hot"), F.ceil(F.col("count") / limit).cast("int").alias("chunks")), "hot")
        dealt = keys.join(broadcast_if_small(hot, hot.count(), 100_000), F.col("key") == F.col("hot"), "left")
        chunk = F.pmod(F.xxhash64("bits"), F.col("chunks")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("key", F.least(j, chunk), F.greatest(j, chunk)))
        runs = dealt.select(F.explode(F.when(F.col("chunks").isNull(), F.array("key")).otherwise(cells)).alias("key"), "asks", "bits")
    return runs.repartition("key").sortWithinPartitions("key", "bits").mapInArrow(_links, "a long, b long")


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node of ``links``; root is the smallest node of its component.

    Large-star and small-star steps in turn (each keeps the components and moves links toward the smallest node), with
    the links written out after each round, until a round changes nothing.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, stored(small, "links")
        forgotten(before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, bits, component_id) of every row: its fingerprint and the smallest doc_id reachable over near links.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows are kept; null ids are kept
    and take part, but name a component only where all its ids are null; very long texts are read whole; an empty table
    gives no rows; other columns are ignored.
    """
    marked = stored(with_fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), shingle), "fingerprints")
    distinct = stored(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(near_links(distinct))
    joined = distinct.join(found, distinct["bits"] == found["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    group_of = joined.select("bits", "root").join(named, "root").select("bits", "component_id")
    return marked.join(group_of, "bits").select("doc_id", "bits", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
