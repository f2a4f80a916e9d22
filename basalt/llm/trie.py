"""Prefix trie of conversations from their sorted order: which conversations begin alike, and what sharing that saves.

Conversations are sorted by their sequences of turns. A candidate prefix, the first d turns of any of them, belongs to the
neighbours whose longest common prefixes (LCPs) don't fall below d: two binary searches over a sparse table of range minima,
one to the left and one to the right, each by itself, give the interval of its members. No stack runs through the order, so
blocks of the order are worked on apart.

A block settles every node inside it. Only prefixes of its first and last conversation may go on in other blocks; these two
stand for the block in a shorter order, with what the block has found attached to each of their prefixes, and the same is
done again, until one block is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, stored, table
from .merkle import CRC32_SQL, CRC32_TABLE_SQL

#: Conversations of a block, and turns after which it is closed all the same.
BLOCK, TURNS = 4096, 1 << 21
#: Conversations that a block has at least, so that each order is shorter than the one before.
LEAST = 4
_NONE = np.iinfo(np.int64).max
_ROW = "seq binary, words array<long>, n array<long>, least array<long>, children array<long>, leaves array<long>, saved array<long>, ends array<string>, keys array<binary>"
#: ``node``: a settled one; ``row``: one that stands for its block; ``piece``: ids that end at a prefix which goes on elsewhere.
_OUT = f"kind string, place long, conv_id long, depth long, parent long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, ids string, {_ROW}"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_NOBODY = sha256(b"").hexdigest()


class Minima:
    """Sparse table: the minimum of any range by two overlapping powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def reach(self, start: np.ndarray, depth: np.ndarray, step: int) -> np.ndarray:
        """How many values from ``start`` on (``step`` 1) or before it (-1) are at least ``depth``, for each start by itself.

        A binary search whose probes are aligned ranges of halving length.
        """
        at, n = start.copy(), len(self.levels[0])
        for level in reversed(range(len(self.levels))):
            size, table = 1 << level, self.levels[level]
            first = at if step > 0 else at - size
            inside = (first >= 0) & (first + size <= n)
            at = np.where(inside & (table[np.clip(first, 0, len(table) - 1)] >= depth), at + step * size, at)
        return np.abs(at - start)


def adjacent_lcp(seqs: list[bytes], width: int = 16) -> np.ndarray:
    """Symbols that each sequence shares with the one before it; -1 for the first."""
    out = np.full(len(seqs), -1, np.int64)
    for i in range(1, len(seqs)):
        a, b = seqs[i - 1], seqs[i]
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            out[i] = n // width
        else:
            differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
            out[i] = int(np.argmax(differ)) // width
    return out


class _Block:
    """Sorted rows with what is attached to their prefixes, as flat arrays: entry ``start[i] + d`` is row i's first d turns."""

    def __init__(self, rows: list[dict], final: bool):
        self.seqs = [r["seq"] for r in rows]
        self.length = np.array([len(s) // 16 for s in self.seqs], np.int64)
        self.start = np.r_[0, np.cumsum(self.length + 1)]
        flat = lambda c: np.concatenate([r[c] for r in rows])
        self.words, self.n, self.least, self.kids, self.leaf, self.save = (flat(c).astype(np.int64) for c in ("words", "n", "least", "children", "leaves", "saved"))
        self.ends = [e for r in rows for e in r["ends"]]
        self.known = [k for r in rows for k in (r["keys"] if r["keys"] is not None else [None] * (len(r["seq"]) // 16 + 1))]
        self.final = final
        self._intervals()
        self._totals()

    def _intervals(self) -> None:
        """Members of every candidate prefix, left and right end each by its own search."""
        lcp = adjacent_lcp(self.seqs)
        total = int(self.start[-1])
        self.row = np.repeat(np.arange(len(self.seqs)), self.length + 1)
        self.depth = np.arange(total) - self.start[self.row]
        minima = Minima(lcp[1:])  # value i lies between rows i and i + 1
        if len(self.seqs) > 1:
            self.left = self.row - minima.reach(self.row, self.depth, -1)
            self.right = self.row + minima.reach(self.row, self.depth, 1)
        else:
            self.left, self.right = self.row.copy(), self.row.copy()
        self.at = self.start[self.left] + self.depth  # the node's entry: that of its first row
        self.first = self.left == self.row
        self.up = np.where(self.depth > 0, self.at[np.maximum(np.arange(total) - 1, 0)], -1)
        self.keys = {int(a): k for a, k in zip(self.at, self.known) if k is not None}
        last = len(self.seqs) - 1
        self.open = np.zeros(total, bool) if self.final else (self.left == 0) | (self.right == last)

    def _below(self, own: np.ndarray) -> np.ndarray:
        """For nodes' entries, the sum of ``own`` (at nodes' entries) over their subtrees.

        Those are the nodes of later rows of the interval, all of them, and the deeper ones of its first row.
        """
        run = np.r_[0, np.cumsum(own)]
        return run[self.start[self.right + 1]] - run[np.arange(len(own))]

    def _totals(self) -> None:
        total = len(self.row)
        own_n, self.own_kids, self.own_leaf, self.own_save = (_added(self.at, values, total) for values in (self.n, self.kids, self.leaf, self.save))
        ids = np.full(total, _NONE, np.int64)
        np.minimum.at(ids, self.at, self.least)
        self.members = self._below(own_n)
        closed = self.first & ~self.open
        inner = np.flatnonzero(self.first & (self.depth > 0) & ~self.open)
        self.own_kids = self.own_kids + np.bincount(self.up[inner], minlength=total)  # children settled here
        # the smallest member: by ranges over rows' minima, and along the first row
        low = np.array([int(ids[s:e].min()) for s, e in zip(self.start[:-1], self.start[1:])], np.int64)
        suffix = ids.copy()
        for s, e in zip(self.start[:-1], self.start[1:]):
            suffix[s:e] = np.minimum.accumulate(ids[s:e][::-1])[::-1]
        rest = _range_min(low, self.row + 1, self.right)
        self.conv = np.minimum(suffix, rest)
        self.own_leaf = self.own_leaf + (closed & (self.own_kids == 0))
        self.own_save = self.own_save + np.where(closed, (self.members - 1) * self.words, 0)
        self.told: dict[int, str | None] = {}
        for entry, text in enumerate(self.ends):
            if text is not None:
                self.told[int(self.at[entry])] = text

    def nodes(self) -> dict[str, list]:
        at = np.flatnonzero(self.first & ~self.open)
        leaves, saved = self._below(self.own_leaf)[at], self._below(self.own_save)[at]
        up = self.up[at]
        known = (up >= 0) & ~self.open[np.maximum(up, 0)]
        return {
            "conv_id": self.conv[at].tolist(), "depth": self.depth[at].tolist(), "parent": [int(self.conv[u]) if k else None for u, k in zip(up.tolist(), known.tolist())],
            "parent_key": [self.keys[u] if u >= 0 and not k else None for u, k in zip(up.tolist(), known.tolist())], "n_convs": self.members[at].tolist(), "n_children": self.own_kids[at].tolist(),
            "n_leaves": leaves.tolist(), "saved_tokens": saved.tolist(), "ends_sha256": [self.told.get(a, _NOBODY) for a in at.tolist()], "key": [self.keys.get(a) for a in at.tolist()],
        }

    def outer(self) -> list[dict]:
        """The first and the last row with what belongs to those of their prefixes which may go on in other blocks."""
        own = np.stack([self.members, self._below(self.own_leaf), self._below(self.own_save)])
        entries = np.flatnonzero(self.first & self.open)
        deeper = np.zeros_like(own)
        for e in entries.tolist():
            if self.up[e] >= 0:
                deeper[:, self.up[e]] += own[:, e]
        own -= deeper
        rows = []
        for i in sorted({0, len(self.seqs) - 1}):
            s, e = int(self.start[i]), int(self.start[i + 1])
            mine = self.at[s:e]
            here = self.left[s:e] > 0 if i else np.ones(e - s, bool)  # prefixes of both are told by the first row
            pick = lambda values, none: np.where(here, values[mine], none).tolist()
            keys = [self.keys[k] for k in mine.tolist()]
            rows.append({"seq": self.seqs[i], "words": self.words[s:e].tolist(), "n": pick(own[0], 0), "least": pick(self.conv, _NONE), "children": pick(self.own_kids, 0), "leaves": pick(own[1], 0), "saved": pick(own[2], 0), "ends": [self.told.get(int(m)) if h else None for m, h in zip(mine, here)], "keys": keys})
        return rows


def _added(at: np.ndarray, values: np.ndarray, total: int) -> np.ndarray:
    out = np.zeros(total, np.int64)
    np.add.at(out, at, values)
    return out


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last], both included; none where the range is empty."""
    minima = Minima(values).levels
    n = last - first + 1
    level = np.where(n > 0, np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1, 0)
    out = np.full(len(n), _NONE, np.int64)
    for k in np.unique(level):
        on = (level == k) & (n > 0)
        out[on] = np.minimum(minima[k][first[on]], minima[k][last[on] - (1 << int(k)) + 1])
    return out


def prefix_keys(seq: bytes) -> list[bytes]:
    """A digest of each prefix, the empty one first."""
    running, out = md5(), [md5().digest()]
    for at in range(0, len(seq), 16):
        running.update(seq[at : at + 16])
        out.append(running.copy().digest())
    return out


def _leaves(rows: list[tuple[bytes, list[int], int]], final: bool) -> tuple[_Block, list[tuple[bytes, str]]]:
    """A block of whole conversations (seq, words, id), and the ids that end at its first and last sequence."""
    runs: list[tuple[int, int]] = []
    for i, (seq, _, _) in enumerate(rows):
        if runs and rows[runs[-1][0]][0] == seq:
            runs[-1] = (runs[-1][0], i)
        else:
            runs.append((i, i))
    out, pieces = [], []
    for a, b in runs:
        seq, words, conv = rows[a]
        d = len(seq) // 16
        ids = ",".join(str(rows[i][2]) for i in range(a, b + 1))
        edge = not final and (a == 0 or b == len(rows) - 1)
        if edge:
            pieces.append((md5(seq).digest(), ids))
        outer = a == 0 or b == len(rows) - 1
        none = [0] * (d + 1)
        out.append({"seq": seq, "words": [0, *words], "n": [*none[1:], b - a + 1], "least": [*[_NONE] * d, conv], "children": none, "leaves": none, "saved": none, "ends": [*[None] * d, "" if edge else sha256(ids.encode()).hexdigest()], "keys": prefix_keys(seq) if outer and not final else None})
    return _Block(out, final), pieces


def _batch(columns: dict[str, list], n: int) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[t]) if c in columns else pa.nulls(n, kinds[t]) for c, t in (f.split() for f in _OUT.split(", "))], names=_NAMES)


def _told(block: _Block, pieces: list[tuple[bytes, str]], place: int) -> Iterator[pa.RecordBatch]:
    found = block.nodes()
    n = len(found["conv_id"])
    if n:
        yield _batch({"kind": ["node"] * n, **found}, n)
    if not block.final:
        rows = block.outer()
        yield _batch({"kind": ["row"] * len(rows), "place": [place * 2 + i for i in range(len(rows))], **{c: [r[c] for r in rows] for c in rows[0]}}, len(rows))
    if pieces:
        yield _batch({"kind": ["piece"] * len(pieces), "place": [place * 2 + i for i in range(len(pieces))], "key": [k for k, _ in pieces], "ids": [t for _, t in pieces]}, len(pieces))


def _blocks(build, columns: list[str], most: int | None):
    """``build`` on blocks of consecutive rows of a sorted partition; without ``most`` it is one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, block, turns, k = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.select(columns).columns)):
                block.append(row)
                turns += len(row[0]) // 16
                if most and (len(block) >= most or turns >= TURNS and len(block) >= LEAST):
                    yield from _told(*build(block), base + k)
                    block, turns, k = [], 0, k + 1
        if block:
            yield from _told(*build(block), base + k)

    return run


def _is_one(rows: DataFrame, block: int) -> tuple[bool, int]:
    """Whether rows fit into one block, and their number."""
    n, turns = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    return n <= LEAST or n <= block and turns <= TURNS, n


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the prefix trie of ``conversations`` (conv_id, seq, words): seq holds 16 bytes a turn, words its numbers of words.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), see ``conversation_trie``.
    """
    names = [c.split()[0] for c in _ROW.split(", ")]
    rows = conversations.select("seq", "words", "conv_id")
    alone = _is_one(rows, block)[0]
    dealt = rows.repartition(1).sortWithinPartitions("seq", "conv_id") if alone else rows.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    done = stored(dealt.mapInArrow(_blocks(lambda r: _leaves(r, alone), ["seq", "words", "conv_id"], None if alone else block), _OUT), "blocks")
    nodes, pieces = done.where("kind = 'node'"), done.where("kind = 'piece'").select("key", "place", "ids")
    chained = None if alone else stored(pieces.repartition("key").sortWithinPartitions("key", "place").mapInArrow(_chained, "end_key binary, whole string"), "ends")
    left, outer = done, None
    while not alone:
        rows = left.where("kind = 'row'").select("place", *names)
        alone, n = _is_one(rows, block)
        dealt = rows.repartition(1).sortWithinPartitions("place") if alone else rows.repartitionByRange(max(1, n // max(block, LEAST)), "place").sortWithinPartitions("place")
        build = lambda r, final=alone: (_Block([dict(zip(names, x)) for x in r], final), [])
        left = stored(dealt.mapInArrow(_blocks(build, names, None if alone else max(block, LEAST)), _OUT), "blocks")
        found = left.where("kind = 'node'")
        outer = found if outer is None else outer.unionByName(found)
    if outer is not None:
        # what was left open: the ids that end at a node which goes over several blocks, and parents that do
        n = outer.count()
        outer = outer.join(broadcast_if_small(chained, chained.count(), 200_000), F.col("key") == F.col("end_key"), "left").withColumn("ends_sha256", F.coalesce("whole", "ends_sha256"))
        outer = stored(outer.select(*nodes.columns), "outer")
        nodes = nodes.unionByName(outer)
        parents = outer.select(F.col("key").alias("_key"), F.col("conv_id").alias("_conv"))
        nodes = nodes.join(broadcast_if_small(parents, n, 200_000), F.col("parent_key") == F.col("_key"), "left").withColumn("parent", F.coalesce("parent", "_conv"))
    return nodes.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of one key in order, joined by commas; only the running digest is held."""
    key, running = None, None
    for batch in batches:
        keys, out = [], []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                if running is not None:
                    keys.append(key)
                    out.append(running.hexdigest())
                key, running = k, sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out)], names=["end_key", "whole"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], names=["end_key", "whole"])


def rebuilt(conversations: DataFrame, shared: int = 20, most: int = 3) -> DataFrame:
    """(conv_id, seq, words) of conversations that begin with turns of the first one of their twenty.

    Conversation c takes the first h = crc32(c) % 4 turns of conversation c - c % 20 and goes on with its own after its
    first h. Turns are ordered by ``turn``, null first, equal ones by the MD5 of role and text; null roles and texts are
    empty. Rows without conv_id belong to no conversation and are left out. A conversation's turns are one row, 24 bytes each.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn").cast("long"), F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("symbol"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    own = conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    own = stored(own.select("conv_id", F.transform("turns", lambda t: t["symbol"]).alias("symbols"), F.transform("turns", lambda t: t["words"]).alias("words")), "own")
    heads = own.where(F.col("conv_id") % shared == 0).select(F.col("conv_id").alias("_of"), F.slice("symbols", 1, most).alias("_symbols"), F.slice("words", 1, most).alias("_words"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    met = own.join(heads, F.col("conv_id") - F.col("conv_id") % shared == F.col("_of"), "left").withColumn("h", h)
    both = lambda head, rest, kind: F.concat(F.slice(F.coalesce(head, F.array().cast(kind)), F.lit(1), F.col("h")), F.slice(rest, F.col("h") + 1, F.greatest(F.size(rest), F.lit(1))))
    out = met.select("conv_id", both(F.col("_symbols"), F.col("symbols"), "array<binary>").alias("symbols"), both(F.col("_words"), F.col("words"), "array<long>").alias("words"))
    return out.select("conv_id", F.unhex(F.array_join(F.transform("symbols", F.hex), "")).alias("seq"), "words")


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of ``rebuilt`` conversations (conv_id, turn, role, text and others), a row for each distinct prefix.

    ``conv_id`` is the smallest member, ``ends_sha256`` the digest of the members that have no further turn. Repeated rows
    are turns each, an empty table gives no rows, very long texts count by their digest and their words, extra columns are
    left out.
    """
    return trie(stored(rebuilt(conversations), "rebuilt"), block)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


SQL = rf"""WITH {CRC32_TABLE_SQL},
t AS (SELECT conv_id AS c, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, s, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, s) AS k FROM t),
h AS (SELECT c, {CRC32_SQL.format(s="CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM t), tb),
r AS (SELECT h.c, o.k, 0 AS own, o.s, o.w FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.k <= h.h UNION ALL SELECT h.c, o.k, 1, o.s, o.w FROM h JOIN o ON o.c = h.c AND o.k > h.h),
q AS (SELECT c, s, w, row_number() OVER (PARTITION BY c ORDER BY own, k) AS d FROM r),
p AS (SELECT c, d, w, string_agg(s, '') OVER (PARTITION BY c ORDER BY d) AS path FROM q UNION ALL SELECT c, 0, 0, '' FROM h),
l AS (SELECT c, max(d) AS len FROM p GROUP BY c),
n AS (SELECT path, any_value(d) AS depth, any_value(w) AS w, min(p.c) AS conv_id, count(*) AS n, coalesce(string_agg(CASE WHEN l.len = p.d THEN CAST(p.c AS VARCHAR) END, ',' ORDER BY p.c), '') AS ends FROM p JOIN l ON l.c = p.c GROUP BY path),
k AS (SELECT left(path, length(path) - 32) AS path, count(*) AS kids FROM n WHERE depth > 0 GROUP BY 1),
b AS (SELECT left(n.path, 32 * u.d) AS path, sum((n.n - 1) * n.w) AS saved, count(*) FILTER (WHERE k.path IS NULL) AS leaves FROM n LEFT JOIN k ON k.path = n.path, LATERAL (SELECT unnest(range(n.depth + 1)) AS d) AS u GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.kids, 0) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN b ON b.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN n AS m ON n.depth > 0 AND m.path = left(n.path, length(n.path) - 32)"""
