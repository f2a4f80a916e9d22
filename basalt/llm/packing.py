"""Hierarchical multi-length packing of tokenised documents.

Every task tokenises its own documents and packs them shard by shard, so no token crosses a shuffle and a shard's size
(``shard_tokens``) bounds the memory.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import WordCache

TIERS = (256, 512, 1024, 2048, 4096)

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, sequence_length long, step_group long"
)


def plan_shard(lengths: list[int], tiers=TIERS) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pack documents of the given token counts; returns pieces (document, start, length, sequence, offset) and sequence sizes.

    Whole windows of the longest tier are cut off first. What remains of each document goes to the shortest tier that
    holds it; tiers are packed from the longest, and the gap that a document leaves in its window is filled with the
    longest remainders of shorter tiers that fit, at last with a part of one that doesn't. Only the last window of a
    shard can stay open: it is cut into powers of two, so no sequence needs padding.
    """
    window = tiers[-1]
    pieces: list[tuple[int, int, int, int, int]] = []
    sizes: list[int] = []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), by length
    for d, n in enumerate(lengths):
        whole = n // window
        for k in range(whole):
            pieces.append((d, k * window, window, len(sizes), 0))
            sizes.append(window)
        if n > whole * window:
            pool.append((n - whole * window, d, whole * window))
    pool.sort()
    while pool:
        n, d, start = pool.pop()
        size = tiers[bisect_left(tiers, n)]
        own, filled = [(d, start, n)], n
        while filled < size and pool:
            gap = size - filled
            at = bisect_right(pool, (gap, float("inf"), 0)) - 1
            if at >= 0:
                n, d, start = pool.pop(at)
            else:
                rest, d, start = pool.pop(0)
                n = gap
                insort(pool, (rest - gap, d, start + gap))
            own.append((d, start, n))
            filled += n
        parts = [size] if filled == size else [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]
        left, offset = parts[0], 0
        sizes.append(left)
        for d, start, n in own:
            while n:
                if offset == left:
                    parts.pop(0)
                    left, offset = parts[0], 0
                    sizes.append(left)
                cut = min(n, left - offset)
                pieces.append((d, start, cut, len(sizes) - 1, offset))
                start, n, offset = start + cut, n - cut, offset + cut
    return pieces, sizes


def balance(sizes: list[int], step_tokens: int) -> list[int]:
    """Step group of each sequence: longest first, each to the group with the fewest tokens so far."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        tokens, g = groups[0]
        out[k] = g
        heapq.heapreplace(groups, (tokens + sizes[k], g))
    return out


def _packer(path: str, eos: int, tiers: tuple[int, ...], shard_tokens: int, step_tokens: int, remembered: int):
    end = eos.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(path, remembered)
        base = TaskContext.get().partitionId() << 40
        sequences = groups = 0

        def flush(docs: list, ids: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, groups
            pieces, sizes = plan_shard([len(x) // 4 for x in ids], tiers)
            group = balance(sizes, step_tokens)
            for k in range(0, len(pieces), 4096):
                part = pieces[k : k + 4096]
                size = [sizes[s] for _, _, _, s, _ in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([docs[d] for d, *_ in part], pa.int64()),
                        pa.array([p[1] for p in part], pa.int64()),
                        pa.array([p[2] for p in part], pa.int64()),
                        pa.array([ids[d][4 * a : 4 * (a + n)] for d, a, n, _, _ in part], pa.binary()),
                        pa.array([len(ids[p[0]]) // 4 for p in part], pa.int64()),
                        pa.array([base + sequences + p[3] for p in part], pa.int64()),
                        pa.array([p[4] for p in part], pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array([n if n & (n - 1) == 0 else tiers[-1] for n in size], pa.int64()),
                        pa.array([base + groups + group[p[3]] for p in part], pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "sequence_length", "step_group"],
                )
            sequences += len(sizes)
            groups += max(group, default=-1) + 1

        docs: list = []
        ids: list[bytes] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc_id)
                ids.append(cache.encode(text or "") + end)
                held += len(ids[-1]) // 4
                if held >= shard_tokens:
                    yield from flush(docs, ids)
                    docs, ids, held = [], [], 0
        if docs:
            yield from flush(docs, ids)

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, eos: int = 2, tiers: tuple[int, ...] = TIERS, shard_tokens: int = 2_000_000, step_tokens: int = 1 << 18, remembered: int = 200_000) -> DataFrame:
    """Pieces of all documents with their token ids (little-endian unsigned 32-bit), sequence, offset and step group.

    ``tiers`` are ascending powers of two; each task remembers the ids of at most ``remembered`` words. A null or empty text is the single id ``eos``; repeated rows are packed each
    on their own; a null ``doc_id`` is kept; very long texts are cut at windows; other columns are ignored; an empty table
    gives no rows.
    """
    if sorted(tiers) != list(tiers) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be ascending powers of two")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_packer(tokenizer_path or default_tokenizer(), eos, tuple(tiers), shard_tokens, step_tokens, remembered), SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), remembered=450_000)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")
