"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

One pass counts the words of each (source, hash bucket). Everything that is decided is decided on those counts: targets,
each source's number of blocks, and each shard's quota, a shard being a range of a source's buckets. A second pass lays
the documents of a bucket out in seeded order and reads off what the chosen blocks take of each. A source that holds
most of the rows is spread over all its buckets, so no task gets a source whole.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients votes/(2k+1); equal quotients go to the earlier party.

    Rounding at one divisor gives a valid apportionment of a number near ``seats``; the difference is then given to the
    highest next quotients, or taken from the lowest last ones.
    """
    total = sum(votes)
    if seats <= 0 or total <= 0:
        return [0] * len(votes)
    out = [int(v * seats / total + 0.5) for v in votes]
    missing = seats - sum(out)
    if missing > 0:
        heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, out)) if v > 0]
        heapq.heapify(heap)
        for _ in range(missing):
            i = heap[0][1]
            out[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
    elif missing < 0:
        heap = [(v / (2 * k - 1), -i) for i, (v, k) in enumerate(zip(votes, out)) if k > 0]
        heapq.heapify(heap)
        for _ in range(-missing):
            i = -heapq.heappop(heap)[1]
            out[i] -= 1
            if out[i]:
                heapq.heappush(heap, (votes[i] / (2 * out[i] - 1), -i))
    return out


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words of each source: ``share`` of all sizes by weight, none above ``most`` times its size, the excess reshared."""
    out = [0.0] * len(sizes)
    left, weight = share * sum(sizes), float(sum(weights))
    for i in sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i]):
        out[i] = min(most * sizes[i], left * weights[i] / weight)
        left, weight = left - out[i], weight - weights[i]
    return out


def _sources(weights: tuple[float, ...], share: float, most: float, block: int, shard_words: int, most_shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["source"], pdf["words"]), key=lambda r: (pd.isna(r[0]), "" if pd.isna(r[0]) else r[0]))
        sizes = [int(w) for _, w in rows]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, most)
        seats = sainte_lague(goal, round(sum(goal) / block))
        shards = [min(most_shards, max(1, -(-w // shard_words))) for w in sizes]
        return pd.DataFrame({"source": pd.Series([None if pd.isna(s) else s for s, _ in rows], dtype=object), "source_size": sizes, "target": goal, "seats": seats, "shards": shards})

    return run


def _quotas(block: int, most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        words = [int(w) for w in pdf["shard_words"]]
        quota = sainte_lague([float(w) for w in words], int(pdf["seats"].iloc[0]))
        pdf["quota"] = [min(q, most * -(-w // block)) for q, w in zip(quota, words)]
        return pdf[["source", "shard", "quota"]]

    return run


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def counted(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``docs`` with ``size`` (words) and ``_hash``, the seeded order: by id and text, so equal ids don't stand together."""
    return docs.withColumns({"size": word_count(F.col("text")), "_hash": F.xxhash64("doc_id", "text", F.lit(seed))})


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = 32, shard_words: int = 1 << 18, shards: int = 4096, bucket_rows: int = 500, seed: int = 42) -> DataFrame:
    """All rows and columns of ``docs`` with what the mix takes of each.

    Added columns: ``size`` (words), ``source_size``, ``target``, ``repeats`` (times the whole document is taken),
    ``spans`` (word ranges taken once more) and ``taken`` (words in all). Sources are ranked by code point, null last,
    and weigh ``weights`` in turn. Null and empty texts have size 0 and nothing is taken of them; repeated rows count
    and are taken each on their own; input columns named like an added one are replaced; an empty table gives no rows.
    Very long texts are counted whole; where a block ends inside a text, only those words are taken. The list of sources,
    one row each, and each source's list of at most ``shards`` shards pass through one task; they hold counts only. A shard
    has as many buckets as keep about ``bucket_rows`` rows in each, so no window grows with the table.

    ``docs`` may come from ``counted``; then its texts aren't read again.
    """
    added = ("source_size", "target", "repeats", "spans", "taken")
    known = "_hash" in docs.columns
    docs = docs.drop(*added) if known else docs.drop("size", *added)
    buckets = shards * max(1, -(-docs.count() // (shards * bucket_rows)))
    keyed = (docs if known else counted(docs, seed)).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("long"))

    counts = stored(keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("words")), "mix-counts")
    plan = counts.groupBy("source").agg(F.sum("words").alias("words")).groupBy(F.lit(0).alias("_all")).applyInPandas(_sources(tuple(weights), share, most, block_words, shard_words, shards), "source string, source_size long, target double, seats long, shards long")
    in_shards = (
        counts.alias("c").join(plan.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")))
        .select("c.source", "_bucket", "words", "source_size", "target", "seats", F.floor(F.col("_bucket") * F.col("shards") / buckets).alias("shard"))
    )
    in_shards = stored(in_shards, "mix-shards")
    quotas = in_shards.groupBy("source", "shard").agg(F.sum("words").alias("shard_words"), F.first("seats").alias("seats")).groupBy("source").applyInPandas(_quotas(block_words, most), "source string, shard long, quota long")

    line = Window.partitionBy("b.source", "b.shard").orderBy("_bucket")
    whole = Window.partitionBy("b.source", "b.shard")
    chosen = (
        in_shards.alias("b").join(quotas.alias("q"), F.col("b.source").eqNullSafe(F.col("q.source")) & (F.col("b.shard") == F.col("q.shard")))
        .select("b.source", "_bucket", "source_size", "target", "quota", "b.shard", (F.sum("words").over(line) - F.col("words")).alias("_from"), F.sum("words").over(whole).alias("_words"))
        .withColumn("_blocks", F.ceil(F.col("_words") / block_words))
        .withColumn("_extra", F.when(F.col("_blocks") > 0, F.col("quota") % F.col("_blocks")).otherwise(0))
        .withColumn("_first", F.when(F.col("_blocks") > 0, F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.col("_blocks"))).otherwise(0))
        .select(
            F.col("source").alias("_source"), F.col("_bucket").alias("_b"), "source_size", "target", "_from",
            F.when(F.col("_blocks") > 0, F.floor(F.col("quota") / F.col("_blocks"))).otherwise(0).cast("int").alias("repeats"),
            (F.col("_first") * block_words).alias("_lo"),
            F.least((F.col("_first") + F.col("_extra")) * block_words, F.col("_words")).alias("_hi"),
            F.greatest((F.col("_first") + F.col("_extra") - F.col("_blocks")) * block_words, F.lit(0)).alias("_wrap"),
        )
    )

    order = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = (
        keyed.join(chosen, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_end", F.col("_from") + F.sum("size").over(order))
        .withColumn("_start", F.col("_end") - F.col("size"))
    )

    def cut(lo: Column, hi: Column) -> Column:
        return F.struct(
            F.least(F.greatest(lo - F.col("_start"), F.lit(0)), F.col("size")).cast("long").alias("from"),
            F.least(F.greatest(hi - F.col("_start"), F.lit(0)), F.col("size")).cast("long").alias("to"),
        )

    spans = F.filter(F.array(cut(F.lit(0), F.col("_wrap")), cut(F.col("_lo"), F.col("_hi"))), lambda s: s["to"] > s["from"])
    return (
        laid.withColumn("spans", spans)
        .withColumn("taken", F.col("repeats") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"]))
        .select(*[c for c in docs.columns if c not in ("size", "_hash")], "size", "source_size", "target", "repeats", "spans", "taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: whole copies, and the taken words where a block cuts a document."""
    mixed = mix_sources(docs, **options)
    part = lambda s: F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"([\x20\x09-\x0D]*{WORD})"), 1), (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")), "")
    parts = F.transform("spans", lambda s: F.when(s["to"] - s["from"] == F.col("size"), F.col("text")).otherwise(part(s)))
    texts = F.concat(F.array_repeat("text", F.col("repeats")), parts)
    out = mixed.withColumn("_texts", texts).withColumn("_text", F.explode("_texts"))
    named = {"text": F.col("_text").alias("text"), "n_chars": F.char_length("_text").cast("long").alias("n_chars")}
    return out.select(*[named.get(c, F.col(c)) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = counted(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return mix_sources(stored(sized, "sizes")).select("doc_id", "size", "source_size", "target", "taken")
