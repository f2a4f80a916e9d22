"""Groups of near copies by bottom-k sketches of one hash function.

A document's sketch is the ``kept`` smallest hashes of its word shingles. Inverted lists of these values bring documents
together: two sets whose similarity reaches the threshold share at least ``least_shared`` sketch values (all but surely,
see there; small sets surely), so a document asks only at its rarest values, as many as leave fewer than that for the
rest. Values that nobody else has need no list. Most documents share too few values with anybody and drop out here.

Within a list documents are compared by the sizes and parities of their sets, which never rule out a similar pair; then
the sketch of the union of a pair, made of its two sketches, estimates its similarity; then the whole sets are compared.
First only neighbours in a few orders of each list are, then all that these links leave apart: a large group of near
copies costs a few links a document. A list with more than ``limit`` documents is cut into runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored, table
from .jaccard import _by_key, _lists, _mixed, _pairs, in_runs, majority_bits, parities, shingles
from .simhash import components, near_links

#: Sketch values of a document.
KEPT = 64


def least_shared(kept: int, percent: int, chance: float = 1e-9) -> int:
    """Values that the sketches of two larger sets of similarity ``percent`` share, but for a ``chance`` of fewer.

    The sketch of the union holds ``kept`` values, each of them in both sets with that similarity's probability; a value
    in both sets that is in the union's sketch is in both sketches.
    """
    share, tail = percent / 100, 0.0
    for n in range(kept + 1):
        tail += comb(kept, n) * share**n * (1 - share) ** (kept - n)
        if tail > chance:
            return n
    return kept


def _sketched(shingle: int, kept: int, fuzzy: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t or "", shingle) for t in part.column(0).to_pylist()]
                own = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), _lists([s[:kept] for s in sets]), pa.array([parities(s) for s in sets], pa.binary()), pa.array([majority_bits(s) if fuzzy and len(s) else 0 for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *own], names=[*part.schema.names[1:], "digest", "size", "sketch", "parity", "bits"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(1), _lists([shingles(t or "", shingle) for t in part.column(0).to_pylist()])], names=["uid", "own"])

    return run


def inverted(distinct: DataFrame, kept: int, percent: int, least: int) -> DataFrame:
    """(key, n, uid): each document at the rarest of its sketch values that others have too, enough to meet every similar one.

    ``n`` documents have the value in their sketches.
    """
    postings = distinct.select("uid", "size", F.explode("sketch").alias("key"))
    shared = stored(postings.groupBy("key").count().where("count > 1"), "values")
    met = postings.join(shared, "key").groupBy("uid", "size").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("held"))
    # of a set so small that its partners' sketches are whole, the shared values are known for sure
    need = F.when(F.col("size") < percent * kept // 100, F.floor((F.col("size") * percent + 99) / 100)).otherwise(least).cast("int")
    asked = F.slice("held", F.lit(1), F.greatest(F.lit(0), F.size("held") - need + 1))
    return met.select("uid", F.explode(asked).alias("v")).select(F.col("v.key").alias("key"), F.col("v.count").alias("n"), "uid")


def _beside(least: float, shuffles: int):
    """Neighbours in their list whose sizes and parities allow it: sorted by size, and in some shuffled orders."""

    def settle(key: np.ndarray, size: np.ndarray, own: np.ndarray, root: np.ndarray, apart: np.ndarray, home: np.ndarray, parity: np.ndarray) -> Iterator[pa.RecordBatch]:
        for seed in range(shuffles + 1):
            place = _mixed((own ^ key).view(np.uint64) + np.uint64(seed)) if seed else size
            order = np.lexsort((own, place, key))
            a, b = order[:-1], order[1:]
            low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            can = (key[a] == key[b]) & (low >= high * least - 1e-9)
            a, b = a[can], b[can]
            can = np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1) <= (size[a] + size[b]) * (1 - least) / (1 + least) + 1e-9
            x, y = own[a[can]], own[b[can]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return _by_key(settle, 7)


def _estimated(kept: int, percent: int, least: int):
    """Pairs whose union's sketch holds enough values of both; for sets within their sketches that is the similarity itself."""

    def likely(x: np.ndarray, y: np.ndarray) -> bool:
        union = np.union1d(x, y)[:kept]
        both = int(np.isin(union, x, assume_unique=True).sum() + np.isin(union, y, assume_unique=True).sum()) - len(union)
        return both >= least if len(union) == kept else 100 * both >= percent * len(union)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [(c.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)) for c in batch.columns[2:4]]
            (x, i), (y, j) = values
            keep = [likely(x[i[n] : i[n + 1]], y[j[n] : j[n + 1]]) for n in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _fuzzy_pairs(met: DataFrame) -> DataFrame:
    """Pairs (a, b) whose SimHash fingerprints are equal or linked by Golay keys."""
    named = stored(met.groupBy("bits").agg(F.min("uid").alias("uid")), "fingerprints")
    end = lambda side: named.select(F.col("bits").alias(side), F.col("uid").alias(f"uid_{side}"))
    fuzzy = near_links(named).join(end("a"), "a").join(end("b"), "b").select(F.col("uid_a").alias("a"), F.col("uid_b").alias("b"))
    same = met.select("bits", F.col("uid").alias("a")).join(named.select("bits", F.col("uid").alias("b")), "bits").select("a", "b")
    return fuzzy.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")


def grouped(docs: DataFrame, percent: int, shingle: int = 5, kept: int = KEPT, chance: float = 1e-9, limit: int = 20_000, shuffles: int = 2, fuzzy: bool = False, small: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, digest, size) of every row of ``docs`` (doc_id, text), and (digest, group, least) of every set.

    ``digest`` names a row's set of shingles, ``size`` counts them, ``group`` is one for all sets reachable over links and
    ``least`` the set's smallest doc_id; empty sets are one group. With ``fuzzy``, SimHash links by Golay keys are tried
    first. ``limit``, ``shuffles``, ``fuzzy`` and ``small`` (documents whose sketches are broadcast) change the work, not the result.
    """
    share, least = percent / 100, least_shared(kept, percent, chance)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = docs.select("text", "doc_id", F.xxhash64("text").alias("text_hash"))
    marked = stored(told.mapInArrow(_sketched(shingle, kept, fuzzy), "doc_id long, text_hash long, digest binary, size int, sketch array<long>, parity binary, bits long"), "sketches")
    one = marked.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("pick"), *[F.first(c).alias(c) for c in ("size", "sketch", "parity", "bits")])
    distinct = stored(one.withColumn("uid", F.monotonically_increasing_id()), "distinct")
    lists = stored(inverted(distinct, kept, percent, least), "lists")
    met = stored(distinct.join(lists.select("uid").distinct(), "uid", "left_semi"), "met")
    n, total = met.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()

    wanted = met.select("uid", F.col("pick.doc_id").alias("_id"), F.col("pick.text_hash").alias("_hash"))
    texts = told.join(broadcast_if_small(wanted, n, 200_000), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("text", "uid")
    sets = stored(texts.mapInArrow(_sets(shingle), "uid long, own array<long>"), "sets")
    sets = sets if sets.count() == n else stored(sets.dropDuplicates(["uid"]), "sets")
    few = lambda df, rows, most: broadcast_if_small(df, rows, most)
    keys = stored(lists.join(few(met.select("uid", "size", "parity"), n, 50_000), "uid").select("key", "n", "size", F.col("uid").alias("digest"), "parity"), "keys")
    side = lambda df, column, name: df.select(F.col("uid").alias(name), F.col(column).alias(f"{column}_{name}"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The similar ones of pairs (a, b). Sketches and sets are broadcast only up to a checked number of values."""
        for end in ("a", "b"):
            pairs = pairs.join(few(side(met, "sketch", end), n, small), end)
        whole = pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_estimated(kept, percent, least), "a long, b long")
        for end in ("a", "b"):
            whole = whole.join(few(side(sets, "own", end), total, 100 * small), end)
        whole = whole.withColumn("shared", F.size(F.array_intersect("own_a", "own_b")))
        return stored(whole.where(100 * F.col("shared") >= percent * (F.size("own_a") + F.size("own_b") - F.col("shared"))).select("a", "b"), "links")

    # documents beside each other in their lists, of which a large group of near copies needs no more
    cells = F.ceil(F.col("n") / limit)
    run = F.when(cells > 1, F.xxhash64("key", F.pmod(F.xxhash64("digest"), cells))).otherwise(F.col("key"))
    runs = keys.select(run.alias("key"), "size", "digest", F.col("digest").alias("root"), F.lit(True).alias("apart"), F.lit(True).alias("home"), "parity").repartition("key").sortWithinPartitions("key")
    pairs = runs.mapInArrow(_beside(share, shuffles), "a long, b long")
    pairs = pairs.unionByName(_fuzzy_pairs(met)) if fuzzy else pairs
    links = confirmed(stored(pairs.distinct(), "pairs"))
    linked = stored(components(links), "linked")
    # then every pair that is still apart
    rooted = keys.join(linked.select(F.col("node").alias("digest"), F.col("root").alias("_r")), "digest", "left").select("key", "size", "digest", F.coalesce("_r", "digest").alias("root"))
    runs = in_runs(rooted, limit).join(few(met.select(F.col("uid").alias("digest"), "parity"), n, 50_000), "digest")
    runs = runs.select("key", "size", "digest", "root", "apart", "home", "parity").repartition("key").sortWithinPartitions("key", "size")
    rest = confirmed(stored(runs.mapInArrow(_pairs(share), "a long, b long, need long").select("a", "b").distinct(), "pairs"))
    found = linked if rest.isEmpty() else components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest))

    groups = distinct.select("uid", "digest", "least").join(found, F.col("uid") == F.col("node"), "left").select("digest", F.coalesce("root", "uid").alias("group"), "least")
    return marked.select("doc_id", "text_hash", "digest", "size"), groups


def near_sets(docs: DataFrame, percent: int = 85, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text and others).

    Rows are linked whose sets of shingles have ``100 * shared >= percent * union``, confirmed on the whole sets; a text of
    fewer words is one shingle. ``component_id`` is the smallest doc_id reachable. Texts that are null or have no word have
    an empty set and are linked with nothing. Repeated rows are kept and are one group; null ids take part, but name a
    component only where all its ids are null; ``kept`` is whether the ids agree, nulls too. Very long texts are read whole,
    an empty table gives no rows, other columns are ignored. ``options`` are those of ``grouped``.
    """
    marked, groups = grouped(docs, percent, **options)
    named = groups.join(groups.groupBy("group").agg(F.min("least").alias("of_group")), "group").select("digest", "of_group")
    out = marked.select("doc_id", "digest", F.col("size").cast("long").alias("n_shingles")).join(named, "digest")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("of_group")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_sets(table(spark, sf_dir, "documents"))


SQL = r"""WITH RECURSIVE w AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT id, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(len(ws) - 4), lambda i: ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] || ' ' || ws[i + 5])) END AS sh FROM w),
n AS (SELECT id, doc_id, CAST(len(sh) AS BIGINT) AS n, CASE WHEN len(sh) > 0 THEN md5(array_to_string(list_sort(sh), chr(10))) END AS k FROM s),
r AS (SELECT k, min(id) AS id, any_value(n) AS n FROM n WHERE n > 0 GROUP BY k),
e AS (SELECT r.id, hash(u.x) AS x, r.n FROM (SELECT id, unnest(sh) AS x FROM s) AS u JOIN r USING (id)),
p AS (SELECT a.id AS a, b.id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT id AS a, id AS b FROM r UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
g AS (SELECT r.k, min(c.b) AS g FROM c JOIN r ON r.id = c.a GROUP BY r.k),
m AS (SELECT g.g, min(n.doc_id) AS m FROM n JOIN g USING (k) GROUP BY g.g)
SELECT n.doc_id, n.n AS n_shingles, CASE WHEN n.n = 0 THEN n.doc_id ELSE m.m END AS component_id, n.doc_id IS NOT DISTINCT FROM CASE WHEN n.n = 0 THEN n.doc_id ELSE m.m END AS kept FROM n LEFT JOIN g USING (k) LEFT JOIN m ON m.g = g.g"""
