"""Merkle manifest of a table: one tree for each group of rows, one tree over their roots, and for each row its witness.

Trees grow by appending. A task appends the leaves of one aligned block in order and keeps a stack of open subtrees; every
leaf carries the witness that it has so far, and each time a sibling subtree is complete, the witnesses of both get the
other's root. A block's root is then appended, as a leaf, to the tree above in the same way, and what it collects there
extends the witnesses of the whole block. So no task sees more than a block, however many leaves a tree has.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored, table

#: A block has 2^LEVELS leaves.
LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, otherwise the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values' fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def node(*digests: bytes) -> bytes:
    """A node's digest: of its children's, as hex text."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def height(size: int) -> int:
    return (size - 1).bit_length() if size > 1 else 0


class Block:
    """Appends leaves of one aligned block; ``witness`` holds for each of them the siblings known so far, bottom up."""

    def __init__(self) -> None:
        self.witness: list[bytearray] = []
        self.open: list[tuple[int, int, bytes]] = []  # height, first leaf, root; heights fall

    def append(self, digest: bytes) -> None:
        self.witness.append(bytearray())
        level, first, root = 0, len(self.witness) - 1, digest
        while self.open and self.open[-1][0] == level:
            level, first, root = self._joined(first, root)
        self.open.append((level, first, root))

    def close(self, levels: int) -> bytes:
        """The root ``levels`` above the leaves; a subtree without a sibling rises alone."""
        level, first, root = self.open.pop()
        while level < levels:
            if self.open and self.open[-1][0] == level:
                level, first, root = self._joined(first, root)
            else:
                level, root = level + 1, node(root)
        return root

    def _joined(self, first: int, root: bytes) -> tuple[int, int, bytes]:
        level, left, other = self.open.pop()
        for i in range(left, first):
            self.witness[i] += root
        for i in range(first, len(self.witness)):
            self.witness[i] += other
        return level + 1, left, node(other, root)


def folded(digest: bytes, proof: bytes, places: tuple[tuple[int, int], ...]) -> bytes:
    """The root that a leaf and its witness lead to, through trees in each of which it stands at (place, of how many)."""
    at = 0
    for place, size in places:
        while size > 1:
            if place ^ 1 < size:
                other = proof[at : at + 32]
                at += 32
                digest = node(other, digest) if place & 1 else node(digest, other)
            else:
                digest = node(digest)
            place, size = place >> 1, (size + 1) >> 1
    return digest


def _grown(levels: int):
    """Witnesses inside blocks of a partition sorted by (tree, place), and on a block's first row its root as ``top``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            trees, places = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            cut = rows.num_rows - 1
            while cut and trees[cut - 1] == trees[-1] and places[cut - 1] >> levels == places[-1] >> levels:
                cut -= 1
            if cut:
                yield told(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield told(held)

    def told(rows: pa.RecordBatch) -> pa.RecordBatch:
        trees, places, sizes, digests = (rows.column(i).to_pylist() for i in range(4))
        witness: list[bytes] = []
        tops: list[bytes | None] = []
        block = Block()
        for i, digest in enumerate(digests):
            block.append(digest)
            if i + 1 == len(digests) or trees[i + 1] != trees[i] or places[i + 1] >> levels != places[i] >> levels:
                tops += [block.close(min(levels, height(sizes[i])))] + [None] * (len(block.witness) - 1)
                witness += map(bytes, block.witness)
                block = Block()
        own = [pa.array(witness, pa.binary()), pa.array(tops, pa.binary())]
        return pa.RecordBatch.from_arrays([*rows.columns, *own], names=[*rows.schema.names, "witness", "top"])

    return run


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0) in their tree's order and its ``size``, nulls first; rows equal in all of it in any fixed order.

    Ranges of (tree, order) are sorted each by itself and shifted by the sizes of the ranges before, so no tree needs one task.
    """
    sorted_ = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(tree, *order, "_row").sortWithinPartitions(tree, *order, "_row")
    sorted_ = stored(sorted_.drop("_row").withColumn("_seq", F.monotonically_increasing_id()), "ordered")
    counts = sorted_.groupBy(F.col(tree).alias("_tree"), F.shiftright("_seq", 33).alias("_part")).agg(F.count("*").alias("n"), F.min("_seq").alias("first"))
    whole = Window.partitionBy("_tree")
    shifts = stored(counts.select("_tree", "_part", (F.sum("n").over(whole.orderBy("_part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size")), "shifts")
    met = sorted_.join(broadcast_if_small(shifts, shifts.count(), 200_000), F.col(tree).eqNullSafe(F.col("_tree")) & (F.shiftright("_seq", 33) == F.col("_part")))
    return met.select(*rows.columns, (F.col("_seq") + F.col("shift")).alias("place"), "size")


def witnessed(nodes: DataFrame, levels: int = LEVELS, limit: int = 100_000) -> DataFrame:
    """``nodes`` (tree, place, size, digest, others...) with ``witness``, the siblings up to their tree's root, and ``root``."""
    schema = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    block = F.shiftright("place", levels)
    rounds: list[DataFrame] = []
    most = nodes.agg(F.max("size")).first()[0] or 0
    while not rounds or most > 1:
        dealt = nodes.repartition("tree", block).sortWithinPartitions("tree", "place")
        rounds.append(stored(dealt.mapInArrow(_grown(levels), f"{schema(nodes)}, witness binary, top binary"), "witnesses"))
        most = -(-most >> levels) if most > 1 << levels else 1
        nodes = rounds[-1].where("top is not null").select("tree", block.alias("place"), F.ceil(F.col("size") / (1 << levels)).cast("long").alias("size"), F.col("top").alias("digest"))
    above = nodes.select(F.col("tree").alias("_tree"), F.col("place").alias("_block"), F.lit(b"").alias("rest"), F.col("digest").alias("root"))
    for grown in reversed(rounds):
        met = grown.join(broadcast_if_small(above, above.count(), limit), F.col("tree").eqNullSafe(F.col("_tree")) & (block == F.col("_block")))
        met = met.withColumn("witness", F.concat("witness", "rest")).drop("_tree", "_block", "rest", "top")
        above = met.select(F.col("tree").alias("_tree"), F.col("place").alias("_block"), F.col("witness").alias("rest"), "root")
    return met


def manifest(leaves: DataFrame, tree: str, order: list[str], keep: list[str], levels: int = LEVELS) -> DataFrame:
    """(keep..., leaf, subroot, root, place, size, tree_place, trees, proof) of every row of ``leaves`` (leaf as hex, and others).

    Rows of one value of ``tree`` are one tree, by ``order`` and then by leaf; the trees' roots, by that value (null first),
    are another. ``proof`` holds the siblings from the leaf through the subroot to the root, 32 bytes each. Equal rows have
    equal leaves, so which of them comes first changes nothing but which row has which proof. An empty table gives no rows.
    """
    rows = stored(leaves.select(F.col(tree).alias("tree"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.unhex("leaf").alias("digest"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]), "leaves")
    kept = [f"_k{i}" for i in range(len(keep))]
    own = witnessed(numbered(rows, "tree", [*(f"_o{i}" for i in range(len(order))), "digest"]).select("tree", "place", "size", "digest", *kept), levels)
    own = stored(own, "own")
    roots = own.where("place = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    top = witnessed(numbered(roots, "tree", ["name"]).select("tree", "place", "size", "digest", "name"), levels)
    top = stored(top.select(F.col("name").alias("_name"), F.col("place").alias("tree_place"), F.col("size").alias("trees"), F.col("witness").alias("rest"), F.col("root").alias("all_root")), "top")
    met = own.join(broadcast_if_small(top, top.count(), 100_000), F.col("tree").eqNullSafe(F.col("_name")))
    hexed = lambda c: F.lower(F.hex(c))
    return met.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], hexed("digest").alias("leaf"), hexed("root").alias("subroot"), hexed("all_root").alias("root"), "place", "size", "tree_place", "trees", F.concat("witness", "rest").alias("proof"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        claimed, *places, proofs = (c.to_pylist() for c in batch.columns[:6])
        roots = [folded(bytes.fromhex(c), w, ((p, n), (q, m))).hex() for c, w, p, n, q, m in zip(claimed, proofs, *places)]
        yield pa.RecordBatch.from_arrays([*batch.columns[6:], pa.array([sha256(w.hex().encode()).hexdigest() for w in proofs]), pa.array(roots)], names=[*batch.schema.names[6:], "proof_sha256", "folded_root"])


def checked(proofs: DataFrame, claimed: str, keep: list[str]) -> DataFrame:
    """(keep..., proof_sha256, folded_root): of a manifest's rows the root that the leaf in ``claimed`` (hex) leads to by the row's proof."""
    rows = proofs.select(F.col(claimed).alias("_claimed"), *[F.col(c).alias(f"_{c}") for c in ("place", "size", "tree_place", "trees", "proof")], *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[6:])
    return rows.mapInArrow(_checked, f"{schema}, proof_sha256 string, folded_root string")


def document_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Documents' leaves, roots and proofs, and what becomes of the proof where ``n_chars`` was tampered with.

    A tree for each ``lang`` (null is one), leaves by doc_id (null first). Null fields are ``-``; empty texts ``0:``; whole
    texts are hashed; repeated rows are leaves each; tampering changes no null; extra columns are left out.
    """
    docs = docs.select(*[F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS])
    doc_id, source, lang, n_chars, text = map(F.col, FIELDS)
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))
    own = leaf(doc_id, source, lang, n_chars, text)
    claimed = F.when(hit & n_chars.isNotNull(), leaf(doc_id, source, lang, n_chars + 1, text))
    leaves = docs.select("doc_id", "lang", own.alias("leaf"), F.unhex(claimed).alias("other"))
    found = manifest(leaves, "lang", ["doc_id"], ["doc_id", "other"], levels)
    found = found.withColumn("claimed", F.coalesce(F.lower(F.hex("other")), "leaf"))
    out = checked(found, "claimed", ["doc_id", "leaf", "subroot", "root"])
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(table(spark, sf_dir, "documents"))


#: crc32 of ``s``, by its table of 256 remainders.
CRC32_SQL = "xor(list_reduce(list_transform(string_split({s}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: xor(tb.t[(xor(a, b) & 255) + 1], a >> 8), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
CRC32_TABLE_SQL = "tb AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END, i) AS v FROM range(256) AS r(i)))"

_FIELD = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = lambda n: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", n, "text"))) + ")"

SQL = f"""WITH RECURSIVE {CRC32_TABLE_SQL},
d AS (SELECT doc_id, lang, {_LEAF("n_chars")} AS h, {_LEAF("n_chars + 1")} AS h1, coalesce({CRC32_SQL.format(s="CAST(doc_id AS VARCHAR)")} % 7 = 0, false) AS hit, n_chars FROM documents, tb),
l AS (SELECT doc_id, lang, h, CASE WHEN hit AND n_chars IS NOT NULL THEN h1 ELSE h END AS claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT lang, 0 AS lvl, i, h, n FROM l UNION ALL SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, i // 2, n),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, h, n FROM s UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, i // 2, n),
w AS (SELECT l.doc_id, l.lang, l.i, 0 AS tree, t.lvl, CASE WHEN o.h IS NULL THEN 'N' WHEN o.i < t.i THEN 'L' || o.h ELSE 'R' || o.h END AS x FROM l JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.i = l.i >> t.lvl AND t.n > 1 LEFT JOIN t AS o ON o.lang IS NOT DISTINCT FROM t.lang AND o.lvl = t.lvl AND o.i = xor(t.i, 1)
UNION ALL SELECT l.doc_id, l.lang, l.i, 1, u.lvl, CASE WHEN o.h IS NULL THEN 'N' WHEN o.i < u.i THEN 'L' || o.h ELSE 'R' || o.h END FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN u ON u.i = s.i >> u.lvl AND u.n > 1 LEFT JOIN u AS o ON o.lvl = u.lvl AND o.i = xor(u.i, 1)),
p AS (SELECT lang, i, list(x ORDER BY tree, lvl) AS xs FROM w GROUP BY lang, i),
f AS (SELECT l.doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(p.xs, []) AS xs, l.claimed FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN p ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(xs, lambda x: substr(x, 2)), '')) AS proof_sha256,
list_reduce(xs, lambda a, x: CASE WHEN x = 'N' THEN sha256(a) WHEN x[1] = 'L' THEN sha256(substr(x, 2) || a) ELSE sha256(a || substr(x, 2)) END, claimed) AS folded_root,
list_reduce(xs, lambda a, x: CASE WHEN x = 'N' THEN sha256(a) WHEN x[1] = 'L' THEN sha256(substr(x, 2) || a) ELSE sha256(a || substr(x, 2)) END, claimed) = root AS verified FROM f"""
