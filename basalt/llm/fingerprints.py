"""Canonical exact digests of whole texts, with DataFrame and SQL functions only.

A text is normalised (NFC), case-folded and its white space folded, and digested to 128 bits by two xxHash64. Equal
digests are confirmed byte by byte: the canonical texts of every digest that occurs more than once are compared, and a
text that differs from the first of its digest gets a number of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored, table


def canonical(text: Column) -> Column:
    """Unicode NFC, full case folding, NFC again, white-space runs as one space, trimmed. Null counts as empty."""
    icu = "com.ibm.icu"
    composed = F.call_function("reflect", F.lit(f"{icu}.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False))
    folded = F.call_function("reflect", F.lit(f"{icu}.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.call_function("reflect", F.lit(f"{icu}.text.Normalizer"), F.lit("compose"), folded, F.lit(False))
    return F.trim(F.regexp_replace(again, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """128 bits of a canonical text as 32 hex digits."""
    pair = F.transform(F.array(F.xxhash64(canon), F.xxhash64(F.lit(1), canon)), lambda h: F.lpad(F.lower(F.hex(h)), 16, "0"))
    return F.array_join(pair, "")


def edited(text: Column, n: Column, following: Column) -> Column:
    """``text`` with its last third replaced by as many first characters of ``following``, or all it has."""
    third = F.floor(n / 3).cast("int")
    return F.concat(F.left(text, (n - third).cast("int")), F.left(following, third))


def _at(bounds: list[int], value: Column) -> Column:
    """Number of sorted ``bounds`` below ``value``, found by way of every 256th of them."""
    if not bounds:
        return F.lit(0)
    below = lambda some: F.size(F.filter(some, lambda b: b < value))
    if len(bounds) <= 256:
        return below(F.lit(bounds).cast("array<bigint>"))
    rows = [bounds[i : i + 256] for i in range(0, len(bounds), 256)]
    row = F.greatest(below(F.lit([r[0] for r in rows]).cast("array<bigint>")) - 1, F.lit(0))
    return row * 256 + below(F.get(F.lit(rows).cast("array<array<bigint>>"), row))


def neighbours(docs: DataFrame, own: Column, per_range: int = 1500, most_ranges: int = 1 << 15) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) and ``own`` with those of the next row by descending ``doc_id``, the first after the last.

    Rows are dealt to ranges of ids with about ``per_range`` rows each (more from ``most_ranges`` ranges on); of every
    range, the last row's next is the first row of the nearest lower range that has rows, which is added to the range as a
    guest. No window spans the table. Ties of one id are ordered by a hash of their text, and then by it; null ids come
    last, dealt to ranges by that hash.
    """
    n = docs.count()
    ranges = max(1, min(most_ranges, n // per_range))
    docs = docs.withColumn("_tie", F.xxhash64("text"))
    bounds: list[int] = []
    spans = 1
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        got = docs.agg(F.percentile_approx("doc_id", shares, 10 * ranges).alias("q"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
        bounds, spans = sorted(set(got["q"] or [])), max(1, min(most_ranges, got["none"] // per_range))
    slice_ = F.floor((F.shiftrightunsigned(F.col("_tie").bitwiseXOR(F.lit(-(1 << 63))), 33)) / F.lit(2**31 / spans)).cast("int")
    dealt = docs.withColumn("range", F.when(F.col("doc_id").isNull(), -1 - slice_).otherwise(_at(bounds, F.col("doc_id"))))
    # the first row of each range, as a guest of the next higher range that has rows
    order = [F.desc_nulls_last("doc_id"), F.asc("_tie"), F.asc("text")]
    firsts = dealt.groupBy("range").agg(F.max("doc_id").alias("top"), F.min("_tie").alias("least")).orderBy("range").collect()
    filled = [r["range"] for r in firsts]
    if not filled:
        nothing = {"own": own, "next_text": F.lit(None).cast("string"), "next_own": F.lit(None).cast("string"), "next_id": F.lit(None).cast("long"), "next_tie": F.lit(None).cast("long")}
        return docs.withColumns(nothing)
    rows = [(r["range"], r["top"], r["least"], filled[(k + 1) % len(filled)]) for k, r in enumerate(firsts)]
    hosts = docs.sparkSession.createDataFrame(rows, "range int, _top long, _least long, _host int")
    guests = dealt.join(F.broadcast(hosts), "range").where((F.col("doc_id").isNull() & (F.col("_tie") == F.col("_least"))) | (F.col("doc_id") == F.col("_top")))
    guests = guests.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy(*order))).where("rank = 1")
    guests = guests.withColumn("range", F.col("_host")).select(*dealt.columns, F.lit(1).alias("guest"))
    line = Window.partitionBy("range").orderBy("guest", *order)
    both = dealt.withColumn("guest", F.lit(0)).unionByName(guests).withColumn("own", own)
    after = {f"next_{name}": F.lead(column).over(line) for name, column in (("text", "text"), ("own", "own"), ("id", "doc_id"), ("tie", "_tie"))}
    return both.withColumns(after).where("guest = 0").drop("guest", "range")


def _variants(found: DataFrame, docs: DataFrame, limit: int) -> DataFrame | None:
    """(digest, canon, variant) of the texts that share a digest with a different text; None where there are none.

    ``found`` names the rows of every digest that occurs more than once by the hashes of their texts, so each different
    text, and each different pair of a text and its next, is read once, whatever their ids are.
    """
    both = found.select(F.col("own").alias("digest")).unionByName(found.select(F.col("changed").alias("digest")))
    often = stored(both.groupBy("digest").count().where("count > 1").select("digest"), "often")
    often = broadcast_if_small(often, often.count(), limit)
    plain = found.join(often, F.col("own") == F.col("digest"), "left_semi").select("_tie")
    altered = found.join(often, F.col("changed") == F.col("digest"), "left_semi").where("own <> changed").select("_tie", "next_tie")
    plain, altered = stored(plain.distinct(), "plain"), stored(altered.distinct(), "altered")
    texts = docs.select(F.xxhash64("text").alias("_tie"), "text", "n_chars")
    first = texts.join(broadcast_if_small(plain, plain.count(), limit), "_tie", "left_semi").select(canonical(F.col("text")).alias("canon"))
    wanted = stored(altered.select("_tie").unionByName(altered.select(F.col("next_tie").alias("_tie"))).distinct(), "wanted")
    parts = stored(texts.join(broadcast_if_small(wanted, wanted.count(), limit), "_tie", "left_semi").dropDuplicates(["text"]), "parts")
    nexts = parts.select(F.col("_tie").alias("next_tie"), F.col("text").alias("next_text"))
    second = altered.join(parts, "_tie").join(nexts, "next_tie").select(canonical(edited(F.col("text"), F.col("n_chars"), F.col("next_text"))).alias("canon"))
    canon = first.unionByName(second).withColumn("digest", digest(F.col("canon"))).distinct()
    shared = canon.groupBy("digest").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).where("least <> most").select("digest")
    shared = stored(shared, "shared")
    if shared.isEmpty():
        return None
    same = canon.join(shared, "digest")
    return stored(same.withColumn("variant", F.row_number().over(Window.partitionBy("digest").orderBy("canon"))).where("variant > 1"), "variants")


def fingerprints(docs: DataFrame, limit: int = 500_000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Null texts count as empty; an empty table gives no rows; a single row is its own next; repeated rows are kept, ties
    of one id being ordered by the hash of their text; null ids come last in the order; very long texts are digested whole;
    other columns are ignored. The likeness of two exact digests is 1 or 0.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("n_chars", F.char_length("text").cast("long"))
    chained = neighbours(base, digest(canonical(F.col("text"))))
    chained = chained.withColumn("edit", edited(F.col("text"), F.col("n_chars"), F.col("next_text")))
    columns = ["doc_id", "_tie", "next_tie", "n_chars", "own", "next_own", F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), digest(canonical(F.col("edit"))).alias("changed")]
    found = stored(chained.select(*columns), "digests")
    variants = _variants(found, base, limit)
    if variants is not None:
        found = _numbered(chained, columns, variants)
    like = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return found.select("doc_id", "n_chars", "edited_sha256", F.col("own").alias("fingerprint"), F.col("changed").alias("edited_fingerprint"), like("own", "changed").alias("near_edited"), like("own", "next_own").alias("near_next"))


def _numbered(chained: DataFrame, columns: list, variants: DataFrame) -> DataFrame:
    """Digests with the number of the text that differs from the first of its digest; texts are worked out again for it."""
    full = chained.select(*columns, "text", "edit", "next_text")
    for column, text in (("own", "text"), ("changed", "edit"), ("next_own", "next_text")):
        v = variants.select(F.col("digest").alias("_d"), F.col("canon").alias("_c"), "variant")
        full = full.withColumn("_k", canonical(F.col(text))).join(v, (F.col(column) == F.col("_d")) & (F.col("_k") == F.col("_c")), "left")
        full = full.withColumn(column, F.concat_ws("-", column, F.col("variant").cast("string"))).drop("_k", "_d", "_c", "variant")
    return full.drop("text", "edit", "next_text")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
