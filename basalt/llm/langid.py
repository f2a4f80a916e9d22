"""Language identification by compression: the language whose dictionary shortens a text most.

Each language's dictionary is raw content: folded text of a bounded, hash-chosen sample of its documents. A text is
folded the same way and encoded whole, in segments, with every dictionary; the smallest sum of sizes decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, only, table

UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Lower case, with every run of anything but letters made one space."""
    return _OTHER.sub(" ", text.lower()).strip()


def learn(labelled: DataFrame, sample_docs: int = 64, piece_chars: int = 1500, dictionary_bytes: int = 1 << 16, seed: int = 42) -> list[tuple[str, bytes]]:
    """Dictionaries (language, raw content), the most frequent language first, from rows with ``doc_id``, ``text``, ``lang``.

    The fit reads at most about twice ``sample_docs`` documents a language, chosen by a seeded hash, and of each at most
    ``piece_chars`` characters. Rows without text or language teach nothing. The driver holds one bounded dictionary a
    language.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    position = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 2 * sample_docs / n) * (1 << 40)))])
    sample = rows.withColumn("p", position).where(F.col("p") < limit[F.col("lang")]).select("lang", "p", "doc_id", F.left("text", F.lit(4 * piece_chars)).alias("text"))
    pieces: dict[str, list[bytes]] = {}
    most = 4 * sample_docs * len(counts)  # one id repeated without end still gives a bounded sample, always the same
    for r in sorted(sample.orderBy("p", "lang", "doc_id", "text").limit(most).collect(), key=lambda r: (r["lang"], r["p"], r["doc_id"] or 0, r["text"])):
        own = pieces.setdefault(r["lang"], [])
        if len(own) < sample_docs:
            own.append(fold(r["text"])[:piece_chars].encode("utf-8", "replace"))
    ordered = sorted(counts, key=lambda lang: (-counts[lang], lang))
    return [(lang, (b"\n".join(pieces.get(lang, [])) or b" ")[-dictionary_bytes:].rjust(16)) for lang in ordered]


@lru_cache(maxsize=9)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int):
    import zstandard

    out = []
    for _, content in dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
    return out


def sizes(folded: str, compressors, segment: int = 4096) -> list[int]:
    """Bytes of the whole text under each dictionary; segments are encoded apart, so none learns from the text itself."""
    raw = folded.encode("utf-8", "replace")
    parts = [raw[i : i + segment] for i in range(0, len(raw), segment)]
    return [sum(len(c(p)) for p in parts) for c in compressors]


def split_dictionaries(dictionaries: tuple[tuple[str, bytes], ...], parts: int = 8) -> tuple[tuple[tuple[str, bytes], ...], ...]:
    """The dictionaries cut into ``parts``: sizes of a short text, summed over them, are told apart more finely than whole bytes."""
    cut = lambda content, i: content[len(content) * i // parts : len(content) * (i + 1) // parts].rjust(16)
    return tuple(tuple((lang, cut(content, i)) for lang, content in dictionaries) for i in range(parts))


def _identify(dictionaries: tuple[tuple[str, bytes], ...], level: int, narrow: float, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(dictionaries, level)
        finer = [_compressors(d, level) for d in split_dictionaries(dictionaries)]
        names = [lang for lang, _ in dictionaries]
        for batch in batches:
            lang, score, rejected = [], [], []
            for text in batch.column(0).to_pylist():
                folded = fold(text or "")
                if not folded or not names:
                    lang.append(UNDETERMINED)
                    score.append(0.0)
                    rejected.append(True)
                    continue
                got = sizes(folded, compressors)
                if len(folded) <= short:
                    got = [sum(s) for s in zip(got, *(sizes(folded, c) for c in finer))]
                best = min(range(len(got)), key=got.__getitem__)
                margin = (sorted(got)[1] - got[best]) / sorted(got)[1] if len(got) > 1 else 1.0
                lang.append(names[best])
                score.append(min(1.0, 0.5 + 5 * margin))
                rejected.append(margin < narrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names[1:], "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], keep: list[str], level: int = 6, narrow: float = 0.01, short: int = 200) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred``, ``score`` (0.5 at no margin to 1) and ``rejected``.

    A text that is null or has no letter is ``und`` with score 0 and rejected; so is every text where no language was
    learned. ``rejected`` also marks texts whose two smallest sizes differ by less than ``narrow``; their prediction is
    still given, and equal sizes go to the more frequent language. Texts of at most ``short`` letters are encoded with
    parts of the dictionaries too. Repeated rows are judged alike; very long texts are encoded whole; an empty table gives
    no rows; other columns are ignored, and kept columns named like an added one are replaced.
    """
    keep = only(keep, "lang_pred", "score", "rejected")
    kept = docs.select(F.col("text").cast("string").alias("_text"), *keep)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[1:])
    return kept.mapInArrow(_identify(tuple(dictionaries), level, narrow, short), f"{schema}lang_pred string, score double, rejected boolean")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc32_mod("doc_id", 3) == 1)
    return identify(docs, learn(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])
