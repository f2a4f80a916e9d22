"""Personal data: spans of fixed kinds, and terms that give protected entities away.

A protected entity is a value (an address, a number) or what many values share: the domain of an e-mail address, the first
digits of a number, the network of an IP address. The corpus tells how strongly a term reveals an entity: with p(e) the share of documents that hold entity e and p(e|t)
the share of term t's documents that hold it next to t, their pointwise mutual information is log(p(e|t)/p(e)), and t
discloses e when that reaches the information log(1/p(e)) of the entity divided by ``alpha``. Disclosing terms are
generalised to a placeholder, or removed when nearly all their documents hold the entity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, stored, table

KINDS = ("email", "ip", "card", "phone", "term")
BASE = 4

#: Fixed patterns of the contract.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address starts where the run of its characters does, so each at sign needs one look back and one ahead."""
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        found = start < at and _DOMAIN.match(text, at + 1)
        if found:
            yield start, found.end()
            pos = found.end()
        at = text.find("@", max(at + 1, pos))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Each run of dotted numbers holds its matches in fours, from its start."""
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        start = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(int(d) for d in digits[-1::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds in code points, by start and then kind; leftmost, non-overlapping per kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entities(kind: int, value: str) -> list[str]:
    """The value and the group that it belongs to."""
    low, digits = value.lower(), "".join(c for c in value if c.isdigit())
    group = (low.partition("@")[2], ".".join(low.split(".")[:2]), digits[:6], digits[:4])[kind]
    return [f"{KINDS[kind]}:{low}", f"{KINDS[kind]}~{group}"]


def _inside_word(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


def terms_near(text: str, start: int, end: int, window: int, reach: int) -> list[str]:
    """Up to ``window`` whole terms on each side that begin within ``reach`` characters of a span."""
    low, high = max(0, start - reach), min(len(text), end + reach)
    while low < start and _inside_word(text, low):
        low += 1
    while _inside_word(text, high):
        high += 1
    return _TERM.findall(text[low:start])[-window:] + _TERM.findall(text[end:high])[:window]


def _contexts(window: int, reach: int):
    """Per entity of a document: its kind and value, and the terms within ``window`` words and ``reach`` characters of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entity, terms = [], []
            for text in batch.column(0).to_pylist():
                near: dict[str, set[str]] = {}
                for start, kind, end in base_spans(text or ""):
                    terms_here = {w.lower() for w in terms_near(text, start, end, window, reach)}
                    for e in entities(kind, text[start:end]):
                        near.setdefault(e, set()).update(terms_here)
                for e, own in near.items():
                    entity.append(e)
                    terms.append(sorted(own))
            yield pa.RecordBatch.from_arrays([pa.array(entity, pa.string()), pa.array(terms, pa.list_(pa.string()))], names=["entity", "terms"])

    return run


def _document_frequency(wanted: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(wanted.intersection(w.lower() for w in _TERM.findall(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "docs"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = list({w.lower() for w in _TERM.findall(text or "")})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["term"])


def disclosing_terms(docs: DataFrame, alpha: float = 1.1, support: int = 3, window: int = 5, reach: int = 120, limit: int = 200_000) -> DataFrame:
    """(term, share): terms that disclose an entity, with the largest p(entity | term).

    A pair counts from ``support`` different surroundings on, so copies of one passage prove nothing. Up to ``limit``
    candidate terms are counted over the corpus inside the tasks; more of them by a shuffled join.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = stored(texts.mapInArrow(_contexts(window, reach), "entity string, terms array<string>"), "contexts")
    per_entity = found.groupBy("entity").agg(F.count("*").alias("entity_docs"))
    pairs = (
        found.groupBy("entity", "terms").agg(F.count("*").alias("n")).select("entity", F.explode("terms").alias("term"), "n")
        .groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("surroundings")).where(F.col("surroundings") >= support)
    )
    pairs = stored(pairs.join(per_entity, "entity"), "pairs")
    names = stored(pairs.select("term").distinct(), "terms")
    n = names.count()
    if not n:
        return names.select("term", F.lit(0.0).alias("share"))
    if n <= limit:
        wanted = frozenset(r["term"] for r in names.collect())
        counts = texts.mapInArrow(_document_frequency(wanted), "term string, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    else:
        counts = texts.mapInArrow(_words, "term string").join(names, "term", "left_semi").groupBy("term").agg(F.count("*").alias("docs"))
    total = F.lit(float(docs.count()))
    held = F.least(F.col("both") / F.col("docs"), F.lit(1.0))
    information = F.log(total / F.col("entity_docs"))
    told = F.log(held * total / F.col("entity_docs"))
    flagged = pairs.join(counts, "term").where((told >= information / alpha) & (information > 0))
    return stored(flagged.groupBy("term").agg(F.max(held).alias("share")), "disclosing")


def redact(text: str, spans: list[tuple[int, int, int]], removed: frozenset[str]) -> str:
    """Spans replaced by placeholders of their kind; overlapping ones by the first one's; ``removed`` terms by nothing."""
    out, pos = [], 0
    for start, kind, end in spans:
        if start >= pos:
            out += [text[pos:start], "" if kind == BASE and text[start:end].lower() in removed else f"<{KINDS[kind].upper()}>"]
        pos = max(pos, end)
    return "".join(out) + text[pos:]


def term_spans(text: str, base: list[tuple[int, int, int]], terms) -> list[tuple[int, int, int]]:
    """Occurrences of the terms that touch no base span."""
    if not terms:
        return []
    free = [(m.start(), BASE, m.end()) for m in _TERM.finditer(text) if m[0].lower() in terms]
    return [s for s in free if not any(a < s[2] and s[0] < b for a, _, b in base)]


def _marker(names: list[str], terms: dict[str, float] | None, remove_at: float, with_terms: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_pylist() if with_terms else [None] * batch.num_rows
            spans_out, texts = [], []
            for text, told in zip(batch.column(0).to_pylist(), own):
                told = terms if terms is not None else {t["term"]: t["share"] for t in told or ()}
                base = base_spans(text or "")
                spans = sorted(base + term_spans(text or "", base, told))
                spans_out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
                gone = frozenset(t for t, share in told.items() if share >= remove_at) if spans else frozenset()
                texts.append(None if text is None else redact(text, spans, gone))
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            rest = batch.columns[1 + with_terms :]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(spans_out, kinds), pa.array(texts, pa.string())], names=[*names, "spans", "clean_text"])

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, term): the different terms of each text, cut as everywhere else."""
    for batch in batches:
        for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = list({w.lower() for w in _TERM.findall(text or "")})
            yield pa.RecordBatch.from_arrays([pa.array([h] * len(words), pa.int64()), pa.array(words, pa.string())], names=["_hash", "term"])


def find_personal_data(docs: DataFrame, keep: list[str], limit: int = 200_000, remove_at: float = 0.9, slots: int = 16, **options) -> DataFrame:
    """``keep`` columns of ``docs`` with ``spans`` (kind, start, end in code points, end exclusive) and ``clean_text``.

    A null text has no spans and stays null; an empty text has none; an empty table gives no rows; very long texts are read
    whole; repeated rows are marked alike; other columns are ignored, and kept columns named like an added one are
    replaced. Terms of the whole corpus up to ``limit`` go to the tasks as a set; more of them reach the documents that
    hold them by a join on the text's hash, each text once, and its copies are dealt to ``slots``. Both ways give the same.
    """
    keep = only(keep, "spans", "clean_text")
    told = disclosing_terms(docs, limit=limit, **options)
    kept = docs.select(F.col("text").cast("string").alias("_text"), *keep)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[1:])
    schema = f"{fields}spans array<struct<kind: string, start: long, end: long>>, clean_text string"
    if told.count() <= limit:
        return kept.mapInArrow(_marker(keep, {r["term"]: r["share"] for r in told.collect()}, remove_at, False), schema)
    hashed = kept.withColumn("_hash", F.xxhash64("_text"))
    texts = hashed.select("_hash", "_text").dropDuplicates()
    held = texts.mapInArrow(_held, "_hash long, term string").join(told, "term").groupBy("_hash").agg(F.collect_set(F.struct("term", "share")).alias("_terms"))
    held = held.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    slot = F.pmod(F.xxhash64(*keep) if keep else F.lit(0), F.lit(slots)).cast("int")
    joined = hashed.withColumn("_slot", slot).join(held, ["_hash", "_slot"], "left").select("_text", "_terms", *keep)
    return joined.mapInArrow(_marker(keep, None, remove_at, True), schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"), ["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS[:BASE]]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"] != KINDS[BASE])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
