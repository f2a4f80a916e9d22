"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics; the statistics themselves stand beside them, so
the ridge has a linear part. Every partition of the labelled rows adds up
its own normal equations; their sums, of a size fixed by ``features``, are all that reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, crc32_mod, only, stored, table

STATISTICS = 18


def statistics(text: str) -> list[float]:
    """Numbers about a whole text; of an empty one, all 0."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * STATISTICS
    distinct = set(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = text.split("\n")
    ascii_text = text.encode("ascii", "replace")
    letters = len(ascii_text) - len(ascii_text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz?"))
    upper = len(ascii_text) - len(ascii_text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(ascii_text) - len(ascii_text.translate(None, b"0123456789"))
    signs = len(ascii_text) - len(ascii_text.translate(None, b"#$%&*+/<=>@[\\]^_`{|}~"))
    stops = len(ascii_text) - len(ascii_text.translate(None, b".,;:"))
    pairs = len(set(zip(words, words[1:])))
    return [
        math.log1p(chars), math.log1p(n), sum(map(len, words)) / n, max(map(len, words)) / (max(map(len, words)) + 20), upper / (letters + 1), digits / chars,
        signs / chars, text.count("|") / n, (text.count("!") + text.count("?")) / n, len(distinct) / n, max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        math.log1p(len(lines)), len(set(lines)) / len(lines), math.log1p(chars / len(lines)), stops / n, sum(len(w) <= 2 for w in words) / n, pairs / n,
    ]


@dataclass(frozen=True)
class Model:
    """Everything a score needs; a model without training rows gives 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack((np.sqrt(2.0 / len(self.shift)) * np.cos(z @ self.weights + self.shift), z, np.ones((len(z), 1))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a small strictly increasing part, so that equal steps of the calibration keep their order."""
        if not len(self.knots):
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        return np.clip(0.98 * np.interp(raw, self.knots, self.values) + 0.02 / (1 + np.exp(-np.clip(4 * raw - 2, -30, 30))), 0, 1)


def isotonic(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means nearest to ``value`` with weights ``count``."""
    blocks: list[list[float]] = []
    for v, c in zip(value, count):
        blocks.append([v, c, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, c2, n2 = blocks.pop()
            v1, c1, n1 = blocks.pop()
            blocks.append([(v1 * c1 + v2 * c2) / (c1 + c2), c1 + c2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(t or "") for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(x, pa.list_(pa.float64()))], names=[*batch.schema.names[1:], "x"])


def _normal_equations(model: Model):
    """One row of sums for each row of the matrix, from all of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                f = model.features(np.array(pdf["x"].tolist()))
                part = np.hstack((f.T @ f, (f.T @ pdf["label"].to_numpy(float))[:, None]))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "sums": list(total)})

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": [pdf["i"].iloc[0]], "sums": [np.sum(np.stack(pdf["sums"].to_list()), axis=0)]})


def _binned(model: Model, low: float, high: float, bins: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                raw = model.raw(np.array(pdf["x"].tolist()))
                at = np.clip((raw - low) / (high - low) * bins, 0, bins - 1).astype(int)
                yield pd.DataFrame({"bin": at, "raw": raw, "label": pdf["label"].to_numpy(float)}).groupby("bin", as_index=False).agg(n=("raw", "size"), raw=("raw", "sum"), label=("label", "sum"))

    return run


def taught(docs: DataFrame, labels: DataFrame, sample: int, seed: int) -> DataFrame:
    """(h, text, label) of about ``sample`` labelled documents at most, chosen by ``h``, a seeded hash of their ids below 2^40.

    ``labels`` has ``doc_id`` and ``label``; labels other than 0 and 1 teach nothing, and of an id's labels the largest
    counts. The chosen labels are counted before they are broadcast.
    """
    known = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    n = known.count()
    known = known.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))).where(F.col("h") < int(min(1.0, sample / max(n, 1)) * (1 << 40)))
    known = stored(known, "taught")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(broadcast_if_small(known, known.count(), 2 * sample), "doc_id").select("h", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, features: int = 256, ridge: float = 1e-3, width: float = 0.12, bins: int = 400, sample: int = 40_000, seed: int = 42) -> Model:
    """Model from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``label``), of which ``taught`` chooses.

    The fit is bounded: it reads about ``sample`` labelled documents, whole. Three quarters of them, by hash, fit the ridge
    regression; the rest calibrate it. Without labelled rows every score is 0.5.
    """
    nothing = Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros((STATISTICS, 1)), np.zeros(1), np.zeros(STATISTICS + 2), np.zeros(0), np.zeros(0))
    measured = taught(docs, labels, sample, seed).select("text", F.col("label").cast("double").alias("label"), (F.col("h") % 4 == 0).alias("calibrates"))
    measured = stored(measured.mapInArrow(_measure, "label double, calibrates boolean, x array<double>"), "statistics")
    fitting = measured.where(~F.col("calibrates"))
    got = fitting.agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    if not got["n"]:
        fitting = measured
        got = fitting.agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    if not got["n"]:
        return nothing
    mean = np.array([got[f"avg{i}"] for i in range(STATISTICS)])
    scale = np.array([got[f"stddev_pop{i}"] or 1.0 for i in range(STATISTICS)])
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, math.sqrt(2 * width), (STATISTICS, features)), rng.uniform(0, 2 * math.pi, features), np.zeros(features + STATISTICS + 1), np.zeros(0), np.zeros(0))
    sums = fitting.select("x", "label").mapInPandas(_normal_equations(model), "i int, sums array<double>").groupBy("i").applyInPandas(_added, "i int, sums array<double>").collect()
    matrix = np.array([r["sums"] for r in sorted(sums, key=lambda r: r["i"])])
    solved = np.linalg.solve(matrix[:, :-1] + ridge * got["n"] * np.diag(np.r_[np.ones(features), np.full(STATISTICS, 0.1), 1e-9]), matrix[:, -1])
    model = Model(model.mean, model.scale, model.weights, model.shift, solved, model.knots, model.values)
    calibrating = measured.where("calibrates")
    low, high = -0.5, 1.5
    binned = calibrating.select("x", "label").mapInPandas(_binned(model, low, high, bins), "bin int, n long, raw double, label double")
    binned = binned.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("raw").alias("raw"), F.sum("label").alias("label")).orderBy("bin").collect()
    if not binned:
        return Model(model.mean, model.scale, model.weights, model.shift, solved, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    count = np.array([r["n"] for r in binned], float)
    knots = np.array([r["raw"] for r in binned]) / count
    values = isotonic((np.array([r["label"] for r in binned]) + 0.5) / (count + 1), count)
    return Model(model.mean, model.scale, model.weights, model.shift, solved, knots, values)


def _score(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(0).to_pylist()]).reshape(-1, STATISTICS)
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names[1:], "score", "predicted"])

    return run


def score_quality(docs: DataFrame, model: Model, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """``keep`` columns of ``docs`` with ``score`` (0 to 1) and ``predicted``; kept columns of these names are replaced.

    A null text scores as an empty one; very long texts are measured whole; repeated rows score alike; an empty table
    gives no rows; other columns are ignored.
    """
    keep = only(keep, "score", "predicted")
    kept = docs.select(F.col("text").cast("string").alias("_text"), *keep)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[1:])
    return kept.mapInArrow(_score(model, threshold), f"{schema}score double, predicted int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc32_mod("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    return score_quality(docs.withColumn("held_out", crc32_mod("doc_id", 5) == 0), fit(docs, labels), ["doc_id", "held_out"])
