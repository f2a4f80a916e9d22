"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

Landmarks are stretches of the words of labelled sentences, each from a word's beginning, that toxic documents hold more
often than others. The kernel of a word and a landmark sums their common
subsequences, letters and the mark of the beginning, each with a decay for every gap, and takes the part of the word where
most of the landmark is found: an insult with inserted, doubled, spread or missing letters, with another ending, or
inside a longer word, stays close to the landmark. A sentence is the sum of its different words' kernel values to each landmark,
mapped by Nyström; the machine separates sentences of toxic documents from others. A document is judged by its sentences'
margins alone: their soft maximum and the share of sentences on the toxic side, calibrated to a score.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, only, stored, table
from .quality import taught

ORDER, DECAY, POWER, LEAST = 3, 0.6, 3, 0.05
#: Letters of the longest word taken whole (longer ones are overlapping windows), and of the shortest and longest beginning.
LONGEST, SHORTEST, PIECE = 24, 3, 10
#: Stands before the first letter of a word.
BEGIN = "^"
#: How soon the greatest margin of a document outweighs the others.
SHARPNESS = 4.0
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_STANDS_FOR = str.maketrans("013457@$!|", "oieastasil")
_SPREAD = re.compile(r"(?:^|\s)\S\s+\S\s+\S(?!\S)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def fold_word(token: str) -> str:
    """Letters of a token in lower case; digits and signs between letters count as the letters they stand for."""
    low = token.lower()
    if low.isalpha():
        return low
    core = _EDGE.sub("", low)
    if not core.isalpha() and any(c.isalpha() for c in core) and not core.isnumeric():
        core = core.translate(_STANDS_FOR)
    return _NOT_LETTERS.sub("", core)


def joined(text: str) -> list[str]:
    """White-space tokens of a text, with runs of three or more single characters made one token."""
    tokens = text.split()
    if not _SPREAD.search(text):
        return tokens
    out, i = [], 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and len(tokens[j]) == 1:
            j += 1
        if j - i >= 3:
            out.append("".join(tokens[i:j]))
            i = j
        else:
            out.append(tokens[i])
            i += 1
    return out


def sentences_of(text: str) -> list[list[str]]:
    """Tokens of each sentence; one ends with a line, or after a token that ends in a stop."""
    out: list[list[str]] = []
    cut = joined if _SPREAD.search(text) else str.split
    for line in text.split("\n"):
        tokens, begin = cut(line), 0
        if "." in line or "!" in line or "?" in line:
            for k, t in enumerate(tokens, 1):
                if t[-1] in ".!?":
                    out.append(tokens[begin:k])
                    begin = k
        if begin < len(tokens):
            out.append(tokens[begin:])
    return out


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(words), width)


def subsequence_kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """(n, k) gap-weighted kernel of the first k+1 letters of each word in ``a`` with the word ``b``."""
    return np.cumsum(_by_last_letter((a[:, :, None] == b[None, None, :]) & (a[:, :, None] != 0), order, decay), axis=0).T


def own_kernel(a: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """(n,) kernel of each word with itself."""
    return _by_last_letter((a[:, :, None] == a[:, None, :]) & (a[:, :, None] != 0), order, decay).sum(axis=0)


def _by_last_letter(same: np.ndarray, order: int, decay: float) -> np.ndarray:
    """(letters, n) parts of the kernel whose subsequences end with each letter, from (n, letters, letters) matches."""
    same = same.transpose(1, 2, 0).astype(np.float32)
    prior = np.ones((same.shape[0] + 1, same.shape[1] + 1, same.shape[2]), np.float32)
    for _ in range(order - 1):
        prior = _gapped(same, prior, decay)
    return decay * decay * (same * prior[:-1, :-1]).sum(axis=1)


def _gapped(same: np.ndarray, prior: np.ndarray, decay: float) -> np.ndarray:
    """One more letter: at (i, j) the matches within the first i and j letters, decayed to there."""
    out = np.zeros_like(prior)
    decay = np.float32(decay)
    for i in range(same.shape[0]):
        row = np.zeros(same.shape[2], np.float32)
        matched = decay * decay * same[i] * prior[i, :-1]
        for j in range(same.shape[1]):
            row = decay * row + matched[j]
            out[i + 1, j + 1] = decay * out[i, j + 1] + row
    return out


def letters(code: np.ndarray) -> np.ndarray:
    """Classes 1 to 63 of coded letters, one of its own for each of a to z; 0 where there is none."""
    return np.where(code == 0, 0, np.where((code >= 97) & (code <= 122), code - 96, 27 + code % 37))


def letter_sets(classes: np.ndarray) -> np.ndarray:
    """The different letters of each row as bits."""
    return np.bitwise_or.reduce(np.where(classes > 0, np.uint64(1) << classes.astype(np.uint64), np.uint64(0)), axis=1)


def may_lack(landmark: str) -> int:
    """Different letters of a landmark that a word near it can be without."""
    return 1 if len(landmark) < 7 else 2


class Similarity:
    """Local kernel of words to the landmarks, to the power ``POWER``; ``near`` holds the tokens with a value above ``LEAST``.

    The value is the most that a stretch of the word, two letters longer than the landmark, holds of the landmark's kernel
    with itself, less for stretches that are richer than the landmark, and 1 at most; below ``LEAST``, and where more of the
    landmark's different letters are absent than ``may_lack`` says, it is 0. Words that have few of the landmark's pairs of
    near letters side by side can't reach ``LEAST`` and are passed over. A word longer than ``LONGEST`` counts as its overlapping windows of that length.
    """

    def __init__(self, landmarks: list[str], limit: int = 400_000):
        self.landmarks = landmarks
        self.codes = [_codes([z], len(z))[0] for z in landmarks]
        self.norm = [float(subsequence_kernel(c[None, :], c)[0, -1]) for c in self.codes]
        self.masks = np.array([letter_sets(letters(c[None, :]))[0] for c in self.codes], np.uint64)
        self.need = np.bitwise_count(self.masks).astype(int) - np.array([may_lack(z) for z in landmarks], int)
        self.pairs = np.zeros((len(landmarks), 64 * 64), np.uint8)
        for k, c in enumerate(letters(c) for c in self.codes):
            for step in range(1, 2 + may_lack(landmarks[k])):
                self.pairs[k, c[:-step] * 64 + c[step:]] = 1
        self.seen: set[str] = set()
        self.near: dict[str, np.ndarray] = {}
        self.limit = limit

    def local(self, code: np.ndarray, k: int) -> np.ndarray:
        """Kernel values of coded words to landmark ``k``."""
        total = subsequence_kernel(code, self.codes[k])
        width = len(self.codes[k]) + 2
        if total.shape[1] > width:
            total = np.column_stack((total[:, :width], total[:, width:] - total[:, :-width]))
        end = total.argmax(axis=1)
        value = total[np.arange(len(total)), end] / self.norm[k]
        near = np.flatnonzero(value**POWER >= LEAST)
        stretch = end[near, None] + np.arange(1 - width, 1)[None, :]
        own = own_kernel(np.where(stretch >= 0, code[near[:, None], np.maximum(stretch, 0)], 0))
        value[near] /= np.sqrt(np.maximum(1, own / self.norm[k]))
        return np.minimum(value, 1) ** POWER

    def vectors(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)))
        by_size = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(words), 16384):
            some = np.array(by_size[at : at + 16384])
            own = [words[i] for i in some]
            code = _codes(own, max(1, len(own[-1])))
            classes = letters(code)
            mask = letter_sets(classes)
            beside = np.hstack((classes[:, :-1] * 64 + classes[:, 1:], classes[:, :-2] * 64 + classes[:, 2:]))
            for k, z in enumerate(self.landmarks):
                rows = np.flatnonzero(np.bitwise_count(mask & self.masks[k]) >= self.need[k])
                rows = rows[self.pairs[k][beside[rows]].sum(axis=1) >= (3 if len(z) < 6 else 4)]
                if len(rows):
                    value = self.local(code[rows], k)
                    out[some[rows], k] = np.where(value >= LEAST, value, 0)
        return out

    def learn(self, tokens: set[str]) -> None:
        """Work out all tokens not yet seen, together."""
        new = tokens - self.seen
        if not new or not self.landmarks:
            return
        if len(self.seen) + len(new) > self.limit:
            self.seen.clear()
            self.near.clear()
            new = tokens
        self.seen |= new
        owners: dict[str, list[str]] = {}
        for t in new:
            for w in windows(BEGIN + fold_word(t)):
                owners.setdefault(w, []).append(t)
        words = list(owners)
        value = self.vectors(words)
        for k in np.flatnonzero(value.any(axis=1)):
            for t in owners[words[k]]:
                self.near[t] = np.maximum(self.near.get(t, 0.0), value[k])


def windows(word: str) -> list[str]:
    """A marked word, or the overlapping windows of a long one; none of a word with fewer than two letters."""
    if len(word) <= LONGEST:
        return [word] if len(word) >= ORDER else []
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


@lru_cache(maxsize=1)
def similarity_of(landmarks: tuple[str, ...]) -> Similarity:
    """One memory of tokens for all tasks that a worker process runs with the same landmarks."""
    return Similarity(list(landmarks))


@dataclass(frozen=True)
class Model:
    """Landmarks, their Nyström map, the separating plane, and the calibration of a document's evidence."""

    landmarks: list[str]
    nystroem: np.ndarray
    weights: np.ndarray
    bias: float
    calibration: np.ndarray

    def evidence(self, sentences: list[np.ndarray], count: int) -> list[float]:
        """Soft maximum of the margins of ``count`` sentences, and the share of them on the toxic side.

        ``sentences`` holds those with a word near a landmark; a document without them has fixed evidence.
        """
        if not sentences:
            return [-1.0, 0.0]
        own = np.clip(np.array(sentences) @ self.nystroem @ self.weights + self.bias, -8, 8)
        most = float(own.max() + np.log(np.exp(SHARPNESS * (own - own.max())).sum()) / SHARPNESS)
        return [max(-1.0, most), math.log1p(10 * float((1 / (1 + np.exp(-SHARPNESS * own))).sum()) / max(1, count))]

    def probability(self, evidence: list[float]) -> float:
        z = float(np.dot(self.calibration[:-1], evidence) + self.calibration[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def tokens_of(text: str) -> set[str]:
    """Every token that a sentence of the text can hold."""
    tokens = set(text.split())
    if _SPREAD.search(text):
        tokens.update(t for line in text.split("\n") for t in joined(line))
    return tokens


def sentence_features(text: str, tokens: set[str], near: dict[str, np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Features of the sentences that hold a word near a landmark, and the number of all; without such a word, none and 0."""
    if near.keys().isdisjoint(tokens):
        return [], 0
    every = sentences_of(text)
    found = ([near[t] for t in dict.fromkeys(sentence) if t in near] for sentence in every)
    return [np.sum(own, axis=0) for own in found if own], len(every)


def _groups(batches: Iterator[pa.RecordBatch], size: int = 1024) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part, [t or "" for t in part.column(0).to_pylist()]


def _beginnings(word: str) -> list[str]:
    return [BEGIN + word[:k] for k in range(SHORTEST, min(len(word), PIECE) + 1)]


def _counts_of_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, toxic, other): documents of each side that hold a word with this beginning, as counts of a partition."""
    counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for part, texts in _groups(batches):
        for text, toxic in zip(texts, part.column(1).to_pylist()):
            counts[0 if toxic else 1].update({z for w in {fold_word(t) for t in tokens_of(text)} for z in _beginnings(w)})
    every = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([counts[0][w] for w in every], pa.int64()), pa.array([counts[1][w] for w in every], pa.int64())], names=["piece", "toxic", "other"])


def _surroundings(wanted: frozenset[str]):
    """(piece, beside): the wanted beginnings in toxic documents, each with its word and the two words on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _groups(batches):
            piece, beside = [], []
            for text in texts:
                own = ["", "", *map(fold_word, joined(text)), "", ""]
                for i in range(2, len(own) - 2):
                    for z in _beginnings(own[i]):
                        if z in wanted:
                            piece.append(z)
                            beside.append(" ".join(own[i - 2 : i + 3]))
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.string()), pa.array(beside, pa.string())], names=["piece", "beside"])

    return run


def _instances(landmarks: list[str], most: int):
    """Labelled sentences: of each document the ``most`` nearest to a landmark; of one without a near word, zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        similarity = similarity_of(tuple(landmarks))
        for part, texts in _groups(batches):
            tokens = [tokens_of(t) for t in texts]
            similarity.learn(set().union(*tokens))
            x, y = [], []
            for text, own, label in zip(texts, tokens, part.column(1).to_pylist()):
                found = sorted(sentence_features(text, own, similarity.near)[0], key=lambda v: -v.max())[:most] or [np.zeros(len(landmarks))]
                x += found
                y += [float(label)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64())], names=["x", "y"])

    return run


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        similarity = similarity_of(tuple(model.landmarks))
        for part, texts in _groups(batches):
            tokens = [tokens_of(t) for t in texts]
            similarity.learn(set().union(*tokens))
            told = [model.evidence(*sentence_features(text, own, similarity.near)) for text, own in zip(texts, tokens)]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(told, pa.list_(pa.float64()))], names=[*part.schema.names[1:], "evidence"])

    return run


def choose_landmarks(ranked: list[str], most: int) -> list[str]:
    """The first of the ranked pieces, without those that begin another chosen one or begin with it."""
    out: list[str] = []
    for piece in ranked:
        if len(out) < most and not any(piece.startswith(z) or z.startswith(piece) for z in out):
            out.append(piece)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton steps."""
    z = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def disguised(word: str, rng: random.Random) -> str:
    """A marked beginning with a letter inserted or doubled."""
    k = rng.randrange(2, len(word))
    return word[:k] + (word[k - 1] if rng.random() < 0.5 else rng.choice("abcdefghijklmnopqrstuvwxyz")) + word[k:]


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM by Newton steps on the squared hinge loss; ``y`` is 1 or -1."""
    z = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        slack = 1 - y * (z @ w)
        on = slack > 0
        active, c = z[on], cost[on]
        gradient = penalty * w - active.T @ (c * y[on] * slack[on])
        step = np.linalg.solve(np.diag(penalty) + active.T @ (c[:, None] * active), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, most_landmarks: int = 32, significance: float = 4.0, sentences: int = 8, seed: int = 42) -> Model:
    """Model from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``label``), of which ``taught`` chooses.

    The fit is bounded: it reads about ``sample`` labelled documents at most, whole, and of each the ``sentences``
    sentences nearest to a landmark teach. Up to ``most_landmarks`` landmarks are beginnings of words that toxic documents
    hold significantly more often, copies of one passage counting once; those with the most toxic documents above the usual,
    weighted for length, come first. Disguised forms of them, made here, join the toxic sentences. Without toxic and other rows, or without such words, nothing is suspect and every text has
    one low score. Labels other than 0 and 1, and those without a text, teach nothing.
    """
    none = Model([], np.zeros((0, 0)), np.zeros(0), -1.0, np.array([0.0, 0.0, -3.0]))
    rows = stored(taught(docs, labels, sample, seed).select("text", "label"), "toxic-rows")
    total = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(total) < 2:
        return none
    counted = stored(rows.mapInArrow(_counts_of_sides, "piece string, toxic long, other long").groupBy("piece").agg(F.sum("toxic").alias("t"), F.sum("other").alias("c")), "pieces")
    usual = F.lit(total[1] / (total[0] + total[1])) * (F.col("t") + F.col("c"))
    odd = counted.withColumn("z", (F.col("t") - usual) / F.sqrt(usual + 1))
    order = [F.desc((F.col("t") - usual) * (1 - F.lit(2) / (F.length("piece") - 1))), F.desc(F.length("piece")), F.col("piece")]
    top = stored(odd.where(F.col("z") >= significance).orderBy(*order).limit(40 * most_landmarks), "odd-pieces")
    beside = rows.where("label = 1").select("text").mapInArrow(_surroundings(frozenset(r["piece"] for r in top.collect())), "piece string, beside string")
    apart = beside.groupBy("piece").agg(F.count_distinct("beside").alias("n"))
    again = top.join(apart, "piece").withColumn("t", F.least("t", "n")).withColumn("z", (F.col("t") - usual) / F.sqrt(usual + 1))
    landmarks = choose_landmarks([r["piece"] for r in again.where(F.col("z") >= significance).orderBy(*order).collect()], most_landmarks)
    if not landmarks:
        return none
    got = rows.mapInArrow(_instances(landmarks, sentences), "x array<double>, y double").collect()
    rng = random.Random(seed)
    similarity = Similarity(landmarks)
    extra = similarity.vectors([disguised(z, rng) for z in landmarks for _ in range(12)])
    x = np.vstack((np.array([r["x"] for r in got]).reshape(-1, len(landmarks)), extra))
    y = np.r_[np.array([r["y"] for r in got]), np.ones(len(extra))] * 2 - 1
    cost = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * 500
    kernel = similarity.vectors(landmarks)
    value, vector = np.linalg.eigh((kernel + kernel.T) / 2 + 1e-6 * np.eye(len(landmarks)))
    nystroem = vector / np.sqrt(np.maximum(value, 0.05))
    weights, bias = squared_hinge(x @ nystroem, y, cost)
    model = Model(landmarks, nystroem, weights, bias, none.calibration)
    told = rows.mapInArrow(_evidence(model), "label int, evidence array<double>").collect()
    return Model(landmarks, nystroem, weights, bias, logistic(np.array([r["evidence"] for r in told]), np.array([r["label"] for r in told], float), ridge=1e-2))


def _score(model: Model, threshold: float):
    evidence = _evidence(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in evidence(batches):
            score = [model.probability(e) for e in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], names=[*part.schema.names[:-1], "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, model: Model, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """``keep`` columns of ``docs`` with ``score`` (0 to 1) and ``predicted``; kept columns of these names are replaced.

    Null and empty texts, and texts without a word near a landmark whatever their length, get the one score of no
    evidence. Very long texts are read whole; repeated rows score alike; an empty table gives no rows; other columns are
    ignored.
    """
    keep = only(keep, "score", "predicted")
    kept = docs.select(F.col("text").cast("string").alias("_text"), *keep)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[1:])
    return kept.mapInArrow(_score(model, threshold), f"{schema}score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc32_mod("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    return score_toxicity(docs.withColumn("held_out", crc32_mod("doc_id", 5) == 0), fit(docs, labels), ["doc_id", "held_out"])
