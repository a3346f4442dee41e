"""Quality of texts by Naive Bayes support vectors.

A text is a set of n-grams: of its characters, of its runs of character classes, and of marks that tell
whether its words repeat. Each is hashed to one of DIMENSIONS indicators. Indicators are scaled by the log ratio of
their smoothed counts in good and bad texts, texts brought to unit length, and a linear model with hinge loss is
fitted to them by dual coordinate descent. A logistic curve over the margins of folds that a model has not seen
turns margins into scores.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from attest.llm.common import plain_names, text_batches, written

DIMENSIONS = 1 << 17
MOST_TEXTS = 8_000
LONGEST_GRAM = 3
LONGEST_CLASS_GRAM = 6
FOLDS = 3
SCORE = "quality_score"

_LETTERS = "LU"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _class_of(code: int) -> int:
    """0 white space, 1 lower or uncased letter, 2 upper-case letter, 3 digit, 4 end of a sentence, 5 other sign."""
    char = chr(code)
    if char.isspace():
        return 0
    kind = unicodedata.category(char)
    if kind[0] in "LM":
        return 2 if kind in ("Lu", "Lt") else 1
    if kind[0] == "N":
        return 3
    return 4 if char in ".,;:?!" else 5


_ASCII_CLASSES = np.array([_class_of(c) for c in range(256)], np.uint8)


def _classes(codes: np.ndarray) -> np.ndarray:
    out = _ASCII_CLASSES[np.minimum(codes, 255)]
    far = codes > 255
    if far.any():
        kinds, at = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([_class_of(int(c)) for c in kinds], np.uint8)[at]
    return out


def _grams(symbols: np.ndarray, longest: int, family: int) -> list[np.ndarray]:
    """Buckets of all n-grams of a sequence, n = 1 to `longest`."""
    out, key = [], np.full(len(symbols), family, np.uint64)
    symbols = symbols.astype(np.uint64)
    for n in range(1, min(longest, len(symbols)) + 1):
        key = (key[: len(symbols) - n + 1] + symbols[n - 1 :] + np.uint64(1)) * _MIX
        key ^= key >> np.uint64(29)
        out.append((key >> np.uint64(40)).astype(np.int64) % DIMENSIONS)
    return out


class Buckets:
    """The indicators of a text, as sorted distinct bucket numbers. Whole texts; one flag array for each worker."""

    def __init__(self):
        self._flags = np.zeros(DIMENSIONS, np.uint8)

    def __call__(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _classes(codes)
        runs = kinds[np.concatenate(([True], kinds[1:] != kinds[:-1]))] if len(kinds) else kinds
        found = [*_grams(codes, LONGEST_GRAM, 1), *_grams(runs, LONGEST_CLASS_GRAM, 2)]
        numbers: dict[str, int] = {}
        words = np.array([numbers.setdefault(w, len(numbers)) for w in text.split()], np.int64)
        if len(words):
            pairs = words[:-1] * len(numbers) + words[1:]
            again = (words[1:] == words[:-1]).astype(np.uint8)
            share = [8 * len(numbers) // len(words), 8 * len(np.unique(pairs)) // max(1, len(pairs)), min(12, len(words)).bit_length()]
            found += _grams(again, 3, 3)
            found += [_grams(np.array([s], np.uint8), 1, 4 + i)[0] for i, s in enumerate(share)]
        for f in found:
            self._flags[f] = 1
        out = np.flatnonzero(self._flags)
        self._flags[out] = 0
        return out


def log_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Log of the ratio of smoothed shares of each indicator among good and bad texts."""
    counts = []
    for side in (good, ~good):
        chosen = [r for r, c in zip(rows, side) if c]
        n = np.bincount(np.concatenate(chosen), minlength=DIMENSIONS).astype(float) if chosen else np.zeros(DIMENSIONS)
        n += 1
        counts.append(np.log(n / n.sum()))
    return counts[0] - counts[1]


def dual_coordinate_descent(rows: list[np.ndarray], good: np.ndarray, ratios: np.ndarray, cost: float = 1.0, passes: int = 40,
                            least: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and constant of the hinge-loss model over ratio-scaled indicators of unit length.

    Each class has the same total cost. Passes visit the texts in a seeded random order and end when no dual variable
    has a projected gradient beyond `least`.
    """
    y = np.where(good, 1.0, -1.0)
    shares = {True: max(1, int(good.sum())), False: max(1, int((~good).sum()))}
    most = np.array([cost * len(rows) / (2 * shares[bool(g)]) for g in good])
    values = []
    for r in rows:
        v = ratios[r]
        norm = np.sqrt(v @ v)
        values.append(v / norm if norm else v)
    squares = np.array([v @ v for v in values]) + 1.0
    weights, constant, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    order, rng = np.arange(len(rows)), np.random.default_rng(0)
    for _ in range(passes):
        rng.shuffle(order)
        worst = 0.0
        for i in order:
            gradient = y[i] * (values[i] @ weights[rows[i]] + constant) - 1
            old = alpha[i]
            projected = min(gradient, 0.0) if old <= 0 else max(gradient, 0.0) if old >= most[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                alpha[i] = min(max(old - gradient / squares[i], 0.0), most[i])
                step = (alpha[i] - old) * y[i]
                weights[rows[i]] += step * values[i]
                constant += step
        if worst < least:
            break
    return weights, constant


def margins(rows: list[np.ndarray], ratios: np.ndarray, weights: np.ndarray, constant: float) -> np.ndarray:
    out = []
    for r in rows:
        v = ratios[r]
        norm = np.sqrt(v @ v)
        out.append(v @ weights[r] / norm + constant if norm else constant)
    return np.array(out)


def _curve(m: np.ndarray, good: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and constant of a logistic curve over margins, fitted to softened labels by Newton's method."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.column_stack((m, np.ones(len(m)))), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (target - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-6), float(w[1])


@dataclass(frozen=True)
class Model:
    """Weights of buckets with the log ratios, the constant of the margin, and the curve from margins to scores."""

    ratios: np.ndarray
    weights: np.ndarray
    constant: float
    curve: tuple[float, float]

    def score(self, row: np.ndarray) -> float:
        m = margins([row], self.ratios, self.weights, self.constant)[0]
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * m + self.curve[1], -30, 30))))


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """The model of these texts; the curve comes from the margins of FOLDS models, each over the fold it has not seen.

    Without texts of both classes all scores are the same: the smoothed share of good texts.
    """
    if not good.any() or good.all():
        share = (good.sum() + 1) / (len(good) + 2)
        return Model(np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, (1e-6, float(np.log(share / (1 - share)))))
    fold = np.empty(len(rows), int)
    for side in (good, ~good):
        fold[side] = np.arange(side.sum()) % FOLDS
    unseen, seen_by = np.zeros(len(rows)), np.zeros(len(rows), bool)
    for f in range(FOLDS):
        held = fold == f
        if not good[~held].any() or good[~held].all():
            continue
        part = [r for r, h in zip(rows, held) if not h]
        ratios = log_ratios(part, good[~held])
        unseen[held] = margins([r for r, h in zip(rows, held) if h], ratios, *dual_coordinate_descent(part, good[~held], ratios))
        seen_by |= held
    ratios = log_ratios(rows, good)
    weights, constant = dual_coordinate_descent(rows, good, ratios)
    if not (good[seen_by].any() and (~good[seen_by]).any()):
        unseen, seen_by = margins(rows, ratios, weights, constant), np.ones(len(rows), bool)
    return Model(ratios, weights, constant, _curve(unseen[seen_by], good[seen_by]))


def learn(documents: DataFrame, labels: DataFrame, most_texts: int = MOST_TEXTS) -> Model:
    """Learns from `labels` (doc_id, quality) over a bounded sample: at most `most_texts` texts of either class, chosen by
    a hash of doc_id. Indicators are made where the texts lie; one task fits the model, which is of fixed size.

    Labels other than 0 and 1 are passed over, and so are ids with both labels and labels without a row; a null text is an empty
    one. Rows that repeat a doc_id count as one text each, and do not raise the bound by more than their number.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    marks = marks.filter("quality = other").drop("other")
    sides = [marks.filter(F.col("quality") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_texts) for side in (0, 1)]
    chosen = written(sides[0].unionByName(sides[1]), "quality-sample")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def featured(batches):
        buckets = Buckets()
        for batch, texts in text_batches(batches):
            found = [buckets(t).astype(np.int32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary())], names=["doc_id", "quality", "buckets"])

    def fitted(batches):
        held = [(d, q, b) for batch in batches for d, q, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "quality", "buckets")))]
        held.sort()
        model = fit([np.frombuffer(b, np.int32) for _, _, b in held], np.array([q == 1 for _, q, _ in held], bool))
        numbers = np.array([model.constant, *model.curve])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.ratios, model.weights, numbers)], names=["ratios", "weights", "numbers"])

    rows = docs.join(F.broadcast(chosen), "doc_id").mapInArrow(featured, "doc_id long, quality int, buckets binary")
    model = rows.repartition(1).mapInArrow(fitted, "ratios binary, weights binary, numbers binary").collect()
    if not model:
        return fit([], np.zeros(0, bool))
    ratios, weights, numbers = (np.frombuffer(bytes(model[0][c])) for c in ("ratios", "weights", "numbers"))
    return Model(ratios, weights, float(numbers[0]), (float(numbers[1]), float(numbers[2])))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Scores every whole text: all columns of `documents`, and SCORE (0 to 1), which replaces a column of that name.

    Only `text` is an input. Null texts are read as empty, and empty texts get the score of a text without indicators.
    Equal texts have equal scores; an empty table gives an empty one.
    """
    documents = documents.drop(SCORE)

    def task(batches):
        buckets = Buckets()
        for batch, texts in text_batches(batches):
            out = [model.score(buckets(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*names, SCORE])

    names = documents.columns
    return plain_names(documents, "text").mapInArrow(task, StructType([*documents.schema.fields, StructField(SCORE, DoubleType())]))
