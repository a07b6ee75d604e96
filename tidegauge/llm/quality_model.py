"""A quality classifier: a linear support vector machine over n-gram indicators scaled by naive Bayes.

A text's features are which hashed n-grams it has: one and two words, and one to three word shapes
(letters, capitals, digits and marks of a word, and whether it repeats the word before). The class
counts of every feature come from all labelled rows; their log ratio scales the indicators. On a
bounded sample of labelled rows, dual coordinate descent fits the hinge loss, and a logistic curve
over margins of rows left out of the fit turns margins into scores. Everything else covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

DIMENSIONS = 1 << 18
SAMPLE_ROWS = 4096
BROADCAST_ROWS = 1 << 20
THRESHOLD = 0.3
FOLDS = 5
SMOOTHING = 1.0
PENALTY = 1.0
EPOCHS = 10

_KNOWN_WORDS = 1 << 18
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_LETTERS, _DIGITS, _MARKS = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"),
                             re.compile(r"([^\w])\1+"))


def _letters(run: str) -> str:
    return "x" if run.islower() else "X" if run.isupper() else "Xx" if run[0].isupper() else "xX"


def shape(word: str) -> str:
    """The kinds of characters of a word, runs as one: marks stay themselves, at most two in a row."""
    if word.isalpha():
        return _letters(word)
    if word[-1] in ".,;" and word[:-1].isalpha():
        return _letters(word[:-1]) + word[-1]
    kinds = _DIGITS.sub("9", _LETTERS.sub(lambda m: _letters(m[0]), word))
    return _MARKS.sub(r"\1\1", kinds)[:12]


class Words:
    """Hashes of the words met so far, without case, and of their shapes; bounded."""

    def __init__(self) -> None:
        self._numbers: dict[bytes, int] = {}
        self._hashes = np.zeros((2, 1 << 12), np.uint64)
        self._seen = np.zeros(DIMENSIONS, bool)

    def _learn(self, words: list[bytes]) -> None:
        if len(self._numbers) > _KNOWN_WORDS:
            self._numbers.clear()
        for data in dict.fromkeys(words):
            if data in self._numbers:
                continue
            n = len(self._numbers)
            if n == self._hashes.shape[1]:
                self._hashes = np.concatenate([self._hashes, np.zeros_like(self._hashes)], axis=1)
            text = data.decode("utf-8", "surrogatepass")
            self._hashes[0, n] = xxhash.xxh64_intdigest(text.lower().encode("utf-8", "surrogatepass"))
            self._hashes[1, n] = xxhash.xxh64_intdigest(shape(text).encode("utf-8", "surrogatepass"),
                                                        1)
            self._numbers[data] = n

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        numbers = list(map(self._numbers.get, words))
        if None in numbers:
            self._learn(words)
            numbers = list(map(self._numbers.get, words))
        plain, kinds = self._hashes[:, np.array(numbers, np.int64)]
        return plain, kinds

    def distinct(self, slots: np.ndarray) -> np.ndarray:
        self._seen[slots] = True
        out = np.flatnonzero(self._seen)
        self._seen[out] = False
        return out


_words = Words()


def features(text: str | None) -> np.ndarray:
    """Numbers of the n-grams a text has, each once; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    plain, kinds = _words.hashes(words)
    kinds[1:][plain[1:] == plain[:-1]] = np.uint64(1)  # a word again, whatever its shape
    a, b, c = _MIX
    grams = [plain, kinds * a]
    if n > 1:
        grams += [plain[:-1] * b + plain[1:] * c, kinds[:-1] * b + kinds[1:] * a]
    if n > 2:
        grams.append(kinds[:-2] * c + kinds[1:-1] * a + kinds[2:] * b)
    mixed = np.concatenate(grams)
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[1]
    return _words.distinct((mixed >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64))


@dataclass(frozen=True)
class Model:
    """``ratios`` scale the indicators, ``weights`` are of the scaled ones, the last is the bias."""
    ratios: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        values = self.ratios[found]
        norm = float(np.sqrt(values @ values)) or 1.0
        return float(values @ self.weights[found]) / norm + float(self.weights[-1])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(
            self.slope * self.margin(features(text)) + self.offset, -30, 30))))


def log_count_ratios(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of each feature's share among the features of class 1 and of class 0."""
    p = smoothing + counts[:, 1].astype(float)
    q = smoothing + counts[:, 0].astype(float)
    return np.log((p / p.sum()) / (q / q.sum()))


def hinge_weights(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray,
                  penalty: float = PENALTY, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Dual coordinate descent for the L1 hinge loss; both classes weigh the same in total."""
    signs = np.where(labels == 1, 1.0, -1.0)
    share = np.maximum([np.sum(signs < 0), np.sum(signs > 0)], 1)
    limit = penalty * len(signs) / (2 * share[(signs > 0).astype(int)])
    scaled = []
    for found in rows:
        values = ratios[found]
        scaled.append(values / (np.sqrt(values @ values) or 1.0))
    squares = np.array([v @ v + 1.0 for v in scaled])
    weights = np.zeros(len(ratios) + 1)
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            found, values = rows[i], scaled[i]
            gradient = signs[i] * (weights[found] @ values + weights[-1]) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), limit[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[found] += step * values
                weights[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, by Newton steps, slightly regularized."""
    slope, offset = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        w = p * (1 - p)
        g = np.array([(p - labels) @ margins + 1e-2 * slope, np.sum(p - labels) + 1e-2 * offset])
        h = np.array([[w @ margins**2 + 1e-2, w @ margins], [w @ margins, w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(slope, 1e-3)), float(offset)


def fit(rows: list[np.ndarray], labels: np.ndarray, counts: np.ndarray) -> Model:
    """The model of a sample of feature rows and the class counts of all labelled rows."""
    ratios = log_count_ratios(counts)
    if len(set(labels.tolist())) < 2:  # one class or none: the score is its share
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(ratios, np.zeros(len(ratios) + 1), 1.0,
                     float(np.log((share + 0.01) / (1.01 - share))))
    held = np.arange(len(rows)) % FOLDS == 0
    fitted = Model(ratios, hinge_weights([r for r, h in zip(rows, held) if not h],
                                         labels[~held], ratios), 1.0, 0.0)
    margins = np.array([fitted.margin(r) for r, h in zip(rows, held) if h])
    slope, offset = logistic_curve(margins, labels[held].astype(float))
    return Model(ratios, hinge_weights(rows, labels, ratios), slope, offset)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a NULL id is among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled documents that are not held out.

    Of repeated labels of a document the more frequent counts (a tie: 1), NULL labels do not. The
    fit reads ``sample_rows`` labelled rows, spread by a hash of the id; the class counts read all.
    """
    known = (labels.filter(~held_out(F.col("doc_id")) & F.col(label).isNotNull())
             .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label")))
    texts = docs.select(F.col("doc_id"), F.col("text"))
    whole = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((DIMENSIONS, 2), np.int64)
        for batch in batches:
            for text, y in zip(batch["text"], batch["label"]):
                total[features(text), int(y)] += 1
        seen = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"feature": seen, "n0": total[seen, 0], "n1": total[seen, 1]})

    rows = (texts.join(whole, "doc_id").select("text", "label")
            .mapInPandas(count, "feature int, n0 long, n1 long")
            .groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas())
    counts = np.zeros((DIMENSIONS, 2), np.int64)
    counts[rows["feature"].to_numpy(np.int64)] = rows[["n0", "n1"]].to_numpy(np.int64)

    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = texts.join(F.broadcast(chosen), "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "found": [
                features(t).astype("<i4").tobytes() for t in batch["text"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [b for b in batches if len(b)]
        table = (pd.concat(found).sort_values(["doc_id", "found"]) if found
                 else pd.DataFrame({"found": [], "label": []}))
        order = np.random.default_rng(1).permutation(len(table))
        table = table.iloc[order]
        model = fit([np.frombuffer(f, "<i4").astype(np.int64) for f in table["found"]],
                    table["label"].to_numpy(np.int64), shared.value)
        yield pd.DataFrame({"weights": [model.weights.astype("<f8").tobytes()],
                            "slope": [model.slope], "offset": [model.offset]})

    # The sample is bounded, so one task can hold it; the model is one row.
    row = (sample.mapInPandas(spell, "doc_id long, label int, found binary").repartition(1)
           .mapInPandas(learn, "weights binary, slope double, offset double").collect())
    if not row:
        return fit([], np.zeros(0, np.int64), counts)
    return Model(log_count_ratios(counts), np.frombuffer(row[0].weights, "<f8"), row[0].slope,
                 row[0].offset)


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD,
           prefix: str = "") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: class 1 likelier) and ``predicted``.

    ``docs`` has the column text; others pass through unread, and ``prefix`` keeps the new names off
    theirs. NULL, empty and wordless texts get the score of the bias alone. Repeated rows repeat; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return (docs.withColumn(f"{prefix}score", score(F.col("text")))
            .withColumn(f"{prefix}predicted",
                        (F.col(f"{prefix}score") >= threshold).cast("int")))
