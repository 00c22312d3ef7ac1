"""Language by a byte convolutional network: multi-width filters, max pooling and softmax.

A text's UTF-8 bytes are cut into windows of a fixed length, the last one padded. Each byte
has a learned vector; filters of several widths slide over a window, each filter's largest
output is kept, and a softmax over the languages follows. A text's prediction is the mean of
its windows' log probabilities. Trained in numpy by stochastic gradient descent with
momentum on windows of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.sampling import labelled_sample
from timeloom.llm.words import slices, text_bytes

#: At most so many labelled rows of each language are learned from, each of so many characters.
ROWS_PER_LABEL, MAX_CHARS = 1000, 2048
WINDOW = 256
WIDTHS, FILTERS, DIMENSIONS = (2, 3, 4), 8, 6
BATCH = 64
UNKNOWN = "und"


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as rows of bytes, and the text of each; an empty text has none."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros((len(owner), WINDOW), np.uint8)
    # Within a text the windows' bytes follow each other, so one flat copy fills all.
    at = np.repeat((np.cumsum(counts) - counts) * WINDOW - offsets[:-1], sizes) + np.arange(len(data))
    out.reshape(-1)[at] = data
    return out, owner if len(place) else np.zeros(0, np.int64)


@dataclass
class LanguageModel:
    """Byte vectors, filters as one matrix over the widest width, and the output layer."""

    languages: list[str]
    vectors: np.ndarray
    filters: np.ndarray
    offsets: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """For every place of every window the vectors of the bytes that filters there see."""
        widest = max(WIDTHS)
        padded = np.zeros((len(windows), WINDOW + widest - 1), np.uint8)
        padded[:, :WINDOW] = windows
        looked = self.vectors[padded]
        return np.lib.stride_tricks.sliding_window_view(looked, widest, axis=1).transpose(0, 1, 3, 2).reshape(
            len(windows) * WINDOW, widest * DIMENSIONS
        )

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns, filter outputs, and each filter's largest output after the rectifier."""
        columns = self.columns(windows)
        raw = (columns @ self.filters).reshape(len(windows), WINDOW, -1)
        return columns, raw, np.maximum(raw.max(axis=1) + self.offsets, 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(windows), len(self.languages)), np.float32)
        for first in range(0, len(windows), BATCH):
            raw = self.pooled(windows[first : first + BATCH])[2] @ self.outputs + self.bias
            raw -= raw.max(axis=1, keepdims=True)
            out[first : first + BATCH] = raw - np.log(np.exp(raw).sum(axis=1, keepdims=True))
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The most probable language's number of each text, and its probability."""
        data, offsets = text_bytes(column)
        windows, owner = cut_windows(data, offsets)
        sums = np.zeros((len(column), len(self.languages)))
        np.add.at(sums, owner, self.log_probabilities(windows))
        counts = np.bincount(owner, minlength=len(column))[:, None]
        mean = sums / np.maximum(counts, 1)
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]


def fit_sample(sample: list[tuple[str, str]], epochs: int = 5, rate: float = 0.05, seed: int = 5) -> LanguageModel | None:
    """Learn from (text, language) rows; None without any row that has text."""
    rows = [(t, y) for t, y in sample if t and y is not None]
    if not rows:
        return None
    languages = sorted({y for _, y in rows})
    number = {y: i for i, y in enumerate(languages)}
    data, offsets = text_bytes(pa.array([t for t, _ in rows], pa.large_string()))
    windows, owner = cut_windows(data, offsets)
    labels = np.array([number[y] for _, y in rows])[owner]
    random = np.random.Generator(np.random.PCG64(seed))
    widest, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    seen = np.zeros((widest, DIMENSIONS, n_filters), np.float32)
    for i, width in enumerate(WIDTHS):
        seen[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
    seen = seen.reshape(widest * DIMENSIONS, n_filters)
    model = LanguageModel(
        languages,
        random.normal(0, 0.5, (256, DIMENSIONS)).astype(np.float32),
        (random.normal(0, 0.3, seen.shape) * seen).astype(np.float32),
        np.zeros(n_filters, np.float32),
        random.normal(0, 0.3, (n_filters, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    weights = [model.vectors, model.filters, model.offsets, model.outputs, model.bias]
    moving = [np.zeros_like(w) for w in weights]
    for epoch in range(epochs):
        order = random.permutation(len(windows))
        step = rate * (1 - epoch / epochs)
        for first in range(0, len(order), BATCH):
            pick = order[first : first + BATCH]
            for weight, speed, gradient in zip(weights, moving, _gradients(model, windows[pick], labels[pick], seen), strict=True):
                speed *= 0.9
                speed -= step * np.clip(gradient, -1, 1)
                weight += speed
    return model


def _gradients(model: LanguageModel, windows: np.ndarray, labels: np.ndarray, seen: np.ndarray) -> list[np.ndarray]:
    n, widest = len(windows), max(WIDTHS)
    columns, raw, pooled = model.pooled(windows)
    scores = pooled @ model.outputs + model.bias
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    error = p / p.sum(axis=1, keepdims=True)
    error[np.arange(n), labels] -= 1
    error /= n
    back = (error @ model.outputs.T) * (pooled > 0)
    # Only the place of a filter's largest output has a gradient.
    best = raw.argmax(axis=1)
    at = (np.arange(n)[:, None] * WINDOW + best).reshape(-1)
    gradient = np.zeros_like(model.filters)
    picked = columns[at].reshape(n, -1, columns.shape[1])
    gradient += np.einsum("nfc,nf->cf", picked, back)
    into = (back[:, :, None] * model.filters.T[None]).reshape(n, -1, widest, DIMENSIONS)
    places = best[:, :, None] + np.arange(widest)
    padded = np.zeros((n, WINDOW + widest), np.uint8)
    padded[:, :WINDOW] = windows
    hit = padded[np.arange(n)[:, None, None], places]
    vectors = np.zeros_like(model.vectors)
    np.add.at(vectors, hit.reshape(-1), into.reshape(-1, DIMENSIONS))
    return [vectors, gradient * seen, back.sum(axis=0), pooled.T @ error, error.sum(axis=0)]


def fit(docs: DataFrame, rows_per_label: int = ROWS_PER_LABEL, max_chars: int = MAX_CHARS) -> LanguageModel | None:
    """Learn from the rows of ``docs`` (doc_id, text, lang) whose lang is not null."""
    labels = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("lang").alias("label"))
    return fit_sample(labelled_sample(docs, labels, rows_per_label, max_chars))


def predict_documents(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row, from the whole text.

    A null text or one without any letter is ``und`` with score 0, as is every text without a
    model; a null doc_id stays null; repeated rows are predicted each; an empty table gives
    no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col("text").cast("string")
    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), has_letter.alias("has_letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                model = shared.value
                known = piece.column("has_letter").to_pylist()
                names, scores = [UNKNOWN] * len(known), [0.0] * len(known)
                if model is not None:
                    best, p = model.predict(piece.column("text"))
                    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                    scores = [float(x) if k else 0.0 for x, k in zip(p, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double")
