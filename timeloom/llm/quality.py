"""Quality by supervised subword embeddings: hashed word and character n-gram vectors.

A document is the average of the vectors of its words and of its byte n-grams (2 to 4 bytes,
white space only at their ends); a word that repeats the one before it also counts as the
feature "repeat". A softmax over two outputs follows. Vectors and outputs are learned by
stochastic gradient descent in numpy. As average and outputs are linear up to the softmax,
scoring looks up one number per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.sampling import labelled_sample
from timeloom.llm.words import SPACED, slices, text_bytes, word_bounds, word_hashes

#: At most so many labelled rows of each label are learned from, each of so many characters.
ROWS_PER_LABEL, MAX_CHARS = 1500, 8192
THRESHOLD = 0.3
BUCKET_BITS, DIMENSIONS = 17, 8
_SIZES = (2, 3, 4)
_REPEAT = 0  # the bucket of the repeat feature; others may share it, as any bucket
_values = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 32, 256, np.uint32)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: buckets, which of them count, and where each text's begin."""
    shift = np.uint32(32 - BUCKET_BITS)
    blank = ~SPACED[data]
    plain = np.where(blank, np.uint8(32), data)
    rolled = _values[plain]
    counts = np.ones(len(data), bool)
    for size in range(2, max(_SIZES) + 1):
        n = len(data) - size + 1
        if n <= 0:
            break
        rolled = rolled[:n] * np.uint32(0x01000193) + _values[plain[size - 1 :]]
        if size > 2:
            counts = counts[:n] & ~blank[size - 2 : size - 2 + n]
        else:
            counts = counts[:n].copy()
        if size in _SIZES:
            whole = counts.copy()
            for back in range(1, size):  # n-grams that run over the end of a text
                at = offsets[1:-1] - back
                whole[at[(at >= 0) & (at < n)]] = False
            yield (rolled * np.uint32(0x9E3779B1)) >> shift, whole, np.minimum(offsets, n)
    starts, ends, first = word_bounds(data, offsets, SPACED)
    hashes = word_hashes(data, starts, ends)
    yield (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32), np.ones(len(hashes), bool), first
    repeat = np.zeros(len(hashes), bool)
    repeat[1:] = hashes[1:] == hashes[:-1]
    repeat[first[:-1][first[:-1] < len(hashes)]] = False
    yield np.full(len(hashes), _REPEAT, np.uint32), repeat, first


@dataclass
class QualityModel:
    """Per bucket how much it speaks for label 1, and the bias of the two outputs' difference."""

    leaning: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """The probability of label 1 of each text; a text without features has the bias alone."""
        data, offsets = text_bytes(column)
        total, count = np.zeros(len(column)), np.zeros(len(column))
        for buckets, valid, first in features(data, offsets):
            sums = np.zeros(len(buckets) + 1)
            np.cumsum(np.where(valid, self.leaning[buckets], 0), out=sums[1:])
            total += sums[first[1:]] - sums[first[:-1]]
            seen = np.zeros(len(buckets) + 1, np.int64)
            np.cumsum(valid, out=seen[1:])
            count += seen[first[1:]] - seen[first[:-1]]
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def _document(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and each one's share."""
    data, offsets = text_bytes(pa.array([text]))
    found = [b[v] for b, v, _ in features(data, offsets)]
    buckets, counts = np.unique(np.concatenate(found), return_counts=True)
    return buckets, (counts / max(1, counts.sum())).astype(np.float32)


def fit_sample(sample: list[tuple[str, int]], prior: float | None = None, epochs: int = 4, rate: float = 0.5, seed: int = 11) -> QualityModel:
    """Learn from (text, 0 or 1) rows; ``prior`` is the share of label 1 among all, if the sample's differs.

    Without rows of both labels every score is the prior (0.5 without any row).
    """
    labels = np.array([int(y) for _, y in sample])
    share = float(labels.mean()) if len(labels) else 0.5
    prior = min(max(share if prior is None else prior, 1e-3), 1 - 1e-3)
    if share in (0.0, 1.0) or not len(labels):
        return QualityModel(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log(prior / (1 - prior))))
    random = np.random.Generator(np.random.PCG64(seed))
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    outputs, bias = random.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in random.permutation(len(sample)):
            buckets, shares = _document(sample[i][0])
            rows = vectors[buckets]
            average = shares @ rows
            raw = average @ outputs + bias
            p = np.exp(raw - raw.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = outputs @ error
            outputs -= step * 0.2 * np.outer(average, error)
            bias -= step * 0.05 * error
            # The step is per unit of the average, whatever the number of features.
            vectors[buckets] = rows - step * np.outer(shares / max(float(shares @ shares), 1e-9), back)
    leaning = vectors @ (outputs[:, 1] - outputs[:, 0])
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return QualityModel(leaning.astype(np.float32), float(bias[1] - bias[0] + shift))


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL, max_chars: int = MAX_CHARS) -> QualityModel:
    """Learn from documents whose row in ``labels`` (doc_id, quality) is given; other labels are ignored."""
    known = labels.filter("quality IN (0, 1)").select("doc_id", F.col("quality").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    return fit_sample(labelled_sample(docs, known, rows_per_label, max_chars), share)


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (0 to 1) of every row; whole texts are scored.

    A null or empty text has no feature and scores by the bias; a null doc_id stays null;
    repeated rows are scored each; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                scores = shared.value.scores(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double")
