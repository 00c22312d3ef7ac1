"""Periodic runs of words, by a sparse dynamic program over the diagonals of a text against itself.

A diagonal is a lag: its match length at a word is how many words up to there equal the word
one lag before. Each word's earlier occurrences lengthen their lags' matches, all other
diagonals end, and one that ends long enough gives out its run. Two facts keep the
occurrences few and the result exact:

- A run with period q and at least 4 q words (6, if that is more) matches at lag q for at
  least 3 q words. For lags from a to below 3 a only occurrences that share the last 3 a
  words (5 for a = 1) can belong to such a run.
- Within a run the nearest of these is q words before: a nearer one would, as 3 a >= q, give
  the run a smaller period (Fine and Wilf). So each word lengthens at most one diagonal
  for each band of lags, and the lag of a long diagonal is a smallest period.

Bands grow by a factor of three, so a text of n words takes of the order of n log n steps,
also if it says one word only. Most texts drop out in the first band: words that repeat no
five words are not looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.words import SPACED, slices, text_bytes, word_bounds, word_hashes

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_KINDS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Grams:
    """Which places of a row of numbers begin equal stretches; a stretch that occurs once is not kept."""

    def __init__(self, numbers: np.ndarray) -> None:
        """``numbers`` are at least 0 and below the greatest 31-bit number."""
        self.places, self.ranks, self.size, self.length = np.arange(len(numbers)), numbers, 1, len(numbers)
        self._keep_repeated()

    def _keep_repeated(self) -> None:
        ranks, number, counts = np.unique(self.ranks, return_inverse=True, return_counts=True)
        repeated = counts[number] > 1
        self.places, self.ranks = self.places[repeated], number[repeated]

    def grow(self, size: int) -> None:
        """To stretches of ``size`` words, at most twice as many as before."""
        shift = size - self.size
        held = np.full(self.length + shift, -1, np.int64)
        held[self.places] = self.ranks
        second = held[self.places + shift]
        both = second >= 0
        self.places = self.places[both]
        self.ranks = self.ranks[both] * (int(second.max(initial=0)) + 1) + second[both]
        self.size = size
        self._keep_repeated()

    def grow_to(self, size: int) -> None:
        while self.size < size and len(self.places):
            self.grow(min(size, 2 * self.size))

    def lags(self) -> tuple[np.ndarray, np.ndarray]:
        """The places whose stretch occurred before, in order, and how far before the nearest began."""
        order = np.argsort(self.ranks, kind="stable")
        ranks, places = self.ranks[order], self.places[order]
        again = np.flatnonzero(ranks[1:] == ranks[:-1]) + 1
        lag = np.zeros(self.length, np.int64)
        lag[places[again]] = places[again] - places[again - 1]
        found = np.flatnonzero(lag)
        return found, lag[found]


def runs_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run in a row of numbers, ordered by start, then period."""
    grams, band, found = Grams(numbers), 1, [np.zeros((3, 0), np.int64)]
    while len(grams.places) and LEAST_PERIODS * band <= len(numbers):
        # A diagonal of the band's least lag that is long enough matches for this many words.
        grams.grow_to(max(LEAST_WORDS, LEAST_PERIODS * band) - band)
        places, lag = grams.lags()
        inside = (lag >= band) & (lag < 3 * band)
        places, lag = places[inside], lag[inside]
        if len(places):
            # A diagonal goes on while the next word matches at the same lag, and ends else.
            ends = np.append((np.diff(places) != 1) | (np.diff(lag) != 0), True)
            last = np.flatnonzero(ends)
            first = np.append(0, last[:-1] + 1)
            period = lag[last]
            start = places[first] - period
            length = places[last] + grams.size - start
            enough = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            found.append(np.stack([start, length, period])[:, enough])
        band *= 3
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def find_in_texts(column: pa.Array) -> list[pa.Array]:
    """Per text: its number of words, its runs, and the text with each run cut to its first period."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_bounds(data, offsets, SPACED)
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(n_words)), n_words)
    # A word is a number within its text, and each text ends with a number of its own.
    words, number = np.unique(word_hashes(data, starts, ends, fold=False), return_inverse=True)
    numbers = np.unique(text * max(len(words), 1) + number, return_inverse=True)[1]
    closed = np.insert(numbers, first[1:], np.arange(len(n_words)) + len(numbers))
    begin = first[:-1] + np.arange(len(n_words))
    start, length, period = runs_of(closed)
    owner = np.searchsorted(begin, start, "right") - 1
    steps = np.zeros(len(numbers) + 1, np.int64)
    place = start - owner  # among all words, without the texts' ends
    np.add.at(steps, place + period, 1)
    np.add.at(steps, place + length, -1)
    kept = np.cumsum(steps[:-1]) == 0
    columns = [pa.array(x, pa.int64()) for x in (start - begin[owner], length, period)]
    bounds = np.searchsorted(owner, np.arange(len(n_words) + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
    return [pa.array(n_words, pa.int64()), runs, _joined(data, starts[kept], ends[kept], text[kept], len(n_words))]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n: int) -> pa.Array:
    """The words of each of ``n`` texts, joined by one space."""
    inner = np.zeros(len(text), bool)
    inner[1:] = text[1:] == text[:-1]
    sizes = ends - starts + inner
    after = np.cumsum(sizes)
    out = data[np.repeat(ends - after, sizes) + np.arange(after[-1] if len(after) else 0)]
    out[(after - sizes)[inner]] = 0x20
    bounds = np.concatenate([[0], after])[np.searchsorted(text, np.arange(n + 1))]
    return pa.StringArray.from_buffers(n, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, collapsed.

    Reads doc_id and text; other columns are ignored. Words are runs without white space
    (space and the controls 0x09 to 0x0D), upper and lower case differ, and are compared as 64-bit hashes. ``runs``
    lists every stretch of words with smallest period q and at least max(6, 4 q) words that no neighbouring word
    extends, as (start, length, period) by start, then period. ``collapsed`` is the text without the
    words that some run contains after its first period, joined by one space.
    A null or empty text has no words, no runs and an empty text; a row without doc_id stays;
    repeated rows count each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                found = find_in_texts(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *found], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _KINDS)


def digest_rows(found: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the one of most periods, and digests."""
    run = "struct<start: bigint, length: bigint, period: bigint>"
    # Of equal shares the first in order stays.
    best = F.aggregate(
        "runs",
        F.lit(None).cast(run),
        lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top),
    )
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.*",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
