"""Words of many texts at once: UTF-8 bytes of an Arrow column, word bounds, 64-bit word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass works on; a longer single text is its own pass.
SLICE_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of anything but space and the controls 0x09 to 0x0D.
SPACED = ~_WHITE
#: Words are runs of digits, Latin letters and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
ALPHANUMERIC[0x80:] = True

_FOLD = np.arange(256)
_FOLD[0x41:0x5B] += 0x20
_random = np.random.Generator(np.random.PCG64(20_240_607))
#: A random value per byte; folded, the same for A and a.
_PLAIN_VALUES = _random.integers(1, 1 << 63, 256, np.uint64)
_BYTE_VALUES = _PLAIN_VALUES[_FOLD]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers.get("up") is None or len(_powers["up"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts together hold about ``limit`` bytes, in order."""
    limit = limit or SLICE_BYTES
    _, offsets = text_bytes(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and for each text the position of its first word.

    The third array has one entry more than there are texts.
    """
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = word_byte[data]
    begins, ends = inside.copy(), np.zeros(len(data) + 1, bool)
    begins[1:] &= ~inside[:-1]
    ends[1:] = inside[:-1] & ~inside[1:]
    # A word ends with its text, also when the next text goes on with a word.
    inner = offsets[1:-1]
    begins[inner] = inside[inner]
    after = inner[inner > 0]
    ends[after] = inside[after - 1]
    starts = np.flatnonzero(begins[:-1])
    return starts, np.flatnonzero(ends), np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, by default after folding A-Z: a polynomial over random byte values."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_VALUES if fold else _PLAIN_VALUES)[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])
