"""Token ids of whole texts by a tokenizer file, with a bounded word cache per worker."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import stage
from timeloom.llm.words import slices, text_bytes

#: Words that a worker's cache holds; the older half is let go when it is full.
CACHE_WORDS = 450_000
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_WHITE, _ALNUM, _MARK = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\x0b\f\r", b"abcdefghijklmnopqrstuvwxyz0123456789", b",.;:!?"))
_encoders: dict[str, WordEncoder | TextEncoder] = {}


class TextEncoder:
    """Ids of whole texts, for tokenizers whose ids may depend on white space."""

    def __init__(self, tokenizer, path: str) -> None:
        self.tokenizer, self.path = tokenizer, path

    def ids(self, text: bytes) -> bytes:
        found = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes()

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        return [self.ids(t) for t in texts]

    def ids_of_slice(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of texts that lie one after the other in ``data``."""
        bounds = offsets.tolist()
        return self.ids_of([data[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)])


class WordEncoder(TextEncoder):
    """Ids of texts from the ids of their words, where white space only separates words.

    Words that are not in the cache are encoded many at a time: letters only words joined by
    spaces, cut after each token that ends a word. Trailing ASCII punctuation is its own run
    of tokens, so "word," is "word" and ","; the commonest are set apart before words are
    looked up, so the cache holds them once. Texts that hold a special token go as a whole.
    """

    def __init__(self, tokenizer, path: str, word_end: str) -> None:
        super().__init__(tokenizer, path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(word_end)]] = True
        self.special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, text: bytes) -> bytes:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of many texts; their new words are encoded together."""
        folded = [t.lower() for t in texts]
        out = self._ids(folded)
        # Folding may make a special token of ordinary text, so any that looks like one goes as a whole.
        for special in self.special:
            for i, text in enumerate(folded):
                if special in text:
                    out[i] = TextEncoder.ids(self, texts[i])
        return out

    def ids_of_slice(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        folded = _FOLD[data]
        whole = folded.tobytes()
        if any(special in whole for special in self.special):
            return super().ids_of_slice(data, offsets)
        # One mark between a letter or digit and the word's end is set apart.
        data, inner = folded, offsets[1:-1]
        last = np.append(_WHITE[data[1:]], True)[: len(data)]
        last[inner[inner > 0] - 1] = True
        first = np.append(False, _ALNUM[data[:-1]])[: len(data)]
        first[inner[inner < len(data)]] = False
        marks = np.flatnonzero(_MARK[data] & first & last)
        text = np.insert(data, marks, 0x20).tobytes()
        bounds = (offsets + np.searchsorted(marks, offsets)).tolist()
        return self._ids([text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() for t in texts]
        self._learn(set().union(*words))
        known = self.young.__getitem__
        return [b"".join(map(known, w)) for w in words]

    def _learn(self, words: set[bytes]) -> None:
        if len(self.young) > CACHE_WORDS // 2:
            self.old, self.young = self.young, {}
        young, known = self.young, self.old
        new = [w for w in words.difference(young) if w not in known or young.__setitem__(w, known[w])]
        plain = [w for w in new if w.isalpha()]
        rest = [w for w in new if not w.isalpha()]
        stems = {w: stem for w in rest if (stem := w.rstrip(_PUNCTUATION)) is not w and stem and _letter_or_digit(stem)}
        whole = {w for w in rest if w not in stems}
        for word, stem in stems.items():
            whole |= {stem, word[len(stem) :]}
        letters, others = plain, []
        for word in whole.difference(young, plain):
            by_letters = word.isalpha() or (not word.isascii() and word.decode("utf-8", "replace").isalpha())
            (letters if by_letters else others).append(word)
        for first in range(0, len(letters), 4096):
            self._encode_letters(letters[first : first + 4096])
        self._encode_each(others)
        for word, stem in stems.items():
            young[word] = young[stem] + young[word[len(stem) :]]

    def _encode_letters(self, words: list[bytes]) -> None:
        joined = b" ".join(words).decode("utf-8", "replace")
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(words):  # a word that folding takes apart
            self._encode_each(words)
            return
        data, begin = ids.tobytes(), 0
        for word, end in zip(words, cuts.tolist(), strict=True):
            self.young[word] = data[begin:end]
            begin = end

    def _encode_each(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        for word, found in zip(words, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            self.young[word] = np.array(found.ids, "<u4").tobytes()


def _letter_or_digit(word: bytes) -> bool:
    if word[-1] < 0x80:
        return word[-1:].isalnum()
    # Folding may take a letter apart into a letter and a mark.
    last = unicodedata.normalize("NFC", word.decode("utf-8", "replace")[-1]).lower()[-1]
    return last.isalpha() or last.isnumeric()


def encoder(path: str) -> TextEncoder:
    """The encoder of a tokenizer file; each worker loads it once."""
    if path not in _encoders:
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        word_end = getattr(tokenizer.model, "end_of_word_suffix", None)
        if word_end and tokenizer.encode(" a ", add_special_tokens=False).ids == tokenizer.encode("a", add_special_tokens=False).ids:
            _encoders[path] = WordEncoder(tokenizer, path, word_end)
        else:
            _encoders[path] = TextEncoder(tokenizer, path)
    return _encoders[path]


def _short(ids: bytes) -> bytes:
    found = np.frombuffer(ids, "<u4")
    return found.astype("<u2").tobytes() if len(found) and found.max() < 1 << 16 else ids


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int | None, short: bool = False) -> DataFrame:
    """The token ids of every row of ``docs``, written to the shared folder.

    Returns doc_id, ``ids`` (little-endian unsigned 32-bit, ``end_id`` last if given),
    ``n_ids``, ``part`` (the number of the task that read the row) and ``part_start`` (ids in
    that task before it). A null text counts as empty; a null doc_id is kept. With ``short``,
    the ids of a text have 16 bits each if they all fit.
    """
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text"):
                data, offsets = text_bytes(piece.column("text"))
                ids = [found + tail for found in encode.ids_of_slice(data, offsets)]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                if short:
                    ids = [_short(x) for x in ids]
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(ids, pa.binary()), pa.array(sizes), pa.array(np.full(len(ids), part, np.int64)), pa.array(starts)],
                    ["doc_id", "ids", "n_ids", "part", "part_start"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(slim.mapInArrow(run, "doc_id long, ids binary, n_ids long, part long, part_start long"), "tokens")
