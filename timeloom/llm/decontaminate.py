"""Benchmark decontamination with suffix arrays over the training texts.

The words of each shard of training text (a run of whole documents of about a million
bytes) are numbered by the benchmark's vocabulary, and the shard's word suffixes are sorted.
Suffixes whose first words occur nowhere in the benchmark cannot match and stay out. Every
benchmark suffix that begins a window is then searched in the sorted suffixes by two
binary searches, which bound all its occurrences; occurrences that go on from one window to
the next make one longest match. The benchmark's windows are the only data sent to tasks:
items are dealt into blocks of a bounded size, and each block is a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.llm.common import stage
from timeloom.llm.words import ALPHANUMERIC, mix, slices, text_bytes, word_bounds, word_hashes

WINDOW = 10
#: Bytes of benchmark text whose index one task holds.
BLOCK_BYTES = 2 << 20
#: Words that a training suffix must share with some window to enter the array.
HEAD = 2

_ITEMS = "array<struct<item_id: long, doc_word: long, item_word: long, n_words: long>>"
_FOUND = f"n_words long, hits array<struct<begin: long, end: long>>, items array<string>, matches {_ITEMS}"


@dataclass
class Windows:
    """The distinct windows of a block of items, as word numbers from 1."""

    vocabulary: np.ndarray  # sorted word hashes; number = place + 1
    words: np.ndarray  # all windows' words, one row each, 0 beyond a short window
    lengths: np.ndarray
    owners: list[list[tuple[int | None, int, int]]]  # per window: (item_id, item row, first word)
    heads: np.ndarray  # sorted hashes of the windows' first words
    head: int  # how many words a head has
    seen: np.ndarray  # which low bits the vocabulary's hashes have


def index_windows(items: list[tuple[int | None, str | None]], window: int) -> Windows | None:
    """The index of a block of items; None if no item has a word."""
    batch = pa.array([t for _, t in items], pa.string())
    data, offsets = text_bytes(batch)
    starts, ends, first = word_bounds(data, offsets, ALPHANUMERIC)
    hashes = word_hashes(data, starts, ends)
    vocabulary, numbers = np.unique(hashes, return_inverse=True)
    found: dict[tuple[int, ...], list[tuple[int | None, int, int]]] = {}
    numbers = numbers + 1
    for row, (item_id, _) in enumerate(items):
        words = numbers[first[row] : first[row + 1]].tolist()
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            found.setdefault(tuple(words[i : i + size]), []).append((item_id, row, i))
    if not found:
        return None
    order = sorted(found)
    lengths = np.array([len(w) for w in order])
    table = np.zeros((len(order), window), np.int32)
    for i, words in enumerate(order):
        table[i, : len(words)] = words
    head = min(HEAD, int(lengths.min()))
    seen = np.zeros(1 << 16, bool)
    seen[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    return Windows(vocabulary, table, lengths, [found[w] for w in order], np.unique(_heads(table[:, :head])), head, seen)


def _heads(words: np.ndarray) -> np.ndarray:
    key = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        key = mix(key * np.uint64(3) + words[:, i].astype(np.uint64) + np.uint64(1))
    return key


def _numbers(hashes: np.ndarray, index: Windows) -> np.ndarray:
    """Each word's number in the benchmark's vocabulary, or 0."""
    out = np.zeros(len(hashes), np.int32)
    maybe = np.flatnonzero(index.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.searchsorted(index.vocabulary, hashes[maybe])
    at[at == len(index.vocabulary)] = 0
    same = index.vocabulary[at] == hashes[maybe]
    out[maybe[same]] = at[same] + 1
    return out


def suffix_array(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the suffixes of ``words`` that begin there, to ``depth`` words.

    ``words`` has at least ``depth`` zeros behind its last place. Sorts by a few words at a
    time, and goes on only within groups that are still equal.
    """
    order, group, live = places.copy(), np.zeros(len(places), np.int64), np.arange(len(places))
    step = 2
    for level in range(0, depth, step):
        if not len(live):
            break
        at = order[live] + level
        key = words[at].astype(np.int64) << 32
        if level + 1 < depth:
            key |= words[at + 1]
        by = np.lexsort((key, group[live]))
        order[live], key = order[live][by], key[by]
        owner = group[live]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
        # A group is named by the place in the array where it begins.
        group[live] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))]
        alone = fresh & np.append(fresh[1:], True)
        live = live[~alone]
    return order


def search(words: np.ndarray, array: np.ndarray, index: Windows, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted window, where its occurrences begin and end in the suffix array."""
    bounds = []
    for upper in (False, True):
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(array), np.int64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            sign = _compare(words, array[middle], index, wanted[open_])
            right = sign <= 0 if upper else sign < 0
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
            open_ = open_[low[open_] < high[open_]]
        bounds.append(low)
    return bounds[0], bounds[1]


def _compare(words: np.ndarray, places: np.ndarray, index: Windows, wanted: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the suffix at each place is before, at or after its window."""
    sign, equal = np.zeros(len(places), np.int8), np.arange(len(places))
    for k in range(index.words.shape[1]):
        equal = equal[index.lengths[wanted[equal]] > k]
        if not len(equal):
            break
        left, right = words[places[equal] + k], index.words[wanted[equal], k]
        sign[equal] = np.sign(left - right)
        equal = equal[left == right]
    return sign


def find_in_shard(column: pa.Array, index: Windows) -> tuple[list[int], list[list], list[list], list[list]]:
    """Per text: its words, hit spans, item keys, and longest matches (item_id, word, item word, words)."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_bounds(data, offsets, ALPHANUMERIC)
    n_words = np.diff(first)
    window = index.words.shape[1]
    # A zero behind each text, and enough behind the last, keeps matches within a text.
    numbers = np.insert(_numbers(word_hashes(data, starts, ends), index), first[1:], 0)
    numbers = np.concatenate([numbers, np.zeros(window + HEAD, np.int32)])
    begin = first[:-1] + np.arange(len(n_words))
    hits: list[list] = [[] for _ in n_words]
    items: list[list] = [[] for _ in n_words]
    matches: list[list] = [[] for _ in n_words]
    places = np.flatnonzero(numbers)
    for k in range(1, index.head):
        places = places[numbers[places + k] > 0]
    if len(places):
        keys = _heads(np.stack([numbers[places + k] for k in range(index.head)], axis=1))
        known = np.isin(keys, index.heads)
        places, keys = places[known], np.unique(keys[known])
        wanted = np.flatnonzero(np.isin(_heads(index.words[:, : index.head]), keys))
        array = suffix_array(numbers, places, window)
        low, high = search(numbers, array, index, wanted)
        hit = np.flatnonzero(high > low)
        if len(hit):
            repeats = (high - low)[hit]
            which = np.repeat(wanted[hit], repeats)
            within = np.arange(len(which)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
            at = array[np.repeat(low[hit], repeats) + within]
            _collect(at, which, begin, index, hits, items, matches)
    return n_words.tolist(), hits, items, matches


def _collect(at, which, begin, index, hits, items, matches) -> None:
    order = np.argsort(at, kind="stable")
    at, which = at[order], which[order]
    text = np.searchsorted(begin, at, "right") - 1
    word, size = at - begin[text], index.lengths[which]
    for t, w, n in zip(text.tolist(), word.tolist(), size.tolist(), strict=True):
        spans = hits[t]
        if spans and w <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], w + n)
        else:
            spans.append({"begin": w, "end": w + n})
    # Windows of one item that follow each other in the text make one longest match.
    running: dict[tuple[int, int, int], dict] = {}
    named: list[dict] = [{} for _ in begin]
    for t, w, n, j in zip(text.tolist(), word.tolist(), size.tolist(), which.tolist(), strict=True):
        for item_id, row, i in index.owners[j]:
            named[t][row] = item_id
            match = running.get((t, row, w - i))
            if match and match["doc_word"] + match["n_words"] == w + n - 1:
                match["n_words"] += 1
            else:
                match = {"item_id": item_id, "doc_word": w, "item_word": i, "n_words": n}
                running[t, row, w - i] = match
                matches[t].append(match)
    for t, found in enumerate(named):
        items[t] = sorted(f"{row}:{'' if item is None else item}" for row, item in found.items())


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, only_clean: bool = False) -> DataFrame:
    """Where benchmark text occurs in documents.

    Reads doc_id and text of ``docs``, item_id and text of ``benchmark``. A word is a run of
    digits, Latin letters (A-Z folded) and characters beyond ASCII. A window is ``window``
    consecutive words of an item, or all words of a shorter one. Returns one row per row of
    ``docs``: doc_id, n_words, n_hit (words inside any occurrence of a window), items (the
    distinct ids of items with occurring windows), and matches: the longest verbatim ones as
    (item_id, doc_word, item_word, n_words), for each row of ``benchmark``.
    Null or empty texts have no words and no hit; null ids stay null (items without id count
    once, as a null entry in items); repeated rows of ``docs`` count each, repeated item ids
    once; an empty benchmark hits nothing; other columns are ignored.
    With ``only_clean`` the rows of ``docs`` without a hit, with all their columns, instead.
    """
    blocks = _item_blocks(benchmark)
    if only_clean:
        for block in blocks:
            docs = _clean_rows(docs, block, window)
        return docs
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(blocks) <= 1:
        found = _one_pass(slim, blocks[0] if blocks else [], window)
    else:
        found = _several_passes(slim, blocks, window)
    size = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    ids = F.array_distinct(F.transform("items", lambda i: F.nullif(F.element_at(F.split(i, ":"), -1), F.lit(""))))
    return found.select("doc_id", "n_words", size.alias("n_hit"), ids.alias("items"), "matches")


def _item_blocks(benchmark: DataFrame) -> list[list[tuple[int | None, str | None]]]:
    """The items in blocks of a bounded size each; the driver holds the benchmark, not the corpus."""
    blocks, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        if not blocks or size > BLOCK_BYTES:
            blocks.append([])
            size = 0
        blocks[-1].append((item_id, text))
        size += len(text or "")
    return blocks


def _one_pass(docs: DataFrame, items: list, window: int) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(index_windows(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield _rows(piece, index.value, window)

    others = [f for f in docs.schema.fields if f.name != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return docs.mapInArrow(run, f"{kinds}, {_FOUND}")


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_MATCHES = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "doc_word", "item_word", "n_words")]))


def _rows(piece: pa.RecordBatch, index: Windows | None, window: int) -> pa.RecordBatch:
    column = piece.column("text")
    if index is None:
        data, offsets = text_bytes(column)
        first = word_bounds(data, offsets, ALPHANUMERIC)[2]
        none: list[list] = [[] for _ in range(len(column))]
        found = (np.diff(first).tolist(), none, none, none)
    else:
        found = find_in_shard(column, index)
    kept = [(n, piece.column(n)) for n in piece.schema.names if n != "text"]
    made = zip(("n_words", "hits", "items", "matches"), found, (pa.int64(), _SPANS, pa.list_(pa.string()), _MATCHES), strict=True)
    columns = kept + [(n, pa.array(v, t)) for n, v, t in made]
    return pa.RecordBatch.from_arrays([c for _, c in columns], [n for n, _ in columns])


def _several_passes(docs: DataFrame, blocks: list, window: int) -> DataFrame:
    """One pass per block; a row's spans from all passes are united."""
    numbered = stage(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    passes = None
    for number, block in enumerate(blocks):
        found = _one_pass(numbered, block, window).withColumn(
            "items", F.transform("items", lambda i, number=number: F.concat(F.lit(f"{number}:"), i))
        )
        passes = found if passes is None else passes.unionByName(found)
    grouped = stage(passes, "passes").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.flatten(F.collect_list("items")).alias("items"),
        F.flatten(F.collect_list("matches")).alias("matches"),
    )

    def unite(acc, span):
        last = F.element_at(acc, -1)
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        return (
            F.when(F.size(acc) == 0, F.array(span))
            .when(span["begin"] <= last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))
            .otherwise(F.concat(acc, F.array(span)))
        )

    empty = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return grouped.withColumn("hits", F.aggregate("hits", empty, unite)).drop("row")


def _clean_rows(docs: DataFrame, items: list, window: int) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(index_windows(items, window))
    if index.value is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                hits = find_in_shard(piece.column("text"), index.value)[1]
                yield piece.filter(pa.array([not h for h in hits], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def digest_rows(found: DataFrame) -> DataFrame:
    """One row per document with the count and digest of its items; the digest skips null ids."""
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
