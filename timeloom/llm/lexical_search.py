"""Ranked lexical search: item tiles times document tiles, multiplied as dense float64 matrices.

One pass over the texts counts, for each document, its terms and how often each term that
may belong to an item occurs. Terms pass a bit filter of bounded size, so the pass is the same
whatever the number of items. Statistics over all documents then give each item's terms
their weights. A task holds a block of items, cut into tiles of items with a compact vocabulary
of their own. Per tile of documents the weights (items x terms) are multiplied by the
impacts (terms x documents). All factors are whole numbers, and a tile's terms are cut so that
no sum in a product reaches 2**53: the products are exact, and tiles are added as 64-bit
integers. Each task keeps the best documents of each item, ties included until ids decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import best_rows, stage
from timeloom.llm.words import ALPHANUMERIC, slices, text_bytes, word_bounds, word_hashes

#: Items, terms and documents of a tile.
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 256, 2048, 1024
#: Weights (item, term) that one pass over the counted terms holds in a task.
BLOCK_WEIGHTS = 1 << 20
#: An impact is below this.
IMPACT = 1_000_000
#: Whole numbers below this are exact in float64.
EXACT = 1 << 53
#: The filter of item terms has at most 2**27 bits (16 MB).
FILTER_BITS = 27


def count_terms(column: pa.Array, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text its number of terms; then bounds, hashes and counts of its distinct terms.

    ``bits`` holds back terms whose place in the filter is not set; they still count as terms.
    """
    data, offsets = text_bytes(column)
    starts, ends, first = word_bounds(data, offsets, ALPHANUMERIC)
    hashes = word_hashes(data, starts, ends)
    n_terms = np.diff(first)
    text = np.repeat(np.arange(len(n_terms)), n_terms)
    if bits is not None:
        place = hashes & np.uint64(len(bits) * 64 - 1)
        known = (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        hashes, text = hashes[known], text[known]
    terms, number = np.unique(hashes, return_inverse=True)
    pairs, counts = np.unique(text * max(len(terms), 1) + number, return_counts=True)
    text, number = np.divmod(pairs, max(len(terms), 1))
    return n_terms, np.searchsorted(text, np.arange(len(n_terms) + 1)), terms[number].view(np.int64), counts


def _counted(df: DataFrame, id_column: str, bits: np.ndarray | None, label: str) -> DataFrame:
    """id, n_terms, terms and counts of each row of ``df``; written."""
    held = None if bits is None else df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                n_terms, bounds, terms, counts = count_terms(piece.column("text"), None if held is None else held.value)
                lists = [pa.LargeListArray.from_arrays(bounds, pa.array(v, pa.int64())) for v in (terms, counts)]
                columns = [piece.column("id"), pa.array(n_terms, pa.int64()), *(v.cast(pa.list_(pa.int64())) for v in lists)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_terms", "terms", "counts"])

    slim = df.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return stage(slim.mapInArrow(run, "id long, n_terms long, terms array<long>, counts array<long>"), label)


def _filter_bits(terms: DataFrame) -> np.ndarray:
    """The bit filter of ``terms`` (term), 16 bits a term up to its greatest size."""
    terms = terms.distinct()
    bits = 1 << max(10, min(FILTER_BITS, (16 * terms.count()).bit_length()))
    place = F.col("term").bitwiseAND(F.lit(bits - 1))
    words = (
        terms.groupBy(F.shiftright(place, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, int(term & {bits - 1} & 63))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(bits >> 6, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    Reads doc_id and text of ``docs``, item_id and text of ``items``; other columns are ignored.
    Terms are runs of digits, Latin letters (A-Z folded) and characters beyond ASCII, compared
    as 64-bit hashes. With N documents that have a term, L their terms, n a document's terms, df
    the documents with a term and tf its occurrences, its weight is
    floor(1000 * ln((2N + 2) / (2df + 1))), its impact 10**9 * tf div (1000 * tf + 12 * m) with
    m = 75 + 25 * n * N div L, and a score sums weight times impact over an item's terms with
    repeats. Only scores above 0 count; equal scores rank by doc_id, rows without one last.
    Null or empty texts have no terms: such a document is never ranked, such an item has no
    rows. Repeated documents are ranked each. Repeated items give the ranks of each. Empty tables give no rows.
    """
    wanted = _counted(items, "item_id", None, "item-terms").withColumn("item", F.monotonically_increasing_id())
    wanted = stage(wanted.select("item", "id", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("item", F.col("id").alias("item_id"), F.col("t.terms").alias("term"), F.col("t.counts").alias("repeats")), "items")
    counted = _counted(docs, "doc_id", _filter_bits(wanted.select("term")), "doc-terms")
    n_docs, n_terms = counted.filter("n_terms > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = stage(wanted.join(holding, "term").select("item", "item_id", "term", (weight * F.col("repeats")).alias("weight")), "weights")
    blocks = max(1, -(-weights.count() // BLOCK_WEIGHTS))
    found = None
    for block in range(blocks):
        part = weights.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        best = _one_pass(counted, item_tiles(part.toArrow()), n_docs, n_terms, k)
        if blocks > 1:
            best = stage(best, "best")
        found = best if found is None else found.unionByName(best)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return best_rows(found, "item", order, k).select("item_id", "rank", "doc_id", "score")


@dataclass
class TermTile:
    """Some terms of an item tile: sorted hashes, and the weights as (item, place of the term)."""

    terms: np.ndarray
    item: np.ndarray
    place: np.ndarray
    weight: np.ndarray


@dataclass
class ItemTile:
    items: np.ndarray  # item row keys
    ids: list  # their ids
    parts: list[TermTile]


def item_tiles(weights: pa.Table) -> list[ItemTile]:
    """Tiles of a block of weights (item, item_id, term, weight)."""
    out = []
    weights = weights.filter(pc.field("weight") > 0).sort_by([("item", "ascending"), ("term", "ascending")])
    rows, begin, number = np.unique(weights["item"].to_numpy(), return_index=True, return_inverse=True)
    ids = weights["item_id"].take(pa.array(begin)).to_pylist()
    terms, weight = weights["term"].to_numpy(), weights["weight"].to_numpy()
    for first in range(0, len(rows), TILE_ITEMS):
        own = slice(*np.searchsorted(number, [first, first + TILE_ITEMS]))
        parts = _term_tiles(number[own] - first, terms[own], weight[own])
        out.append(ItemTile(rows[first : first + TILE_ITEMS], ids[first : first + TILE_ITEMS], parts))
    return out


def _term_tiles(item: np.ndarray, term: np.ndarray, weight: np.ndarray) -> list[TermTile]:
    """Cut by terms so that the greatest weights of a tile's terms, times any impact, stay exact in sum.

    A weight too large for that by itself is dealt over several tiles.
    """
    most, out = (EXACT - 1) // IMPACT, []
    while len(item):
        now = np.minimum(weight, most)
        terms, place = np.unique(term, return_inverse=True)
        greatest = np.zeros(len(terms), np.int64)
        np.maximum.at(greatest, place, now)
        begin = 0
        while begin < len(terms):
            within = np.cumsum(greatest[begin : begin + TILE_TERMS]) <= most
            end = begin + max(1, int(within.sum()))
            own = (place >= begin) & (place < end)
            out.append(TermTile(terms[begin:end], item[own], place[own] - begin, now[own]))
            begin = end
        more = weight > most
        item, term, weight = item[more], term[more], weight[more] - most
    return out


def _one_pass(counted: DataFrame, tiles: list[ItemTile], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The best documents of each item, of each task."""
    held = counted.sparkSession.sparkContext.broadcast(tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[Best(k) for _ in tile.ids] for tile in held.value]
        for batch in batches:
            for first in range(0, batch.num_rows, TILE_DOCS):
                piece = batch.slice(first, TILE_DOCS)
                bounds, terms, impacts = document_tile(piece, n_docs, n_terms)
                doc_ids = piece.column("id").fill_null(0).to_numpy()
                absent = piece.column("id").is_null().to_numpy(zero_copy_only=False)
                for tile, own in zip(held.value, best, strict=True):
                    scores = tile_scores(tile, bounds, terms, impacts)
                    for i in np.flatnonzero(scores.max(axis=1, initial=0) > 0).tolist():
                        own[i].add(scores[i], absent, doc_ids)
        rows = [
            (item, item_id, None if gone else doc, score)
            for tile, own in zip(held.value, best, strict=True)
            for item, item_id, kept in zip(tile.items.tolist(), tile.ids, own, strict=True)
            for score, gone, doc in kept.rows()
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["item", "item_id", "doc_id", "score"]
        )

    return counted.filter("size(terms) > 0").select("id", "n_terms", "terms", "counts").mapInArrow(run, "item long, item_id long, doc_id long, score long")


def document_tile(piece: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each document's terms begin, the terms and their impacts."""
    terms, counts = piece.column("terms"), piece.column("counts")
    bounds = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
    tf = counts.flatten().to_numpy()
    length = 75 + 25 * piece.column("n_terms").to_numpy() * n_docs // max(n_terms, 1)
    impacts = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(length, np.diff(bounds)))
    return bounds, terms.flatten().to_numpy(), impacts


def tile_scores(tile: ItemTile, bounds: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """The exact scores, items x documents, of a tile of each."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.zeros((len(tile.ids), len(bounds) - 1), np.int64)
    for part in tile.parts:
        at = np.searchsorted(part.terms, terms)
        at[at == len(part.terms)] = 0
        known = np.flatnonzero(part.terms[at] == terms)
        # Only terms that some document of the tile has are multiplied.
        present, column = np.unique(at[known], return_inverse=True)
        if not len(present):
            continue
        right = np.zeros((len(present), len(bounds) - 1))
        right[column, doc[known]] = impacts[known]
        place = np.full(len(part.terms), -1)
        place[present] = np.arange(len(present))
        own = place[part.place] >= 0
        left = np.zeros((len(tile.ids), len(present)))
        left[part.item[own], place[part.place[own]]] = part.weight[own]
        out += (left @ right).astype(np.int64)
    return out


class Best:
    """The k best documents of an item so far, by falling score, then doc_id, rows without one last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.absent, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, absent: np.ndarray, doc: np.ndarray) -> None:
        least = self.score[-1] if len(self.score) == self.k else 1
        at = np.flatnonzero(score >= max(least, 1))
        if len(at) > self.k:
            # All that tie with the k-th go on, for ids to decide.
            own = score[at]
            at = at[own >= np.partition(own, -self.k)[-self.k]]
        if len(at):
            score, absent, doc = (np.concatenate(x) for x in ((self.score, score[at]), (self.absent, absent[at]), (self.doc, doc[at])))
            order = np.lexsort((doc, absent, -score))[: self.k]
            self.score, self.absent, self.doc = score[order], absent[order], doc[order]

    def rows(self) -> Iterator[tuple[int, bool, int]]:
        return zip(self.score.tolist(), self.absent.tolist(), self.doc.tolist(), strict=True)
