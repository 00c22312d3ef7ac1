"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, union-find.

A document is the set of its distinct word shingles. Equal sets form a class, which goes on
as one row. A class's signature is cut into bands; classes that share a band's key are
candidates for each other, and candidates connected by shared keys form a cluster. Every
cluster is cut into blocks of a bounded size; each pair of blocks with a shared key is one
unit of work that gets both blocks' full shingle sets, counts all their intersections at
once and gives out a forest of the links found, never the pairs. So each class's set is
sent once for most clusters, large groups of near copies are spread over many tasks, and
no link between classes that share a key is lost. With the default bands a pair at the
threshold shares none with a probability below one in ten million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import attach, stage
from timeloom.llm.components import UnionFind, components
from timeloom.llm.superminhash import band_keys, signatures
from timeloom.llm.words import SPACED, mix, slices, text_bytes, word_bounds, word_hashes

PLACES, BANDS = 128, 32
#: A block holds about this many classes and this many shingles at most.
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 1 << 20
#: Shared shingles that one matrix product counts.
_COLUMNS = 2048


def shingle_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes; a text of fewer words is one shingle, none is empty."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_bounds(data, offsets, SPACED)
    hashes = word_hashes(data, starts, ends)
    rolled = hashes.copy()
    for i in range(1, shingle):
        rolled = mix(rolled[: len(rolled) - 1] * np.uint64(0x9E3779B97F4A7C15) + hashes[i:]) if len(rolled) > 1 else rolled[:0]
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= shingle:
            out.append(_distinct(rolled[a : b - shingle + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                whole = mix(np.array([whole]) * np.uint64(0xC2B2AE3D27D4EB4F) + h)[0]
            out.append(np.array([whole]))
        else:
            out.append(hashes[:0])
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    fresh = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


def _signature_table(docs: DataFrame, shingle: int, places: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = shingle_sets(piece.column("text"), shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                keys = band_keys(signatures(np.concatenate(sets), bounds, places), bands).view(np.int64)
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                rows = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("text_key"), pa.array(sizes), pa.array(names, pa.binary()), rows],
                    ["doc_id", "text_key", "n_shingles", "set_key", "bands"],
                )

    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    kinds = "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>"
    return stage(slim.mapInArrow(run, kinds), "signatures")


def find_near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, places: int = PLACES, bands: int = BANDS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, component_id, kept.

    Reads ``doc_id`` and ``text``; other columns are ignored. Words are runs without white
    space, A-Z folded. Documents are linked if 100 * intersection >= ``percent`` * union of
    their shingle sets; component_id is the smallest doc_id reachable, itself included.
    A null or empty text has no shingles and is linked with nothing; a row without doc_id
    is linked with nothing, has a null component_id and is kept; repeated rows share a
    component and are kept alike; an empty table gives no rows. ``text_key`` is a hash of the
    text, to find the row again.
    """
    table = _signature_table(docs, shingle, places, bands)
    with_set = table.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = stage(
        with_set.groupBy("set_key").agg(
            F.min("doc_id").alias("class"),
            F.count(F.lit(1)).alias("members"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    # Written first: else two Python workers would run in each task.
    found = components(stage(_links(docs, classes, shingle, percent), "links"))
    label = F.coalesce("component", "class").alias("component_id")
    # Two classes have the same least doc_id only if a doc_id is repeated with other text.
    named = classes.join(found, F.col("class") == F.col("node"), "left").select("set_key", label, "members")
    rows = table.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    out = attach(rows, stage(named, "components"), "set_key", "members")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def _links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between classes, as forests of the units of work."""
    keyed = classes.select("class", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("class").alias("first"), F.max("class").alias("last")).filter("first <> last")
    buckets = stage(keyed.join(shared.select("key", "first"), "key"), "buckets")
    clusters = components(buckets.select(F.col("class").alias("a"), F.col("first").alias("b")))
    own = buckets.select("class").distinct().join(clusters, F.col("class") == F.col("node"), "left")
    members = own.select("class", F.coalesce("component", "class").alias("cluster")).join(
        classes.select("class", "set_key", "n_shingles"), "class"
    )
    members = stage(members, "members")
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    sizes = members.groupBy("cluster").agg(needed.alias("n_blocks"), F.count(F.lit(1)).alias("members"))
    placed = attach(members, stage(sizes, "cluster-sizes"), "cluster", "members").withColumn(
        "block", F.pmod(F.xxhash64("class"), F.col("n_blocks"))
    )
    units = stage(_units(placed, buckets), "units")
    sets = _sets(docs, units, shingle)
    return sets.repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right").mapInArrow(
        lambda batches: _verify(batches, percent), "a long, b long"
    )


def _units(placed: DataFrame, buckets: DataFrame) -> DataFrame:
    """class, set_key and the units it takes part in: (cluster, left, right) blocks, left <= right."""
    alone = placed.filter("n_blocks = 1").select(
        "class", "set_key", F.array(F.struct("cluster", F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"))).alias("units")
    )
    several = placed.filter("n_blocks > 1")
    spread = stage(buckets.select("class", "key").join(several.select("class", "cluster", "block"), "class").select("key", "cluster", "block").distinct(), "spread")
    pairs = (
        spread.select("key", "cluster", F.col("block").alias("left"))
        .join(spread.select("key", F.col("block").alias("right")), "key")
        .filter("left <= right")
        .select("cluster", "left", "right")
        .distinct()
    )
    unit = F.struct("cluster", "left", "right")
    takes = pairs.select("cluster", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"), unit.alias("unit"))
    by_block = takes.groupBy("cluster", "block").agg(F.collect_list("unit").alias("units"))
    return alone.unionByName(several.join(by_block, ["cluster", "block"]).select("class", "set_key", "units"))


def _candidate_bits(units: DataFrame) -> tuple[int, np.ndarray]:
    """A Bloom filter of the classes: its number of bits, and the bits as 64-bit words.

    It has at most 2**27 bits (16 MB), however many classes there are. A fuller filter lets
    more documents through, which the join behind it drops; it never holds a class back.
    """
    bits = 1 << max(10, min(27, (16 * units.count()).bit_length()))
    places = units.select(F.explode(F.array(*_bit_places("class", bits))).alias("place"))
    words = (
        places.groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(bits >> 6, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bits, out.view(np.uint64)


def _bit_places(column: str, bits: int) -> list:
    return [F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(bits)).alias(f"place_{k}") for k in range(3)]


def _sets(docs: DataFrame, units: DataFrame, shingle: int) -> DataFrame:
    """The shingle set of each class, once for each unit it takes part in.

    The texts are read where they lie. A Bloom filter of bounded size picks the candidates'
    rows, so only their sets, not all texts, go into the join that finds the exact ones.
    """
    text = F.col("text").cast("string")
    bits, words = _candidate_bits(units)
    wanted = docs.sparkSession.sparkContext.broadcast(words)
    slim = docs.select(F.col("doc_id").cast("long").alias("class"), text.alias("text")).filter("class IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.ones(batch.num_rows, bool)
            for k in range(3):
                place = batch.column(f"place_{k}").to_numpy().astype(np.uint64)
                known &= (wanted.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            for piece in slices(batch.filter(pa.array(known)), "text"):
                raw = [found.tobytes() for found in shingle_sets(piece.column("text"), shingle)]
                names = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("class"), pa.array(names, pa.binary()), pa.array(raw, pa.binary())],
                    ["class", "set_key", "shingles"],
                )

    sets = slim.select("*", *_bit_places("class", bits)).mapInArrow(run, "class long, set_key binary, shingles binary")
    # A repeated doc_id with another text is another class.
    joined = sets.join(units, ["class", "set_key"]).select("class", "shingles", F.explode("units").alias("unit"))
    return joined.select("unit.cluster", "unit.left", "unit.right", "class", "shingles")


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The links of each unit, as a forest; a unit's rows follow each other."""
    unit, ids, sets = None, [], []
    done: list[tuple[int, int]] = []

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.int64()) for i in (0, 1)], ["a", "b"])
        done.clear()
        return batch

    for batch in batches:
        keys = zip(*(batch.column(n).to_pylist() for n in ("cluster", "left", "right")), strict=True)
        for key, own, raw in zip(keys, batch.column("class").to_pylist(), batch.column("shingles"), strict=True):
            if key != unit:
                done += find_links(ids, sets, percent)
                unit, ids, sets = key, [], []
                if len(done) > 10_000:
                    yield out()
            ids.append(own)
            sets.append(np.frombuffer(raw.as_py(), np.uint64))
    done += find_links(ids, sets, percent)
    yield out()


def find_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of the links between the sets; repeated rows of one id are linked."""
    if len(ids) < 2:
        return []
    found = UnionFind()
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(ids) <= 6:
        for i in range(len(ids)):
            for j in range(i):
                small, large = sorted((int(sizes[i]), int(sizes[j])))
                if 100 * small >= percent * large and found.root(ids[i]) != found.root(ids[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (small + large - both):
                        found.unite(ids[i], ids[j])
    else:
        both = _intersections(sets)
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        for i, row in enumerate(linked):
            for j in np.flatnonzero(row[:i]).tolist():
                found.unite(ids[i], ids[j])
    members, roots = found.forest()
    return list(zip(members, roots, strict=True))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The size of every two sets' intersection, by products of 0/1 matrices over shared shingles."""
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    group = np.cumsum(fresh) - 1
    common = np.bincount(group)[group] > 1
    group, owner = np.unique(group[common], return_inverse=True)[1], owner[common]
    out = np.zeros((n, n), np.float32)
    for first in range(0, int(group[-1]) + 1 if len(group) else 0, _COLUMNS):
        a, b = np.searchsorted(group, [first, first + _COLUMNS])
        part = np.zeros((n, _COLUMNS), np.float32)
        part[owner[a:b], group[a:b] - first] = 1
        out += part @ part.T
    return out.astype(np.int64)


def keep_representatives(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one document per component, with all their columns."""
    gone = find_near_duplicates(docs, shingle, percent).filter("NOT kept")
    gone = stage(gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "dropped")
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key"))
    return docs.join(gone, same, "left_anti")
