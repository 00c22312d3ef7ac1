"""Nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts with few edges between
them. A small classifier learns, from the parts that a vector's neighbours lie in, which parts
to look in for a vector's neighbours. It deals every vector of the table to its most probable
part, and routes each query to its most probable parts until these hold a certain share of the
probability. That share is set by measurement: a bounded number of queries is searched in all
vectors, and the share is the least that finds the wanted part of their neighbours. The
vectors of the parts a query is routed to are all ranked by their exact inner product.

Parts may have any size: one of many vectors is cut into blocks, and its queries into chunks.
A unit of work is a block with a chunk. Its task holds the block and streams the queries, and
gives out one row for each query with its nearest in the block; these rows are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import best_rows, stage

#: Vectors that the index is fitted on: at least the first, and this many for each part, of which there are at most 2**8.
SAMPLE, SAMPLE_OF_PART, MOST_LEVELS = 2048, 64, 8
#: About this many vectors to a part, while there are fewer than the most parts.
PART_VECTORS = 1024
#: Neighbours in the graph; queries that the share is measured with; what part of their neighbours must be found.
GRAPH_NEIGHBOURS, MEASURED_QUERIES, WANTED_RECALL = 10, 256, 0.96
#: Vectors of a block, queries of a chunk, queries of one matrix product.
BLOCK_VECTORS, CHUNK_QUERIES, PRODUCT_QUERIES = 16_384, 65_536, 256
_HASHES = 1 << 30


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """Each vector's ``k`` nearest others by inner product, a row each."""
    k = min(k, len(vectors) - 1)
    out = np.zeros((len(vectors), k), np.int64)
    for first in range(0, len(vectors), 512):
        scores = vectors[first : first + 512] @ vectors.T
        own = np.arange(len(scores))
        scores[own, first + own] = -np.inf
        out[first : first + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(neighbours: np.ndarray, levels: int, random: np.random.Generator) -> np.ndarray:
    """The part, of 2**levels, of each vertex; halves of halves that differ by one vertex at most."""
    a = np.repeat(np.arange(len(neighbours)), neighbours.shape[1])
    b = neighbours.reshape(-1)
    part = np.zeros(len(neighbours), np.int64)
    for _ in range(levels):
        halves = np.zeros(len(part), np.int64)
        inside = part[a] == part[b]
        for p in range(int(part.max(initial=0)) + 1):
            own = np.flatnonzero(part == p)
            place = np.zeros(len(part), np.int64)
            place[own] = np.arange(len(own))
            edges = inside & (part[a] == p)
            halves[own] = bisect(len(own), place[a[edges]], place[b[edges]], random)
        part = 2 * part + halves
    return part


def bisect(n: int, a: np.ndarray, b: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """0 or 1 for each of ``n`` vertices, in equal halves, with few edges (a, b) between them."""
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    # A vector that changes slowly along edges; its middle parts the graph.
    slow = random.standard_normal(n)
    for _ in range(40):
        slow = (slow + np.bincount(a, slow[b], minlength=n) / degree) / 2
        slow -= (slow * degree).sum() / degree.sum()
        slow /= max(np.abs(slow).max(), 1e-30)
    half = np.zeros(n, np.int64)
    half[np.argsort(slow, kind="stable")[n // 2 :]] = 1
    # Exchange the vertices that gain most, while fewer edges are cut.
    cut = int((half[a] != half[b]).sum())
    swaps = max(1, n // 20)
    while swaps and cut:
        gain = np.bincount(a, np.where(half[a] != half[b], 1.0, -1.0), minlength=n)
        sides = [np.flatnonzero(half == side) for side in (0, 1)]
        m = min(swaps, *(len(s) for s in sides))
        if not m:
            break
        moved = np.concatenate([s[np.argsort(-gain[s], kind="stable")[:m]] for s in sides])
        half[moved] ^= 1
        now = int((half[a] != half[b]).sum())
        if now >= cut:
            half[moved] ^= 1
            swaps //= 2
        else:
            cut = now
    return half


@dataclass
class Router:
    """The classifier: one hidden layer, and how much of the probability a query's parts hold."""

    scale: float
    hidden: tuple[np.ndarray, np.ndarray]
    out: tuple[np.ndarray, np.ndarray]
    share: float = 1.0

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        inner = np.maximum(vectors * self.scale @ self.hidden[0] + self.hidden[1], 0)
        return _softmax(inner @ self.out[0] + self.out[1])

    def parts_of(self, vectors: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The parts that each vector is routed to; together they hold ``least`` vectors, if all do."""
        found = self.probabilities(vectors)
        order = np.argsort(-found, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(found, order, 1), axis=1) - np.take_along_axis(found, order, 1)
        held = np.cumsum(sizes[order], axis=1) - sizes[order]
        return [o[(b < self.share) | (h < least)] for o, b, h in zip(order, before, held, strict=True)]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train_router(vectors: np.ndarray, targets: np.ndarray, random: np.random.Generator, hidden: int = 64, epochs: int = 40) -> Router:
    """Learn the shares of the parts (``targets``) among a vector's neighbours, by stochastic gradient descent."""
    dim, parts = vectors.shape[1], targets.shape[1]
    scale = float(np.sqrt(dim) / max(np.sqrt((vectors**2).sum(axis=1).mean()), 1e-30))
    x = vectors * scale
    values = [random.standard_normal((dim, hidden)) * np.sqrt(2 / dim), np.zeros(hidden), random.standard_normal((hidden, parts)) * 0.1, np.zeros(parts)]
    mean, square, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs):
        order = random.permutation(len(x))
        for first in range(0, len(x), 128):
            at = order[first : first + 128]
            inner = np.maximum(x[at] @ values[0] + values[1], 0)
            error = (_softmax(inner @ values[2] + values[3]) - targets[at]) / len(at)
            back = (error @ values[2].T) * (inner > 0)
            slopes = [x[at].T @ back, back.sum(axis=0), inner.T @ error, error.sum(axis=0)]
            step += 1
            for i, slope in enumerate(slopes):
                mean[i] += 0.1 * (slope - mean[i])
                square[i] += 0.01 * (slope**2 - square[i])
                values[i] -= 0.003 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    return Router(scale, (values[0], values[1]), (values[2], values[3]))


def fit(sample: np.ndarray, levels: int, seed: int = 7) -> Router:
    """The router of 2**levels parts, from a sample of vectors (a row each, at least two)."""
    random = np.random.default_rng(seed)
    neighbours = neighbour_graph(sample, GRAPH_NEIGHBOURS)
    part = balanced_parts(neighbours, levels, random)
    targets = np.zeros((len(sample), 1 << levels))
    rows = np.arange(len(sample))
    for column in (rows, *neighbours.T):
        np.add.at(targets, (rows, part[column]), 1)
    return train_router(sample, targets / targets.sum(axis=1, keepdims=True), random)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part; of the same length all."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(
        F.col("vec_id").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    sizes = own.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.filter(F.size("embedding") == (sizes[0] if sizes else 0))


def _sampled(own: DataFrame, rows: int, n: int, seed: int) -> pa.Table:
    """About ``rows`` rows of the ``n`` of ``own``, and no more; by a hash of vec_id."""
    spread = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(_HASHES))
    wanted = own.filter(spread < int(min(1.0, 1.25 * rows / max(n, 1)) * _HASHES)).dropDuplicates(["vec_id"])
    return wanted.orderBy(spread, "vec_id").limit(rows).toArrow()


def search(vectors: DataFrame, is_query: Column, k: int = 20, wanted_recall: float = WANTED_RECALL) -> DataFrame:
    """The ``k`` nearest found of each query among all other vectors: query_id, rank, vec_id, score.

    Reads vec_id and embedding; ``is_query`` says of a row, by its vec_id, whether it is a query;
    other columns are ignored. The score is the inner product in double precision, summed in the
    order of components; equal scores rank by vec_id. A row without vec_id, and a vector that is
    null, empty, zero or holds a null or non-finite component takes no part, nor one of another
    length than most have. Of rows with the same vec_id the one with the least vector counts.
    A query without any other vector has no rows; an empty table gives none.
    Found are at least about ``wanted_recall`` of the true neighbours: parts are added until
    that share of a sample's true neighbours is found. The share is then the same for all queries.
    """
    own = usable(vectors)
    n = own.count()
    levels = int(np.clip(round(np.log2(max(n, 1) / PART_VECTORS)), 1, MOST_LEVELS))
    sample = _matrix(_sampled(own, max(SAMPLE, SAMPLE_OF_PART << levels), n, 0)["embedding"].combine_chunks())
    if len(sample) < 2:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = fit(sample, levels)
    indexed = assign(own, router)
    sizes = np.zeros(1 << levels, np.int64)
    for part, count in indexed.groupBy("part").count().collect():
        sizes[part] = count
    router.share = measured_share(indexed, is_query, router, n, k, wanted_recall)
    routed = stage(route(indexed.filter(is_query), router, sizes, k + 1), "routed")
    plan = _plan(sizes, dict(routed.select(F.explode("parts").alias("part")).groupBy("part").count().collect()))
    small = F.broadcast(vectors.sparkSession.createDataFrame(plan, "part int, blocks long, chunks long"))
    block, chunk = F.pmod(F.xxhash64("vec_id"), F.col("blocks")), F.pmod(F.xxhash64("vec_id"), F.col("chunks"))
    up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    held = indexed.join(small, "part").select("part", block.alias("block"), up_to("chunks").alias("chunk"), F.lit(0).alias("kind"), "vec_id", "embedding")
    asked = routed.withColumn("part", F.explode("parts")).join(small, "part")
    asked = asked.select("part", up_to("blocks").alias("block"), chunk.alias("chunk"), F.lit(1).alias("kind"), "vec_id", "embedding")
    unit = ["part", "block", "chunk"]
    units = sum(b * c for _, b, c in plan) or 1
    dealt = held.unionByName(asked).repartition(min(units, 100_000), *unit).sortWithinPartitions(*unit, "kind", "vec_id")
    found = dealt.mapInArrow(lambda batches: _search_units(batches, k), "query_id long, vec_ids array<long>, scores array<double>")
    merged = found.repartition("query_id").sortWithinPartitions("query_id")
    return merged.mapInArrow(lambda batches: _merge(batches, k), "query_id long, rank int, vec_id long, score double")


def _plan(sizes: np.ndarray, queries: dict[int, int]) -> list[tuple[int, int, int]]:
    """Into how many blocks and chunks each part is cut; a part without queries is left out."""
    return [
        (part, max(1, -(-int(sizes[part]) // BLOCK_VECTORS)), max(1, -(-count // CHUNK_QUERIES)))
        for part, count in sorted(queries.items())
    ]


def assign(own: DataFrame, router: Router) -> DataFrame:
    """One row per vec_id: vec_id, embedding, part; written."""
    held = own.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.zeros(batch.num_rows, np.int32)
            for first in range(0, batch.num_rows, 4096):
                part[first : first + 4096] = held.value.probabilities(_matrix(batch.column("embedding").slice(first, 4096))).argmax(axis=1)
            yield batch.append_column("part", pa.array(part))

    single = own.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    kind = own.schema["embedding"].dataType.simpleString()
    return stage(single.mapInArrow(run, f"vec_id long, embedding {kind}, part int"), "indexed")


def route(queries: DataFrame, router: Router, sizes: np.ndarray, least: int) -> DataFrame:
    """vec_id, embedding and the parts of each query."""
    held = queries.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = held.value.parts_of(_matrix(batch.column("embedding")), sizes, least) if batch.num_rows else []
            yield batch.drop_columns(["part"]).append_column("parts", pa.array(parts, pa.list_(pa.int32())))

    kind = queries.schema["embedding"].dataType.simpleString()
    return queries.mapInArrow(run, f"vec_id long, embedding {kind}, parts array<int>")


def measured_share(indexed: DataFrame, is_query: Column, router: Router, n: int, k: int, wanted: float) -> float:
    """The least share of the probability whose parts hold ``wanted`` of the true neighbours of a sample of queries."""
    queries = indexed.filter(is_query)
    sample = _sampled(queries, MEASURED_QUERIES, queries.count(), 1)
    if not sample.num_rows:
        return 0.0
    asked = _matrix(sample["embedding"].combine_chunks())
    held = indexed.sparkSession.sparkContext.broadcast((sample["vec_id"].to_numpy(), asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = held.value
        score, part = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int32)
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                piece = batch.slice(first, 4096)
                now = vectors @ _matrix(piece.column("embedding")).T
                now[ids[:, None] == piece.column("vec_id").to_numpy()] = -np.inf
                both = np.concatenate([score, now], axis=1)
                parts = np.concatenate([part, np.broadcast_to(piece.column("part").to_numpy(), now.shape)], axis=1)
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                score, part = np.take_along_axis(both, top, 1), np.take_along_axis(parts, top, 1)
        query, column = np.nonzero(score > -np.inf)
        columns = [pa.array(query, pa.int64()), pa.array(score[query, column]), pa.array(part[query, column])]
        yield pa.RecordBatch.from_arrays(columns, ["query", "score", "part"])

    found = best_rows(indexed.mapInArrow(run, "query long, score double, part int"), "query", [F.col("score").desc(), F.col("part")], k)
    true = found.select("query", "part").toArrow()
    if not true.num_rows:
        return 0.0
    odds = router.probabilities(asked)
    own = odds[true["query"].to_numpy(), true["part"].to_numpy()]
    # The share that comes before a neighbour's part in its query's order of parts.
    rows, parts = true["query"].to_numpy(), true["part"].to_numpy()
    ahead = (odds[rows] > own[:, None]) | ((odds[rows] == own[:, None]) & (np.arange(odds.shape[1]) < parts[:, None]))
    before = np.sort((odds[rows] * ahead).sum(axis=1))
    return float(before[min(len(before) - 1, int(np.ceil(wanted * len(before))))]) + 1e-9


def _search_units(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best of each unit: its block's rows come first, then its queries."""
    unit: tuple | None = None
    block: list[tuple[np.ndarray, np.ndarray]] = []
    ready: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("part", "block", "chunk", "kind")])
        changes = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        ids = batch.column("vec_id").to_numpy()
        for first, last in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows], strict=True):
            if first == last:
                continue
            *own, kind = keys[:, first].tolist()
            if own != unit:
                unit, block, ready = own, [], None
            rows = _matrix(batch.column("embedding").slice(first, last - first))
            if kind == 0:
                block.append((ids[first:last], rows))
                continue
            if ready is None and block:
                ready = np.concatenate([i for i, _ in block]), np.concatenate([r for _, r in block])
            for at in range(0, last - first, PRODUCT_QUERIES) if ready is not None else ():
                part = slice(first + at, min(last, first + at + PRODUCT_QUERIES))
                yield _rows(*nearest(ids[part], rows[at : at + PRODUCT_QUERIES], *ready, k))


def _rows(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """A row for each query; the rows of one follow each other."""
    begin = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    bounds = np.append(begin, len(query)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (vec_id, score)]
    return pa.RecordBatch.from_arrays([pa.array(query[begin]), *lists], ["query_id", "vec_ids", "scores"])


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of each query, ranked; the rows of a query follow each other."""
    left = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def ranked(whole: list[np.ndarray]) -> pa.RecordBatch:
        rank = np.arange(len(whole[0])) - np.searchsorted(whole[0], whole[0]) + 1
        columns = [whole[0], rank.astype(np.int32), *whole[1:]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "rank", "vec_id", "score"])

    for batch in batches:
        query = np.repeat(batch.column("query_id").to_numpy(), batch.column("vec_ids").value_lengths().to_numpy())
        own = [query, batch.column("vec_ids").flatten().to_numpy(), batch.column("scores").flatten().to_numpy()]
        query, vec_id, score = (np.concatenate(x) for x in zip(left, own, strict=True))
        order = np.lexsort((vec_id, -score, query))
        query = query[order]
        order = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
        best = [np.concatenate(x)[order] for x in zip(left, own, strict=True)]
        # The last query may go on in the next batch.
        whole = int(np.searchsorted(best[0], best[0][-1])) if len(order) else 0
        yield ranked([x[:whole] for x in best])
        left = [x[whole:] for x in best]
    yield ranked(left)


def nearest(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, vector id and exact score of each query's ``k`` nearest, ties to the smaller id."""
    rough = queries @ vectors.T
    rough[query_ids[:, None] == ids] = -np.inf
    least = np.full(len(queries), -np.inf)
    if len(ids) > k:
        # A matrix product may round otherwise than the exact sum: all within that distance go on.
        reach = np.linalg.norm(queries, axis=1) * np.sqrt((vectors**2).sum(axis=1).max()) * queries.shape[1] * 4 * np.finfo(float).eps
        least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - reach
    query, found = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
    score = np.zeros(len(query))
    for d in range(queries.shape[1]):
        score += queries[query, d] * vectors[found, d]
    order = np.lexsort((ids[found], -score, query))
    query, found, score = query[order], found[order], score[order]
    begin = np.searchsorted(query, np.arange(len(queries)))
    top = np.arange(len(query)) - begin[query] < k
    return query_ids[query[top]], ids[found[top]], score[top]
