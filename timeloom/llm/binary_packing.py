"""Best-fit-decreasing packing of token ids into rows of a fixed capacity, and packed files.

Documents longer than the capacity are cut into full rows and a rest. Rests are dealt by a
hash into shards of a bounded number of pieces and ids; each shard sorts its pieces by length and
puts each into the open row with the least room that still takes it. A segment tree over
the possible rooms finds that row in a logarithmic number of steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import stage
from timeloom.llm.tokens import token_table

CAPACITY = 4096
END_ID = 2
#: Pieces that one task packs; more pieces make more shards.
SHARD_PIECES = 200_000
#: Ids that one task packs, about: it holds its pieces with their ids (32 MB, or half).
SHARD_IDS = 1 << 23
#: Pieces in a batch that a task gives out.
OUT_ROWS = 1024
#: Rows of the matrix in a batch.
OUT_MATRIX_ROWS = 128


class Rooms:
    """Open rows by the room they have left; a segment tree finds the least that suffices."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the open row with the least room of at least ``need``."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not self.count[node]:
                    node += 1
        room = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and offset of each piece; ``lengths`` are sorted from long to short, none over capacity."""
    rooms, n_rows = Rooms(capacity), 0
    row_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        found = rooms.take(length)
        if found is None:
            found = (capacity, n_rows)
            n_rows += 1
        room, row_of[i] = found
        offset[i] = capacity - room
        if room > length:
            rooms.add(room - length, found[1])
    return row_of, offset


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """Pieces of documents placed in rows of at most ``capacity`` ids.

    Reads ``doc_id`` and ``text``; other columns are ignored. Returns one row per piece:
    doc_id, start, length, doc_tokens, piece (a unique number), ``ids``, sequence_id and offset
    (gapless from 0). The pieces of a packed row are neighbours, in order. A null or empty text
    has the end id alone; a null doc_id stays null; repeated rows are packed once each; equal
    lengths are placed by piece number; an empty table gives no rows. ``sequence_id`` is
    shard * 2**32 + the row's number in its shard.
    """
    return place(_pieces(token_table(docs, tokenizer_path, end_id, short=True), capacity), capacity)


def _pieces(tokens: DataFrame, capacity: int) -> DataFrame:
    cut = tokens.filter("n_ids > 0").withColumn("cut", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_ids") - 1) / capacity))))
    start = F.col("cut") * capacity
    length = F.least(F.col("n_ids") - start, F.lit(capacity))
    size = F.length("ids") / F.col("n_ids")
    return cut.select(
        "doc_id",
        start.alias("start"),
        length.alias("length"),
        F.col("n_ids").alias("doc_tokens"),
        # Ids before the piece in its task are under 2**40, tasks under 2**23.
        (F.shiftleft("part", 40) + F.col("part_start") + start).alias("piece"),
        F.substring("ids", (start * size + 1).cast("int"), (length * size).cast("int")).alias("ids"),
    )


def _widened(table: pa.Table) -> pa.Table:
    """``ids`` of 32 bits each."""
    at = table.schema.get_field_index("ids")
    if at < 0:
        return table
    ids = [
        np.frombuffer(x, "<u2").astype("<u4").tobytes() if len(x) == 2 * n else x
        for x, n in zip(table.column("ids").to_pylist(), table.column("length").to_pylist(), strict=True)
    ]
    return table.set_column(at, "ids", pa.array(ids, pa.binary()))


def _dealt(pieces: DataFrame) -> DataFrame:
    n, total = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return pieces.repartition(max(1, -(-n // SHARD_PIECES), -(-total // SHARD_IDS)), "piece")


def _placed(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """A shard's pieces in the order of their rows, with sequence_id and offset."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    parts.clear()
    order = pc.sort_indices(table.select(["length", "piece"]), [("length", "descending"), ("piece", "ascending")]).to_numpy()
    row, offset = best_fit_decreasing(table.column("length").to_numpy()[order], capacity)
    by_row = np.lexsort((offset, row))
    order, row, offset = order[by_row], row[by_row], offset[by_row]
    row += TaskContext.get().partitionId() << 32
    for first in range(0, len(order), OUT_ROWS):
        some = slice(first, first + OUT_ROWS)
        out = _widened(table.take(pa.array(order[some]))).append_column("sequence_id", pa.array(row[some]))
        yield from out.append_column("offset", pa.array(offset[some])).combine_chunks().to_batches()


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows of ``piece`` (unique) and ``length``, a row's pieces next to each other."""
    pieces = pieces.drop("sequence_id", "offset")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return _dealt(pieces).mapInArrow(lambda batches: _placed(batches, capacity), f"{fields}, sequence_id long, offset long")


_MATRIX = (
    "sequence_id long, ids binary, cu_seqlens array<int>, positions binary, "
    "segments array<struct<doc_id: long, start: long, length: long, doc_tokens: long>>"
)


def packed_rows(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """One row of the packed matrix per sequence, ready to be written, from what ``pack`` returns.

    Returns sequence_id; ``ids``, padded to ``capacity`` with ``pad_id``; ``cu_seqlens``, the
    cumulative lengths from 0; ``positions``, which begin at 0 in every piece (0 in the padding);
    and ``segments``, (doc_id, start, length, doc_tokens) in order. Ids and positions are
    little-endian 32-bit values, so a file of rows is a matrix. The pieces of a row must be
    neighbours in one partition, as ``pack`` leaves them; others are an error.
    """
    slim = pieces.select("sequence_id", "offset", "length", "doc_id", "start", "doc_tokens", "ids")
    return slim.mapInArrow(lambda batches: _matrix_batches(batches, capacity, pad_id), _MATRIX)


def _matrix_batches(batches: Iterator[pa.RecordBatch], capacity: int, pad_id: int) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        # The last row may go on in the next batch.
        row = table.column("sequence_id").to_numpy()
        firsts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])).tolist()
        end = firsts[-1]
        cuts = [*firsts[:-1:OUT_MATRIX_ROWS], end]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield _matrix_rows(table.slice(a, b - a), capacity, pad_id)
        held = table.slice(end)
    if held is not None:
        yield _matrix_rows(held, capacity, pad_id)


def _matrix_rows(table: pa.Table, capacity: int, pad_id: int) -> pa.RecordBatch:
    batch = table.combine_chunks().to_batches()[0]
    row, offset, length = (batch.column(c).to_numpy() for c in ("sequence_id", "offset", "length"))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    last = np.append(first[1:], len(row))
    total = np.cumsum(length)
    begin = total - length
    if (offset != begin - np.repeat(begin[first], last - first)).any() or (total[last - 1] - begin[first] > capacity).any():
        raise ValueError("pieces of a packed row are not next to each other")
    at = np.repeat(np.arange(len(first)), last - first) * capacity + offset
    ids, positions = np.full((len(first), capacity), pad_id, "<u4"), np.zeros((len(first), capacity), "<i4")
    for here, n, found in zip(at.tolist(), length.tolist(), batch.column("ids"), strict=True):
        ids.reshape(-1)[here : here + n] = np.frombuffer(found.as_buffer(), "<u4")
        positions.reshape(-1)[here : here + n] = np.arange(n)
    # As many bounds as pieces and one more.
    bounds = np.insert(offset + length, first, 0).astype(np.int32)
    lists = np.append(first, len(row)).astype(np.int32)
    segments = pa.StructArray.from_arrays(
        [batch.column(c) for c in ("doc_id", "start", "length", "doc_tokens")], ["doc_id", "start", "length", "doc_tokens"]
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row[first]),
            pa.array([x.tobytes() for x in ids], pa.binary()),
            pa.ListArray.from_arrays(lists + np.arange(len(lists), dtype=np.int32), bounds),
            pa.array([x.tobytes() for x in positions], pa.binary()),
            pa.ListArray.from_arrays(lists, segments),
        ],
        ["sequence_id", "ids", "cu_seqlens", "positions", "segments"],
    )


def packed_matrix(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int | None = END_ID, pad_id: int = 0
) -> DataFrame:
    """``packed_rows`` of ``pack``, in one Python worker per task, written to the shared folder."""
    dealt = _dealt(_pieces(token_table(docs, tokenizer_path, end_id, short=True), capacity))
    rows = dealt.mapInArrow(lambda batches: _matrix_batches(_placed(batches, capacity), capacity, pad_id), _MATRIX)
    return stage(rows, "matrix")


def digest_rows(matrix: DataFrame) -> DataFrame:
    """The pieces of a packed matrix, with a checksum of the ids that its rows hold for them."""
    pieces = F.transform(
        "segments",
        lambda s, i: F.struct(
            s["doc_id"].alias("doc_id"),
            s["start"].alias("start"),
            s["length"].alias("length"),
            F.crc32(F.col("ids").substr(F.col("cu_seqlens")[i] * 4 + 1, (F.col("cu_seqlens")[i + 1] - F.col("cu_seqlens")[i]) * 4)).alias("ids_crc32"),
            s["doc_tokens"].alias("doc_tokens"),
            F.col("cu_seqlens")[i].cast("long").alias("offset"),
        ),
    )
    return matrix.select("sequence_id", F.inline(pieces)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
