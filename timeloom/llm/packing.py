"""Concatenate and cut: all token ids as one long row, cut into windows of a fixed size.

Two passes. The first writes every document's ids with their start within the task that
read them. One row per task then gives, by a prefix sum over the tasks' totals, where each
task begins in the whole; a document's place is the sum of both. The second pass cuts at
the multiples of the window with built-in functions. Nothing is sorted or shuffled but one
row per task, and no document needs another one's row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm.tokens import token_table

WINDOW = 4096
END_ID = 2


def concatenate_and_cut(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int | None = END_ID) -> DataFrame:
    """Pieces of documents in windows: all windows but the last are full.

    Reads ``doc_id`` and ``text``; other columns are ignored. Returns one row per piece:
    doc_id, start (ids of its document before it), length, doc_tokens, sequence_id, offset
    (ids of its window before it) and ``ids`` (little-endian unsigned 32-bit).
    A null or empty text has the end id alone (no piece without an end id); a null doc_id
    stays null; repeated rows are packed once each; an empty table gives no rows.
    """
    tokens = token_table(docs, tokenizer_path, end_id)
    totals = tokens.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_ids")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_begin"))
    # One row per input task, whatever the input holds.
    placed = tokens.join(F.broadcast(starts), "part").withColumn("begin", F.col("part_begin") + F.col("part_start"))
    last = F.col("begin") + F.col("n_ids") - 1
    cut = placed.filter("n_ids > 0").withColumn(
        "sequence_id", F.explode(F.sequence(F.floor(F.col("begin") / window), F.floor(last / window)))
    )
    first = F.greatest(F.col("begin"), F.col("sequence_id") * window)
    after = F.least(F.col("begin") + F.col("n_ids"), (F.col("sequence_id") + 1) * window)
    return cut.select(
        "doc_id",
        (first - F.col("begin")).alias("start"),
        (after - first).alias("length"),
        F.col("n_ids").alias("doc_tokens"),
        "sequence_id",
        (first - F.col("sequence_id") * window).alias("offset"),
        F.substring("ids", ((first - F.col("begin")) * 4 + 1).cast("int"), ((after - first) * 4).cast("int")).alias("ids"),
    )


def windows(pieces: DataFrame) -> DataFrame:
    """Each window's ids as one value, with its boundary records in order.

    Returns sequence_id, ids, and ``boundaries``: an array of (offset, length, doc_id, start).
    A window holds a bounded number of ids, so its group is bounded too.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["offset"], p["length"], p["doc_id"], p["start"])).alias("boundaries"),
    )


def digest_rows(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
