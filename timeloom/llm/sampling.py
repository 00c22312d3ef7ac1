"""Bounded samples of labelled texts, which classifiers are fitted on."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.near_dedup import shingle_sets

#: How many shingle hashes stand for a text when near copies are looked for.
MARKS = 8


def labelled_sample(
    docs: DataFrame, labels: DataFrame, per_label: int, max_chars: int, pieces: int = 16
) -> list[tuple[str, object]]:
    """Texts and labels to learn from, on the driver: at most ``per_label`` rows of each label.

    ``labels`` has ``doc_id`` and a non-null ``label``. The rows are the first by a hash of
    doc_id, and come in that order. A text of over ``max_chars`` characters gives ``pieces``
    evenly spaced pieces that hold as many together, so labels times ``per_label`` times
    ``max_chars`` bounds what reaches the driver. Of near copies in the sample only the first
    stays, so that a group of copies does not pass for evidence. Only fitting reads this.
    """
    wanted = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").dropDuplicates(["doc_id"])
    kinds = [r[0] for r in wanted.select("label").distinct().orderBy("label").limit(1000).collect()]
    chosen = None
    for kind in kinds:
        part = wanted.filter(F.col("label") == F.lit(kind)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return []
    text = F.coalesce("text", F.lit(""))
    size = max_chars // pieces
    thinned = F.concat_ws(
        " ",
        F.transform(
            F.sequence(F.lit(0), F.lit(pieces - 1)),
            lambda i: F.substring(text, F.floor(i * (F.length(text) - size) / (pieces - 1)).cast("int") + 1, F.lit(size)),
        ),
    )
    rows = (
        docs.select("doc_id", F.when(F.length(text) <= max_chars, text).otherwise(thinned).alias("text"))
        .join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")
        .collect()
    )
    rows.sort(key=lambda r: (hash((r.doc_id * 2654435761) & 0xFFFFFFFF), r.doc_id, r.text))
    return drop_copies([(r.text, r.label) for r in rows])


def drop_copies(sample: list[tuple[str, object]]) -> list[tuple[str, object]]:
    """The rows whose text shares fewer than half of its marks with every earlier text.

    A text's marks are the least hashes of its three-word shingles.
    """
    kept, owners = [], {}
    for first in range(0, len(sample), 500):
        part = sample[first : first + 500]
        for row, found in zip(part, shingle_sets(pa.array([t for t, _ in part], pa.large_string()), 3), strict=True):
            marks = found[:MARKS].tolist()
            shared = Counter(owners[m] for m in marks if m in owners)
            if not marks or max(shared.values(), default=0) * 2 < len(marks):
                for m in marks:
                    owners.setdefault(m, len(kept))
                kept.append(row)
    return kept
