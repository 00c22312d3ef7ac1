"""Exact duplicates by whole content, in three combining steps that no hot group can skew.

1. Each task reduces its own rows to one per text (the map side of the first aggregation).
2. What the tasks are left with is merged per (digest, text, salt), the salt being the task
   that read the row, modulo a fixed number.
3. The salts' winners, at most that many per text, meet by digest and are merged per text.

The grouping keys hold the digest and the whole text at every step, so texts are only taken
as equal when they are. Rows then find their winner by digest alone. Should two different
texts share a digest, the rows of that digest, and only these, find it by digest and text.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import attach, stage

SALTS = 16
#: A run of white space that is not one space already.
_TO_SPACE = r"[\x20\x09-\x0D]*[\x09-\x0D][\x20\x09-\x0D]*|\x20{2,}"


def normalized(text: Column) -> Column:
    """Each run of space and the controls 0x09 to 0x0D as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _TO_SPACE, " ")


def _keyed(docs: DataFrame, digest_bytes: int) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("text"))
    sha = text.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    return sha.withColumn("digest", F.substring("sha", 1, digest_bytes))


def find_duplicates(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Reads ``doc_id`` and ``text``; other columns are ignored. Texts are equal if they are
    after ``normalized``; null equals empty. The smallest doc_id of a group is its keep_id;
    a null doc_id comes last. Exactly one row of a group is kept, also when rows with the
    smallest doc_id are repeated. An empty table gives no rows. ``digest_bytes`` shortens
    the digest that rows are dealt by, which changes no result.
    """
    rows = stage(
        _keyed(docs, digest_bytes).select("doc_id", "sha", "digest", F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    merged = _merge(_keyed(docs, digest_bytes))
    by_digest = stage(
        merged.groupBy("digest").agg(
            F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("n_texts")
        ),
        "winners",
    )
    shared = by_digest.filter("n_texts > 1").select("digest")
    alone = by_digest.withColumn("weight", F.col("group_size")).drop("n_texts")
    found = attach(rows, alone, "digest", "weight")
    if not shared.isEmpty():
        # Different texts under one digest: regroup these rows by the texts' full digest.
        texts = _merge(_keyed(docs, digest_bytes).join(shared, "digest", "left_semi").withColumn("digest", F.col("sha")))
        by_text = texts.select(F.col("digest").alias("sha"), "keep_id", "group_size", F.col("group_size").alias("weight"))
        apart = rows.join(shared, "digest", "left_semi")
        found = found.join(shared, "digest", "left_anti").unionByName(attach(apart, stage(by_text, "winners"), "sha", "weight"))
        found = stage(found, "found")
    first = (
        found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("sha")
        .agg(F.min("row").alias("row"))
        .select("row", F.lit(True).alias("kept"))
    )
    return found.join(first, "row", "left").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce("kept", F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _merge(keyed: DataFrame) -> DataFrame:
    """digest, text, keep_id and group_size of each text."""
    salted = keyed.groupBy("digest", "text", (F.spark_partition_id() % SALTS).alias("salt")).agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return (
        salted.repartition("digest")
        .groupBy("digest", "text")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""

    def key(sha: Column, doc_id: Column) -> Column:
        return F.concat(sha, F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))

    winners = find_duplicates(docs).filter("kept").select(key(F.unhex("text_sha256"), F.col("doc_id")).alias("__key"))
    sha = F.unhex(F.sha2(normalized(F.col("text")).cast("binary"), 256))
    keyed = docs.withColumn("__key", key(sha, F.col("doc_id").cast("long")))
    # Of repeated rows of one doc_id and text one stays.
    return keyed.join(winners, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
