"""Technique tags scored against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5
KEYS = ("host", "record", "technique_id")


def predictions(events: DataFrame) -> DataFrame:
    """Distinct ``(host, record, technique)`` of tagged events."""
    return events.select(
        F.coalesce("host", F.lit("")).alias("host"),
        F.col("raw_ref.record").alias("record"),
        F.explode("attack_techniques").alias("t"),
    ).select("host", "record", F.col("t.technique_id").alias("technique_id")).distinct()


def score(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: precision, recall, counts, and the first false positives in order.

    Both sides are tagged and grouped once, which yields the intersection and both
    differences in a single shuffle.
    """
    sides = predicted.select(*KEYS, F.lit(1).alias("p"), F.lit(0).alias("e")).unionByName(
        expected.select(*KEYS, F.lit(0).alias("p"), F.lit(1).alias("e"))
    )
    keyed = sides.groupBy(*KEYS).agg(F.max("p").alias("p"), F.max("e").alias("e"))
    totals = keyed.agg(
        F.count_if((F.col("p") == 1) & (F.col("e") == 1)).alias("true_positives"),
        F.count_if((F.col("p") == 1) & (F.col("e") == 0)).alias("false_positives"),
        F.count_if((F.col("p") == 0) & (F.col("e") == 1)).alias("false_negatives"),
    )
    # A top-k per task, then one small list.
    examples = (
        keyed.filter("p = 1 AND e = 0")
        .orderBy(*KEYS)
        .limit(EXAMPLES)
        .agg(F.array_sort(F.collect_list(F.struct(*KEYS))).alias("_examples"))
        .select(
            F.transform("_examples", lambda x: F.concat_ws(" ", *[x[k] for k in KEYS])).alias(
                "false_positive_examples"
            )
        )
    )
    hits, wrong, missed = (
        F.col("true_positives"),
        F.col("false_positives"),
        F.col("false_negatives"),
    )
    rated = totals.select(
        F.when(hits + wrong > 0, hits / (hits + wrong)).otherwise(F.lit(1.0)).alias("precision"),
        F.when(hits + missed > 0, hits / (hits + missed)).otherwise(F.lit(1.0)).alias("recall"),
        "true_positives",
        "false_positives",
        "false_negatives",
        F.lit(1).alias("_one"),
    )
    return rated.join(F.broadcast(examples.withColumn("_one", F.lit(1))), "_one").drop("_one")
