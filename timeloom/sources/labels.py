"""Ground-truth labels: which technique a record exhibits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(host, record, technique_id)`` rows of a label document."""
    schema = (
        "events array<struct<computer string, record_id string, technique_ids array<string>>>"
    )
    labels = spark.read.schema(schema).json(path, multiLine=True)
    events = labels.select(F.explode("events").alias("e"))
    return events.select(
        F.col("e.computer").alias("host"),
        F.col("e.record_id").alias("record"),
        F.explode("e.technique_ids").alias("technique_id"),
    ).distinct()
