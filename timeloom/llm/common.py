"""Help that several operators share: lineage cuts, joins on hot keys, the split of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.session import new_path

#: A key is heavy if it has more than this share of all rows, so there are at most 1000.
HEAVY_SHARE = 1000
#: In how many parts the best rows of all tasks are merged at first.
MERGE_PARTS = 64


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = new_path(spark, f"llm-{label}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of many rows with one row per key, whatever share of them one key has.

    ``right`` has at most one row per value of ``key`` and counts, in ``weight``, the rows of
    ``left`` with it; it must be cheap to read twice. Keys with over a thousandth of the
    weight are at most a thousand; these are broadcast, and their rows never shuffled.
    All other keys are joined by shuffle. Rows whose key is null get nulls.
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("__total"))
    values = [c for c in right.columns if c not in (key, weight)]
    heavy = (
        right.join(F.broadcast(total))
        .filter(F.col(weight) * HEAVY_SHARE > F.col("__total"))
        .select(F.col(key), F.struct(*values).alias("__heavy"))
    )
    known = left.join(F.broadcast(heavy), key, "left")
    found = known.filter("__heavy IS NOT NULL").select(*left.columns, "__heavy.*")
    rest = known.filter("__heavy IS NULL").drop("__heavy").join(right.drop(weight), key, "left")
    return found.unionByName(rest.select(*left.columns, *values))


def digits_hash(id_column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``: the split into learned and held-out rows."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def best_rows(found: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each ``group`` in ``order``, and their rank from 1.

    ``found`` holds the best rows of each task: a group's rows grow with the number of tasks,
    so they are merged in parts first.
    """
    parted = found.withColumn("__tasks", F.spark_partition_id() % MERGE_PARTS)
    parted = parted.withColumn("rank", F.row_number().over(Window.partitionBy(group, "__tasks").orderBy(*order))).filter(F.col("rank") <= k)
    return parted.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k).drop("__tasks")
