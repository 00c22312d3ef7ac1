"""Shared reading rules, record positions, and the mapped row every source ends in.

A source has two halves. A reader yields raw rows: the tool's own columns as strings,
plus ``source_artifact``, ``raw_ref`` and ``ord``. A mapper turns raw rows into mapped
rows, which are canonical events before validation, with a nullable ``reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.functions.timestamps import add_timestamp
from timeloom.schema import DETAILS, ORD, RAW_REF
from timeloom.session import materialize

FILE, SPLIT, ROW = "_file", "_split", "_row"
POSITION = (FILE, SPLIT, ROW)

MAPPED = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("timestamp_raw", T.StringType()),
        T.StructField("source_timezone", T.StringType()),
        T.StructField("timestamp_desc", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("principal", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("object", T.StringType()),
        T.StructField("source_tool", T.StringType()),
        T.StructField("source_artifact", T.StringType()),
        T.StructField("details", DETAILS),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("raw_ref", RAW_REF),
        T.StructField("ord", ORD),
        T.StructField("reason", T.StringType()),
    ]
)


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def cell(df: DataFrame, name: str) -> Column:
    """A cell as text: empty when the column is absent or the row is short."""
    if name in df.columns:
        return F.coalesce(column(name).cast("string"), F.lit(""))
    return F.lit("")


def with_position(df: DataFrame) -> DataFrame:
    """Add file, split and row position to a file scan, without moving any row.

    Rows of one split are consecutive in one task, so the id Spark generates per task
    orders them; file and split offset order the splits.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").cast("long").alias(SPLIT),
    ).withColumn(ROW, F.monotonically_increasing_id())


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines as ``value`` with positions; a leading byte-order mark is dropped."""
    df = with_position(spark.read.text(path))
    return df.withColumn("value", F.regexp_replace("value", r"^\x{FEFF}", ""))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``value``, one row per file; parallel across files."""
    df = with_position(spark.read.text(path, wholetext=True))
    return df.withColumn("value", F.regexp_replace("value", r"^\x{FEFF}", ""))


def file_name() -> Column:
    """The file's base name, decoded from its URI form."""
    name = F.substring_index(F.col(FILE), "/", -1)
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def with_row_number(df: DataFrame, output: str) -> DataFrame:
    """Write positioned rows, and add each row's 1-based number within its file.

    The source is read once: counts are taken from the written copy, from its positions alone.
    Rows are counted as they are written, so filters before this may have dropped some.
    """
    return number_written(materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "rows"), output)


def number_written(df: DataFrame, output: str) -> DataFrame:
    """Number written rows whose ids are consecutive within each split.

    Only one small row per split is aggregated: the first row id and the row count.
    Running sums of the counts give every split its offset, and the number follows
    from the row id, so the rows themselves are not sorted. The split table is written,
    so that its size is known when the join is planned.
    """
    splits = df.groupBy(FILE, SPLIT).agg(F.min(ROW).alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(FILE).orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        FILE,
        SPLIT,
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    offsets = materialize(offsets, "splits")
    numbered = df.join(offsets, [FILE, SPLIT])
    return numbered.withColumn(output, F.col(ROW) + F.col("_shift")).drop("_shift")


def position(input_index: int, sub: Column | None = None) -> Column:
    """The ``ord`` struct of a positioned row."""
    return F.struct(
        F.lit(input_index).alias("input"),
        F.col(FILE).alias("file"),
        F.col(SPLIT).alias("split"),
        F.col(ROW).alias("row"),
        (F.lit(0) if sub is None else sub).cast("int").alias("sub"),
    ).cast(ORD)


def table_position(key: Column, input_index: int = 0, sub: Column | None = None) -> Column:
    """The ``ord`` struct of a table row, ordered by a key column."""
    return F.struct(
        F.lit(input_index).alias("input"),
        F.lit("").alias("file"),
        F.lit(0).cast("long").alias("split"),
        key.cast("long").alias("row"),
        (F.lit(0) if sub is None else sub).cast("int").alias("sub"),
    ).cast(ORD)


def reference(source_file: Column, record: Column) -> Column:
    return F.struct(source_file.alias("source_file"), record.alias("record")).cast(RAW_REF)


def mapped(
    df: DataFrame,
    *,
    raw_time: Column,
    timestamp_desc: Column,
    message: Column,
    action: Column,
    source_tool: str,
    details: Column,
    host: Column | None = None,
    principal: Column | None = None,
    object: Column | None = None,
    confidence: Column | None = None,
    assume_timezone: Column | str | None = None,
    reason: Column | None = None,
) -> DataFrame:
    """Project raw rows to the mapped row layout, normalizing the timestamp."""
    nothing = F.lit(None).cast("string")
    per_row = isinstance(assume_timezone, Column)
    projected = df.select(
        raw_time.alias("timestamp_raw"),
        (assume_timezone if per_row else nothing).alias("_assumed_zone"),
        timestamp_desc.alias("timestamp_desc"),
        message.alias("message"),
        (nothing if host is None else host).alias("host"),
        (nothing if principal is None else principal).alias("principal"),
        action.alias("action"),
        (nothing if object is None else object).alias("object"),
        F.lit(source_tool).alias("source_tool"),
        "source_artifact",
        details.alias("details"),
        (F.lit(1.0) if confidence is None else confidence).alias("confidence"),
        "raw_ref",
        "ord",
        (nothing if reason is None else reason).alias("_refused"),
    )
    timed = add_timestamp(
        projected,
        F.col("timestamp_raw"),
        F.col("_assumed_zone") if per_row else assume_timezone,
    )
    timed = timed.withColumn("reason", F.coalesce("_refused", "time_reason"))
    return timed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MAPPED.fields])
