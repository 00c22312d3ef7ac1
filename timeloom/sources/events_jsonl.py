"""Saved canonical events: read back, checked, and their ids recomputed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions import details as D
from timeloom.functions.text import strip
from timeloom.operators.normalize import first_violation, with_identity
from timeloom.schema import DEFAULT_NAMESPACES, EVENT_COLUMNS, RAW_REF, TECHNIQUES, Namespaces
from timeloom.session import materialize
from timeloom.sources.common import position, read_lines

_STRINGS = (
    "event_id",
    "datetime",
    "timestamp_raw",
    "source_timezone",
    "timestamp_desc",
    "message",
    "action",
    "source_tool",
    "source_artifact",
)
_NULLABLE = ("host", "principal", "object")
_ARRAYS = ("attack_techniques", "ioc_refs", "tags")
_ALL = (*_STRINGS, *_NULLABLE, *_ARRAYS, "details", "confidence", "raw_ref")


class InvalidEventsError(ValueError):
    """A line is no valid canonical event, or its id does not match its content."""


def read_checked(
    spark: SparkSession, path: str, namespaces: Namespaces = DEFAULT_NAMESPACES
) -> DataFrame:
    """Every line as an event with a nullable ``reason`` for what is wrong with it."""
    lines = read_lines(spark, path).filter(strip(F.col("value")) != "")
    parsed = lines.withColumn("_object", F.try_parse_json("value"))

    def item(name: str):
        return F.try_variant_get("_object", f"$.{name}", "variant")

    def kind(name: str):
        return F.coalesce(F.schema_of_variant(item(name)), F.lit("MISSING"))

    keys = F.map_keys(F.try_variant_get("_object", "$", "map<string,variant>"))
    shape = F.when(
        ~F.coalesce(F.schema_of_variant("_object").startswith("OBJECT"), F.lit(False)),
        F.lit("not a JSON object"),
    ).when(F.size(F.array_except(keys, F.array(*map(F.lit, _ALL)))) > 0, F.lit("unknown field"))
    for name in _STRINGS:
        shape = shape.when(kind(name) != "STRING", F.lit(f"{name} must be a string"))
    for name in _NULLABLE:
        shape = shape.when(~kind(name).isin("STRING", "VOID"), F.lit(f"{name} must be a string or null"))
    for name in _ARRAYS:
        shape = shape.when(~kind(name).startswith("ARRAY"), F.lit(f"{name} must be an array"))
    for name in ("details", "raw_ref"):
        shape = shape.when(~kind(name).startswith("OBJECT"), F.lit(f"{name} must be an object"))
    confidence = F.try_variant_get("_object", "$.confidence", "double")
    shape = shape.when(
        kind("confidence").isin("STRING", "BOOLEAN", "VOID", "MISSING"),
        F.lit("confidence must be a number"),
    )
    techniques = F.from_json(F.to_json(item("attack_techniques")), TECHNIQUES)
    rows = parsed.select(
        *[F.try_variant_get("_object", f"$.{n}", "string").alias(n) for n in (*_STRINGS, *_NULLABLE)],
        D.from_variant(item("details")).alias("details"),
        techniques.alias("attack_techniques"),
        F.try_variant_get("_object", "$.ioc_refs", "array<string>").alias("ioc_refs"),
        confidence.alias("confidence"),
        F.struct(
            F.try_variant_get("_object", "$.raw_ref.source_file", "string").alias("source_file"),
            F.try_variant_get("_object", "$.raw_ref.record", "string").alias("record"),
        )
        .cast(RAW_REF)
        .alias("raw_ref"),
        F.try_variant_get("_object", "$.tags", "array<string>").alias("tags"),
        position(0).alias("ord"),
        shape.alias("_shape"),
    )
    real = F.col("datetime").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$")
    rows = rows.withColumn(
        "ts",
        F.when(real, F.rtrim(F.col("datetime"), F.lit("Z")).try_cast("timestamp_ntz")).cast(
            "timestamp"
        ),
    ).withColumnRenamed("event_id", "_provided")
    checked = with_identity(rows, namespaces)
    reason = (
        F.when(F.col("_shape").isNotNull(), F.col("_shape"))
        .when(F.col("ts").isNull(), F.lit("datetime is not a real UTC instant"))
        .otherwise(
            F.coalesce(
                first_violation(),
                F.when(
                    F.col("_provided") != F.col("event_id"),
                    F.concat(
                        F.lit("event_id mismatch: provided "),
                        F.col("_provided"),
                        F.lit(" but the content gives "),
                        F.col("event_id"),
                    ),
                ),
            )
        )
    )
    return checked.withColumn("reason", reason).select(*EVENT_COLUMNS, "reason")


def read(
    spark: SparkSession, path: str, namespaces: Namespaces = DEFAULT_NAMESPACES
) -> DataFrame:
    """Valid saved events, the last line winning on a repeated id. Any bad line fails."""
    rows = materialize(read_checked(spark, path, namespaces), "saved-events")
    bad = rows.filter(F.col("reason").isNotNull()).select("ord", "reason").limit(1).collect()
    if bad:
        raise InvalidEventsError(bad[0]["reason"])
    payload = F.struct(*[F.col(name) for name in EVENT_COLUMNS if name != "event_id"])
    last = rows.groupBy("event_id").agg(F.max_by(payload, F.col("ord")).alias("_last"))
    return last.select("event_id", "_last.*").select(*EVENT_COLUMNS)
