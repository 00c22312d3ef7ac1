"""Claim documents: an object with a ``claims`` array, or a bare array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions.details import scalar_text
from timeloom.functions.text import blank_to_null, strip
from timeloom.schema import EVENT_ID_PATTERN
from timeloom.sources.common import read_documents

CLAIM_COLUMNS = (
    "index",
    "text",
    "citations",
    "malformed_citations",
    "asserts",
    "revises",
)


def strip_fence(text: Column) -> Column:
    """The document without one surrounding Markdown fence."""
    trimmed = strip(text)
    opened = F.regexp_replace(trimmed, r"^```[^\n\r]*(?:\r\n|\n|\r)?", "")
    closed = strip(F.regexp_replace(opened, r"(?:^|\r\n|\n|\r)[^\S\n\r]*```[^\S\n\r]*$", ""))
    return F.when(trimmed.startswith("```"), closed).otherwise(trimmed)


def well_formed(citations: Column) -> Column:
    """Valid event ids, trimmed and lower-cased, first-seen distinct."""
    lowered = F.transform(citations, lambda item: F.lower(strip(item)))
    return F.array_distinct(F.filter(lowered, lambda item: item.rlike(EVENT_ID_PATTERN)))


def malformed(citations: Column) -> Column:
    """The other citations, as they were written."""
    trimmed = F.transform(citations, strip)
    return F.filter(
        trimmed, lambda item: (item != "") & ~F.lower(item).rlike(EVENT_ID_PATTERN)
    )


def _text_of(value: Column) -> Column:
    """A JSON value as text: scalars bare, containers as JSON, null as null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.isNull() | (kind == "VOID"), F.lit(None))
        .when(kind == "BOOLEAN", F.initcap(scalar_text(value)))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(value))
        .otherwise(scalar_text(value))
    )


def parse(documents: DataFrame, value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Claim rows from one document per row; text that is no such document yields none.

    A document is one answer, so its claims are numbered inside the row that holds it.
    """
    parsed = documents.select(*keys, F.try_parse_json(strip_fence(F.col(value))).alias("_doc"))
    kind = F.schema_of_variant("_doc")
    entries = F.when(
        kind.startswith("OBJECT"), F.try_variant_get("_doc", "$.claims", "array<variant>")
    ).when(kind.startswith("ARRAY"), F.try_variant_get("_doc", "$", "array<variant>"))

    def text_of(entry: Column, path: str) -> Column:
        return _text_of(F.try_variant_get(entry, path, "variant"))

    usable = F.filter(
        entries,
        lambda entry: F.schema_of_variant(entry).startswith("OBJECT")
        & (F.coalesce(strip(text_of(entry, "$.text")), F.lit("")) != ""),
    )
    exploded = parsed.select(*keys, F.posexplode(usable).alias("index", "_claim"))
    claim = F.col("_claim")
    raw = F.try_variant_get(claim, "$.citations", "variant")
    listed = F.try_variant_get(claim, "$.citations", "array<variant>")
    cited = F.when(
        F.schema_of_variant(raw).startswith("ARRAY"),
        F.transform(listed, lambda item: F.coalesce(_text_of(item), F.lit("None"))),
    ).otherwise(F.filter(F.array(_text_of(raw)), lambda item: item.isNotNull()))

    def asserted(name: str) -> Column:
        return blank_to_null(text_of(claim, f"$.asserts.{name}")).alias(name)

    staged = exploded.withColumn("_cited", cited)
    return staged.select(
        *keys,
        "index",
        strip(text_of(claim, "$.text")).alias("text"),
        well_formed(F.col("_cited")).alias("citations"),
        malformed(F.col("_cited")).alias("malformed_citations"),
        F.struct(*[asserted(name) for name in ("datetime", "principal", "action", "object")]).alias(
            "asserts"
        ),
        blank_to_null(text_of(claim, "$.revises")).alias("revises"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Claims of one or many document files, keyed by file and index."""
    documents = read_documents(spark, path).withColumnRenamed("_file", "document")
    claims = parse(documents, "value", ("document",))
    return claims.withColumn(
        "claim_id", F.concat("document", F.lit("#"), F.col("index").cast("string"))
    )
