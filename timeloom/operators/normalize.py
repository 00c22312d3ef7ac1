"""Mapped rows to canonical events, provenance and problems."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions import details as D
from timeloom.functions.identity import event_id, packed, unpacked
from timeloom.functions.text import quote, strip
from timeloom.functions.timestamps import canonical_datetime
from timeloom.operators.skew import join_counted
from timeloom.schema import (
    ACTION_PATTERN,
    DEFAULT_NAMESPACES,
    EVENT,
    EVENT_COLUMNS,
    SOURCE_TOOLS,
    TECHNIQUES,
    TIMESTAMP_DESCS,
    Namespaces,
)
from timeloom.session import materialize


@dataclass(frozen=True)
class Normalized:
    """The three tables a normalization yields."""

    events: DataFrame
    provenance: DataFrame
    problems: DataFrame


def first_violation() -> Column:
    """The first canonical rule a row breaks, or null."""

    def blank(name: str) -> Column:
        return F.coalesce(strip(F.col(name)), F.lit("")) == ""

    def broken(text: str) -> Column:
        return F.lit(f"could not build a canonical event: {text}")

    confidence = F.col("confidence")
    return (
        F.when(blank("timestamp_raw"), broken("timestamp_raw must be a non-empty string"))
        .when(blank("source_timezone"), broken("source_timezone must be a non-empty string"))
        .when(blank("message"), broken("message must be a non-empty string"))
        .when(blank("source_artifact"), broken("source_artifact must be a non-empty string"))
        .when(
            ~F.coalesce(F.col("timestamp_desc").isin(*TIMESTAMP_DESCS), F.lit(False)),
            F.concat(
                broken(f"timestamp_desc must be one of {list(TIMESTAMP_DESCS)}, got "),
                quote(F.coalesce("timestamp_desc", F.lit(""))),
            ),
        )
        .when(
            ~F.coalesce(F.col("source_tool").isin(*SOURCE_TOOLS), F.lit(False)),
            F.concat(
                F.lit("no mapper registered for source_tool "),
                quote(F.coalesce("source_tool", F.lit(""))),
            ),
        )
        .when(
            ~F.coalesce(F.col("action").rlike(ACTION_PATTERN), F.lit(False)),
            F.concat(
                broken("action must be a snake_case verb like process_create, got "),
                quote(F.coalesce("action", F.lit(""))),
            ),
        )
        .when(
            ~F.coalesce(confidence.between(0.0, 1.0), F.lit(False)),
            broken("confidence must be between 0 and 1"),
        )
        .when(
            (F.coalesce(strip(F.col("raw_ref.source_file")), F.lit("")) == "")
            | (F.coalesce(strip(F.col("raw_ref.record")), F.lit("")) == ""),
            broken("raw_ref must name a file and a record"),
        )
    )


def with_identity(df: DataFrame, namespaces: Namespaces = DEFAULT_NAMESPACES) -> DataFrame:
    """Add ``datetime`` and the content-derived ``event_id`` to rows with a ``ts``."""
    timed = df.withColumn("datetime", canonical_datetime(F.col("ts")))
    identity = event_id(
        namespaces.event,
        {
            name: F.col(name)
            for name in (
                "action",
                "datetime",
                "host",
                "object",
                "principal",
                "source_artifact",
                "source_tool",
                "timestamp_desc",
            )
        },
    )
    return timed.withColumn("event_id", identity)


def to_events(mapped: DataFrame, namespaces: Namespaces = DEFAULT_NAMESPACES) -> DataFrame:
    """Every accepted row as a canonical event, duplicates included, plus rejects.

    Rejected rows keep their ``reason`` and have no event id.
    """
    checked = mapped.withColumn("reason", F.coalesce("reason", first_violation()))
    identified = with_identity(checked, namespaces)
    identified = identified.withColumn(
        "event_id", F.when(F.col("reason").isNull(), F.col("event_id"))
    )
    return (
        identified.withColumn("attack_techniques", F.array().cast(TECHNIQUES))
        .withColumn("ioc_refs", F.array().cast("array<string>"))
        .withColumn("tags", F.array().cast("array<string>"))
        .select(*EVENT_COLUMNS, "reason")
    )


def problem_rows(rows: DataFrame) -> DataFrame:
    """The reject table: where a row came from and why it was refused."""
    return rows.filter(F.col("reason").isNotNull()).select(
        "source_tool", "raw_ref", "ord", "reason"
    )


def provenance_rows(rows: DataFrame) -> DataFrame:
    """One row per source record of an event, in reading order by ``ord``.

    Kept in long form: a group of copies of any size stays spread over the cluster.
    """
    return rows.filter(F.col("reason").isNull()).select("event_id", "ord", "raw_ref")


def deduplicate(rows: DataFrame) -> DataFrame:
    """One event per id: the first record survives, detection details are merged.

    Only ids and positions are aggregated. Ids that occur once pass through; for the
    others the row at the first position stays, and only their copies are looked at for
    tags and titles. These are first reduced to the distinct combinations per event, then
    gathered: what is gathered is bounded by the rules that can fire on one event, not
    by its number of copies.
    """
    good = rows.filter(F.col("reason").isNull()).select(*EVENT_COLUMNS)
    repeated = (
        good.groupBy(packed(F.col("event_id")).alias("_id"))
        .agg(F.min("ord").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .select(unpacked(F.col("_id")).alias("event_id"), "_first", "_n")
    )
    repeated = materialize(repeated, "repeated")
    if repeated.isEmpty():
        return good
    # One event may have any share of the rows as copies.
    placed = join_counted(good, repeated, "event_id", "_n")
    first = placed.filter(F.col("_first").isNull() | (F.col("ord") == F.col("_first"))).drop("_first")
    detections = (
        placed.filter(F.col("_first").isNotNull())
        .select(
            "event_id",
            "ord",
            F.coalesce(
                D.values(F.col("details"), "rule_mitre_tags"), F.array().cast("array<string>")
            ).alias("tags"),
            D.scalar(F.col("details"), "rule_title").alias("title"),
        )
        .filter((F.size("tags") > 0) | F.col("title").isNotNull())
    )
    combinations = detections.groupBy("event_id", "tags", "title").agg(F.min("ord").alias("ord"))
    merged = combinations.groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "tags", "title"))).alias("_seen")
    )
    return _merge_details(first.join(merged, "event_id", "left")).select(*EVENT_COLUMNS)


def _merge_details(joined: DataFrame) -> DataFrame:
    seen = F.col("_seen")
    tags = F.array_distinct(F.flatten(F.transform(seen, lambda item: item["tags"])))
    titles = F.array_distinct(
        F.filter(F.transform(seen, lambda item: item["title"]), lambda title: title.isNotNull())
    )
    staged = joined.withColumn("_tags", tags).withColumn("_titles", titles)
    kept_title = F.coalesce(D.scalar(F.col("details"), "rule_title"), F.get("_titles", F.lit(0)))
    staged = staged.withColumn("_title", kept_title)
    others = F.filter("_titles", lambda title: title != F.col("_title"))
    details = F.struct(
        D.with_entry(F.col("details.scalars"), "rule_title", F.col("_title")).alias("scalars"),
        D.with_entry(
            D.with_entry(
                F.col("details.lists"),
                "rule_mitre_tags",
                F.when(F.size("_tags") > 0, F.col("_tags")),
            ),
            "additional_rule_titles",
            F.when(F.size(others) > 0, others),
        ).alias("lists"),
        F.col("details.maps").alias("maps"),
    ).cast(EVENT["details"].dataType)
    # Nothing to merge when the only detection seen is the surviving row's own.
    own = (F.size(seen) == 1) & (F.get(seen, F.lit(0))["ord"] == F.col("ord"))
    unchanged = seen.isNull() | own
    return staged.withColumn("details", F.when(unchanged, F.col("details")).otherwise(details))


def normalize(mapped: DataFrame, namespaces: Namespaces = DEFAULT_NAMESPACES) -> Normalized:
    """Mapped rows to de-duplicated events, provenance and problems.

    The rows are written once and all three tables read that copy: the exports are
    parsed a single time, and no filter on a derived column is pushed into its parsing.
    """
    rows = materialize(to_events(mapped, namespaces), "rows")
    return Normalized(deduplicate(rows), provenance_rows(rows), problem_rows(rows))


def duplicate_count(provenance: DataFrame, events: DataFrame) -> DataFrame:
    """One row: how many records collapsed into an event already seen."""
    return (
        provenance.agg(F.count("*").alias("n"))
        .unionAll(events.agg((-F.count("*")).alias("n")))
        .agg(F.sum("n").alias("duplicates"))
    )
