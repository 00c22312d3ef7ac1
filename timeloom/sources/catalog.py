"""The technique catalog: tactics in matrix order, techniques and their successors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.session import materialize

TACTIC_SCHEMA = "position int, tactic_id string, shortname string, name string"
TECHNIQUE_SCHEMA = (
    "technique_id string, name string, display_name string, tactics array<string>, "
    "deprecated boolean, revoked_by string"
)


@dataclass(frozen=True)
class Catalog:
    """``tactics`` and ``techniques`` tables, and the release they come from."""

    tactics: DataFrame
    techniques: DataFrame
    version: str = ""

    def successors(self) -> DataFrame:
        """Revoked ids and their live successors: ``technique_id, revoked_by``."""
        return self.techniques.filter(F.col("revoked_by").isNotNull()).select(
            "technique_id", "revoked_by"
        )


def with_display_names(techniques: DataFrame) -> DataFrame:
    """Add ``display_name``: a sub-technique's name behind its parent's."""
    parents = techniques.select(
        F.col("technique_id").alias("_parent"), F.col("name").alias("_parent_name")
    )
    parent_id = F.when(
        F.col("technique_id").contains("."), F.substring_index("technique_id", ".", 1)
    )
    joined = techniques.withColumn("_parent", parent_id).join(parents, "_parent", "left")
    name = F.coalesce(
        F.concat(F.nullif("_parent_name", F.lit("")), F.lit(": "), F.col("name")), F.col("name")
    )
    return joined.withColumn("display_name", name).drop("_parent", "_parent_name")


def from_rows(
    spark: SparkSession,
    tactics: list[tuple[str, str, str]],
    techniques: list[tuple[str, str, list[str], bool, str | None]],
    version: str = "",
) -> Catalog:
    """A catalog from literal rows: ``(id, shortname, name)`` and
    ``(id, name, tactics, deprecated, revoked_by)``."""
    tactic_rows = [(i, *row) for i, row in enumerate(tactics)]
    plain = spark.createDataFrame(
        techniques,
        "technique_id string, name string, tactics array<string>, deprecated boolean, "
        "revoked_by string",
    )
    return Catalog(
        spark.createDataFrame(tactic_rows, TACTIC_SCHEMA), with_display_names(plain), version
    )


_STIX = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("x_mitre_version", T.StringType()),
        T.StructField("x_mitre_shortname", T.StringType()),
        T.StructField("x_mitre_deprecated", T.BooleanType()),
        T.StructField("revoked", T.BooleanType()),
        T.StructField("tactic_refs", T.ArrayType(T.StringType())),
        T.StructField("relationship_type", T.StringType()),
        T.StructField("source_ref", T.StringType()),
        T.StructField("target_ref", T.StringType()),
        T.StructField(
            "external_references",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("source_name", T.StringType()),
                        T.StructField("external_id", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "kill_chain_phases",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("kill_chain_name", T.StringType()),
                        T.StructField("phase_name", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def final_successors(patterns: DataFrame, revocations: DataFrame) -> DataFrame:
    """``(id, successor_id)``: each revocation chain followed to its live end.

    One self-join per round advances every unfinished chain at once; a chain that leads
    nowhere, or in a circle, ends without a successor.
    """
    step = revocations.groupBy("source_ref").agg(F.max_by("target_ref", "_order").alias("_next"))
    state = patterns.select(F.col("id").alias("_next"), F.col("revoked").alias("_revoked"))
    links = step.join(state, "_next", "left").select(
        F.col("source_ref").alias("_from"), "_next", "_revoked"
    )
    links = materialize(links, "revocations")
    # A link to an unknown pattern ends the chain without a successor.
    usable = links.filter(F.col("_revoked").isNotNull())
    jumps = usable.select(F.col("_from").alias("id"), F.col("_next").alias("at"), F.col("_revoked").alias("open"))
    # Every round doubles how far an unfinished chain has come, so after as many rounds as
    # the number of links has binary digits only circles are unfinished.
    for _ in range(links.count().bit_length() + 1):
        pending = jumps.filter("open")
        if pending.isEmpty():
            break
        further = jumps.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("open").alias("_open"))
        moved = pending.join(further, "at").select("id", F.col("_at").alias("at"), F.col("_open").alias("open"))
        jumps = materialize(jumps.filter("NOT open").unionByName(moved), "revocation-step")
    return jumps.filter("NOT open").select("id", F.col("at").alias("successor"))


def read_bundle(spark: SparkSession, path: str) -> Catalog:
    """The catalog of a published STIX bundle file."""
    bundle = spark.read.schema(T.StructType([T.StructField("objects", T.ArrayType(_STIX))])).json(
        path, multiLine=True
    )
    objects = bundle.select(F.posexplode("objects").alias("_order", "o")).select("_order", "o.*")
    objects = materialize(objects, "bundle")
    external = F.filter(
        "external_references",
        lambda ref: (ref["source_name"] == "mitre-attack")
        & (F.coalesce(ref["external_id"], F.lit("")) != ""),
    )
    external_id = F.get(external, F.lit(0))["external_id"]
    collections = objects.filter(F.col("type") == "x-mitre-collection").limit(2).collect()
    matrices = objects.filter(F.col("type") == "x-mitre-matrix").limit(2).collect()
    if len(collections) != 1 or len(matrices) != 1:
        raise ValueError("expected exactly one collection and one matrix in the bundle")
    tactics = (
        objects.filter(F.col("type") == "x-mitre-matrix")
        .select(F.posexplode("tactic_refs").alias("position", "id"))
        .join(
            objects.select(
                "id",
                external_id.alias("tactic_id"),
                F.col("x_mitre_shortname").alias("shortname"),
                "name",
            ),
            "id",
        )
        .select("position", "tactic_id", "shortname", "name")
    )
    patterns = objects.filter(F.col("type") == "attack-pattern").select(
        "id",
        "name",
        F.coalesce("revoked", F.lit(False)).alias("revoked"),
        F.coalesce("x_mitre_deprecated", F.lit(False)).alias("_deprecated"),
        external_id.alias("technique_id"),
        F.array_sort(
            F.array_distinct(
                F.transform(
                    F.filter(
                        F.coalesce("kill_chain_phases", F.array().cast(_STIX["kill_chain_phases"].dataType)),
                        lambda phase: phase["kill_chain_name"] == "mitre-attack",
                    ),
                    lambda phase: phase["phase_name"],
                )
            )
        ).alias("tactics"),
    )
    revocations = objects.filter(
        (F.col("type") == "relationship") & (F.col("relationship_type") == "revoked-by")
    ).select("source_ref", "target_ref", "_order")
    ends = final_successors(patterns, revocations).join(
        patterns.select(F.col("id").alias("successor"), F.col("technique_id").alias("revoked_by")),
        "successor",
    )
    techniques = (
        patterns.filter(F.col("technique_id").isNotNull())
        .join(ends.select("id", "revoked_by"), "id", "left")
        .select(
            "technique_id",
            "name",
            F.when(F.col("revoked"), F.array().cast("array<string>")).otherwise(F.col("tactics")).alias("tactics"),
            F.when(F.col("revoked"), F.col("revoked_by").isNull())
            .otherwise(F.col("_deprecated"))
            .alias("deprecated"),
            F.when(F.col("revoked"), F.col("revoked_by")).alias("revoked_by"),
        )
    )
    repeated = techniques.groupBy("technique_id").count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"duplicate technique id in bundle: {repeated[0]['technique_id']}")
    return Catalog(tactics, with_display_names(techniques), collections[0]["x_mitre_version"])
