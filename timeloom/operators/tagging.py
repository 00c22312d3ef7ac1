"""Technique tags: the source's own, resolved against a catalog, else by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions import details as D
from timeloom.functions.text import strip
from timeloom.operators.skew import join_counted
from timeloom.schema import DETECTION_TOOLS, TECHNIQUE_PATTERN, TECHNIQUES
from timeloom.session import materialize

#: Up to this many revoked ids are one map in every task.
CATALOG_ROWS = 5_000
RULE_TAG, MAPPING_TABLE = "rule_tag", "mapping_table"

# The inference rules in order, as (technique, verb, how the lower-cased
# object must end or what it must contain).
RULES = (
    ("T1053.005", "scheduled_task_create", None, ()),
    ("T1053.005", "process_create", "ends", ("\\schtasks.exe",)),
    ("T1543.003", "service_install", None, ()),
    ("T1003.001", "process_access", "ends", ("\\lsass.exe",)),
    ("T1547.001", "registry_set", "contains", ("\\currentversion\\run",)),
    ("T1021.002", "network_share_access", "ends", ("\\admin$", "\\c$")),
    (
        "T1059.001",
        "process_create",
        "ends",
        ("\\powershell.exe", "\\pwsh.exe", "\\powershell_ise.exe"),
    ),
    (
        "T1560.001",
        "process_create",
        "ends",
        ("\\7z.exe", "\\7za.exe", "\\rar.exe", "\\winrar.exe"),
    ),
    ("T1047", "process_create", "ends", ("\\wmic.exe",)),
    ("T1685.005", "log_clear", None, ()),
    ("T1055", "remote_thread_create", None, ()),
    ("T1136", "account_create", None, ()),
)


def _rule_holds(verb: str, how: str | None, needles: tuple[str, ...]) -> Column:
    target = F.lower(F.coalesce("object", F.lit("")))
    holds = F.col("action") == verb
    if how is None:
        return holds
    tests = [target.endswith(n) if how == "ends" else target.contains(n) for n in needles]
    matched = tests[0]
    for test in tests[1:]:
        matched = matched | test
    return holds & matched


def rule_techniques() -> Column:
    """The techniques the rules assign, in rule order, without repeats.

    Twelve constant rules are a projection; no join is needed.
    """
    matches = F.array(
        *[F.when(_rule_holds(verb, how, needles), F.lit(tid)) for tid, verb, how, needles in RULES]
    )
    ids = F.array_distinct(F.filter(matches, lambda tid: tid.isNotNull()))
    return F.transform(ids, lambda tid: _technique(tid, MAPPING_TABLE, F.lit(None)))


def _technique(technique_id: Column, mapping_source: str, source_id: Column) -> Column:
    return F.struct(
        technique_id.alias("technique_id"),
        F.lit(mapping_source).alias("mapping_source"),
        source_id.cast("string").alias("source_id"),
    )


def _with_native(events: DataFrame, successors: DataFrame | None) -> DataFrame:
    """Add ``_native``: a source's own tags as techniques, revoked ids by their successors.

    Well-formed ids only. The first tag to resolve to an id keeps its place; the id it was
    written as is kept when it was replaced. Tags are resolved within the row, from one map of
    the revoked ids, so no event moves; more than ``CATALOG_ROWS`` revoked ids are joined.
    """
    tags = D.values(F.col("details"), "rule_mitre_tags")
    written = F.filter(F.transform(tags, lambda t: F.upper(strip(t))), lambda t: t.rlike(TECHNIQUE_PATTERN))
    keyed = events.withColumn("_tags", F.when(F.size(tags) > 0, written))
    if successors is None:
        found = F.transform("_tags", lambda t: _technique(t, RULE_TAG, F.lit(None)))
        return _filled(keyed.withColumn("_found", _first_per_id(found)))
    lives = (
        successors.filter(F.col("technique_id").isNotNull())
        .groupBy("technique_id")
        .agg(F.array_sort(F.collect_set(F.coalesce("revoked_by", "technique_id"))).alias("live"))
    )
    if lives.limit(CATALOG_ROWS + 1).count() > CATALOG_ROWS:
        return _joined_native(keyed, lives)
    known = lives.agg(F.map_from_entries(F.collect_list(F.struct("technique_id", "live")))).scalar()
    asked = keyed.withColumn("_known", known)
    found = F.flatten(F.transform("_tags", lambda t: _resolved(t, F.try_element_at(F.col("_known"), t))))
    return _filled(asked.withColumn("_found", _first_per_id(found)).drop("_known"))


def _resolved(requested: Column, live: Column) -> Column:
    """The techniques one written id stands for: its successors, or itself."""
    source = lambda i: F.when(i != requested, requested)
    return F.transform(F.coalesce(live, F.array(requested)), lambda i: _technique(i, RULE_TAG, source(i)))


def _first_per_id(techniques: Column) -> Column:
    """Techniques without those whose id came before."""
    return F.aggregate(
        techniques,
        F.array().cast(TECHNIQUES),
        lambda seen, new: F.when(F.exists(seen, lambda old: old["technique_id"] == new["technique_id"]), seen).otherwise(
            F.concat(seen, F.array(new)).cast(TECHNIQUES)
        ),
    )


def _filled(found: DataFrame) -> DataFrame:
    return found.withColumn("_native", F.coalesce("_found", F.array().cast(TECHNIQUES))).drop("_tags", "_found")


def _joined_native(keyed: DataFrame, lives: DataFrame) -> DataFrame:
    """As ``_with_native``, by joins. Lists of tags recur: each distinct one is resolved once,
    frequent ones meet their rows where they lie, and rows without tags join nothing."""
    tagged = F.coalesce(F.size("_tags") > 0, F.lit(False))
    lists = materialize(keyed.filter(tagged).groupBy("_tags").agg(F.count("*").alias("_n")), "tag-lists")
    asked = lists.select("_tags", F.posexplode("_tags").alias("_position", "technique_id"))
    pieces = asked.join(lives, "technique_id", "left").select(
        "_tags", F.struct("_position", _resolved(F.col("technique_id"), F.col("live")).alias("techniques")).alias("piece")
    )
    gathered = pieces.groupBy("_tags").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    found = _first_per_id(F.flatten(F.transform("pieces", lambda p: p["techniques"])))
    native = materialize(gathered.withColumn("_found", found).join(lists, "_tags").select("_tags", "_found", "_n"), "tag-lists")
    nothing = F.array().cast(TECHNIQUES).alias("_found")
    return _filled(
        join_counted(keyed.filter(tagged), native, "_tags", "_n").unionByName(keyed.filter(~tagged).select("*", nothing))
    )


def merge_techniques(existing: Column, added: Column) -> Column:
    """Existing techniques, then the added ones whose (id, source) is not there yet."""
    fresh = F.filter(
        added,
        lambda new: ~F.exists(
            existing,
            lambda old: (old["technique_id"] == new["technique_id"])
            & (old["mapping_source"] == new["mapping_source"]),
        ),
    )
    return F.concat(existing, fresh)


def tag_events(
    events: DataFrame, successors: DataFrame | None = None, use_rule_tags: bool = True
) -> DataFrame:
    """Set ``attack_techniques``; tagging a tagged event changes nothing.

    ``successors`` pairs revoked ids with live ones (``technique_id, revoked_by``; see
    ``sources.catalog``). With ``use_rule_tags=False`` every event gets the inference
    rules only, which is a projection.
    """
    table = rule_techniques()
    if use_rule_tags:
        staged = _with_native(events, successors)
        resolved = F.when(
            (F.size("_native") > 0) | F.col("source_tool").isin(*DETECTION_TOOLS), F.col("_native")
        ).otherwise(table)
    else:
        staged, resolved = events, table
    staged = staged.withColumn("_resolved", resolved.cast(TECHNIQUES))
    merged = merge_techniques(F.col("attack_techniques"), F.col("_resolved"))
    return staged.select(
        *[
            merged.cast(TECHNIQUES).alias(name) if name == "attack_techniques" else F.col(name)
            for name in events.columns
        ]
    )
