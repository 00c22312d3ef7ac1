"""The given tables in the shape of tool exports, as plain projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.operators import normalize as N
from timeloom.session import materialize, prepare
from timeloom.sources import catalog, generic
from timeloom.sources.common import reference, table_position

TIMELINE_MAP = generic.ColumnMap(
    timestamp="when",
    message_column="note",
    host_column="machine",
    principal_column="account",
    object_column="target",
    action_column="label",
    default_timestamp_desc="logged",
    source_artifact="events",
    detail_columns=("level", "props"),
)

LABELS = {
    "click": "Process Create",
    "purchase": "Service Install",
    "signup": "account create",
    "error": "PROCESS-ACCESS",
    "view": "File Read",
}
TARGETS = (
    "C:\\Windows\\System32\\WindowsPowerShell\\v1.0\\powershell.exe",
    "C:\\Windows\\System32\\lsass.exe",
    "C:\\Program Files\\7-Zip\\7z.exe",
    "HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\Updater",
)
TACTICS = [
    ("TA0002", "execution", "Execution"),
    ("TA0003", "persistence", "Persistence"),
    ("TA0006", "credential-access", "Credential Access"),
    ("TA0009", "collection", "Collection"),
    ("TA0040", "impact", "Impact"),
]
TECHNIQUES = [
    ("T1003", "OS Credential Dumping", ["credential-access"], False, None),
    ("T1003.001", "LSASS Memory", ["credential-access"], False, None),
    ("T1043", "Commonly Used Port", ["impact"], True, None),
    ("T1059", "Command and Scripting Interpreter", ["execution"], False, None),
    ("T1059.001", "PowerShell", ["execution"], False, None),
    ("T1070.001", "Clear Windows Event Logs", [], False, "T1685.005"),
    ("T1136", "Create Account", ["persistence"], False, None),
    ("T1543.003", "Windows Service", ["execution", "persistence"], False, None),
    ("T1560.001", "Archive via Utility", ["collection"], False, None),
    ("T1685.005", "Clear Event Logs", ["impact"], False, None),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as its files are split."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows in as many parts as a shuffle has: few files would mean few tasks for costly rows."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts)


def by_value(key: Column, options: dict[str, str]) -> Column:
    result = F.lit(None).cast("string")
    for name, text in options.items():
        result = F.when(key == name, F.lit(text)).otherwise(result)
    return result


def by_index(index: Column, options: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (index + 1).cast("int"))


def account() -> Column:
    service = F.concat(F.lit("CORP\\svc"), (F.col("user_id") % 5).cast("string"))
    return (
        F.when(F.col("event_type") == "view", F.lit(None))
        .when(F.col("event_type") == "error", F.lit("NT AUTHORITY\\SYSTEM"))
        .otherwise(service)
    )


def level() -> Column:
    value = F.col("value")
    return (
        F.when(value >= 80, F.lit("crit"))
        .when(value >= 40, F.lit("High"))
        .when(value >= 20, F.lit("med"))
        .when(value >= 10, F.lit("low"))
        .when(value >= 5, F.lit(" Info "))
        .otherwise(F.lit("none"))
    )


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a text export, every row."""
    events = table(spark, sf_dir, "events")
    note = F.concat(
        F.lit("seen 10."),
        (F.col("user_id") % 7).cast("string"),
        F.lit("."),
        (F.col("user_id") % 11).cast("string"),
        F.lit(".9 via host"),
        (F.col("user_id") % 13).cast("string"),
        F.lit(".example.com"),
    )
    return events.select(
        "event_id",
        F.col("ts").cast("string").alias("when"),
        F.concat(F.lit("HOST-"), (F.col("user_id") % 3).cast("string")).alias("machine"),
        account().alias("account"),
        by_value(F.col("event_type"), LABELS).alias("label"),
        by_index(F.col("user_id") % 4, TARGETS).alias("target"),
        note.alias("note"),
        level().alias("level"),
        "props",
    )


def timeline_rows(spark: SparkSession, sf_dir: str) -> N.Normalized:
    raw = generic.from_table(export(spark, sf_dir), TIMELINE_MAP, "event_id", "events")
    return N.normalize(generic.map_rows(raw, TIMELINE_MAP))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events of the whole event table."""
    return materialize(timeline_rows(spark, sf_dir).events, "timeline")


def seed_catalog(spark: SparkSession) -> catalog.Catalog:
    return catalog.from_rows(spark, TACTICS, TECHNIQUES, "19.2")


WINDOWS_IDS = {"click": "4688", "purchase": "7045", "signup": "4720", "error": "10", "view": "x9"}
WINDOWS_CHANNELS = {
    "click": "Sec",
    "purchase": "System",
    "signup": "",
    "error": "Sysmon",
    "view": "App",
}


def detections(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """The event table as a detection timeline; ``second`` is another rule's pass over it."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    user = F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string"))
    path = by_index(F.col("user_id") % 4, TARGETS)
    service = F.concat(F.lit("Svc"), (F.col("user_id") % 9).cast("string"))
    details = (
        F.when(
            kind == "click",
            F.concat(F.lit("Proc: "), path, F.lit(" ¦ User: "), user, F.lit(" ¦ LID: n/a")),
        )
        .when(kind == "purchase", F.concat(F.lit("Svc: "), service, F.lit(" ¦ Path: "), path))
        .when(kind == "signup", F.concat(F.lit("TargetUserName: "), user, F.lit(" ¦ noise")))
        .when(
            kind == "error",
            F.concat(F.lit("TgtProc: "), path, F.lit(" ¦ SrcUser: CORP\\"), user),
        )
        .otherwise(F.lit("-"))
    )
    extra = F.when(kind == "click", F.lit("SubjectDomainName: CORP")).otherwise(
        F.lit("SubjectUserName: - ¦ Other: 1")
    )
    if second:
        title = F.concat(F.lit("Second rule "), (F.col("user_id") % 4).cast("string"))
        tags = F.concat(F.lit("T1136 ¦ T1059.001 ¦ T"), (1000 + F.col("user_id") % 3).cast("string"))
    else:
        title = F.when(
            kind != "view", F.concat(F.lit("First rule "), (F.col("user_id") % 6).cast("string"))
        ).otherwise(F.lit("-"))
        tags = (
            F.when(kind == "click", F.lit("t1059.001 ¦ T1070.001 ¦ G0016"))
            .when(kind == "error", F.lit("T1043 ¦ T9999 ¦ - ¦ T1070.001 ¦ T1685.005"))
            .otherwise(F.lit(""))
        )
    return events.select(
        F.concat(F.col("ts").cast("string"), F.lit(" +02:00")).alias("Timestamp"),
        F.concat(F.lit("HOST-"), (F.col("user_id") % 3).cast("string")).alias("Computer"),
        by_value(kind, WINDOWS_CHANNELS).alias("Channel"),
        by_value(kind, WINDOWS_IDS).alias("EventID"),
        level().alias("Level"),
        F.col("event_id").cast("string").alias("RecordID"),
        title.alias("RuleTitle"),
        F.lit("").alias("EvtxFile"),
        tags.alias("MitreTags"),
        details.alias("Details"),
        extra.alias("ExtraFieldInfo"),
        F.concat(F.lit("log-"), F.lit("2" if second else "1")).alias("source_artifact_file"),
        "event_id",
    )


def detection_rows(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """Raw detection rows straight from the table, without a file in between."""
    df = detections(spark, sf_dir, second)
    return df.withColumns(
        {
            "source_artifact": F.lit("Detections.evtx"),
            "raw_ref": reference(F.col("source_artifact_file"), F.col("RecordID")),
            "ord": table_position(F.col("event_id"), 1 if second else 0),
        }
    )
