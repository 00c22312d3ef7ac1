"""The canonical event: field types, vocabularies and namespaces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Namespaces:
    """Prefixes hashed into derived ids.

    Ids from a store built under other prefixes are reproduced by passing those
    prefixes here.
    """

    event: str = "timeloom-event-v1"
    episode: str = "timeloom-episode-v1"
    indicator: str = "timeloom-indicator-v1"


DEFAULT_NAMESPACES = Namespaces()

# The closed vocabularies of the canonical event.
TIMESTAMP_DESCS = ("accessed", "created", "logged", "modified", "other")
SOURCE_TOOLS = (
    "chainsaw",
    "dissect",
    "eztools",
    "generic_csv",
    "hayabusa",
    "plaso",
    "velociraptor",
)
DETECTION_TOOLS = ("hayabusa", "chainsaw")
ACTION_PATTERN = r"^[a-z][a-z0-9_]*$"
TECHNIQUE_PATTERN = r"^T\d{4}(?:\.\d{3})?$"
EVENT_ID_PATTERN = r"^[0-9a-f]{64}$"

# The recommended verbs, in alphabetical order.
KNOWN_ACTIONS = (
    "account_create",
    "account_modify",
    "dns_query",
    "file_create",
    "file_delete",
    "file_metadata_change",
    "file_read",
    "file_rename",
    "file_write",
    "log_clear",
    "logoff",
    "logon",
    "logon_failure",
    "network_connect",
    "network_listen",
    "network_share_access",
    "other",
    "privilege_use",
    "process_access",
    "process_create",
    "process_terminate",
    "registry_delete",
    "registry_set",
    "remote_thread_create",
    "scheduled_task_create",
    "service_control",
    "service_install",
)

RAW_REF = T.StructType(
    [T.StructField("source_file", T.StringType()), T.StructField("record", T.StringType())]
)

# Position of a record: input, file, split within the file, row within the task,
# and the sub-record when one row yields several.
ORD = T.StructType(
    [
        T.StructField("input", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("split", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("sub", T.IntegerType()),
    ]
)

TECHNIQUES = T.ArrayType(
    T.StructType(
        [
            T.StructField("technique_id", T.StringType()),
            T.StructField("mapping_source", T.StringType()),
            T.StructField("source_id", T.StringType()),
        ]
    )
)

# Details are at most two levels deep: scalars, lists of strings, maps of strings.
SCALARS = T.MapType(T.StringType(), T.StringType())
LISTS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
MAPS = T.MapType(T.StringType(), SCALARS)
DETAILS = T.StructType(
    [
        T.StructField("scalars", SCALARS),
        T.StructField("lists", LISTS),
        T.StructField("maps", MAPS),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("datetime", T.StringType()),
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
        T.StructField("attack_techniques", TECHNIQUES),
        T.StructField("ioc_refs", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("raw_ref", RAW_REF),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("ord", ORD),
    ]
)
EVENT_COLUMNS = tuple(EVENT.fieldNames())
