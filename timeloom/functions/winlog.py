"""Event-log records to verb, actor and object, through one rule table per channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.functions.text import placeholder_to_null, strip

SECURITY = "Security"
SYSTEM = "System"
SYSMON = "Microsoft-Windows-Sysmon/Operational"
TASK_SCHEDULER = "Microsoft-Windows-TaskScheduler/Operational"

MAPPED_CONFIDENCE = 1.0
FALLBACK_CONFIDENCE = 0.5

_SUBJECT = ("SubjectUserName", "SubjectDomainName")
_TARGET = ("TargetUserName", "TargetDomainName")
_USER = ("User", None)
_SOURCE_USER = ("SourceUser", None)
_NOBODY = (None, None)

# Fixed values: (channel, event id, verb, constant object, object is an endpoint, object
# fields in order, actor fields).
RULES = (
    (SECURITY, 1102, "log_clear", "Security", False, (), _SUBJECT),
    (SECURITY, 4624, "logon", None, False, ("IpAddress",), _TARGET),
    (SECURITY, 4625, "logon_failure", None, False, ("IpAddress",), _TARGET),
    (SECURITY, 4688, "process_create", None, False, ("NewProcessName",), _SUBJECT),
    (SECURITY, 4689, "process_terminate", None, False, ("ProcessName",), _SUBJECT),
    (SECURITY, 4697, "service_install", None, False, ("ServiceName",), _SUBJECT),
    (SECURITY, 4698, "scheduled_task_create", None, False, ("TaskName",), _SUBJECT),
    (SECURITY, 4720, "account_create", None, False, ("TargetUserName",), _SUBJECT),
    (SECURITY, 5140, "network_share_access", None, False, ("ShareName",), _SUBJECT),
    (SECURITY, 5145, "network_share_access", None, False, ("ShareName",), _SUBJECT),
    (SYSTEM, 104, "log_clear", None, False, ("Channel",), _SUBJECT),
    (SYSTEM, 7036, "service_control", None, False, ("param1", "ServiceName"), _NOBODY),
    (SYSTEM, 7040, "service_control", None, False, ("param4", "param1"), _NOBODY),
    (SYSTEM, 7045, "service_install", None, False, ("ServiceName",), _NOBODY),
    (SYSMON, 1, "process_create", None, False, ("Image",), _USER),
    (SYSMON, 3, "network_connect", None, True, (), _USER),
    (SYSMON, 8, "remote_thread_create", None, False, ("TargetImage",), _SOURCE_USER),
    (SYSMON, 10, "process_access", None, False, ("TargetImage",), _SOURCE_USER),
    (SYSMON, 11, "file_create", None, False, ("TargetFilename",), _USER),
    (SYSMON, 13, "registry_set", None, False, ("TargetObject",), _USER),
    (SYSMON, 22, "dns_query", None, False, ("QueryName",), _USER),
    (SYSMON, 23, "file_delete", None, False, ("TargetFilename",), _USER),
    (SYSMON, 26, "file_delete", None, False, ("TargetFilename",), _USER),
    (TASK_SCHEDULER, 106, "scheduled_task_create", None, False, ("TaskName",), ("UserContext", None)),
)

_RULE_SCHEMA = T.StructType(
    [
        T.StructField("_channel_key", T.StringType()),
        T.StructField("_event_number", T.LongType()),
        T.StructField("rule_action", T.StringType()),
        T.StructField("object_constant", T.StringType()),
        T.StructField("object_is_endpoint", T.BooleanType()),
        T.StructField("object_keys", T.ArrayType(T.StringType())),
        T.StructField("user_key", T.StringType()),
        T.StructField("domain_key", T.StringType()),
    ]
)


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules keyed for lookup; a blank channel finds the Security and System rules."""
    rows = []
    for channel, number, action, constant, endpoint, keys, (user, domain) in RULES:
        channel_keys = ["sysmon" if channel == SYSMON else channel.lower()]
        if channel in (SECURITY, SYSTEM):
            channel_keys.append("")
        rows += [
            (key, number, action, constant, endpoint, list(keys), user, domain)
            for key in channel_keys
        ]
    return spark.createDataFrame(rows, _RULE_SCHEMA)


def event_number(event_id: Column) -> Column:
    """The event id as a number, or null when it is not an integer."""
    text = strip(event_id)
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def event_id_text(event_id: Column) -> Column:
    """The event id in canonical form: the number when it is one, else the text."""
    return F.coalesce(event_number(event_id).cast("string"), strip(event_id), F.lit(""))


def lookup_rules(df: DataFrame, channel: Column, event_id: Column) -> DataFrame:
    """Add the rule columns for each row's channel and event id (null when uncovered).

    The table is fixed and tiny, so the lookup is a map-side join.
    """
    key = F.lower(strip(F.coalesce(channel, F.lit(""))))
    key = F.when(key.contains("sysmon"), F.lit("sysmon")).otherwise(key)
    keyed = df.withColumn("_channel_key", key).withColumn("_event_number", event_number(event_id))
    joined = keyed.join(
        F.broadcast(rule_table(df.sparkSession)), ["_channel_key", "_event_number"], "left"
    )
    return joined.drop("_channel_key", "_event_number")


def field(fields: Column, key: Column | str) -> Column:
    """A field's value, or null when absent, blank or a placeholder."""
    return placeholder_to_null(F.try_element_at(fields, F.lit(key) if isinstance(key, str) else key))


def actor(fields: Column) -> Column:
    """``DOMAIN\\user`` from the fields the joined rule names."""
    user = field(fields, F.col("user_key"))
    domain = field(fields, F.col("domain_key"))
    qualified = F.concat(domain, F.lit("\\"), user)
    return F.when(domain.isNotNull() & ~user.contains("\\"), qualified).otherwise(user)


def target(fields: Column) -> Column:
    """The object: a constant, an endpoint, or the first field with a value."""
    keys = F.col("object_keys")
    address = F.coalesce(field(fields, "DestinationIp"), field(fields, "DestinationHostname"))
    port = field(fields, "DestinationPort")
    endpoint = F.when(port.isNotNull(), F.concat(address, F.lit(":"), port)).otherwise(address)
    candidates = F.filter(
        F.transform(keys, lambda key: field(fields, key)), lambda value: value.isNotNull()
    )
    return (
        F.when(F.col("object_constant").isNotNull(), F.col("object_constant"))
        .when(F.col("object_is_endpoint"), endpoint)
        .otherwise(F.get(candidates, F.lit(0)))
    )


def action() -> Column:
    return F.coalesce(F.col("rule_action"), F.lit("other"))


def confidence() -> Column:
    return F.when(F.col("rule_action").isNotNull(), F.lit(MAPPED_CONFIDENCE)).otherwise(
        F.lit(FALLBACK_CONFIDENCE)
    )


def event_message(lead: Column, channel: Column, event_id: Column, host: Column) -> Column:
    """``<lead> event <id> on <host>`` for a record without a message of its own."""
    where = F.coalesce(host, F.nullif(channel, F.lit("")), F.lit("unknown host"))
    return F.concat(lead, F.lit(" event "), event_id, F.lit(" on "), where)
