"""One function per query: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queries import inputs as I
from timeloom.functions import details as D
from timeloom.functions.phrasing import phrase
from timeloom.functions.severity import event_severity, severity_rank
from timeloom.functions.text import action_verb, json_string
from timeloom.functions.timestamps import add_timestamp, canonical_datetime
from timeloom.operators import episodes, indicators, normalize, rounds, scoring, tagging, views
from timeloom.operators.verify import verify_claims
from timeloom.plans import evaluate, outputs, report
from timeloom.plans.case import Case, EvidenceInput, analyze, case_from_events
from timeloom.schema import DEFAULT_NAMESPACES, TECHNIQUES
from timeloom.session import materialize, new_path, prepare
from timeloom.sources import (
    chainsaw,
    claims,
    dissect,
    events_jsonl,
    eztools,
    generic,
    hayabusa,
    plaso,
    velociraptor,
)
from timeloom.sources import catalog as catalog_source
from timeloom.sources.common import reference, table_position


def _joined(values: Column, separator: str = "|") -> Column:
    return F.array_join(values, separator)


def _new_folder(spark: SparkSession, label: str) -> str:
    return new_path(spark, label)


# --- identity, timestamps, duplicates -------------------------------------------------


def event_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.timeline_rows(spark, sf_dir).events
    return events.select(
        "event_id", "datetime", "source_timezone", "host", "principal", "action", "object", "message"
    )


def timestamp_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    shapes = [
        F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")),
        F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" -04:00")),
        F.date_format(ts, "MM/dd/yyyy HH:mm:ss"),
        F.concat(F.date_format(ts, "yyyy/MM/dd HH:mm:ss"), F.lit("+0530")),
        F.date_format(ts, "yyyyMMdd'T'HHmmss"),
        F.date_format(ts, "yyyy-MM-dd"),
        F.date_format(ts, "HH:mm:ss"),
        F.date_format(ts, "'99/99/9999 'HH:mm:ss"),
    ]
    options = F.array(*shapes)
    texts = I.table(spark, sf_dir, "events").select(
        "event_id", F.posexplode(options).alias("shape", "raw")
    )
    timed = add_timestamp(texts, F.col("raw"))
    return timed.select(
        "event_id",
        "shape",
        canonical_datetime(F.col("ts")).alias("datetime"),
        F.when(F.col("time_reason").isNull(), F.col("source_timezone")).alias("source_timezone"),
        F.col("time_reason").alias("reason"),
    )


def timestamp_free_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-two spellings of every event's time, in free order and with zone names, one of them no date."""
    ts = F.col("ts")
    day, month, year = (F.date_format(ts, x) for x in ("d", "MMM", "yyyy"))
    clock, short = F.date_format(ts, "HH:mm:ss"), F.date_format(ts, "HH:mm")
    noon = F.date_format(ts, "h:mm:ss a")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    shapes = [
        text(year, F.date_format(ts, "-MM-dd "), clock, " EST"),
        text(F.date_format(ts, "EEE "), day, " ", month, " ", year, " ", clock),
        text(F.date_format(ts, "EEE, d MMM yyyy "), clock, " -0500 (EST)"),
        text(day, "th of ", F.date_format(ts, "MMMM "), year, " at ", noon),
        text(F.date_format(ts, "MMMM "), day, "th, ", year, " ", noon, " PST"),
        text(year, " ", month, " ", day, " ", clock),
        text(year, "/", month, "/", day, " ", clock),
        text(day, ".", month, ".", year, " ", clock),
        text(month, "-", day, "-", year, " ", clock),
        text(F.date_format(ts, "MMM d "), clock, " EDT ", year),
        text(F.date_format(ts, "EEE MMM d "), clock, " UTC+2 ", year),
        text(F.date_format(ts, "yyyy-MM-dd "), clock, " GMT-03:00"),
        text(F.date_format(ts, "yyyy-MM-dd HH'h'mm'm'ss's'")),
        text(day, " ", month, " ", year, " ", F.date_format(ts, "h a")),
        text(short, " on ", day, " ", F.date_format(ts, "MMMM "), year),
        text(year, " ", day, " ", month, " ", clock),
        text(year, ". ", F.date_format(ts, "M"), ". ", day, ". ", clock),
        text(F.date_format(ts, "yyyy-MM-dd "), clock, " +5"),
        text(F.date_format(ts, "yyyy-MM-dd"), " at ", clock),
        text(F.date_format(ts, "yyyyMMdd "), short, " CET"),
        text(clock, " ", day, month, year),
        text(day, " ", F.lit("Foo"), " ", year, " ", clock),
    ]
    events = I.spread(I.table(spark, sf_dir, "events").select("event_id", "ts"))
    texts = events.select("event_id", F.posexplode(F.array(*shapes)).alias("shape", "raw"))
    timed = add_timestamp(texts, F.col("raw"))
    return timed.select(
        "event_id",
        "shape",
        canonical_datetime(F.col("ts")).alias("datetime"),
        F.when(F.col("time_reason").isNull(), F.col("source_timezone")).alias("source_timezone"),
    )


def dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = hayabusa.map_rows(I.detection_rows(spark, sf_dir)).unionByName(
        hayabusa.map_rows(I.detection_rows(spark, sf_dir, second=True))
    )
    result = normalize.normalize(both)
    copies = result.provenance.groupBy("event_id").agg(
        F.count("*").alias("records"),
        F.min(F.struct("ord", "raw_ref")).alias("first"),
    )
    details = F.col("details")
    return result.events.join(copies, "event_id").select(
        "event_id",
        "records",
        F.concat("first.raw_ref.source_file", F.lit("#"), "first.raw_ref.record").alias("first_ref"),
        D.scalar(details, "rule_title").alias("rule_title"),
        F.coalesce(_joined(D.values(details, "rule_mitre_tags")), F.lit("")).alias("tags"),
        F.coalesce(_joined(D.values(details, "additional_rule_titles")), F.lit("")).alias(
            "other_titles"
        ),
    )


def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hayabusa.map_rows(I.detection_rows(spark, sf_dir))
    again = hayabusa.map_rows(I.detection_rows(spark, sf_dir, second=True))
    result = normalize.normalize(rows.unionByName(again))
    return normalize.duplicate_count(result.provenance, result.events)


# --- mappings -------------------------------------------------------------------------


def _mapped_columns(df: DataFrame) -> DataFrame:
    rows = normalize.to_events(df)
    return rows.select(
        F.col("raw_ref.record").alias("record"),
        "event_id",
        canonical_datetime(F.col("ts")).alias("datetime"),
        "source_timezone",
        "timestamp_desc",
        "host",
        "principal",
        "action",
        "object",
        "source_artifact",
        "message",
        "confidence",
    )


def winevent_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped_columns(hayabusa.map_rows(I.detection_rows(spark, sf_dir)))


def detection_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = _new_folder(spark, "csv")
    export = I.detections(spark, sf_dir).drop("event_id", "source_artifact_file", "EvtxFile")
    export = export.withColumn("EvtxFile", F.lit("D:\\case\\Detections.evtx"))
    export.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    raw = hayabusa.read_timeline_csv(spark, path)
    return _mapped_columns(hayabusa.map_rows(raw))


def _json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = I.detections(spark, sf_dir).drop("event_id", "source_artifact_file", "EvtxFile")
    return df.withColumn("EvtxFile", F.lit("D:/case/Detections.evtx"))


def detection_jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = _new_folder(spark, "jsonl") + "/timeline.jsonl"
    export = _json_objects(spark, sf_dir)
    export.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return _mapped_columns(hayabusa.map_rows(hayabusa.read(spark, path)))


def detection_json_stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = _new_folder(spark, "json") + "/timeline.json"
    export = _json_objects(spark, sf_dir)
    text = F.to_json(F.struct("*"))
    spread = F.concat(F.lit("{\n"), F.substr(text, F.lit(2)))
    export.select(spread.alias("value")).write.text(path)
    return _mapped_columns(hayabusa.map_rows(hayabusa.read(spark, path)))


#: Events of one array; a longer table makes more arrays.
ARRAY_EVENTS = 3_000


def _array_lines(objects: DataFrame) -> DataFrame:
    """Lines of JSON arrays in order, from ``event_id`` and the ``text`` of each object; ``number`` tells the array."""
    number = F.lpad(F.floor(F.col("event_id") / ARRAY_EVENTS).cast("string"), 12, "0")
    held = objects.withColumn("number", number)
    order = Window.partitionBy("number").orderBy("event_id")
    begin = F.when(F.row_number().over(order) == 1, F.lit("[")).otherwise(F.lit(","))
    end = F.when(F.lead("event_id").over(order).isNull(), F.lit("]")).otherwise(F.lit(""))
    return held.select("number", "event_id", F.concat(begin, "text", end).alias("value")).sortWithinPartitions("number", "event_id")


def mixed_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder whose files hold JSON lines, one array each, or objects one after the other."""
    prepare(spark)
    path = _new_folder(spark, "mixed")
    export = I.detections(spark, sf_dir).drop("source_artifact_file", "EvtxFile")
    export = export.withColumn("EvtxFile", F.lit("D:/case/Detections.evtx"))
    names = [c for c in export.columns if c != "event_id"]
    text = F.to_json(F.struct(*names))
    kind = F.col("event_id") % 3
    spread = F.concat(F.lit("{\n"), F.substr(text, F.lit(2)))
    lines = export.filter(kind == 0).select(text.alias("value"), F.lit("lines").alias("form"))
    objects = export.filter(kind == 1).select(spread.alias("value"), F.lit("objects").alias("form"))
    arrays = _array_lines(export.filter(kind == 2).select("event_id", text.alias("text")))
    arrays = arrays.select("value", F.concat(F.lit("array-"), "number").alias("form"))
    for part in (lines, objects, arrays):
        part.write.partitionBy("form").mode("append").text(path)
    return _mapped_columns(hayabusa.map_rows(hayabusa.read_timeline_json(spark, path)))


def _log_fields() -> Column:
    user = F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string"))
    pairs = {
        "NewProcessName": I.by_index(F.col("user_id") % 4, I.TARGETS),
        "SubjectUserName": user,
        "SubjectDomainName": F.lit("CORP"),
        "DestinationIp": F.lit("-"),
        "DestinationHostname": F.concat(
            F.lit("h"), (F.col("user_id") % 13).cast("string"), F.lit(".example.org")
        ),
        "DestinationPort": F.lit("443"),
        "User": F.concat(F.lit("CORP\\"), user),
        "TaskName": F.lit(""),
        "UserContext": user,
    }
    return F.create_map(*[c for key, value in pairs.items() for c in (F.lit(key), value)])


LOG_IDS = {"click": "4688", "purchase": "3", "signup": "106", "error": "4688", "view": "7036"}
LOG_CHANNELS = {
    "click": "security",
    "purchase": "x-SYSMON-y",
    "signup": "Microsoft-Windows-TaskScheduler/Operational",
    "error": "Application",
    "view": "",
}


def log_row_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    raw = I.table(spark, sf_dir, "events").select(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("Timestamp"),
        F.concat(F.lit("HOST-"), (F.col("user_id") % 3).cast("string")).alias("Computer"),
        I.by_value(kind, LOG_CHANNELS).alias("Channel"),
        I.by_value(kind, LOG_IDS).alias("EventID"),
        F.when(kind == "error", F.lit("from the log")).otherwise(F.lit("-")).alias("Message"),
        F.lit("Logs").alias("Artifact"),
        _log_fields().alias("fields"),
        F.lit("log.evtx").alias("source_artifact"),
        reference(F.lit("log.jsonl"), F.col("event_id").cast("string")).alias("raw_ref"),
        table_position(F.col("event_id")).alias("ord"),
    )
    return _mapped_columns(velociraptor.map_rows(raw))


def log_jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = _new_folder(spark, "rows")
    kind = F.col("event_type")
    export = I.table(spark, sf_dir, "events").select(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("Timestamp"),
        F.concat(F.lit("HOST-"), (F.col("user_id") % 3).cast("string")).alias("Computer"),
        I.by_value(kind, LOG_CHANNELS).alias("Channel"),
        I.by_value(kind, LOG_IDS).try_cast("int").alias("EventID"),
        F.col("event_id").alias("EventRecordID"),
        F.when(kind == "error", F.lit("from the log")).otherwise(F.lit("-")).alias("Message"),
        F.lit("log.evtx").alias("Artifact"),
        _log_fields().alias("EventData"),
    )
    lines = F.concat(F.to_json(F.struct("*")), F.lit("\n\n{broken"))
    export.select(lines.alias("value")).write.text(path)
    raw = velociraptor.read(spark, path)
    return _mapped_columns(velociraptor.map_rows(raw))


def _tagged_detections(raw: DataFrame) -> DataFrame:
    rows = normalize.normalize(chainsaw.map_rows(raw)).events
    return tagging.tag_events(rows).select(
        "event_id",
        "message",
        "action",
        "principal",
        "object",
        _joined(views.technique_ids(F.col("attack_techniques"))).alias("techniques"),
    )


def detection_document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested detections read from the JSON arrays of a folder."""
    prepare(spark)
    path = _new_folder(spark, "hunt")
    kind = F.col("event_type")
    system = F.struct(
        I.by_value(kind, LOG_IDS).alias("EventID"),
        I.by_value(kind, LOG_CHANNELS).alias("Channel"),
        F.concat(F.lit("HOST-"), (F.col("user_id") % 3).cast("string")).alias("Computer"),
        F.col("event_id").alias("EventRecordID"),
    )
    event = F.struct(system.alias("System"), _log_fields().alias("EventData"))
    document = F.struct(F.lit("C:\\case\\log.evtx").alias("path"), F.struct(event.alias("Event")).alias("data"))
    detection = F.struct(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp"),
        F.when(kind == "view", F.lit("")).otherwise(F.lit("Rule")).alias("name"),
        I.level().alias("level"),
        F.array(F.lit("attack.execution"), F.lit("attack.t1059.001"), F.lit("Attack.T1059.001")).alias("tags"),
        F.lit('[{"not } an \\ element').alias("note"),
        document.alias("document"),
    )
    objects = I.table(spark, sf_dir, "events").select("event_id", F.to_json(detection).alias("text"))
    _array_lines(objects).select("value", "number").write.partitionBy("number").text(path)
    return _tagged_detections(chainsaw.read(spark, path))


def detection_document_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    tags = F.array(F.lit("attack.execution"), F.lit("attack.t1059.001"), F.lit("Attack.T1059.001"))
    raw = I.table(spark, sf_dir, "events").select(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp"),
        F.when(kind == "view", F.lit("")).otherwise(F.lit("Rule")).alias("name"),
        I.level().alias("level"),
        I.by_value(kind, LOG_IDS).alias("event_id"),
        I.by_value(kind, LOG_CHANNELS).alias("channel"),
        F.concat(F.lit("HOST-"), (F.col("user_id") % 3).cast("string")).alias("computer"),
        tags.alias("tags"),
        _log_fields().alias("fields"),
        F.lit("log.evtx").alias("source_artifact"),
        reference(F.lit("hunt.json"), F.col("event_id").cast("string")).alias("raw_ref"),
        table_position(F.col("event_id")).alias("ord"),
    )
    return _tagged_detections(raw)


def extracted_log_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    system = {
        "TimeCreated_SystemTime": F.concat(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")
        ),
        "Computer": F.concat(F.lit("HOST-"), (F.col("user_id") % 3).cast("string")),
        "Channel": I.by_value(kind, LOG_CHANNELS),
        "EventID": I.by_value(kind, LOG_IDS),
        "Provider_Name": F.when(kind == "click", F.lit("Provider")).otherwise(F.lit("")),
        "EventRecordID": F.col("event_id").cast("string"),
    }
    flat = F.map_concat(
        _log_fields(), F.create_map(*[c for k, v in system.items() for c in (F.lit(k), v)])
    )
    records = I.table(spark, sf_dir, "events").select(
        F.lit("log.evtx").alias("source_file"), F.col("event_id").alias("line"), flat.alias("fields")
    )
    return _mapped_columns(dissect.map_rows(dissect.log_records(records)))


def supertimeline_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped_columns(plaso.map_rows(_supertimeline_rows(spark, sf_dir)))


def supertimeline_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A super-timeline read from CSV files whose notes hold line breaks and quotes."""
    prepare(spark)
    path = _new_folder(spark, "super")
    rows = _supertimeline_rows(spark, sf_dir).withColumns(
        {
            "MACB": F.lit("...B"),
            "sourcetype": F.lit("FILE log"),
            "version": F.lit("2"),
            "inode": F.lit("-"),
            "notes": F.concat(F.lit('first, "quoted"\n'), "host", F.lit('\n\n"last')),
            "format": F.lit("log"),
        }
    )
    rows.select(*plaso.COLUMNS).write.option("header", True).option("escape", '"').csv(path)
    return _mapped_columns(plaso.map_rows(plaso.read(spark, path))).drop("record")


def _supertimeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    types = {
        "click": "Event Logged",
        "purchase": "Creation Time",
        "signup": "Last Written",
        "error": "Event Logged",
        "view": "Unheard Of",
    }
    filename = (
        F.when(kind == "click", F.lit("C:/Windows/System32/winevt/Logs/Security.evtx"))
        .when(kind == "error", F.lit("/var/log/app.log"))
        .when(kind == "view", F.lit("-"))
        .otherwise(I.by_index(F.col("user_id") % 4, I.TARGETS))
    )
    return I.table(spark, sf_dir, "events").select(
        F.date_format("ts", "MM/dd/yyyy").alias("date"),
        F.date_format("ts", "HH:mm:ss").alias("time"),
        F.when(F.col("user_id") % 2 == 0, F.lit("America/New_York"))
        .otherwise(F.lit(""))
        .alias("timezone"),
        F.lit("FILE").alias("source"),
        I.by_value(kind, types).alias("type"),
        F.when(kind == "view", F.lit("-")).otherwise(F.lit("jdoe")).alias("user"),
        F.concat(F.lit("HOST-"), (F.col("user_id") % 3).cast("string")).alias("host"),
        F.when(kind == "signup", F.lit("short text")).otherwise(F.lit("")).alias("short"),
        F.when(kind == "click", F.lit("long text")).otherwise(F.lit(" ")).alias("desc"),
        filename.alias("filename"),
        F.lit("event_identifier: 4688; size: 12; plain").alias("extra"),
        F.lit("FILE log").alias("source_artifact"),
        reference(F.lit("super.csv"), F.col("event_id").cast("string")).alias("raw_ref"),
        table_position(F.col("event_id")).alias("ord"),
    )


def file_table_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = I.table(spark, sf_dir, "orders")
    when = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    rows = orders.select(
        F.col("o_orderkey").cast("string").alias("EntryNumber"),
        F.lit("1").alias("SequenceNumber"),
        F.lit(".\\data\\").alias("ParentPath"),
        F.concat(F.lit("order"), F.col("o_custkey").cast("string"), F.lit(".dat")).alias("FileName"),
        when.alias("Created0x10"),
        F.when(F.col("o_orderstatus") == "F", when).otherwise(F.lit(" ")).alias("LastModified0x10"),
        F.lit("").alias("LastAccess0x10"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 23:59:59.1234567")).alias(
            "LastRecordChange0x10"
        ),
        F.lit(eztools.ARTIFACT).alias("source_artifact"),
        "o_orderkey",
    )
    expanded = eztools.expand_rows(rows)
    record = F.concat(F.lit("entry:"), "EntryNumber", F.lit(" seq:1 "), "_descriptor")
    raw = expanded.withColumns(
        {
            "raw_ref": reference(F.lit("mft.csv"), record),
            "ord": table_position(F.col("o_orderkey"), 0, F.col("_sub")),
        }
    )
    return _mapped_columns(eztools.map_rows(raw))


def file_facts_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = I.table(spark, sf_dir, "orders")
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    nothing = F.lit(None).cast("string")
    facts = orders.select(
        F.lit("$MFT").alias("source_file"),
        F.col("o_orderkey").alias("line"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("segment"),
        F.lit("7").alias("sequence"),
        F.concat(F.lit("data/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.lit("f").alias("file_name"),
        F.lit(False).alias("is_dir"),
        F.lit("1").alias("file_size"),
        iso.alias("created"),
        nothing.alias("modified"),
        F.when(F.col("o_orderstatus") == "O", iso).alias("accessed"),
        nothing.alias("record_changed"),
    )
    return _mapped_columns(dissect.map_rows(dissect.file_facts(facts)))


def column_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = I.table(spark, sf_dir, "orders")
    customer = I.table(spark, sf_dir, "customer")
    text = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed"),
        F.col("c_name").alias("who"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("verb"),
        F.col("o_orderstatus").alias("thing"),
    )
    columns = generic.ColumnMap(
        timestamp="placed",
        host_column="segment",
        principal_column="who",
        object_column="thing",
        action_column="verb",
        default_action="unlabelled",
        assume_timezone="Europe/Paris",
        source_artifact="orders",
    )
    raw = generic.from_table(text, columns, "o_orderkey", "orders")
    return _mapped_columns(generic.map_rows(raw, columns))


def delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delimited(spark, I.export(spark, sf_dir))


def quoted_delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``delimited_scan``, with a column of cells of several lines."""
    remark = F.concat(F.lit('said "'), "label", F.lit('",\n\n'), "event_id", F.lit(',"\r\n'))
    names = I.export(spark, sf_dir).columns
    return _delimited(spark, I.export(spark, sf_dir).select(*names[:4], remark.alias("remark"), *names[4:]))


def _delimited(spark: SparkSession, export: DataFrame) -> DataFrame:
    prepare(spark)
    path = _new_folder(spark, "edr")
    export.write.option("header", True).option("escape", '"').csv(path)
    columns = generic.ColumnMap.from_dict(
        {
            "timestamp": "when",
            "message_column": "note",
            "host_column": "machine",
            "principal_column": "account",
            "object_column": "target",
            "action_column": "label",
            "record_id_column": "event_id",
            "default_timestamp_desc": "logged",
            "source_artifact": "events",
        }
    )
    raw = generic.read(spark, path, columns)
    return _mapped_columns(generic.map_rows(raw, columns))


def action_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = I.table(spark, sf_dir, "part")
    label = F.concat("p_type", F.lit(" / "), "p_name")
    return part.select(
        "p_partkey",
        action_verb(label, "other").alias("verb"),
        action_verb(F.col("p_size").cast("string"), "other").alias("numeric_verb"),
    )


def kv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("Name: "), "c_name", F.lit(" ¦ Path: C:\\x\\"), "c_mktsegment",
        F.lit(" ¦ lone ¦ Name : again:"), F.col("c_custkey").cast("string"),
    )
    parsed = I.table(spark, sf_dir, "customer").select(
        "c_custkey", D.parse_pairs(text, D.BROKEN_BAR).alias("m")
    )
    return parsed.select(
        "c_custkey",
        F.try_element_at("m", F.lit("Name")).alias("name"),
        F.try_element_at("m", F.lit("Path")).alias("path"),
        F.size("m").alias("pairs"),
    )


def multi_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    bars = F.concat(F.lit(" a"), key, F.lit(" ¦ - ¦  ¦b"), "c_mktsegment")
    listed = F.concat(F.lit('["x'), key, F.lit('", " ", "y"]'))
    cell = F.when(F.col("c_nationkey") % 2 == 0, bars).otherwise(listed)
    values = I.table(spark, sf_dir, "customer").select("c_custkey", D.split_values(cell).alias("v"))
    return values.select("c_custkey", _joined(F.col("v")).alias("cells"), F.size("v").alias("n"))


# --- enrichment -----------------------------------------------------------------------


def problem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reject table: every rule broken by some rows, and two at once, which shows their order."""
    raw = generic.from_table(I.export(spark, sf_dir), I.TIMELINE_MAP, "event_id", "events")
    mapped = generic.map_rows(raw, I.TIMELINE_MAP)
    kind = F.col("ord.row") % 12

    def broken(name: str, kinds: tuple[int, ...], value: Column) -> Column:
        return F.when(kind.isin(*kinds), value).otherwise(F.col(name)).alias(name)

    changed = {
        "timestamp_raw": broken("timestamp_raw", (1, 9), F.lit(" ")),
        "message": broken("message", (2, 9, 10), F.lit("\t")),
        "source_artifact": broken("source_artifact", (3,), F.lit("")),
        "timestamp_desc": broken("timestamp_desc", (4,), F.lit("guessed")),
        "source_tool": broken("source_tool", (5, 11), F.lit("toolbox")),
        "action": broken("action", (6, 11), F.lit("Not a verb")),
        "confidence": broken("confidence", (7, 10), F.lit(1.5)),
        "raw_ref": broken(
            "raw_ref", (8,), F.struct(F.lit("events").alias("source_file"), F.lit("").alias("record"))
        ),
    }
    rows = normalize.to_events(mapped.select(*[changed.get(c, F.col(c)) for c in mapped.columns]))
    problems = normalize.problem_rows(materialize(rows, "problem-rows"))
    return problems.select(F.col("ord.row").alias("row"), "source_tool", "reason")


def episodes_gap_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = episodes.cluster(I.timeline(spark, sf_dir))
    return found.select("episode_id", "host", "principal", "start", "end", "event_count")


def episode_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = episodes.cluster(I.timeline(spark, sf_dir))
    return members.select("event_id", "episode_id")


def tag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tagging.tag_events(I.timeline_rows(spark, sf_dir).events)
    return tagged.select(
        "event_id", _joined(views.technique_ids(F.col("attack_techniques"))).alias("techniques")
    )


def tag_native_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = normalize.normalize(hayabusa.map_rows(I.detection_rows(spark, sf_dir))).events
    tagged = tagging.tag_events(events, I.seed_catalog(spark).successors())
    text = F.transform(
        "attack_techniques",
        lambda t: F.concat_ws(
            ":", t["technique_id"], t["mapping_source"], F.coalesce(t["source_id"], F.lit("-"))
        ),
    )
    return tagged.select("event_id", _joined(text).alias("techniques"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = normalize.normalize(hayabusa.map_rows(I.detection_rows(spark, sf_dir))).events
    both = events.unionByName(I.timeline_rows(spark, sf_dir).events)
    return materialize(tagging.tag_events(both, I.seed_catalog(spark).successors()), "tagged")


def technique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.technique_counts(_tagged(spark, sf_dir))


def technique_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.technique_matrix(_tagged(spark, sf_dir), I.seed_catalog(spark))


def technique_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the layer file, written and read back."""
    path = _new_folder(spark, "layer")
    outputs.write_layer(_tagged(spark, sf_dir), I.seed_catalog(spark), "events", path)
    entry = "techniqueID string, score bigint, comment string, enabled boolean"
    layer = F.from_json("value", f"techniques array<struct<{entry.replace(' ', ':').replace(',:', ', ')}>>, gradient struct<maxValue:bigint>")
    read = spark.read.text(path).select(layer.alias("layer"))
    rows = read.select(F.explode("layer.techniques").alias("t"), F.col("layer.gradient.maxValue").alias("highest"))
    return rows.select(
        F.col("t.techniqueID").alias("technique_id"), F.col("t.comment").alias("name"), F.col("t.score").alias("score"), "highest"
    )


def unmapped_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.unmapped_techniques(_tagged(spark, sf_dir), I.seed_catalog(spark))


def technique_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = report.technique_references(_tagged(spark, sf_dir), I.seed_catalog(spark))
    text = F.transform("techniques", lambda t: F.concat_ws(":", t["technique_id"], t["name"], t["status"]))
    return refs.select("event_id", _joined(text).alias("techniques"))


def _text_indicators(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    found = indicators.find_indicators(
        df.select(key, text), F.array(text), DEFAULT_NAMESPACES.indicator, "found"
    )
    return indicators.inverted_index(found, key)


def indicators_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = _text_indicators(I.table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.drop("ioc_key")


def indicators_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = I.table(spark, sf_dir, "pages").select(
        "page_id", F.concat_ws(" ", "url", "html").alias("text")
    )
    index, _ = _text_indicators(pages, "page_id", "text")
    return index.drop("ioc_key")


def indicator_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, references = _text_indicators(I.table(spark, sf_dir, "documents"), "doc_id", "text")
    return references.drop("ioc_key")


def indicator_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    extraction = indicators.extract(I.timeline(spark, sf_dir))
    return extraction.events.select("event_id", _joined(F.col("ioc_refs")).alias("refs"))


def indicators_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.extract(I.timeline(spark, sf_dir)).indicators.drop("ioc_key")


# --- views and sentences --------------------------------------------------------------


def severity_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.timeline_rows(spark, sf_dir).events
    severity = event_severity(F.col("details"))
    return events.select(
        "event_id", severity.alias("severity"), severity_rank(severity).alias("severity_rank")
    )


def view_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tagging.tag_events(I.timeline(spark, sf_dir))
    shown = views.select_view(tagged, views.DEFAULT_BUDGET)
    return shown.withColumn("techniques", _joined(F.col("techniques")))


def phrase_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.timeline(spark, sf_dir)
    verbs = F.array(
        F.col("action"), F.lit("logon"), F.lit("log_clear"), F.lit("other"), F.lit("made_up")
    )
    spread = events.select(
        "event_id", "principal", "object", "message", F.explode(verbs).alias("action")
    )
    return phrase(spread).select("event_id", "action", "statement")


def redact_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.timeline(spark, sf_dir).withColumn(
        "message", F.concat("message", F.lit(" by "), F.coalesce(F.upper("principal"), F.lit("?")))
    )
    config = views.Redaction(strip_message=False, strip_host=True)
    redacted = views.redact(views.event_view(events), config)
    return redacted.select("event_id", "host", "principal", "object", "message")


# --- claims ---------------------------------------------------------------------------


def derived_claims(events: DataFrame) -> DataFrame:
    """One claim per event in nine variants, chosen by its content hash."""
    variant = F.conv(F.substring("event_id", 9, 4), 16, 10).cast("int") % 9
    staged = events.select("event_id", "datetime", "ts", "principal", "action", "object").withColumn(
        "variant", variant
    )
    own, nothing = F.col("event_id"), F.lit(None).cast("string")
    v = F.col("variant")
    none = F.array().cast("array<string>")
    citations = (
        F.when(v.isin(1, 2), none)
        .when(v == 3, F.array(own, F.reverse(own)))
        .when(v == 4, F.array(own))
        .otherwise(F.array(own))
    )
    datetime = F.when(
        v == 5, canonical_datetime(F.col("ts") + F.expr("interval 2 seconds"))
    ).otherwise(F.col("datetime"))
    return staged.select(
        own.alias("claim_id"),
        "variant",
        citations.alias("citations"),
        F.when(v == 1, F.array(F.lit("EVT-1"))).otherwise(none).alias("malformed_citations"),
        F.struct(
            F.when(v != 4, datetime).alias("datetime"),
            F.when(v == 6, F.lit("CORP\\nobody"))
            .when(v == 4, nothing)
            .otherwise(F.upper("principal"))
            .alias("principal"),
            F.when(v == 7, F.lit("logoff")).when(v == 4, nothing).otherwise(F.col("action")).alias(
                "action"
            ),
            F.when(v == 8, F.concat("object", F.lit("x")))
            .when(v == 4, nothing)
            .otherwise(F.concat(F.lit(" "), F.lower("object")))
            .alias("object"),
        ).alias("asserts"),
    )


def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.timeline(spark, sf_dir)
    judged = verify_claims(derived_claims(events), events)
    return judged.select("claim_id", "ok", "backing_event_id", "reason", "detail")


def claim_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.timeline(spark, sf_dir)
    results = outputs.claim_results(derived_claims(events), events)
    return results.select("claim_id", "ok", "statement")


def claim_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.timeline(spark, sf_dir)
    return outputs.claim_totals(outputs.claim_results(derived_claims(events), events))


def narrative_drafts(events: DataFrame) -> DataFrame:
    """One case per event with up to three recorded drafts, built row by row."""
    turn = F.conv(F.substring("event_id", 3, 4), 16, 10).cast("int") % 4
    truth = F.concat(
        F.lit('{"action":'), json_string(F.col("action")),
        F.lit(',"datetime":'), json_string(F.col("datetime")), F.lit("}"),
    )
    lie = F.lit('{"action":"logoff"}')

    def document(text: str, asserts: Column, revises: str | None) -> Column:
        tail = f',"revises":"{revises}"' if revises else ""
        return F.concat(
            F.lit('```json\n{"claims":[{"text":"' + text + '","citations":["'),
            F.upper("event_id"), F.lit('"],"asserts":'), asserts, F.lit(tail + "}]}\n```"),
        )

    t = F.col("turn")
    staged = events.select("event_id", "datetime", "action").withColumn("turn", turn)
    rounds_of = F.array(
        F.when(t == 0, document("right at once", truth, None)).otherwise(
            document("first try", lie, None)
        ),
        F.when(t == 1, document("fixed", truth, "c0"))
        .when(t == 2, document("still wrong", lie, "c0"))
        .otherwise(F.lit("not json")),
        F.when(t == 2, document("fixed late", truth, "c0")).otherwise(
            document("unrelated", truth, "c9")
        ),
    )
    return staged.select(
        F.col("event_id").alias("case_id"), F.posexplode(rounds_of).alias("round", "document")
    )


def narrative_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.timeline(spark, sf_dir)
    result = rounds.resolve(narrative_drafts(events), events)
    return result.accepted.select("case_id", "round_index", "text", "statement", "backing_event_id")


def narrative_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.timeline(spark, sf_dir)
    result = rounds.resolve(narrative_drafts(events), events)
    return result.audit.select(
        "case_id", "round_index", "kind", "claim_text", "reason", "dropped", "detail"
    )


def narrative_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.timeline(spark, sf_dir)
    return rounds.resolve(narrative_drafts(events), events).rounds


# --- quality --------------------------------------------------------------------------


def benchmark_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.benchmark_classes(evaluate.run_benchmark(I.timeline(spark, sf_dir)))


def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = evaluate.run_benchmark(I.timeline(spark, sf_dir))
    return evaluate.benchmark_summary(evaluate.benchmark_classes(judged))


def citation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.timeline(spark, sf_dir)
    accepted = rounds.resolve(narrative_drafts(events), events).accepted
    return evaluate.citation_accuracy(accepted, events)


def _expected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "events").select(
        F.concat(F.lit("HOST-"), (F.col("user_id") % 3).cast("string")).alias("host"),
        F.col("event_id").cast("string").alias("record"),
        F.when(F.col("event_type") == "signup", F.lit("T1136"))
        .when(F.col("event_type") == "purchase", F.lit("T1543.003"))
        .when(F.col("event_type") == "view", F.lit("T1005"))
        .alias("technique_id"),
    )
    return rows.filter(F.col("technique_id").isNotNull())


def technique_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags as they are beside the inference rules alone."""
    events = I.timeline(spark, sf_dir)
    wrong = F.col("action") == "account_create"
    extra = F.array(
        F.struct(
            F.lit("T1005").alias("technique_id"),
            F.lit("rule_tag").alias("mapping_source"),
            F.lit(None).cast("string").alias("source_id"),
        )
    )
    tagged = tagging.tag_events(events)
    shown = F.when(wrong, F.concat("attack_techniques", extra.cast(TECHNIQUES)))
    tagged = tagged.withColumn("attack_techniques", shown.otherwise(F.col("attack_techniques")))
    scored = evaluate.technique_scores(tagged, _expected_labels(spark, sf_dir), None)
    return scored.drop("false_positive_examples")


def catalog_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of one technique per customer, most of them revoked by the next one."""
    key = F.col("c_custkey")
    customers = I.table(spark, sf_dir, "customer").select("c_custkey")
    number = F.concat(F.lit("T"), key.cast("string"))
    revoked = key % 50 != 0
    pattern = F.struct(
        F.concat(F.lit("p"), key.cast("string")).alias("id"),
        F.lit("attack-pattern").alias("type"),
        F.concat(F.lit("Name "), number).alias("name"),
        revoked.alias("revoked"),
        (key % 100 == 0).alias("x_mitre_deprecated"),
        F.array(F.struct(F.lit("mitre-attack").alias("source_name"), number.alias("external_id"))).alias("external_references"),
    )
    link = F.struct(
        F.concat(F.lit("r"), key.cast("string")).alias("id"),
        F.lit("relationship").alias("type"),
        F.lit("revoked-by").alias("relationship_type"),
        F.concat(F.lit("p"), key.cast("string")).alias("source_ref"),
        F.concat(F.lit("p"), (key + 1).cast("string")).alias("target_ref"),
    )
    objects = customers.select(F.to_json(pattern).alias("o")).unionByName(
        customers.filter(revoked).select(F.to_json(link).alias("o"))
    )
    fixed = (
        '{"id":"c","type":"x-mitre-collection","x_mitre_version":"1"},'
        '{"id":"m","type":"x-mitre-matrix","tactic_refs":["t"]},'
        '{"id":"t","type":"x-mitre-tactic","name":"One","x_mitre_shortname":"a",'
        '"external_references":[{"source_name":"mitre-attack","external_id":"TA1"}]},'
    )
    path = _new_folder(spark, "bundle")
    body = F.concat(F.lit('{"objects":[' + fixed), F.array_join(F.collect_list("o"), ","), F.lit("]}"))
    objects.agg(body.alias("value")).write.text(path)
    techniques = catalog_source.read_bundle(spark, path).techniques
    return techniques.select("technique_id", "deprecated", "revoked_by")


def score_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tagging.tag_events(I.timeline(spark, sf_dir))
    scored = scoring.score(scoring.predictions(tagged), _expected_labels(spark, sf_dir))
    return scored.withColumn(
        "false_positive_examples", _joined(F.col("false_positive_examples"), ";")
    )


# --- case and report ------------------------------------------------------------------


def _case(spark: SparkSession, sf_dir: str) -> Case:
    rows = I.timeline_rows(spark, sf_dir)
    events = materialize(rows.events, "timeline")
    return case_from_events(
        events,
        "events",
        I.seed_catalog(spark),
        provenance=rows.provenance,
        problems=rows.problems,
    )


def analyze_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from files: JSON lines, a mapped CSV with unusable times, the first again."""
    prepare(spark)
    path = _new_folder(spark, "mixed-case")
    lines, table = f"{path}/timeline.jsonl", f"{path}/export"
    _json_objects(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).write.text(lines)
    bad = F.col("event_id") % 7 == 0
    export = I.export(spark, sf_dir).drop("props")
    export = export.withColumn("when", F.when(bad, F.lit("some time")).otherwise(F.col("when")))
    export.write.option("header", True).option("quote", '"').option("escape", '"').csv(table)
    found = analyze(
        spark,
        [
            EvidenceInput("hayabusa", lines),
            EvidenceInput("generic_csv", table, I.TIMELINE_MAP),
            EvidenceInput("Hayabusa", lines),
        ],
        "mixed",
        I.seed_catalog(spark),
    )
    duplicates = normalize.duplicate_count(found.provenance, found.events)
    totals = (
        found.events.agg(F.count("*").alias("events"))
        .join(found.problems.agg(F.count("*").alias("problems")))
        .join(duplicates)
    )
    return found.inputs.select("input", "source", "file", "records").join(totals)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.stats(_case(spark, sf_dir)).drop("records_read")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.findings(_case(spark, sf_dir))
    ids = F.transform("techniques", lambda t: t["technique_id"])
    return found.select(
        "backing_event_id",
        "datetime",
        "host",
        "statement",
        "detection",
        "severity",
        F.coalesce(_joined(ids), F.lit("")).alias("techniques"),
        "episode_id",
    )


def _told_case(spark: SparkSession, sf_dir: str) -> Case:
    """The case with a narrative: every event's drafts, judged."""
    events = I.timeline(spark, sf_dir)
    return case_from_events(events, "told", I.seed_catalog(spark), drafts=narrative_drafts(events))


def narrative_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrative of the report: one entry per accepted event, with what backs it."""
    entries = report.narrative(_told_case(spark, sf_dir))
    return entries.select(
        "case_id",
        "backing_event_id",
        "round_index",
        "datetime",
        "host",
        "statement",
        "detection",
        "severity",
        F.coalesce(_joined(F.transform("techniques", lambda t: t["technique_id"])), F.lit("")).alias("techniques"),
        _joined(F.col("verified_fields")).alias("verified"),
        F.size("context_citations").alias("context"),
        "episode_id",
    )


def notable_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are findings, or that the narrative rests on."""
    return report.notable_events(_told_case(spark, sf_dir)).select("event_id", "severity", "notable")


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table of a report with a narrative, written and read back by its manifest."""
    path = _new_folder(spark, "report") + "/told"
    outputs.write_report(_told_case(spark, sf_dir), path)
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name, df in outputs.read_report(spark, path).items()
        if name in ("events", "findings", "narrative", "audit", "episodes", "episode_events", "provenance", "problems")
    ]
    return reduce(DataFrame.unionByName, counts)


def notable_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = report.displayed_events(_case(spark, sf_dir), 2000)
    return shown.select("event_id", "severity", "notable", "capped")


def episode_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.episodes_table(_case(spark, sf_dir))
    return rows.select("episode_id", "event_count", _joined(F.col("techniques")).alias("techniques"))


def events_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.events_table(_case(spark, sf_dir))
    shown = F.transform("referenced_iocs", lambda i: F.concat_ws(":", i["type"], i["defanged"]))
    return rows.select(
        "event_id", "episode_id", "severity", "notable", _joined(shown).alias("iocs"),
        _joined(F.col("tags")).alias("tags"),
    )


def saved_events_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = _case(spark, sf_dir)
    path = _new_folder(spark, "saved")
    outputs.write_events_jsonl(case.events, path)
    again = events_jsonl.read(spark, path)
    return again.select(
        "event_id",
        "datetime",
        "message",
        _joined(views.technique_ids(F.col("attack_techniques"))).alias("techniques"),
        D.scalar(F.col("details"), "level").alias("level"),
    )


QUERIES = {
    "episodes_gap_handoff": episodes_gap_handoff,
    "episode_members": episode_members,
    "event_identity": event_identity,
    "timestamp_norm": timestamp_norm,
    "timestamp_free_forms": timestamp_free_forms,
    "dedup_merge": dedup_merge,
    "duplicate_counts": duplicate_counts,
    "winevent_mapping": winevent_mapping,
    "detection_csv_scan": detection_csv_scan,
    "detection_jsonl_scan": detection_jsonl_scan,
    "detection_json_stream_scan": detection_json_stream_scan,
    "log_row_mapping": log_row_mapping,
    "log_jsonl_scan": log_jsonl_scan,
    "detection_document_mapping": detection_document_mapping,
    "extracted_log_mapping": extracted_log_mapping,
    "supertimeline_mapping": supertimeline_mapping,
    "file_table_mapping": file_table_mapping,
    "file_facts_mapping": file_facts_mapping,
    "column_map": column_map,
    "delimited_scan": delimited_scan,
    "quoted_delimited_scan": quoted_delimited_scan,
    "detection_document_scan": detection_document_scan,
    "supertimeline_scan": supertimeline_scan,
    "action_labels": action_labels,
    "kv_parse": kv_parse,
    "multi_value": multi_value,
    "tag_rules": tag_rules,
    "tag_native_resolution": tag_native_resolution,
    "technique_counts": technique_counts,
    "technique_matrix": technique_matrix,
    "unmapped_techniques": unmapped_techniques,
    "technique_references": technique_references,
    "indicators_documents": indicators_documents,
    "indicators_pages": indicators_pages,
    "indicator_references": indicator_references,
    "indicator_refs": indicator_refs,
    "indicators_events": indicators_events,
    "severity_norm": severity_norm,
    "view_budget": view_budget,
    "phrase_events": phrase_events,
    "redact_views": redact_views,
    "claim_verdicts": claim_verdicts,
    "claim_statements": claim_statements,
    "claim_totals": claim_totals,
    "narrative_accepted": narrative_accepted,
    "narrative_audit": narrative_audit,
    "narrative_rounds": narrative_rounds,
    "benchmark_classes": benchmark_classes,
    "benchmark_summary": benchmark_summary,
    "citation_accuracy": citation_accuracy,
    "score_sets": score_sets,
    "catalog_bundle": catalog_bundle,
    "technique_scores": technique_scores,
    "technique_layer": technique_layer,
    "problem_rows": problem_rows,
    "mixed_folder_scan": mixed_folder_scan,
    "analyze_mixed": analyze_mixed,
    "stats": stats,
    "findings": findings,
    "notable_capped": notable_capped,
    "narrative_report": narrative_report,
    "notable_cited": notable_cited,
    "written_report": written_report,
    "episode_techniques": episode_techniques,
    "events_annotated": events_annotated,
    "saved_events_reload": saved_events_reload,
}
