"""Readers and mappers on small files with the edge cases of each layout."""

import json

import pytest
from pyspark.sql import functions as F

from timeloom.operators import normalize as N
from timeloom.plans import outputs
from timeloom.plans.case import EvidenceInput, UnknownSourceError, read_input
from timeloom.sources import catalog as catalog_source
from timeloom.sources import claims, dissect, generic, labels

HEADER = "Timestamp,Computer,Channel,EventID,Level,MitreTags,RecordID,RuleTitle,Details,ExtraFieldInfo\n"
TIMELINE = HEADER + (
    '2026-03-14 04:42:17.000 -04:00,WS-1,Sec,4688,high,T1059.001 ¦ G0001,80038,Office macro,'
    '"Proc: C:\\Windows\\powershell.exe ¦ User: jdoe ¦ LID: n/a","SubjectDomainName: CORP"\n'
    'not-a-time,WS-1,Sec,4688,high,,80040,Broken,"Proc: C:\\x.exe",\n'
    '2026-03-14 05:10:00.000 -04:00,WS-1,App,9999,info,,-,,"Foo: ""bar"" ¦ Baz: qux",\n'
    '2026-03-14 05:11:00.000 -04:00,WS-1,Sysmon,3,low,,7,Net,"TgtIP: 203.0.113.7 ¦ TgtPort: 443 ¦ User: CORP\\jdoe"\n'
)


def _events(spark, item):
    result = N.normalize(read_input(spark, item, 0))
    rows = [json.loads(r["value"]) for r in outputs.event_lines(result.events).collect()]
    return sorted(rows, key=lambda r: r["datetime"]), result


def _write(tmp_path, name, text, bom=False):
    path = tmp_path / name
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode())
    return str(path)


@pytest.mark.parametrize("bom", [False, True])
def test_detection_csv(spark, tmp_path, bom):
    path = _write(tmp_path, "t.csv", TIMELINE, bom)
    rows, result = _events(spark, EvidenceInput("hayabusa", path))
    assert [r["action"] for r in rows] == ["process_create", "other", "network_connect"]
    first, second, third = rows
    assert first["principal"] == "CORP\\jdoe"
    assert first["object"] == "C:\\Windows\\powershell.exe"
    assert first["source_artifact"] == "Security.evtx"
    assert first["raw_ref"] == {"source_file": "t.csv", "record": "80038"}
    assert first["details"]["rule_mitre_tags"] == ["T1059.001", "G0001"]
    assert first["details"]["fields"] == {
        "NewProcessName": "C:\\Windows\\powershell.exe", "SubjectUserName": "jdoe",
        "SubjectDomainName": "CORP",
    }
    assert second["raw_ref"]["record"] == "line:4"
    assert second["confidence"] == 0.5 and second["details"]["win_event_id"] == 9999
    assert second["message"] == "Application event 9999 on WS-1"
    assert second["details"]["fields"] == {"Foo": '"bar"', "Baz": "qux"}
    assert third["object"] == "203.0.113.7:443"
    problems = result.problems.collect()
    assert [p["reason"] for p in problems] == ["cannot parse timestamp 'not-a-time'"]
    assert problems[0]["raw_ref"]["record"] == "80040"


def test_detection_json_forms_agree_with_csv(spark, tmp_path):
    objects = [
        {"Timestamp": "2026-03-14T08:42:17Z", "Computer": "WS-1", "Channel": "Sec", "EventID": 4688,
         "Details": {"Proc": "C:\\a.exe", "User": "jdoe"}, "MitreTags": ["T1047"], "RuleTitle": "R"},
        {"Timestamp": "2026-03-14T08:43:17Z", "Computer": "WS-1", "Channel": "Sys", "EventID": 7045,
         "Details": {"Svc": "X"}, "RuleTitle": "S", "RecordID": 5},
    ]
    lines = json.dumps(objects[0]) + "\n\nbroken\n" + json.dumps(objects[1]) + "\n[1]\n"
    pretty = "".join(json.dumps(o, indent=2) + "\n" for o in objects)
    forms = {
        "a.jsonl": lines, "b.json": json.dumps(objects, indent=1), "c.json": pretty,
        "d.json": pretty + "{truncated",
    }
    seen = []
    for name, content in forms.items():
        rows, _ = _events(spark, EvidenceInput("hayabusa", _write(tmp_path, name, content)))
        seen.append([(r["event_id"], r["object"], r["details"]["fields"]) for r in rows])
        assert rows[0]["raw_ref"]["record"] == "entry:1" and rows[1]["raw_ref"]["record"] == "5"
        assert rows[0]["details"]["rule_mitre_tags"] == ["T1047"]
    assert all(s == seen[0] for s in seen)


def test_detection_documents(spark, tmp_path):
    def detection(system, data, **extra):
        return {"name": "Rule", "level": "high", **extra,
                "document": {"path": "C:\\Logs\\Security.evtx", "data": {"Event": {"System": system, "EventData": data}}}}

    system = {"EventID": {"#text": 4688}, "Channel": "Security", "Computer": "WS-1",
              "TimeCreated": {"#attributes": {"SystemTime": "2026-03-14T08:42:17Z"}}}
    data = {"NewProcessName": "C:\\a.exe", "SubjectUserName": "jdoe", "Flag": True, "Deep": {"x": 1}}
    document = [
        detection(system, data, tags=["attack.t1059.001", "attack.execution", "attack.T1059.001"]),
        detection({"EventID": 1, "EventRecordID": 9}, None, timestamp="2026-03-14T09:00:00Z"),
        "stray",
    ]
    rows, _ = _events(spark, EvidenceInput("chainsaw", _write(tmp_path, "d.json", json.dumps(document))))
    assert rows[0]["object"] == "C:\\a.exe" and rows[0]["raw_ref"]["record"] == "detection:1"
    assert rows[0]["details"]["rule_mitre_tags"] == ["T1059.001"]
    assert rows[0]["details"]["fields"]["Flag"] == "true" and rows[0]["details"]["fields"]["Deep"] == ""
    assert rows[1]["raw_ref"]["record"] == "9" and rows[1]["action"] == "other"
    empty, _ = _events(spark, EvidenceInput("chainsaw", _write(tmp_path, "e.json", '{"a": 1}')))
    assert empty == []


def test_file_table_and_log_rows(spark, tmp_path):
    table = (
        "EntryNumber,SequenceNumber,ParentPath,FileName,Created0x10,LastModified0x10\n"
        "8042,3,.\\Users\\jdoe\\,a.exe,2026-03-14 08:44:12.1234567,\n"
        ",,,b.txt,2026-03-14 09:00:00,2026-03-14 09:01:00\n"
    )
    rows, _ = _events(spark, EvidenceInput("eztools", _write(tmp_path, "m.csv", table)))
    assert [r["raw_ref"]["record"] for r in rows] == [
        "entry:8042 seq:3 created", "line:3 created", "line:3 modified",
    ]
    assert rows[0]["object"] == ".\\Users\\jdoe\\a.exe" and rows[0]["datetime"].endswith(".123456Z")
    log = (
        '{"Timestamp": "2026-03-14T08:55:03Z", "Channel": "Security", "EventID": 4624, '
        '"EventData": {"TargetUserName": "svc", "TargetDomainName": "CORP", "IpAddress": "10.4.12.66"}}\n'
        "\n{bad\n"
        '{"Timestamp": "2026-03-14T08:56:03Z", "EventID": "odd", "Artifact": "Custom", "Message": "m"}\n'
    )
    rows, _ = _events(spark, EvidenceInput("velociraptor", _write(tmp_path, "v.jsonl", log)))
    assert rows[0]["principal"] == "CORP\\svc" and rows[0]["raw_ref"]["record"] == "line:1"
    assert rows[1]["raw_ref"]["record"] == "line:4" and rows[1]["source_artifact"] == "Custom"
    assert rows[1]["details"]["win_event_id"] == "odd"


def test_line_numbers_across_splits(spark, tmp_path):
    lines = "".join(
        json.dumps({"Timestamp": "2026-03-14T08:55:03Z", "Computer": f"h{i}"}) + "\n" * (1 + i % 3)
        for i in range(400)
    )
    path = _write(tmp_path, "big.jsonl", lines)
    want, number = {}, 1
    for i in range(400):
        want[f"h{i}"] = f"line:{number}"
        number += 1 + i % 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        mapped = read_input(spark, EvidenceInput("velociraptor", path), 0)
        assert mapped.rdd.getNumPartitions() > 4
        got = {r["host"]: r["record"] for r in mapped.select("host", "raw_ref.record").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")
    assert got == want


def test_supertimeline(spark, tmp_path):
    header = "date,time,timezone,MACB,source,sourcetype,type,user,host,short,desc,version,filename,inode,notes,format,extra\n"
    text = header + (
        "03/14/2026,08:56:40,UTC,....,EVT,WinEVTX,Event Logged,-,WS-2,s,A service,2,"
        "C:/Windows/Logs/System.evtx,1,,winevtx,event_identifier: 7045; n: 1\n"
        "03/14/2026,08:44:12,America/New_York,..B.,FILE,,Creation Time,jdoe,WS-1,short,,2,/x/y.exe,2,,mft,\n"
        "03/14/2026,08:44:12,Mars/Base,..B.,FILE,,Creation Time,jdoe,WS-1,short,,2,/x/y.exe,2,,mft,\n"
    )
    rows, result = _events(spark, EvidenceInput("plaso", _write(tmp_path, "p.csv", text)))
    assert rows[0]["action"] == "service_install" and rows[0]["object"] is None
    assert rows[0]["details"]["filename"] == "C:/Windows/Logs/System.evtx"
    assert rows[0]["details"]["extra"] == {"event_identifier": "7045", "n": "1"}
    assert rows[1]["datetime"] == "2026-03-14T12:44:12Z" and rows[1]["source_artifact"] == "FILE"
    assert result.problems.first()["reason"] == "unknown timezone 'Mars/Base'"


def test_column_map(spark, tmp_path):
    text = "When,Host.Name,Act,What,Extra\n2026-03-14T08:42:17Z, WS-1 ,Process Create,C:\\a.exe,keep\n"
    columns = generic.ColumnMap.from_json(
        '{"timestamp": "When", "host_column": "Host.Name", "action_column": "Act", "object_column": "What"}'
    )
    rows, _ = _events(spark, EvidenceInput("generic_csv", _write(tmp_path, "g.csv", text), columns))
    assert rows[0]["host"] == "WS-1" and rows[0]["action"] == "process_create"
    assert rows[0]["message"] == "process_create C:\\a.exe" and rows[0]["details"] == {"Extra": "keep"}
    with pytest.raises(ValueError):
        generic.ColumnMap("t", default_action="Not A Verb")
    with pytest.raises(ValueError):
        generic.ColumnMap(" ")
    with pytest.raises(ValueError):
        generic.ColumnMap("t", default_timestamp_desc="sometime")


def test_extracted_records_and_unknown_kind(spark):
    fields = {"TimeCreated_SystemTime": "2026-03-14T08:42:17+00:00", "EventID": "4688",
              "Channel": "Security", "NewProcessName": "C:\\a.exe", "Provider_Name": "P"}
    table = spark.createDataFrame([("S.evtx", 1, fields)], "source_file string, line int, fields map<string,string>")
    raw = dissect.log_records(table)
    rows = N.to_events(dissect.map_rows(raw)).collect()
    assert rows[0]["object"] == "C:\\a.exe" and rows[0]["message"] == "P event 4688 on Security"
    odd = N.to_events(dissect.map_rows(raw.withColumn("kind", F.lit("other")))).collect()
    assert odd[0]["reason"] == "record has unknown or missing artifact kind 'other'"


def test_unknown_sources_and_misplaced_maps(spark):
    with pytest.raises(UnknownSourceError):
        read_input(spark, EvidenceInput("nope", "x"), 0)
    with pytest.raises(UnknownSourceError):
        read_input(spark, EvidenceInput("generic_csv", "x"), 0)
    with pytest.raises(UnknownSourceError):
        read_input(spark, EvidenceInput("plaso", "x", generic.ColumnMap("t")), 0)


def test_claim_documents(spark):
    good = "a" * 64
    fenced = "```json\n" + json.dumps({"claims": [
        {"text": " t ", "citations": [good.upper(), good, "EVT-1", " "],
         "asserts": {"action": " x ", "object": " ", "principal": None}, "revises": "c1"},
        {"text": "", "citations": []}, "stray", {"text": "u", "citations": good},
    ]}) + "\n```"
    docs = [fenced, json.dumps([{"text": "bare"}]), "not json", '{"claims": 3}']
    df = spark.createDataFrame(list(enumerate(docs)), "d int, value string")
    rows = {(r["d"], r["index"]): r for r in claims.parse(df, "value", ("d",)).collect()}
    assert set(rows) == {(0, 0), (0, 1), (1, 0)}
    first = rows[0, 0]
    assert first["citations"] == [good] and first["malformed_citations"] == ["EVT-1"]
    assert first["asserts"]["action"] == "x" and first["asserts"]["object"] is None
    assert first["revises"] == "c1" and first["text"] == "t"
    assert rows[0, 1]["citations"] == [good] and rows[1, 0]["citations"] == []


def test_catalog_bundle(spark, tmp_path):
    def ref(x):
        return [{"source_name": "mitre-attack", "external_id": x}]

    def technique(sid, tid, **kw):
        return {"id": sid, "type": "attack-pattern", "name": f"N{tid}", "external_references": ref(tid),
                "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "b"},
                                      {"kill_chain_name": "mitre-attack", "phase_name": "a"}], **kw}

    def revoked(a, b):
        return {"id": f"r{a}", "type": "relationship", "relationship_type": "revoked-by",
                "source_ref": a, "target_ref": b}

    objects = [
        {"id": "c", "type": "x-mitre-collection", "x_mitre_version": "19.2"},
        {"id": "m", "type": "x-mitre-matrix", "tactic_refs": ["t2", "t1"]},
        {"id": "t1", "type": "x-mitre-tactic", "name": "One", "x_mitre_shortname": "a", "external_references": ref("TA1")},
        {"id": "t2", "type": "x-mitre-tactic", "name": "Two", "x_mitre_shortname": "b", "external_references": ref("TA2")},
        technique("p1", "T1000"), technique("p2", "T1000.001"),
        technique("p3", "T1001", revoked=True), technique("p4", "T1002", revoked=True),
        technique("p5", "T1003", x_mitre_deprecated=True), technique("p6", "T1004", revoked=True),
        technique("p7", "T1005", revoked=True),
        revoked("p3", "p4"), revoked("p4", "p2"), revoked("p6", "p7"), revoked("p7", "p6"),
    ]
    path = _write(tmp_path, "bundle.json", json.dumps({"objects": objects}))
    cat = catalog_source.read_bundle(spark, path)
    assert [r["shortname"] for r in cat.tactics.orderBy("position").collect()] == ["b", "a"]
    rows = {r["technique_id"]: r for r in cat.techniques.collect()}
    assert rows["T1000.001"]["display_name"] == "NT1000: NT1000.001"
    assert rows["T1000"]["tactics"] == ["a", "b"] and rows["T1003"]["deprecated"]
    assert dict(map(tuple, cat.successors().collect())) == {"T1001": "T1000.001", "T1002": "T1000.001"}
    assert rows["T1004"]["deprecated"] and rows["T1004"]["revoked_by"] is None


def test_revocation_chains_of_any_length(spark):
    ids = [f"p{i}" for i in range(41)]
    patterns = spark.createDataFrame(
        [(i, i != ids[-1]) for i in ids] + [("x", True), ("y", True), ("z", True)], "id string, revoked boolean"
    )
    links = list(zip(ids, ids[1:])) + [("x", "y"), ("y", "x"), ("z", "unknown")]
    revocations = spark.createDataFrame(
        [(a, b, n) for n, (a, b) in enumerate(links)], "source_ref string, target_ref string, _order int"
    )
    found = catalog_source.final_successors(patterns, revocations).collect()
    assert sorted(map(tuple, found)) == sorted((i, ids[-1]) for i in ids[:-1])


def test_labels(spark, tmp_path):
    text = json.dumps({"events": [{"computer": "h", "record_id": "1", "technique_ids": ["T1", "T2"]}]})
    rows = labels.read(spark, _write(tmp_path, "l.json", text)).collect()
    assert {tuple(r) for r in rows} == {("h", "1", "T1"), ("h", "1", "T2")}
