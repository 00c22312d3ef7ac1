"""Column functions against plain Python restatements of the same rules."""

import hashlib
import json
import random
import warnings
from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timeloom.functions import details as D
from timeloom.functions import identity, redaction, text
from timeloom.functions import indicators as I
from timeloom.functions.phrasing import phrase
from timeloom.functions.severity import normalize_severity, severity_rank
from timeloom.functions.timestamps import (
    add_asserted_instant,
    add_timestamp,
    canonical_datetime,
)


def _timed(spark, raws, zone=None):
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    rows = add_timestamp(df, F.col("raw"), zone).withColumn(
        "dt", canonical_datetime(F.col("ts"))
    ).collect()
    return {r["raw"]: (r["dt"], r["source_timezone"], r["time_reason"]) for r in rows}


def test_timestamps(spark):
    got = _timed(
        spark,
        [
            "2026-03-14T08:42:17.500Z", "2026-03-14 04:42:17.000 -04:00", "03/14/2026 08:44:12",
            "2026-03-14", "08:42:17", "2026-03", "99/99/9999 99:99:99", "  ", "2026-02-30 00:00:00",
            "14 March 2026 08:42:17", "3/4/2026 12:05:01 AM", "20260314T084217Z",
            "2026-03-14T08:42:17+05:30",
        ],
    )
    assert got["2026-03-14T08:42:17.500Z"] == ("2026-03-14T08:42:17.5Z", "UTC", None)
    assert got["2026-03-14 04:42:17.000 -04:00"] == ("2026-03-14T08:42:17Z", "UTC-04:00", None)
    assert got["03/14/2026 08:44:12"] == ("2026-03-14T08:44:12Z", "assumed_utc", None)
    assert got["2026-03-14"][0] == "2026-03-14T00:00:00Z"
    assert got["14 March 2026 08:42:17"][0] == "2026-03-14T08:42:17Z"
    assert got["3/4/2026 12:05:01 AM"][0] == "2026-03-04T00:05:01Z"
    assert got["20260314T084217Z"][0] == "2026-03-14T08:42:17Z"
    assert got["2026-03-14T08:42:17+05:30"][:2] == ("2026-03-14T03:12:17Z", "UTC+05:30")
    assert "complete date" in got["08:42:17"][2] and "complete date" in got["2026-03"][2]
    assert got["  "][2] == "timestamp is empty"
    assert got["99/99/9999 99:99:99"][0] is None and got["2026-02-30 00:00:00"][0] is None


def test_assumed_zone_and_bad_zone(spark):
    raws = ["2026-07-01 12:00:00", "2026-07-01T12:00:00Z", "nonsense"]
    new_york = _timed(spark, raws, "America/New_York")
    assert new_york[raws[0]][:2] == ("2026-07-01T16:00:00Z", "America/New_York")
    assert new_york[raws[1]][:2] == ("2026-07-01T12:00:00Z", "America/New_York")
    bad = _timed(spark, raws, "Nowhere/Else")
    assert bad[raws[0]][2] == "unknown timezone 'Nowhere/Else'"
    assert bad[raws[1]][2] == "unknown timezone 'Nowhere/Else'"
    assert "cannot parse" in bad[raws[2]][2]


def test_less_common_forms(spark):
    want = {
        "Tue Jan  2 03:04:05 2024": "2024-01-02T03:04:05Z",
        "Tue Jan 2 03:04:05 UTC 2024": "2024-01-02T03:04:05Z",
        "01/02/24 10:00": "2024-01-02T10:00:00Z",
        "13/02/24": "2024-02-13T00:00:00Z",
        "1.2.99 1:05 pm": "1999-01-02T13:05:00Z",
        "2024-01-02T03": "2024-01-02T03:00:00Z",
        "2024-01-02T03+02:00": "2024-01-02T01:00:00Z",
        "10:00 2024-01-02": "2024-01-02T10:00:00Z",
        "10:00:30 PM, Jan 2, 2024": "2024-01-02T22:00:30Z",
        "2024-01-02 03:04:05 EST": "2024-01-02T03:04:05Z",  # a name of several zones tells no offset
        "10:00": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "raw string")
    timed = add_timestamp(df, F.col("raw")).select("raw", canonical_datetime(F.col("ts")).alias("at"))
    assert {r["raw"]: r["at"] for r in timed.collect()} == want


def _dateutil(raw):
    """What a free-form parser makes of a text, if it holds a full date: instant, and whether it has an offset.

    It refuses some made texts for their punctuation alone ("3rd-Mar-26"); these may be read here.
    """
    parser = pytest.importorskip("dateutil.parser")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            first, second = (parser.parse(raw, default=datetime(2001 + i, 1 + i, 1 + i)) for i in range(2))
    except (ValueError, OverflowError):
        return None
    if first != second:
        return None
    aware = first.tzinfo is not None
    at = first.astimezone(timezone.utc) if aware else first.replace(tzinfo=timezone.utc)
    return at.replace(tzinfo=None), aware


FREE = """Mon 3 Mar 2026 08:15|Mon, 3 Mar 2026 08:15:00 -0500 (EST)|3rd of March 2026 at 8:15 PM|March 3rd, 2026 8:15pm EST
2026 Mar 3 08:00:00|2026/Mar/14 08:15|14.Mar.2026 08:15|14-Mar-26 08:15|14 Mar 26 08:15:00 GMT|Mar-14-2026 08:15
Mar 14 08:15:00 EST 2026|Sat Mar 14 08:15:00 UTC+2 2026|2026-03-14 08:15 GMT-03:00|2026-03-14 08:15 EST-0500
2026-03-14 08h15m30s|14 Mar 2026 8pm|14 Mar 2026 8 a.m.|8:15 on 14 March 2026|99-Jan-01 08:15|01-Jan-99 08:15
2026 14 Mar 08:15|Mar 2026 14 08:15|Sept 14 2026|14 Mar '26|2026. 3. 14. 8:15|2026-03-14 08:15:30 +5|2026-03-14 at 08:15
03 14 2026 08:15|14 03 2026 08:15|26 03 14 08:15|20260314 08:15 EST|Sat Mar 14 2026 08:15:30 GMT+0100 (CET)
10:36:28.5 14 Mar 2026|14 Mar 2026 10h36|14 Mar 2026 10h|1996.July.10 AD 12:08 PM|5:50 A.M. on June 13, 1990|14Mar2026 08:15
14/Mar/2026:08:15:00 +0000|Saturday|Mar 14|8pm|14 Mar 2026 25:00|14 Foo 2026 08:15|2026-03-14 08:15:30 +530|2026-03-14 08:15 est
2026-03-14 08:15:30 (EST)|14 Mar 2026 08:15 and 3|2026-03-14 24:00|31 Feb 2026 08:15|Mar Apr 2026|2026-03-14 08:15 Z EST""".replace("\n", "|")


def test_free_forms_are_read_as_a_free_form_parser_reads_them(spark):
    r = random.Random(3)
    fixed = FREE.split("|")
    raws = list(fixed)
    for _ in range(400):
        day, year = r.choice(["14", "3", "3rd", "31st", "02"]), r.choice(["2026", "1999", "26", "'98"])
        month = r.choice(["Mar", "March", "JUL", "july", "Sept", "Dec.", "May"])
        date = r.choice(["{d} {m} {y}", "{m} {d}, {y}", "{d}-{m}-{y}", "{m}/{d}/{y}", "{y} {m} {d}", "{d} of {m}, {y}", "{d} {m}"])
        date = date.format(d=day, m=month, y=year)
        time = r.choice(["08:15", "8:15:30", "08:15:30.25", "8:15 pm", "8pm", "11:59:59 AM", "23:00:01,5", "8h", ""])
        zone = r.choice(["", "", " EST", " GMT", "Z", " UTC", "+0200", " -03:30", " UTC+1", " PDT-7", " CEST +02:00"]) if time else ""
        raws.append(r.choice(["{d} {t}{z}", "{w} {d} {t}{z}", "{t}{z} {d}", "{w}, {d} at {t}{z}"]).format(
            d=date, t=time, z=zone, w=r.choice(["Mon", "Tuesday", "sat"])))
    df = spark.createDataFrame([(x,) for x in dict.fromkeys(raws)], "raw string")
    found = add_timestamp(df, F.col("raw")).collect()
    wrong = [
        (x["raw"], x["ts"], x["source_timezone"], _dateutil(x["raw"]))
        for x in found
        if (None if x["time_reason"] else (x["ts"], x["source_timezone"] != "assumed_utc")) != _dateutil(x["raw"])
        and (x["raw"] in fixed or _dateutil(x["raw"]))
    ]
    assert not wrong, "\n".join(map(str, wrong))
    assert sum(x["time_reason"] is None for x in found) > 200


def test_row_zones_are_all_usable(spark):
    from timeloom.functions.timestamps import KNOWN_ZONES

    df = spark.createDataFrame([(z,) for z in KNOWN_ZONES], "zone string")
    timed = add_timestamp(df, F.lit("2026-01-15 00:00:00"), F.col("zone"))
    assert timed.filter("ts IS NULL OR time_reason IS NOT NULL").count() == 0


def test_asserted_instants(spark):
    raws = ["2026-03-14T08:42:17Z", "2026-03-14T04:42:17-04:00", " 2026-03-14 ", "yesterday"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    rows = add_asserted_instant(df, F.col("raw"), "at").collect()
    got = {r["raw"]: r["at"] and r["at"].strftime("%H:%M:%S") for r in rows}
    assert got[raws[0]] == got[raws[1]] == "08:42:17"
    assert got[raws[2]] == "00:00:00" and got[raws[3]] is None


FIELDS = identity.IDENTITY_FIELDS


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(*[st.none() | st.text(max_size=12)] * 8), min_size=1, max_size=40))
def test_event_id_is_the_documented_hash(spark, rows):
    rows = [
        tuple(v and v.encode("utf-8", "ignore").decode() for v in row) for row in rows
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in FIELDS))
    ids = df.select(
        "*", identity.event_id("ns", {n: F.col(n) for n in FIELDS}).alias("id")
    ).collect()
    for row in ids:
        payload = {n: row[n] or "" for n in FIELDS}
        blob = json.dumps(
            ["ns", payload], sort_keys=True, separators=(",", ":"), ensure_ascii=False
        )
        assert row["id"] == hashlib.sha256(blob.encode()).hexdigest()


def test_fold_matches_case_folding(spark):
    words = ["Straße", "ΣΊΣΥΦΟΣ", "σίσυφος", "ﬁle", "µ", "ſ", "ıI", "İ", "C:\\Übung"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for row in df.select("w", text.fold(F.col("w")).alias("f")).collect():
        assert row["f"] == row["w"].casefold()


def test_strip_and_placeholders(spark):
    df = spark.createDataFrame([("\u2003\x1fa b\xa0",), ("-",), (" n/a ",), ("",)], "w string")
    rows = df.select(
        text.strip(F.col("w")).alias("s"), text.placeholder_to_null(F.col("w")).alias("p")
    ).collect()
    assert [r["s"] for r in rows] == ["a b", "-", "n/a", ""]
    assert [r["p"] for r in rows] == ["a b", None, None, None]


def test_action_verb_and_channel_files(spark):
    df = spark.createDataFrame([("Process  Create!",), ("4624",), (None,)], "w string")
    verbs = [r[0] for r in df.select(text.action_verb(F.col("w"), "other")).collect()]
    assert verbs == ["process_create", "other", "other"]
    paths = spark.createDataFrame(
        [("C:\\Logs\\A%4B.EVTX",), ("/x/y.log",), (".evtx",)], "p string"
    )
    assert [r[0] for r in paths.select(text.file_channel(F.col("p"))).collect()] == [
        "A/B", None, None,
    ]


def test_details_cells(spark):
    cells = [
        "A: C:\\x ¦ B : 2 ¦ lone ¦ A: z", '{"a":1,"b":["x","y"],"c":null,"d":true}', "-", None,
    ]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(D.parse_details(F.col("c"))).collect()]
    assert got == [{"A": "z", "B": "2"}, {"a": "1", "b": "x y", "c": "", "d": "True"}, {}, {}]
    lists = spark.createDataFrame([(" a ¦ - ¦b",), ('["x"," "]',), ("",)], "c string")
    assert [r[0] for r in lists.select(D.split_values(F.col("c"))).collect()] == [
        ["a", "b"], ["x"], [],
    ]


def _found(spark, value):
    df = spark.createDataFrame([(value,)], "t string").select(F.array("t").alias("a"))
    return [tuple(x) for x in I.scan(df, "a", "f").first()["f"]]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("C:\\Program Files\\a b\\c.exe", [("path", "C:\\Program Files\\a b\\c.exe")]),
        ('"C:\\P F\\a.exe" /s', [("path", "C:\\P F\\a.exe")]),
        ("C:\\a.exe https://evil.example.com/x", [("path", "C:\\a.exe"), ("domain", "evil.example.com")]),
        ("127.0.0.1 10.0.0.256 10.1.2.3 0.0.0.0", [("ip", "10.1.2.3")]),
        ("updater.exe report.PDF real.zip", [("domain", "real.zip")]),
        ("d41d8cd98f00b204e9800998ecf8427e", [("hash", "d41d8cd98f00b204e9800998ecf8427e")]),
        ("\\\\srv\\share\\f.txt;x", [("path", "\\\\srv\\share\\f.txt")]),
        ("C:\\w\\ntdll.dll+9d2e4", [("path", "C:\\w\\ntdll.dll")]),
        ("éa.example.com", [("domain", "example.com")]),
    ],
)
def test_indicator_scan(spark, value, expected):
    assert _found(spark, value) == expected


def test_hostile_text_is_scanned_quickly(spark):
    import time

    started = time.time()
    assert _found(spark, "a." * 50_000 + "!") == []
    assert time.time() - started < 10


def test_defang_and_keys(spark):
    df = spark.createDataFrame(
        [("domain", "httpbin.org"), ("path", "C:\\Win\\"), ("hash", "AB")], "k string, v string"
    )
    rows = df.select(
        I.defang(F.col("k"), F.col("v")).alias("d"), I.dedup_key(F.col("k"), F.col("v")).alias("key")
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("httpbin[.]org", "httpbin.org"), ("C:\\Win\\", "c:\\win"), ("AB", "ab"),
    ]


def test_severity(spark):
    df = spark.createDataFrame([(" CRIT ",), ("med",), ("odd",), (None,)], "l string")
    rows = df.select(normalize_severity(F.col("l")).alias("s")).withColumn(
        "r", severity_rank(F.col("s"))
    )
    assert [tuple(r) for r in rows.collect()] == [
        ("critical", 4), ("medium", 2), (None, -1), (None, -1),
    ]


def test_sentences(spark):
    rows = [
        ("log_clear", None, "Security", "m", "The Security event log was cleared."),
        ("log_clear", "jdoe", None, "m", "jdoe cleared an event log."),
        ("file_read", None, "c:\\x", "m", "c:\\x was accessed."),
        ("file_read", None, None, "m", "A file was accessed."),
        ("logon_failure", "a", None, "m", "A logon as a failed."),
        ("other", "a", None, "msg.", "a: msg."),
        ("foo_bar", None, "o", "m", "An actor performed foo bar on o."),
        ("dns_query", "{object}", "evil.example.", "m", "{object} resolved evil.example."),
    ]
    df = spark.createDataFrame(
        rows, "action string, principal string, object string, message string, want string"
    )
    for row in phrase(df).collect():
        assert row["statement"] == row["want"]


def test_username_redaction(spark):
    df = spark.createDataFrame([("CORP\\jdoe", "c:\\Users\\JDOE\\x corp\\Jdoe")], "p string, t string")
    blanked = redaction.strip_username(F.col("t"), F.col("p"), "[$1]")
    assert df.select(blanked).first()[0] == "c:\\Users\\[$1]\\x [$1]"


def test_details_round_trip(spark):
    source = '{"win_event_id":4688,"level":"high","tags":["a\\"b","c"],"fields":{"k":"v\\\\w"}}'
    df = spark.createDataFrame([(source,)], "j string")
    loaded = df.select(D.from_variant(F.parse_json("j")).alias("d"))
    again = json.loads(loaded.select(D.to_json_text(F.col("d"))).first()[0])
    assert again == json.loads(source)
