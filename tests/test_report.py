"""Report tables: rows are joined by full keys, hot keys are spread, names are looked up in place."""

import re

from pyspark.sql import functions as F

from timeloom.functions import identity
from timeloom.operators.skew import join_counted
from timeloom.plans import report
from timeloom.plans.case import EvidenceInput, analyze

HEADER = "Timestamp,Computer,Channel,EventID,Level,MitreTags,RecordID,RuleTitle,Details\n"


def _timeline(tmp_path, episodes=40):
    """Each episode has an hour of its own, a technique of its own and a domain of its own."""
    rows = [
        f"2026-03-{1 + i // 20:02d}T{i % 20:02d}:00:00Z,WS-1,Sec,4688,low,T{1000 + i},{i},Rule,"
        f'"Proc: C:\\x{i}.exe ¦ Cmdline: curl host{i}.example.net shared.example.org"'
        for i in range(episodes)
    ]
    path = tmp_path / "t.csv"
    path.write_text(HEADER + "\n".join(rows) + "\n", encoding="utf-8")
    return str(path)


def test_short_ids_that_collide_mix_nothing(spark, catalog, tmp_path, monkeypatch):
    path = _timeline(tmp_path)
    monkeypatch.setattr(identity, "SHORT_ID_LENGTH", 1)
    case = analyze(spark, [EvidenceInput("hayabusa", path)], "c", catalog)
    episodes = report.episodes_table(case).collect()
    assert len(episodes) == 40 and len({r["episode_id"] for r in episodes}) <= 16
    assert sorted(r["techniques"] for r in episodes) == sorted([f"T{1000 + i}"] for i in range(40))
    assert len({r["ioc_id"] for r in case.indicators.select("ioc_id").collect()}) <= 16
    for row in report.events_table(case).collect():
        number = re.search(r"x(\d+)\.exe", row["object"])[1]
        shown = [(i["type"], i["defanged"]) for i in row["referenced_iocs"]]
        assert shown == [
            ("domain", f"host{number}[.]example[.]net"), ("domain", "shared[.]example[.]org"), ("path", f"C:\\x{number}.exe"),
        ]


def test_names_by_map_and_by_join_agree(spark, catalog, tmp_path, monkeypatch):
    case = analyze(spark, [EvidenceInput("hayabusa", _timeline(tmp_path))], "c", catalog)
    known = case.catalog.techniques.select("technique_id").first()[0]
    tag = F.struct(F.lit(known).alias("technique_id"), F.lit("rule").alias("mapping_source"), F.lit(None).cast("string").alias("source_id"))
    events = case.events.withColumn("attack_techniques", F.when(F.col("event_id") > "8", F.array()).otherwise(
        F.concat("attack_techniques", F.array(tag.cast(case.events.schema["attack_techniques"].dataType.elementType)))))
    events = events.withColumn("attack_techniques", F.col("attack_techniques").cast(case.events.schema["attack_techniques"].dataType))
    looked_up = report.with_named_techniques(events, case.catalog)
    assert "Exchange" not in looked_up._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    first = sorted(map(str, looked_up.select("event_id", "techniques").collect()))
    monkeypatch.setattr(report, "CATALOG_ROWS", 0)
    again = sorted(map(str, report.with_named_techniques(events, case.catalog).select("event_id", "techniques").collect()))
    assert first == again and any("active" in row for row in first) and any("unknown" in row for row in first)


def _rows_by_task(df):
    return [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]


def test_one_key_with_half_of_all_rows_is_spread(spark):
    rows = 40_000
    left = spark.range(rows, numPartitions=8).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 7 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"),
        "id",
    )
    right = left.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    right = right.filter((F.col("k") == "hot") | (F.col("top") % 3 == 0))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = join_counted(left, right, "k", "n")
        plain = left.join(right.drop("n"), "k", "left").select("k", "id", "top")
        assert found.columns == ["k", "id", "top"]
        assert found.exceptAll(plain).count() == 0 and plain.exceptAll(found).count() == 0
        sizes = _rows_by_task(found.filter("k = 'hot'"))
        assert len(sizes) == 8 and max(sizes) == rows // 16
        assert max(_rows_by_task(plain.filter("k = 'hot'"))) == rows // 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_join_without_rows_or_heavy_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 1, "x")], "k string, n int, w string")
    assert sorted(map(tuple, join_counted(left, right, "k", "n").collect()), key=str) == [("a", 1, "x"), ("b", 3, None), (None, 2, None)]
    assert sorted(map(tuple, join_counted(left, right.limit(0), "k", "n").collect()), key=str) == [("a", 1, None), ("b", 3, None), (None, 2, None)]
    assert join_counted(left.limit(0), right, "k", "n").count() == 0
    many = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n"), F.col("id").alias("w"))
    assert join_counted(many.select("k"), many, "k", "n").filter("k <> cast(w AS string) OR w IS NULL").count() == 0


def test_a_report_is_there_as_a_whole_or_not_at_all(spark, catalog, tmp_path, monkeypatch):
    import pytest

    from timeloom.plans import outputs

    case = analyze(spark, [EvidenceInput("hayabusa", _timeline(tmp_path, 3))], "c", catalog)
    path = str(tmp_path / "report")
    tables = report.report_tables(case)
    broken = case.events.limit(1).select(F.raise_error(F.lit("a task failed")).cast("string").alias("x"))
    names = list(tables)
    half = dict(list(tables.items())[: len(names) // 2]) | {"broken": broken} | {names[-1]: tables[names[-1]]}
    monkeypatch.setattr(outputs, "report_tables", lambda _: half)
    with pytest.raises(Exception, match="a task failed"):
        outputs.write_report(case, path)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("report")]
    with pytest.raises(outputs.IncompleteReportError):
        outputs.read_report(spark, path)
    monkeypatch.setattr(outputs, "report_tables", lambda _: tables)
    outputs.write_report(case, path + "/")
    found = outputs.read_report(spark, path)
    assert found.keys() == tables.keys() and found["events"].count() == 3
    with pytest.raises(FileExistsError):
        outputs.write_report(case, path)
