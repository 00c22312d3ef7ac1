"""What is written and moved on the way: packed ids, compressed copies, bounded windows."""

import hashlib
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from timeloom.functions.identity import packed, unpacked
from timeloom.operators import episodes, normalize
from timeloom.session import discard, materialize, run_folder
from timeloom.sources import generic, structure
from timeloom.sources.common import FILE, SPLIT
from timeloom.sources.structure import csv_records


def _digest(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def test_packed_ids_come_back(spark):
    ids = [_digest(1), _digest(2).upper(), _digest(3)[:63], _digest(4) + "\n", "", "é" * 32, "a", None]
    df = spark.createDataFrame([(i,) for i in ids], "id string").withColumn("p", packed(F.col("id")))
    rows = df.select("id", unpacked(F.col("p")).alias("again"), F.octet_length("p").alias("n")).collect()
    assert [r["again"] for r in rows] == ids
    assert rows[0]["n"] == 33


def test_copies_take_half_of_a_hex_digit(spark):
    ids = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("event_id")).coalesce(1)
    copy = materialize(ids, "ids")
    folder = copy.copy_path.removeprefix("file:")
    assert sum(e.stat().st_size for e in os.scandir(folder)) < 20_000 * 45
    assert copy.distinct().count() == 20_000
    discard(copy)
    assert not os.path.exists(folder)


def test_episodes_leave_no_copies_that_nothing_reads(spark):
    at = datetime(2026, 1, 1)
    rows = [(_digest(i), "h", at + timedelta(seconds=400 * i), f"u{i // 4}") for i in range(40)]
    events = spark.createDataFrame(rows, "event_id string, host string, ts timestamp, principal string")
    folder = run_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    found, members = episodes.cluster(events)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left == {"episode-members", "episodes"}
    assert {r["event_id"] for r in members.collect()} == {r[0] for r in rows}
    assert found.agg(F.sum("event_count")).first()[0] == 40


def test_events_without_copies_join_nothing(spark):
    columns = generic.ColumnMap(timestamp="when", message_column="note")
    rows = [(i, f"2026-01-01T00:00:{i:02d}Z", "n") for i in range(20)]
    df = spark.createDataFrame(rows, "key long, when string, note string")
    raw = generic.from_table(df, columns, "key", "t")
    events = normalize.normalize(generic.map_rows(raw, columns)).events
    assert "Join" not in events._jdf.queryExecution().optimizedPlan().toString()
    assert events.count() == 20
    again = generic.from_table(df, columns, "key", "t", 1)
    twice = normalize.normalize(generic.map_rows(raw.unionByName(again), columns))
    assert (twice.events.count(), twice.provenance.count()) == (20, 40)


def test_windows_of_records_are_bounded_within_a_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(structure, "_CHUNK_BITS", 3)
    text = "a,b\n" + "".join(f'{i},"x\n\n""{i}"\n' for i in range(100)) + '7,"' + "long\n" * 30 + '"\n'
    (tmp_path / "t.csv").write_text(text)
    sizes = []
    inner = structure._with_states

    def seen(df, order):
        if "value" in df.columns:
            sizes.append(df.groupBy(FILE, SPLIT).count().agg(F.max("count")).first()[0])
        return inner(df, order)

    monkeypatch.setattr(structure, "_with_states", seen)
    records = csv_records(spark, str(tmp_path / "t.csv")).orderBy("_number").collect()
    assert sizes and max(sizes) <= 8
    assert [r["_number"] for r in records] == list(range(1, 103))
    assert [r["value"] for r in records[1:101]] == [f'{i},"x\n\n""{i}"' for i in range(100)]
    assert records[101]["value"] == '7,"' + "long\n" * 30 + '"'
