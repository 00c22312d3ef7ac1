import hashlib
import re

import pytest

from timeloom.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id long, row string, digest int"
ROWS = [
    (5, "a b"),
    (3, "a \n\t b"),
    (9, "a b "),
    (4, None),
    (2, ""),
    (7, "x"),
    (7, "x"),
    (7, "y"),
    (None, "y"),
    (None, "z"),
    (None, "z"),
    (1, "long " * 50_000),
    (0, "long\x0b" * 50_000),
    *((100 + i, "copy") for i in range(60)),
    *((200 + i, f"text {i}") for i in range(30)),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "r", 2) for r in rows], SCHEMA).repartition(5)


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    return groups


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_groups_and_one_kept_row_each(spark, digest_bytes):
    got = exact_dedup.find_duplicates(frame(spark, ROWS), digest_bytes).collect()
    assert len(got) == len(ROWS)
    for text, ids in brute(ROWS).items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in got if r.text_sha256 == sha]
        keep = min((i for i in ids if i is not None), default=None)
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in own) == sorted((i is None, i or 0) for i in ids)
        assert {(r.keep_id, r.group_size) for r in own} == {(keep, len(ids))}
        assert [r.doc_id for r in own if r.kept] == [keep]


def test_kept_rows_have_all_columns(spark):
    got = exact_dedup.keep_first(frame(spark, ROWS))
    assert got.columns == ["doc_id", "text", "keep_id", "row", "digest"]
    kept = got.collect()
    groups = brute(ROWS)
    assert len(kept) == len(groups)
    for r in kept:
        ids = groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")]
        assert r.doc_id == min((i for i in ids if i is not None), default=None)


def test_no_rows(spark):
    assert exact_dedup.find_duplicates(frame(spark, [])).count() == 0
    assert exact_dedup.keep_first(frame(spark, [])).count() == 0
