import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from timeloom.llm import binary_packing, packing, queries, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "The quick, brown fox's ideas... don't stop!",
    "<|endoftext|> inside <|startoftext|>x",
    "İstanbul ǅ ﬁne été été ÉTÉ ½ ² x² 5.5,, “quoted.” ”.",
    "",
    None,
    "  \t\n ",
    "a b c\x1cd ​ zero",
    "word " * 30,
    "日本語 テキスト, ok. नमस्ते! 👩‍👩‍👧",
]


def rows(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'x' AS ids", "1 AS part", "2 AS sequence_id", "3 AS offset") if extra else df


def direct(path, text, end=2):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aBé İ.,'!?5½\n\t$&´́“”ſǅ", max_size=40))
def test_cached_words_give_the_ids_of_whole_texts(text):
    made = tokens.encoder(WORDS)
    found = np.frombuffer(made.ids(text.encode()), "<u4").tolist()
    assert found == made.tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_turns_over(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 8)
    made = tokens.WordEncoder(Tokenizer.from_file(WORDS), WORDS, "</w>")
    for text in ("one two three four five six", "seven eight one two", "nine ten eleven one", "one two, three."):
        assert np.frombuffer(made.ids(text.encode()), "<u4").tolist() == direct(WORDS, text)[:-1]


@pytest.mark.parametrize("path", [WORDS, BYTES])
@pytest.mark.parametrize("window", [8, 4096])
def test_windows_hold_every_id_once(spark, path, window):
    texts = TEXTS + TEXTS[:2]
    pieces = packing.concatenate_and_cut(rows(spark, texts, True).repartition(3), path, window=window)
    got = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in got:
        assert r.sequence_id * window + r.offset == at and r.length * 4 == len(r.ids) and r.offset + r.length <= window
        at += r.length
    for i, text in enumerate(texts):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == direct(path, text)
        assert {r.doc_tokens for r in own} == {sum(r.length for r in own)}
    whole = {r.sequence_id: r for r in packing.windows(pieces).collect()}
    assert sorted(whole) == list(range(len(whole)))
    assert all(len(whole[i].ids) == 4 * window for i in range(len(whole) - 1))
    first = whole[0].boundaries
    assert [b.offset for b in first] == np.cumsum([0, *[b.length for b in first[:-1]]]).tolist()


def test_packing_of_an_empty_table_and_null_ids(spark):
    assert packing.concatenate_and_cut(rows(spark, []), WORDS).count() == 0
    assert binary_packing.pack(rows(spark, []), WORDS).count() == 0
    null = spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")
    assert [r.doc_id for r in packing.concatenate_and_cut(null, WORDS).collect()] == [None, None]
    assert binary_packing.pack(null, WORDS).count() == 2


def test_digest_rows_match_the_ids(spark):
    pieces = packing.concatenate_and_cut(rows(spark, TEXTS), WORDS, window=16)
    want = {(r.sequence_id, r.offset): zlib.crc32(bytes(r.ids)) for r in pieces.collect()}
    assert {(r.sequence_id, r.offset): r.ids_crc32 for r in packing.digest_rows(pieces).collect()} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_takes_the_least_room(lengths):
    lengths = sorted(lengths, reverse=True)
    row, offset = binary_packing.best_fit_decreasing(np.array(lengths, np.int64), 20)
    room: dict[int, int] = {}
    for length, r, o in zip(lengths, row.tolist(), offset.tolist(), strict=True):
        fits = [x for x in room.values() if x >= length]
        assert room.get(r, 20) == 20 - o
        assert room.get(r, 20) == min(fits, default=20)
        room[r] = 20 - o - length
    assert all(x >= 0 for x in room.values())


def test_packed_rows_round_trip(spark, tmp_path):
    texts = TEXTS + TEXTS[:1]
    pieces = binary_packing.pack(rows(spark, texts, True), WORDS, capacity=32)
    binary_packing.packed_rows(pieces, 32, pad_id=9).write.parquet(str(tmp_path / "packed"))
    found: dict[int, dict[int, list]] = {}
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        ids, places = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<i4")
        assert len(ids) == len(places) == 32 and r.cu_seqlens[0] == 0 and len(r.cu_seqlens) == len(r.segments) + 1
        for (a, b), s in zip(zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False), r.segments, strict=True):
            assert b - a == s.length and places[a:b].tolist() == list(range(s.length))
            found.setdefault(s.doc_id, {})[s.start] = ids[a:b].tolist()
        assert (ids[r.cu_seqlens[-1] :] == 9).all()
    for i, text in enumerate(texts):
        assert sum((found[i][k] for k in sorted(found[i])), []) == direct(WORDS, text)


def test_shards_hold_all_pieces(spark, monkeypatch):
    monkeypatch.setattr(binary_packing, "SHARD_PIECES", 7)
    pieces = spark.createDataFrame([(i, 1 + i * 37 % 60) for i in range(50)], "piece long, length long")
    got = binary_packing.place(pieces, 64).collect()
    assert sorted(r.piece for r in got) == list(range(50))
    rows_: dict[int, list] = {}
    for r in got:
        rows_.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in rows_.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist()
        assert sum(n for _, n in parts) <= 64


def test_queries_pack_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(WORDS)
    for query in (queries.op7_packing, queries.op2_binary_packing):
        got = query(spark, folder).collect()
        by_doc: dict[int, list] = {}
        for r in got:
            by_doc.setdefault(r.doc_id, []).append(r)
        assert set(by_doc) == set(docs)
        for doc_id, own in by_doc.items():
            ids = np.array([*tokenizer.encode(docs[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
            own.sort(key=lambda r: r.start)
            assert sum(r.length for r in own) == own[0].doc_tokens == len(ids)
            for r in own:
                assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        rows_: dict[int, list] = {}
        for r in got:
            rows_.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in rows_.values():
            parts.sort()
            assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist()
            assert sum(n for _, n in parts) <= 4096
        assert sum(n for p in rows_.values() for _, n in p) / (4096 * len(rows_)) > 0.95


def test_binary_packing_reports_the_matrix_it_has_written(spark):
    from pathlib import Path

    from timeloom.session import run_folder

    before = set(Path(run_folder(spark)).glob("llm-matrix-*"))
    got = {(r.sequence_id, r.offset): r for r in queries.op2_binary_packing(spark, "/root/testdata/sf0.001").collect()}
    (made,) = set(Path(run_folder(spark)).glob("llm-matrix-*")) - before
    seen = 0
    for r in spark.read.parquet(str(made)).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == 4096 and len(r.positions) == 4 * 4096
        for begin, end, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.segments, strict=False):
            told = got[r.sequence_id, begin]
            assert (told.doc_id, told.start, told.length) == (s.doc_id, s.start, s.length) and end - begin == s.length
            assert zlib.crc32(ids[begin:end].tobytes()) == told.ids_crc32
            seen += 1
    assert seen == len(got)


def test_packed_rows_want_whole_rows(spark):
    pieces = binary_packing.pack(rows(spark, TEXTS), WORDS, capacity=32)
    with pytest.raises(Exception, match="next to each other"):
        binary_packing.packed_rows(pieces.filter("offset > 0"), 32).collect()


def test_slices_with_marks_and_special_tokens_in_any_case():
    import random

    import pyarrow as pa

    from timeloom.llm.words import text_bytes

    r = random.Random(5)
    bits = ["a", "B", "é", "É", "1", ",", ".", "..", "!", "?", ";", " ", " ", " ", "\n", "\t", "日", "ß", "İ", "'s", "-"]
    bits += ["Word,", "x.", "\x0b", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "😀", "́", "²"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(6000)]
    tokenizer, made = Tokenizer.from_file(WORDS), tokens.encoder(WORDS)
    for first in range(0, len(texts), 100):
        part = texts[first : first + 100]
        for text, found in zip(part, made.ids_of_slice(*text_bytes(pa.array(part))), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert made.ids_of_slice(np.zeros(0, np.uint8), np.zeros(1, np.int64)) == []
