import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from timeloom.llm import near_dedup
from timeloom.llm.superminhash import band_keys, signatures
from timeloom.llm.words import ALPHANUMERIC, SPACED, slices, text_bytes, word_bounds, word_hashes

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ09 \t\n\x0b.,-éあ'", max_size=12)), max_size=8)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_regular_expressions(texts):
    for table, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        starts, ends, first = word_bounds(data, offsets, table)
        hashes = word_hashes(data, starts, ends)
        raw, known = data.tobytes(), {}
        for i, text in enumerate(texts):
            found = [raw[a:b].decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
            assert [fold(w) for w in found] == re.findall(pattern, fold(text))
            for word, h in zip(found, hashes[first[i] : first[i + 1]], strict=True):
                assert known.setdefault(fold(word), h) == h
        assert len(set(known.values())) == len(known)


def test_slices_keep_rows_in_order_and_split_none():
    batch = pa.record_batch({"text": ["a" * 10, None, "b" * 100, "", "c"]})
    parts = list(slices(batch, "text", 20))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()
    assert len(parts) > 1


def test_signatures_estimate_similarity_and_stop_with_full_rows():
    random = np.random.default_rng(3)
    for size in (1, 3, 40, 900):
        errors = []
        for _ in range(60):
            shared = max(1, int(size * 0.7))
            values = random.integers(1, 1 << 62, 2 * size - shared).astype(np.uint64)
            a, b = values[:size], values[size - shared :]
            got = signatures(np.concatenate([a, b, a[::-1], a]), np.array([0, size, 2 * size, 4 * size]), 128)
            assert (got[0] == got[2]).all()
            assert (got >> np.uint64(56) < 128).all()
            errors.append((got[0] == got[1]).mean() - shared / (2 * size - shared))
        assert abs(np.mean(errors)) < 0.02


def test_signature_of_an_empty_set_and_band_keys():
    got = signatures(np.array([5, 6], np.uint64), np.array([0, 0, 2]), 16)
    assert (got[0] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    keys = band_keys(got, 4)
    assert keys.shape == (2, 4) and len(set(keys[1].tolist())) == 4


def test_shingle_sets_of_short_texts():
    sets = near_dedup.shingle_sets(pa.array(["a b c d", "A B  C\nd", "a", "a b", "b a", "", None, "a b c a b c"]), 3)
    assert [len(s) for s in sets] == [2, 2, 1, 1, 1, 0, 0, 3]
    assert (sets[0] == sets[1]).all() and sets[3][0] != sets[4][0]
