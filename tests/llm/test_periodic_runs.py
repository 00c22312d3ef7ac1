import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from timeloom.llm import periodic_runs, words
from timeloom.llm.periodic_runs import find_in_texts, find_runs, runs_of
from timeloom.llm.queries import with_planted_runs

DOCS = "doc_id long, text string, runs int, n_words string"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w):
    """Every run of the definition, by trying all periods at all places."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            smaller = any(all(w[t] == w[t - p] for t in range(start + p, j)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sample(r, alphabet):
    parts = []
    for _ in range(r.randrange(1, 6)):
        unit = [r.choice(alphabet) for _ in range(r.randrange(1, 12))]
        parts += unit * r.randrange(1, 9) + unit[: r.randrange(len(unit))]
    return parts


@pytest.mark.parametrize("size", [1, 2, 3, 20])
def test_runs_are_those_of_all_periods_and_places(size):
    r = random.Random(size)
    alphabet = [f"w{i}" for i in range(size)]
    for _ in range(150):
        w = sample(r, alphabet)
        numbers = np.unique(w, return_inverse=True)[1]
        assert list(zip(*(x.tolist() for x in runs_of(numbers)), strict=True)) == brute(w)


def test_nested_and_overlapping_runs():
    inner = ["a", "b"] * 4 + ["c"]
    w = [*inner * 5, "d", "d"]
    found = list(zip(*(x.tolist() for x in runs_of(np.unique(w, return_inverse=True)[1])), strict=True))
    assert found == brute(w)
    assert (0, 45, 9) in found and (9, 8, 2) in found


def test_one_word_and_long_periods_take_little_time():
    began = time.time()
    assert [x.tolist() for x in runs_of(np.zeros(300_000, np.int64))] == [[0], [300_000], [1]]
    r = np.random.default_rng(1)
    unit = r.permutation(40_000)
    assert [x.tolist() for x in runs_of(np.tile(unit, 5))] == [[0], [200_000], [40_000]]
    assert time.time() - began < 20


def test_texts_of_a_slice_do_not_touch():
    texts = ["a a a", "a a a", None, "", "x\ta a\na  a\x0ba a", "é é é é é é É"]
    n_words, runs, collapsed = find_in_texts(pa.array(texts))
    assert n_words.to_pylist() == [3, 3, 0, 0, 7, 7]
    assert [[tuple(r.values()) for r in x] for x in runs.to_pylist()] == [[], [], [], [], [(1, 6, 1)], [(0, 6, 1)]]
    assert collapsed.to_pylist() == ["a a a", "a a a", "", "", "x a", "é É"]
    assert [len(x) for x in find_in_texts(pa.array([], pa.string()))] == [0, 0, 0]


def test_defined_results_for_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(words, "SLICE_BYTES", 64)
    r = random.Random(8)
    texts = [(i, r.choice([" ", "\n", " \t"]).join(sample(r, ["a", "B", "b", "日本", "c-d"]))) for i in range(60)]
    texts += [(None, "a " * 9), (70, None), (71, ""), (72, " \n\t "), texts[0], (73, "w " * 50_000)]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in texts], DOCS).repartition(3)
    found = [(x.doc_id, x.n_words, tuple(map(tuple, x.runs)), x.collapsed) for x in find_runs(docs).collect()]
    expected = []
    for i, t in texts:
        w = split(t)
        runs = brute(w) if i != 73 else [(0, 50_000, 1)]
        expected.append((i, len(w), tuple(runs), collapse(w, runs)))
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert find_runs(docs.limit(0)).count() == 0


def planted(doc_id, text):
    w = split(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_digests_of_planted_documents(spark):
    r = random.Random(9)
    texts = [(i, " ".join(sample(r, [f"w{k}" for k in range(9)]))) for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in texts], DOCS)
    rows = {x.doc_id: x for x in periodic_runs.digest_rows(find_runs(with_planted_runs(docs))).collect()}
    assert len(rows) == len(texts)
    assert any(planted(i, t) != split(t) for i, t in texts)
    for i, t in texts:
        w = planted(i, t)
        runs, x = brute(w), rows[i]
        best = min(runs, key=lambda u: (-u[1] / u[2], u[0], u[2]), default=(None,) * 3)
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(collapse(w, runs).encode()).hexdigest()
