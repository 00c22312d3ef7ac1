import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm import learned_partitions
from timeloom.llm.learned_partitions import balanced_parts, bisect, nearest, neighbour_graph, search

KINDS = "vec_id long, embedding array<float>, rank string, query_id int"


def brute(rows, step, k=20):
    """Query, rank, id and score, summed in the order of components."""
    own = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = tuple(float(np.float32(x)) for x in v)
            own[i] = min(own.get(i, v), v)
    out = []
    for q, a in own.items():
        if q % step == 0:
            found = []
            for i, b in own.items():
                total = 0.0
                for x, y in zip(a, b, strict=True):
                    total += x * y
                if i != q:
                    found.append((-total, i))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3) for i, v in rows], KINDS).repartition(4)


def clusters(n, dim, seed, norms=False):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, dim))
    x = centres[r.integers(0, 12, n)] + 0.3 * r.standard_normal((n, dim))
    return x * (r.uniform(0.2, 3, (n, 1)) if norms else 1)


@pytest.mark.parametrize("norms", [False, True])
def test_recall_against_brute_force(spark, norms):
    rows = [(i, v.tolist()) for i, v in enumerate(clusters(6000, 16, 1, norms))]
    found = {}
    for r in search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    expected = {}
    for q, _, i, s in brute(rows, 20):
        expected.setdefault(q, {})[i] = s
    assert found.keys() == expected.keys()
    hits = 0
    for q, own in found.items():
        assert [r for r, _, _ in sorted(own)] == list(range(1, 21))
        assert sorted(own) == [(n, i, s) for n, (i, s) in enumerate(sorted(((i, s) for _, i, s in own), key=lambda x: (-x[1], x[0])), 1)]
        hits += sum(i in expected[q] and s == expected[q][i] for _, i, s in own)
    assert hits >= 0.9 * 20 * len(expected)


@pytest.mark.parametrize("block, chunk", [(16_384, 65_536), (40, 7)])
def test_whole_recall_is_brute_force_for_odd_rows_and_ties(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(learned_partitions, "BLOCK_VECTORS", block)
    monkeypatch.setattr(learned_partitions, "CHUNK_QUERIES", chunk)
    r = random.Random(3)
    x = clusters(260, 5, 2).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[8][1]) for i in range(130)]  # a third are copies
    rows += [(2000, None), (2005, []), (2010, [0.0] * 5), (2015, [1.0, None, 1.0, 1.0, 1.0]), (2020, [1.0, float("nan"), 1.0, 1.0, 1.0])]
    rows += [(2025, [1.0, float("inf"), 1.0, 1.0, 1.0]), (2030, [1.0, 2.0]), (None, rows[3][1]), rows[5], rows[5], (10, [-9.0] * 5)]
    r.shuffle(rows)
    found = search(frame(spark, rows), F.col("vec_id") % 5 == 0, wanted_recall=1.0)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert sorted(map(tuple, found.collect())) == brute([(i, v) for i, v in rows if v is None or len(v) != 2], 5)


def test_few_rows(spark):
    assert search(frame(spark, []), F.col("vec_id") % 2 == 0).collect() == []
    assert search(frame(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 2 == 0).collect() == []
    assert search(frame(spark, [(1, [1.0, 2.0]), (3, [1.0, 1.0])]), F.col("vec_id") % 2 == 0).collect() == []
    found = search(frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (4, [-1.0, 0.0])]), F.col("vec_id") % 2 == 0)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 1, 5.0), (0, 2, 4, -1.0), (4, 1, 0, -1.0), (4, 2, 1, -1.0)]


def test_parts_are_balanced_and_follow_the_graph():
    x = clusters(1000, 8, 5)
    neighbours = neighbour_graph(x, 10)
    part = balanced_parts(neighbours, 3, np.random.default_rng(1))
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() - sizes.min() <= 3
    assert (part[:, None] == part[neighbours]).mean() > 0.6
    a, b = np.array([0, 1, 2, 4, 5, 6, 0]), np.array([1, 2, 3, 5, 6, 7, 4])
    half = bisect(8, a, b, np.random.default_rng(0))
    assert half.sum() == 4 and (half[a] != half[b]).sum() == 1
    assert bisect(1, a[:0], b[:0], np.random.default_rng(0)).tolist() == [1]


def test_copies_have_one_score_wherever_they_lie():
    r = np.random.default_rng(6)
    own = r.standard_normal(64).astype(np.float32).astype(float)
    vectors = np.concatenate([r.standard_normal((500, 64)) * 0.1, np.tile(own, (300, 1))])[r.permutation(800)]
    ids = r.permutation(800)
    _, found, score = nearest(np.array([-1]), own[None] + 0.01, ids, vectors, 20)
    copies = np.sort(ids[(vectors == own).all(axis=1)])
    assert found.tolist() == copies[:20].tolist() and len(set(score.tolist())) == 1
