import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from timeloom.llm import lexical_search
from timeloom.llm.lexical_search import Best, item_tiles, rank_documents, tile_scores

DOCS = "doc_id long, text string, score int, item_id int"
ITEMS = "item_id long, text string, doc_id int, rank string"


def terms(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in held:
            m = 75 + 25 * c.total() * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text)
                if c[t]
            )
            if score:
                found.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, gone, doc_id) in enumerate(sorted(found)[:k], 1):
            out.append((item_id, rank, None if gone else doc_id, -score))
    return sorted(out, key=str)


def corpus(seed=5):
    r = random.Random(seed)
    vocabulary = ["a", "B", "c7", "été", "The", "x_1", "日本", "don't", *(f"w{i}" for i in range(60))]

    def text(n):
        return r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(n))

    docs = [(i * 3 % 101, text(r.choice([0, 1, 5, 40, 300]))) for i in range(90)]
    docs += [(200 + i, "w1 w2 W3") for i in range(50)] + [(None, "w1 w2 w3"), (7, None), (8, ""), (9, "_ - !"), docs[3]]
    items = [(i, text(n)) for i, n in enumerate([3, 12, 40, 1, 200])]
    items += [(10, "w1 w2 w3"), (11, None), (12, ""), (13, "unheard"), (None, "w1 w5"), (14, "w4 " * 50), (10, "w9"), items[0]]
    return docs, items


@pytest.mark.parametrize("k", [20, 1000])
@pytest.mark.parametrize("block", [1 << 20, 40])
def test_ranks_are_those_of_all_pairs(spark, monkeypatch, k, block):
    monkeypatch.setattr(lexical_search, "BLOCK_WEIGHTS", block)
    docs, items = corpus()
    left = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], DOCS).repartition(5)
    right = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    found = rank_documents(left, right, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, k)


def test_empty_tables_give_no_rows(spark):
    docs, items = spark.createDataFrame([(1, "a", 1, 1)], DOCS), spark.createDataFrame([(1, "a", 1, "x")], ITEMS)
    assert rank_documents(docs.limit(0), items).count() == 0
    assert rank_documents(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in rank_documents(docs, items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // 2200))]


def test_a_long_text_counts_to_its_end(spark):
    long = "filler " * 300_000 + "needle"
    docs = spark.createDataFrame([(1, long, 1, 1), (2, "needle", 1, 1), (3, "other", 1, 1)], DOCS)
    items = spark.createDataFrame([(5, "Needle", 1, "x")], ITEMS)
    assert [(r.rank, r.doc_id) for r in rank_documents(docs, items).collect()] == [(1, 2), (2, 1)]


def weights(rows):
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("item", "item_id", "term", "weight"))})


@pytest.mark.parametrize("terms_, items_", [(2048, 256), (3, 2)])
def test_tiles_are_exact_beyond_the_reach_of_float64(monkeypatch, terms_, items_):
    monkeypatch.setattr(lexical_search, "TILE_TERMS", terms_)
    monkeypatch.setattr(lexical_search, "TILE_ITEMS", items_)
    r = np.random.default_rng(2)
    rows = [(i, i, t, int(r.integers(1, 1 << r.integers(1, 36)))) for i in range(5) for t in range(0, 40, 1 + i)]
    dense = np.zeros((5, 40), object)
    for i, _, t, w in rows:
        dense[i, t] += w
    tiles = item_tiles(weights(rows))
    most = 9_007_199_254
    for tile in tiles:
        for part in tile.parts:
            total = np.bincount(part.item, part.weight, minlength=items_)
            assert total.max() <= most and len(part.terms) <= terms_
    impacts = r.integers(0, 1_000_000, (7, 40))
    bounds, own = np.arange(8) * 40, np.tile(np.arange(40), 7)
    found = np.concatenate([tile_scores(t, bounds, own, impacts.reshape(-1)) for t in tiles])
    assert found.tolist() == (dense @ impacts.T.astype(object)).tolist()
    assert found.max() > 1 << 53


def test_ties_are_kept_until_ids_decide():
    r = np.random.default_rng(4)
    for _ in range(200):
        n = int(r.integers(0, 60))
        score, doc, gone = r.integers(0, 4, n), r.permutation(n), r.random(n) < 0.1
        best = Best(5)
        for part in np.array_split(np.arange(n), 4):
            best.add(score[part], gone[part], doc[part])
        expected = sorted((-s, g, d) for s, g, d in zip(score.tolist(), gone.tolist(), doc.tolist(), strict=True) if s > 0)
        assert [(-s, g, d) for s, g, d in best.rows()] == expected[:5]
