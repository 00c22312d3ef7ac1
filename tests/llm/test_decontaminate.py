import hashlib
import random
import re

import numpy as np
import pytest

from timeloom.llm import decontaminate

DOCS = "doc_id long, text string, hits int, row string, item_id int"
ITEMS = "item_id long, text string, doc_id int"


def words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(docs, items, size):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), []
        for item_id, item in items:
            w = words(item)
            n = min(size, len(w))
            windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            at = [i for i in range(len(own) - n + 1) if n and tuple(own[i : i + n]) in windows]
            for i in at:
                hit.update(range(i, i + n))
            if at and item_id not in found:
                found.append(item_id)
        joined = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = ["a", "b", "c", "été", "The", "x1", "日本"]

    def text(n):
        return [r.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(text(n))) for i, n in enumerate([14, 12, 10, 9, 3, 30])] + [(6, ""), (7, None), (8, "--"), (9, "unique")]
    items += [(10, items[0][1]), (None, " ".join(text(11)))]
    items += [(1, items[0][1]), (None, items[3][1]), (3, " ".join(text(12))), items[5]]  # ids and rows that repeat
    docs = []
    for i in range(40):
        parts = text(r.choice([0, 3, 15, 60]))
        if i % 3 == 0:
            item = words(r.choice(items)[1])
            cut = item[r.randrange(3) :]
            parts = [*parts, *cut, *text(4), *cut]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(parts)))
    return [*docs, (50, None), (51, ""), (None, items[0][1].upper()), docs[0], (52, "Unique-UNIQUE")], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
@pytest.mark.parametrize("size", [10, 4])
def test_hits_are_those_of_all_windows(spark, monkeypatch, size, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    docs, items = corpus()
    left = spark.createDataFrame([(*d, 1, "r", 2) for d in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    found = decontaminate.find_contamination(left, right, size)
    got = sorted((tuple(r) for r in decontaminate.digest_rows(found).collect()), key=str)
    want = brute(docs, items, size)
    assert got == want
    clean = decontaminate.find_contamination(left, right, size, only_clean=True)
    assert clean.columns == left.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(w[0]) for w in want if not w[5])


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x y " + item + " z"), (2, "w5 w6 w7 w8 q")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(docs, items, 4).collect()}
    assert [tuple(m) for m in got[1].matches] == [(7, 2, 0, 20)]
    assert [tuple(m) for m in got[2].matches] == [(7, 0, 5, 4)] and got[2].n_hit == 4


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.digest_rows(decontaminate.find_contamination(docs, none)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got) == [(1, 2, 0, False), (2, 0, 0, False)]
    assert decontaminate.find_contamination(docs, none, only_clean=True).count() == 2
    assert decontaminate.find_contamination(docs.limit(0), none).count() == 0


def test_suffix_array_is_sorted():
    random_ = np.random.default_rng(1)
    words_ = np.concatenate([random_.integers(0, 3, 500), np.zeros(12, int)]).astype(np.int32)
    places = np.flatnonzero(words_)
    array = decontaminate.suffix_array(words_, places, 10)
    keys = [tuple(words_[p : p + 10]) for p in array]
    assert keys == sorted(keys) and sorted(array) == sorted(places)
