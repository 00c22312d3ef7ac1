import random
import re

import pytest

from timeloom.llm import components, near_dedup

SCHEMA = "doc_id long, text string, set_key int, cluster string, class int, bands int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2, 3) for r in rows], SCHEMA).repartition(4)


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    found = components.UnionFind()
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                found.unite(a, b)
    return {i: found.root(i) for i, _ in sets}, {i: len(s) for i, s in sets}


def corpus(seed=1):
    r = random.Random(seed)
    rows, words = [], [f"w{i}" for i in range(3000)]

    def text(n):
        return [r.choice(words) for _ in range(n)]

    def changed(base, share):
        return [r.choice(words) if r.random() < share else w for w in base]

    for _ in range(12):
        base = text(r.choice([8, 40, 200]))
        for share in (0.0, 0.0, 0.01, 0.02, 0.04, 0.08):
            rows.append(changed(base, share))
    hot = text(120)  # a large group whose members are linked in part
    rows += [changed(hot, r.choice([0.005, 0.02, 0.05])) for _ in range(70)]
    rows += [text(60) for _ in range(20)] + [["one"], ["one"], ["two", "words"], ["Two", "WORDS"]]
    r.shuffle(rows)
    ids = r.sample(range(10_000), len(rows))
    out = [(i, " ".join(w)) for i, w in zip(ids, rows, strict=True)]
    return out + [(20_001, ""), (20_002, None), (20_003, " \n"), (None, out[0][1]), (None, None), out[1]]


@pytest.mark.parametrize(("size", "percent", "classes"), [(3, 85, 256), (5, 80, 256), (3, 85, 16)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, size, percent, classes):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", classes)
    rows = corpus()
    want, sizes = brute(rows, size, percent)
    got = near_dedup.find_near_duplicates(frame(spark, rows), size, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], sizes[r.doc_id])
            assert r.kept == (r.doc_id == want[r.doc_id])


def test_representatives_keep_all_columns(spark):
    rows = corpus(2)
    want, _ = brute(rows, 5, 80)
    got = near_dedup.keep_representatives(frame(spark, rows))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    kept = [r.doc_id for r in got.collect()]
    assert {i for i in kept if i is not None} == {i for i, c in want.items() if i == c}
    assert kept.count(None) == 2


def test_no_rows(spark):
    assert near_dedup.find_near_duplicates(frame(spark, [])).count() == 0
    assert near_dedup.keep_representatives(frame(spark, [])).count() == 0


def test_repeated_doc_id_with_other_text(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "a b c d e f")]
    got = near_dedup.find_near_duplicates(frame(spark, rows), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1)]


def test_connected_components(spark, monkeypatch):
    monkeypatch.setattr(components, "FOREST_LINKS", 3)
    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 540)]
    links += [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(90)] + [(7, 7)]
    r.shuffle(links)
    sets = components.UnionFind()
    for a, b in links:
        sets.unite(a, b)
    want = {x: sets.root(x) for pair in links for x in pair if sets.root(x) != x}
    df = spark.createDataFrame([(a, b) if r.random() < 0.5 else (b, a) for a, b in links], "a long, b long").repartition(7)
    got = components.components(df).collect()
    assert len(got) == len(want) and {x.node: x.component for x in got} == want
    assert components.components(df.limit(0)).count() == 0
