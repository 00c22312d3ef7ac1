import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_exact_dedup import brute as brute_copies
from tests.llm.test_near_dedup import brute as brute_near
from timeloom.llm import queries


def tables(spark, folder):
    r = random.Random(8)
    words = [a + b for a in "bdfglmnprt" for b in ("ano", "eli", "iru", "oma", "usk", "ett", "ald", "ink")]

    def text(n):
        return [r.choice(words) for _ in range(n)]

    docs, labels = [], []
    for i in range(400):
        parts = text(r.choice([12, 60, 150]))
        if i % 4 == 0:
            parts[r.randrange(len(parts))] = r.choice(["idiot", "moron", "scum"])
        docs.append((i, " ".join(parts)))
        labels.append((i, 1, int(i % 4 == 0)))
    item = text(25)
    extra = [docs[1][1], docs[2][1] + "\n", docs[3][1] + " " + r.choice(words), "An 1d10t wrote " + docs[5][1]]
    extra += [" ".join([*text(30), *item, *text(30)]), " ".join(text(40)), "", None]
    docs += [(1000 + i, t) for i, t in enumerate(extra)] + [docs[6], (None, "row without an id " + " ".join(text(20)))]
    rows = [(*d, "en", "s", 1, "x") for d in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    frame.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, [(1, " ".join(item))]


def pairs(rows):
    return sorted(((r[0], r[1]) for r in rows), key=str)


def test_every_stage_and_the_whole(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = tables(spark, folder)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]

    bad = {"idiot", "moron", "scum", "1d10t"}
    clean = [d for d in docs if not bad & set((d[1] or "").split())]
    got = stages["toxicity"](spark, frame, folder)
    assert got.columns == frame.columns and pairs(got.collect()) == pairs(clean)

    copies = brute_copies(clean)
    got = stages["exact_dedup"](spark, got, folder)
    unique = {(min((i for i in ids if i is not None), default=None), t) for t, ids in copies.items()}
    assert got.columns == frame.columns
    assert {r.doc_id for r in got.collect()} == {i for i, _ in unique} and got.count() == len(unique)

    left = pairs(got.collect())
    components, _ = brute_near(left, 5, 80)
    got = stages["near_dedup"](spark, got, folder)
    want = [d for d in left if d[0] is None or components[d[0]] == d[0]]
    assert got.columns == frame.columns and pairs(got.collect()) == want and len(want) < len(left)

    clean_ids = {r[0] for r in brute_hits(want, items, 10) if not r[5]}
    got = stages["decontamination"](spark, got, folder)
    want = [d for d in want if d[0] in clean_ids]
    assert got.columns == frame.columns and pairs(got.collect()) == want and 1004 not in clean_ids

    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in want}
    total = {d: len(own) for d, own in ids.items()}
    for packed in (stages["packing"](spark, got, folder).collect(), corpus_pipeline.run(spark, folder).collect()):
        sums: dict = {}
        for r in packed:
            sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
        assert sums == total
        at = np.array(sorted((r.sequence_id * 4096 + r.offset, r.length) for r in packed))
        for r in packed:
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length]
        assert (at[1:, 0] == at[:-1, 0] + at[:-1, 1]).all() and at[0, 0] == 0
