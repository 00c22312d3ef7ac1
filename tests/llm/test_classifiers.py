import zlib

import numpy as np
import pyarrow as pa
import pytest

from timeloom.llm import language, quality, queries, toxicity
from timeloom.llm.sampling import drop_copies, labelled_sample

FOLDER = "/root/testdata/sf0.1"


def labels(spark, name):
    return {r.doc_id: r[name] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}


def held_out(got, truth, modulus, rest):
    rows = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % modulus == rest]
    assert all(r.held_out for r in rows) and not any(r.held_out for r in got if r not in rows[:0] and zlib.crc32(str(r.doc_id).encode()) % modulus != rest)
    return [(r, truth[r.doc_id]) for r in rows if truth.get(r.doc_id) is not None]


@pytest.mark.parametrize(
    ("query", "name", "split", "least"),
    [
        (queries.op4_quality, "quality", queries.QUALITY_SPLIT, 0.97),
        (queries.op10_toxicity, "toxic", queries.TOXICITY_SPLIT, 0.95),
    ],
)
def test_held_out_accuracy(spark, query, name, split, least):
    got = query(spark, FOLDER).collect()
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    pairs = held_out(got, labels(spark, name), *split)
    right = np.mean([r.predicted == y for r, y in pairs])
    assert len(pairs) > 500 and right >= least
    for label in (0, 1):
        assert np.mean([r.predicted == y for r, y in pairs if y == label]) > 0.9


def test_held_out_language(spark):
    got = queries.op6_language(spark, FOLDER).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    pairs = held_out(got, truth, *queries.LANGUAGE_SPLIT)
    assert np.mean([r.lang_pred == y for r, y in pairs]) > 0.98


def test_edge_rows(spark):
    rows = [(None, "text", "en", 1, 0.0), (1, None, None, 2, 1.0), (2, "", "en", 3, 1.0), (2, "", "en", 3, 1.0), (3, "123 ... 456", "de", 4, 0.0)]
    docs = spark.createDataFrame([*rows, (4, "ein Wort " * 60_000, "de", 1, 0.0)], "doc_id long, text string, lang string, score int, bias double")
    known = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for module in (quality, toxicity):
        model = module.fit(docs, known)
        got = module.score_documents(docs, model)
        assert got.count() == 6 and all(0 <= r.score <= 1 for r in got.collect())
        assert module.score_documents(docs.limit(0), model).count() == 0
    assert language.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language.predict_documents(docs, None).collect()} == {"und"}
    model = language.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in language.predict_documents(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and (4, "de") in got


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} " * 300) for i in range(50)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 3) for i in range(50)] * 2 + [(None, 1), (3, None)], "doc_id long, label int")
    got = labelled_sample(docs, known, 5, 160)
    assert len(got) == 15 and all(len(t) <= 160 + 16 for t, _ in got)
    assert got == labelled_sample(docs.repartition(7), known, 5, 160)


def test_near_copies_leave_the_sample():
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), " ".join(["x", *base]), " ".join(f"v{i}" for i in range(200)), "", "a", "a", "b"]
    assert [t for t, _ in drop_copies([(t, 0) for t in texts])] == [texts[0], texts[2], "", "a", "b"]


def test_folding():
    assert toxicity.folded_words("An 1d10t, ІDIОT i​diot ïdiót $cum t.rash") == ["an", "idiot", "idiot", "idiot", "idiot", "scum", "t", "rash"]
    assert toxicity.folded_words("WORD!! word$$$ 100") == ["word", "word", "ioo"]
    assert toxicity.folded_words(None) == []


def test_lexicon_exceptions_and_length():
    model = toxicity.ToxicityModel({" trash ": 5.0, " stupi": 5.0}, ("trash can",), (-4.0, 2.0, 1.0))
    assert model.features("the trash can")[0] == 0
    assert model.features("trash trash")[0] == pytest.approx(np.log1p(10))
    assert model.score("so stupidly trash") > model.score("so stupidly trash " + "fine " * 300) > model.score("fine")


def test_quality_of_many_texts_is_that_of_each():
    sample = [("good words in a row here", 1), ("BAD!! BAD!! BAD!!", 0)] * 20
    model = quality.fit_sample(sample)
    texts = ["good words", "", None, "BAD!!", "é", "a b a b b", "good words in a row"]
    together = model.scores(pa.array(texts))
    assert together == pytest.approx([model.scores(pa.array([t], pa.string()))[0] for t in texts])
    assert together[0] > 0.5 > together[3]


def test_windows_cover_the_whole_text():
    texts = ["a" * 700, "", "b" * 256, "c"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    found, owner = language.cut_windows(data, np.array([0, 700, 700, 956, 957]))
    assert owner.tolist() == [0, 0, 0, 2, 3]
    assert [int((found[owner == i] != 0).sum()) for i in range(4)] == [700, 0, 256, 1]


def test_training_gradients_are_right():
    random = np.random.default_rng(2)
    model = language.fit_sample([("ab ba " * 20, "x"), ("cd dc " * 20, "y")], epochs=1)
    for name in ("vectors", "filters", "offsets", "outputs", "bias"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    windows = random.integers(97, 101, (3, language.WINDOW)).astype(np.uint8)
    labels_ = np.array([0, 1, 1])
    seen = (model.filters != 0).astype(float)

    def loss():
        raw = model.pooled(windows)[2] @ model.outputs + model.bias
        return -np.mean([r[y] - np.log(np.exp(r).sum()) for r, y in zip(raw, labels_, strict=True)])

    for name, gradient in zip(("vectors", "filters", "offsets", "outputs", "bias"), language._gradients(model, windows, labels_, seen), strict=True):
        weight = getattr(model, name)
        at = tuple(random.integers(0, n) for n in weight.shape) if name != "vectors" else (97, 1)
        if name == "filters" and not seen[at]:
            continue
        kept, step = weight[at], 1e-5
        weight[at] = kept + step
        up = loss()
        weight[at] = kept - step
        down = loss()
        weight[at] = kept
        assert gradient[at] == pytest.approx((up - down) / (2 * step), abs=1e-4)
