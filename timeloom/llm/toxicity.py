"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, strips marks, maps look-alike letters to Latin ones and digits and signs
that stand for letters to these, and drops invisible characters. Lexicon entries are whole
words or beginnings of words with a weight, learned from labelled texts. Of entries that
overlap the first and longest counts, so a longer exception phrase (weight 0) takes its words
out. A logistic function of the weights' sum and of that sum per length gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.llm.sampling import labelled_sample
from timeloom.llm.words import slices

#: At most so many labelled rows of each label are learned from, each of so many characters.
ROWS_PER_LABEL, MAX_CHARS = 4000, 16_384
THRESHOLD = 0.3
#: How much better than chance a learned entry must be (log likelihood ratio), and how much
#: likelier in toxic texts (log ratio).
MIN_EVIDENCE, MIN_WEIGHT = 24.0, 1.5
SHORTEST_STEM, LONGEST_STEM = 3, 9
#: Phrases that hold a term in a harmless sense.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "not stupid", "not worthless")

_LOOK_ALIKES = {
    **dict(zip("аеорсухіјѕһԁӏкмтвнг", "aeopcyxijshdlkmtbhr", strict=True)),
    **dict(zip("αεοριυνκτχημβ", "aeopiuvktxnmb", strict=True)),
    **dict(zip("ıłøđħŧɑɡɩ", "ilodhtagi", strict=True)),
}
_DIGITS = dict(zip("0134579", "oieastg", strict=True))
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
_SIGN = re.compile(r"[@$!|€](?=[a-z@$!|€]*[a-z])")


class _Folding(dict):
    """Code point to folded text, made when first met."""

    def __missing__(self, code: int) -> str:
        letter = chr(code)
        kind = unicodedata.category(letter)
        if letter in _SIGNS:
            folded = letter
        elif kind in ("Cf", "Mn", "Me"):
            folded = ""
        else:
            plain = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
            plain = "".join(_LOOK_ALIKES.get(c, _DIGITS.get(c, c)) for c in plain.casefold())
            folded = plain if plain and all(c.isalnum() for c in plain) else " "
        self[code] = folded
        return folded


_folding = _Folding()


def folded_words(text: str | None) -> list[str]:
    """The words of a text after folding."""
    text = (text or "").translate(_folding)
    if any(s in text for s in _SIGNS):
        text = _SIGN.sub(lambda m: _SIGNS[m[0]], text)
        text = re.sub(r"[@$!|€]+", " ", text)
    return text.split()


def _joined(words: list[str]) -> str:
    # Every word has two spaces of its own, so that matches of neighbours do not overlap.
    return f" {'  '.join(words)} "


@dataclass
class ToxicityModel:
    """Entries " word " or " stem" to weights, exceptions, and the logistic function's coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-4.0, 2.0, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                made.add_word(entry, weight)
            for phrase in self.exceptions:
                made.add_word(_joined(folded_words(phrase)), 0.0)
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float]:
        """The logarithms of the weights' sum and of that sum per hundred words."""
        words = folded_words(text)
        automaton = self.automaton()
        if not len(automaton) or not words:
            return 0.0, 0.0
        total = sum(weight for _, weight in automaton.iter_long(_joined(words)))
        return math.log1p(total), math.log1p(100 * total / len(words))

    def score(self, text: str | None) -> float:
        bias, a, b = self.coefficients
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + a * x + b * y))))


def learn_lexicon(sample: list[tuple[str, int]]) -> dict[str, float]:
    """Words and stems that tell toxic texts, with their log ratio as weight.

    A stem is left out where a shorter stem in the lexicon tells about as well.
    """
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    rows = [0, 0]
    vocabulary: Counter = Counter()
    texts = []
    for text, toxic in sample:
        texts.append((set(folded_words(text)), int(toxic)))
        rows[int(toxic)] += 1
        if toxic:
            vocabulary.update(_entries(texts[-1][0]))
    if not all(rows):
        return {}
    least = max(3, int(MIN_EVIDENCE / (2 * math.log((rows[0] + rows[1]) / rows[1]))))
    wanted = {e for e, n in vocabulary.items() if n >= least}
    for words, toxic in texts:
        seen[toxic].update(_entries(words) & wanted)
    base = rows[1] / (rows[0] + rows[1])
    # Where one word explains most toxic rows of a stem, only the rest is evidence for it.
    explained: dict[str, int] = {}
    for entry in wanted:
        if entry.endswith(" "):
            for size in range(SHORTEST_STEM + 1, len(entry)):
                explained[entry[:size]] = max(explained.get(entry[:size], 0), seen[1][entry])
    weights: dict[str, float] = {}
    for entry in sorted(wanted, key=lambda e: (len(e), e)):
        bad, good = seen[1][entry], seen[0][entry]
        if 2 * explained.get(entry, 0) > bad:
            bad -= explained[entry]
        n = bad + good
        if bad < least:
            continue
        weight = math.log((bad + 0.5) / (rows[1] + 1)) - math.log((good + 0.5) / (rows[0] + 1))
        evidence = 2 * (bad * math.log(bad / (n * base)) + (good * math.log(good / (n * (1 - base))) if good else 0.0))
        if weight < MIN_WEIGHT or evidence < MIN_EVIDENCE:
            continue
        shorter = [weights[entry[:i]] for i in range(SHORTEST_STEM + 1, len(entry)) if entry[:i] in weights]
        if not shorter or weight > max(shorter) + 0.7:
            weights[entry] = weight
    return weights


def _entries(words: set[str]) -> set[str]:
    found = {f" {w} " for w in words}
    for size in range(SHORTEST_STEM, LONGEST_STEM + 1):
        found.update(f" {w[:size]}" for w in words if len(w) >= size)
    return found


def fit_sample(sample: list[tuple[str, int]], prior: float | None = None, exceptions: tuple[str, ...] = EXCEPTIONS) -> ToxicityModel:
    """A model from (text, 0 or 1) rows; ``prior`` is the share of toxic texts among all, if the sample's differs.

    Without rows of both labels the lexicon is empty and every score the same low one.
    """
    model = ToxicityModel(learn_lexicon(sample), exceptions)
    toxic = np.array([int(y) for _, y in sample], float)
    if not model.weights or toxic.min(initial=1) == toxic.max(initial=0):
        return model
    x = np.array([(1.0, *model.features(t)) for t, _ in sample])
    share = toxic.mean()
    prior = share if prior is None else prior
    weight = np.where(toxic > 0, prior / share, (1 - prior) / (1 - share))
    coefficients = np.zeros(3)
    # Newton steps of a logistic regression with a small ridge, which keeps separable data finite.
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ coefficients, -30, 30)))
        gradient = x.T @ (weight * (toxic - p)) - 0.1 * coefficients
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        coefficients = coefficients + np.linalg.solve(curve, gradient)
    model.coefficients = tuple(float(c) for c in coefficients)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """Learn from documents whose row in ``labels`` (doc_id, toxic) is given; other labels are ignored."""
    known = labels.filter("toxic IN (0, 1)").select("doc_id", F.col("toxic").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    return fit_sample(labelled_sample(docs, known, rows_per_label, max_chars), share)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1) of every row; whole texts are scored.

    A null or empty text scores as one without hits; a null doc_id stays null; repeated rows
    are scored each; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double")


def keep_civil(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield piece.filter(pa.array([shared.value.score(t.as_py()) < threshold for t in piece.column("text")], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
