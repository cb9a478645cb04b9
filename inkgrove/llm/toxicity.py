"""Toxic documents and the sentences that make them so (operator 2).

Multiple-instance learning: a document is a bag of sentences of which only the bag is
labelled.  A sentence's chance of being toxic is logistic in its words; a document is
toxic unless every sentence is clean (noisy-or).  Labels err now and then, whatever the
text, so the label follows the noisy-or with a floor and a ceiling.  All weights are
fitted to document labels; the sentence scores then locate what offends.

The model is fitted on the driver on a sample of at most ``SAMPLE`` labelled rows, the
only thing that is bounded; every document is scored, whole.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.llm.common import map_batches, text_or_empty, values

SAMPLE = 3000
VOCABULARY = 4000
LEAST_DOCS = 4
STEPS = 300
# Chance that a clean text is labelled 1, and that a toxic one is labelled 0.
FLOOR, CEILING = 0.03, 0.97

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word and its beginnings, marked by ``*``: insults inflect."""
    return [word, *(word[:n] + "*" for n in (3, 4, 5) if len(word) > n)]


def lower(text: str) -> str:
    """Lower case, of the same length: a few letters would change theirs and stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Words(dict):
    """Word to its total weight, remembered for at most ``limit`` words."""

    def __init__(self, weights: dict[str, float], limit: int = 200_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        self[word] = total = sum(self.weights.get(f, 0.0) for f in features(word))
        return total


@dataclass(frozen=True)
class Model:
    """Weights of words and of beginnings, and that of a sentence without any."""

    weights: dict[str, float]
    bias: float

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """A model with its cache of words; one per task."""

    def __init__(self, model: Model):
        self.bias, self.words = model.bias, Words(model.weights)

    def spans(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Start, end and chance of every sentence that holds a word of positive weight."""
        low, total = lower(text), self.words
        triggers = {w for w in set(WORD.findall(low)) if total[w] > 0}
        if triggers:
            for m in SENTENCE.finditer(low):
                words = set(WORD.findall(m[0]))
                if not triggers.isdisjoint(words):
                    yield m.start(), m.end(), 1 / (1 + math.exp(-(self.bias + sum(total[w] for w in sorted(words)))))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Chance that the text's label is 1, and its sentences with a word of positive weight.

        Other sentences count as clean, so that length alone never makes a text toxic.
        """
        spans = list(self.spans(text))
        clean = math.prod(1 - p for *_, p in spans)
        return FLOOR + (CEILING - FLOOR) * (1 - clean), spans


def held_out(id_column: str = "doc_id"):
    """Whether a row's label is never learnt from: one in five by a checksum of its id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``size`` labelled texts that may be learnt from, chosen by a hash of their id."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # At most ``size`` narrow rows.
    rows = docs.select("doc_id", text_or_empty()).join(F.broadcast(chosen), "doc_id")
    return [(r["text"], r["toxic"]) for r in rows.select("text", "toxic").orderBy("doc_id", "text").collect()]


def fit(rows: list[tuple[str, int]], steps: int = STEPS) -> Model:
    """Noisy-or model of (text, label) rows; without both labels nothing is toxic."""
    labels = np.array([label for _, label in rows], float)
    if not len(labels) or labels.min() == labels.max():
        return Model({}, -20.0)
    vocabulary = _vocabulary(rows, labels)
    number = {w: i for i, w in enumerate(vocabulary)}
    entries, sentences, documents = array("q"), array("q"), array("q")
    at = 0
    for d, (text, _) in enumerate(rows):
        for sentence in SENTENCE.findall(lower(text)):
            known = [number[f] for w in sorted(set(WORD.findall(sentence))) for f in features(w) if f in number]
            if known:
                entries.extend(known)
                sentences.extend([at] * len(known))
                documents.append(d)
                at += 1
    entries, sentences, documents = (np.array(x, np.int64) for x in (entries, sentences, documents))
    weights, bias = np.zeros(len(vocabulary)), -3.0
    moment, square = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    n = len(labels)
    for step in range(1, steps + 1):
        z = bias + np.bincount(sentences, weights[entries], at)
        p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
        clean = np.exp(np.bincount(documents, np.log1p(-p), n))
        q = FLOOR + (CEILING - FLOOR) * (1 - clean)
        # Gradient of the log loss; d(1 - clean) / dz is clean * p for each sentence.
        outer = (q - labels) / (q * (1 - q)) * (CEILING - FLOOR) * clean
        inner = outer[documents] * p
        slope = np.bincount(entries, inner[sentences], len(vocabulary)) / n + 2e-5 * np.sign(weights) + 1e-5 * weights
        both = np.append(slope, inner.sum() / n)
        moment, square = 0.9 * moment + 0.1 * both, 0.999 * square + 0.001 * both**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    kept = {w: float(x) for w, x in zip(vocabulary, weights) if abs(x) > 0.3}
    return Model(kept, float(bias))


def _vocabulary(rows: list[tuple[str, int]], labels: np.ndarray) -> list[str]:
    """The features whose documents' labels differ most from all, by a chi-square of counts."""
    total: dict[str, int] = {}
    toxic: dict[str, int] = {}
    for text, label in rows:
        for word in {f for w in set(WORD.findall(lower(text))) for f in features(w)}:
            total[word] = total.get(word, 0) + 1
            if label:
                toxic[word] = toxic.get(word, 0) + 1
    share = labels.mean()
    words = [w for w, n in total.items() if n >= LEAST_DOCS]
    n = np.array([total[w] for w in words], float)
    k = np.array([toxic.get(w, 0) for w in words], float)
    score = (k - n * share) ** 2 / (n * share * (1 - share))
    order = np.lexsort((words, -score)) if words else []
    return [words[i] for i in order[:VOCABULARY]]


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    return fit(sample(docs, labels, size))


def score(docs: DataFrame, model: Model, column: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``score``, ``predicted`` and ``offending`` to every row.

    ``score`` is the chance, 0 to 1, that the label is 1; ``predicted`` is 1 from
    ``threshold`` on; ``offending`` lists (start, end, score, text) of the sentences whose
    own chance reaches it.  Null, empty and blank texts have no sentences: they get the
    floor and are clean.  Texts are read whole.  Equal texts get equal scores; empty
    tables give empty results; other columns pass through, those named like a result are
    replaced.
    """
    results = ["score", "predicted", "offending"]
    kept = [c for c in docs.columns if c not in results]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(
        pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text", pa.string())])
    )

    scorers: list[Scorer] = []

    def run(batch: pa.RecordBatch):
        if not scorers:
            scorers.append(shared.value.scorer())
        own = scorers[0]
        scores, offending = [], []
        for text in values(batch.column("__text")):
            value, spans = own.score(text)
            scores.append(value)
            offending.append(
                [{"start": s, "end": e, "score": p, "text": text[s:e]} for s, e, p in spans if p >= threshold]
            )
        scored = np.array(scores)
        arrays = [pa.array(scored), pa.array((scored >= threshold).astype(np.int32)), pa.array(offending, kind)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], [*kept, *results])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    schema += "score double, predicted int, offending array<struct<start: int, end: int, score: double, text: string>>"
    return map_batches(docs.select(*kept, text_or_empty(column).alias("__text")), run, schema)
