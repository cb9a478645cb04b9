"""Quality of documents by a regularised quadratic discriminant (operator 11).

A text becomes a vector of transformed statistics: shares of letters, words, shingles and
lines of some kind, on a variance-stabilising scale, and logarithms of lengths.  Each class
is a normal distribution with a covariance of its own, shrunk towards the pooled one and
then towards its diagonal.  The score is the logistic of the difference of the two log
densities; Mahalanobis distances come from the inverse Cholesky factors kept in the model.

Fitting needs sums and products only, so all labelled rows count and nothing is sampled.
Statistics are whole multiples of ``1 / GRID``: sums are exact, and a model doesn't depend
on how rows were split among tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.llm.common import map_batches, text_or_empty, values

GRID = 4096
#: Share of the pooled covariance in a class's own, and of the diagonal in the mixture.
POOLED, DIAGONAL = 0.05, 0.05
#: Added to every variance, in units of statistics squared: constant statistics occur.
LEAST_VARIANCE = 1e-3

LETTERS = re.compile(r"[^\W\d_]+")
MARKS = re.compile(r"[^\w\s.,;:'\"()?!¿¡…«»-]")
NAMES = (
    "upper", "marks", "calls", "digits", "twins", "echoes", "distinct", "short", "long",
    "ended", "lines", "capital", "width", "sentence",
)


def share(part: int, whole: int, usual: float, weight: int) -> float:
    """A share on the arcsine scale, where its spread hardly depends on it.

    ``weight`` cases with the ``usual`` share are added, so a short text, in which a share
    says little, is close to an ordinary one.
    """
    return float(np.arcsin(np.sqrt((min(part, whole) + usual * weight) / (whole + weight))))


def statistics(text: str) -> list[int]:
    """The statistics of a whole text, in ``NAMES``' order, in multiples of 1 / GRID."""
    words = text.split()
    runs = LETTERS.findall(text)
    lines = [line for line in text.split("\n") if line.strip()]
    letters, n = sum(map(len, runs)), len(words)
    widths = list(map(len, runs))
    triples = n - 2 if n > 2 else 0
    ends = sum(map(text.count, ".!?"))
    found = [
        share(sum(map(str.isupper, text)), letters, 0.03, 100),
        share(len(MARKS.findall(text)), len(text), 0.002, 100),
        share(text.count("!") + text.count("?"), n, 0.01, 20),
        share(sum(map(str.isdigit, text)), len(text), 0.005, 200),
        share(sum(map(eq, words, islice(words, 1, None))), n, 0.01, 40),
        share(triples - len(set(zip(words, islice(words, 1, None), islice(words, 2, None)))), triples, 0.05, 100),
        share(len(set(words)), n, 0.8, 60),
        share(sum(w <= 3 for w in widths), len(widths), 0.35, 40),
        share(sum(w >= 12 for w in widths), len(widths), 0.08, 40),
        share(sum(line.rstrip().endswith((".", "!", "?")) for line in lines), len(lines), 0.95, 10),
        share(sum(" " not in line.strip() for line in lines), len(lines), 0.05, 10),
        share(sum(run[0].isupper() for run in runs), len(runs), 0.15, 40),
        float(np.log((letters + 5 * 40) / (len(runs) + 40))),
        float(np.log((n + 8 * 5) / (ends + 5))) / 4,
    ]
    return [round(x * GRID) for x in found]


def describe(docs: DataFrame, column: str = "text") -> DataFrame:
    """Every row with ``statistics`` (integers, see ``NAMES``) in place of its text.

    Texts are read whole; null, empty and blank ones have the statistics of an empty text.
    Equal texts get equal statistics, repeated rows stay, an empty table gives an empty
    one.  Other columns pass through; one named ``statistics`` is replaced.
    """
    kept = [c for c in docs.columns if c not in (column, "statistics")]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [statistics(text) for text in values(batch.column("__text"))]
        arrays = [*(batch.column(c) for c in kept), pa.array(found, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, [*kept, "statistics"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    source = docs.select(*(F.col(f"`{c}`") for c in kept), text_or_empty(column).alias("__text"))
    return map_batches(source, run, schema + "statistics array<bigint>")


@dataclass(frozen=True)
class Normal:
    """A class: its prior, mean, and the inverse of the Cholesky factor of its covariance."""

    log_prior: float
    mean: np.ndarray
    factor: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Log of prior times density of every row, but for a constant."""
        distance = np.square((x - self.mean) @ self.factor.T).sum(axis=1)
        return self.log_prior + np.log(np.diag(self.factor)).sum() - distance / 2


@dataclass(frozen=True)
class Model:
    """The two classes; without both, ``share`` of label 1 is every row's score."""

    classes: tuple[Normal, Normal] | None
    share: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for every row of statistics."""
        if self.classes is None:
            return np.full(len(x), self.share)
        low, high = (c.log_density(x / GRID) for c in self.classes)
        return 1 / (1 + np.exp(np.clip(low - high, -700, 700)))


def held_out(id_column: str = "doc_id"):
    """Whether a row's label is never learnt from: one in four by a checksum of its id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of ``statistics`` for each ``label``, exactly.

    Tasks add up what they read; Spark sums one row for each label and entry.
    """
    size = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for label in np.unique(labels):
                own = x[labels == label]
                entries = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                total[int(label)] = total.get(int(label), 0) + entries
        for label, entries in total.items():
            columns = [np.full(len(entries), label), np.arange(len(entries)), entries]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["label", "at", "value"])

    summed = rows.mapInArrow(run, "label long, at long, value long").groupBy("label", "at").agg(F.sum("value").alias("value"))
    found: dict[int, np.ndarray] = {}
    for row in summed.collect():  # two labels, 1 + p + p * p entries each
        found.setdefault(row.label, np.zeros(1 + size + size * size, object))[row.at] = row.value
    return {k: (v[0], v[1 : size + 1], v[size + 1 :].reshape(size, size)) for k, v in found.items()}


def fit(found: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """The discriminant of the moments of labels 0 and 1."""
    counts = [found[k][0] if k in found else 0 for k in (0, 1)]
    if not all(counts):
        return Model(None, counts[1] / sum(counts) if any(counts) else 0.5)
    total = sum(counts)
    means, covariances = [], []
    for label, n in enumerate(counts):
        _, sums, products = found[label]
        # Integers up to here, so nothing cancels before the division.
        spread = (products * n - np.outer(sums, sums)).astype(float) / (float(n) * n)
        means.append(sums.astype(float) / n / GRID)
        covariances.append(spread / GRID**2)
    pooled = sum(c * n / total for c, n in zip(covariances, counts))
    classes = []
    for mean, own, n in zip(means, covariances, counts):
        mixed = (1 - POOLED) * own + POOLED * pooled
        mixed = (1 - DIAGONAL) * mixed + DIAGONAL * np.diag(np.diag(mixed))
        lower = np.linalg.cholesky(mixed + LEAST_VARIANCE * np.eye(len(mean)))
        classes.append(Normal(float(np.log(n / total)), mean, np.linalg.inv(lower)))
    return Model((classes[0], classes[1]))


def train(described: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The model of all labelled rows that aren't held out.

    Labels other than 0 and 1, null ids and ids that are held out are left; of several
    labels of one id the largest counts.  Rows of one id all count.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).cast("long").alias("label"))
    return fit(moments(described.select("doc_id", "statistics").join(known, "doc_id").select("label", "statistics")))


def score(described: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Add ``score`` (0 to 1, chance of label 1) and ``predicted`` (1 from ``threshold`` on).

    Takes the rows of ``describe``.  Other columns pass through; those named like a result
    are replaced.
    """
    kept = [c for c in described.columns if c not in ("score", "predicted")]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
        scores = model.score(x)
        arrays = [*(batch.column(c) for c in kept), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(arrays, [*kept, "score", "predicted"])

    schema = "".join(f"`{c}` {described.schema[c].dataType.simpleString()}, " for c in kept)
    return map_batches(described.select(*(F.col(f"`{c}`") for c in kept)), run, schema + "score double, predicted int")
