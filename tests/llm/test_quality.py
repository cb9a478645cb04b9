"""Quality scores against a plain discriminant and held-out labels."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrove.llm import quality
from inkgrove.llm.common import bound_batches, table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, n long"


@pytest.fixture(scope="module")
def labelled(spark):
    bound_batches(spark)
    rows = table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id")
    return [(r.doc_id, r.text or "", r.quality) for r in rows.select("doc_id", "text", "quality").collect()]


def is_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def plain_discriminant(rows):
    """Scores of all rows, from covariances of the texts and densities as in a textbook."""
    x = np.array([quality.statistics(t) for _, t, _ in rows]) / quality.GRID
    y = np.array([q for *_, q in rows])
    known = np.array([not is_held(i) for i, *_ in rows])
    parts = [x[known & (y == k)] for k in (0, 1)]
    own = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(c * len(p) for c, p in zip(own, parts)) / known.sum()
    logs = []
    for part, c in zip(parts, own):
        c = (1 - quality.POOLED) * c + quality.POOLED * pooled
        c = (1 - quality.DIAGONAL) * c + quality.DIAGONAL * np.diag(np.diag(c)) + quality.LEAST_VARIANCE * np.eye(len(c))
        away = x - part.mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away)
        logs.append(np.log(len(part) / known.sum()) - np.linalg.slogdet(c)[1] / 2 - distance / 2)
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def test_scores_equal_a_plain_discriminant(spark, labelled):
    described = quality.describe(table(spark, SF, "documents").select("doc_id", "text"))
    model = quality.train(described, table(spark, SF, "labels"))
    got = {r.doc_id: r for r in quality.score(described, model).collect()}
    for (doc_id, _, _), want in zip(labelled, plain_discriminant(labelled)):
        assert got[doc_id].score == pytest.approx(want, abs=1e-6)
        assert got[doc_id].predicted == int(got[doc_id].score >= 0.7)


def test_held_out_accuracy(spark, labelled):
    described = quality.describe(table(spark, SF, "documents").select("doc_id", "text"))
    scored = quality.score(described, quality.train(described, table(spark, SF, "labels")))
    got = {r.doc_id: r for r in scored.select("doc_id", "predicted", quality.held_out().alias("held")).collect()}
    assert all(got[i].held == is_held(i) for i, *_ in labelled)
    held = [(got[i].predicted, q) for i, _, q in labelled if is_held(i)]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)
    assert all(p == 1 for p, q in held if q == 1)


def test_held_out_labels_do_not_matter(spark):
    described = quality.describe(table(spark, SF, "documents").select("doc_id", "text")).cache()
    labels = table(spark, SF, "labels")
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    rows = [quality.score(described, quality.train(described, t)).orderBy("doc_id").collect() for t in (labels, flipped)]
    assert rows[0] == rows[1]


def test_model_does_not_depend_on_partitions(spark):
    described = quality.describe(table(spark, SF, "documents").select("doc_id", "text")).cache()
    labels = table(spark, SF, "labels")
    one, other = (quality.train(described.repartition(n), labels) for n in (1, 7))
    for a, b in zip(one.classes, other.classes):
        assert (a.mean == b.mean).all() and (a.factor == b.factor).all() and a.log_prior == b.log_prior


def test_awkward_rows(spark):
    long = "word " * 200_000
    rows = [(1, None, "s", 1), (2, "", "s", 1), (3, " \n ", "s", 1), (4, long, None, 2), (5, "same", "s", 3), (5, "same", "s", 3), (None, "no id", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(4, 1), (4, 0), (1, None), (2, 7), (None, 1), (5, 1), (1, 0), (3, 0)], "doc_id long, quality int")
    described = quality.describe(docs.withColumn("statistics", F.lit("taken")))
    scored = quality.score(described, quality.train(described, labels))
    assert scored.columns == ["doc_id", "n", "statistics", "score", "predicted"]
    got = [r.asDict() for r in scored.drop("statistics").collect()]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] == by[2] == by[3] and len({r["score"] for r in got if r["doc_id"] == 5}) == 1


def test_no_labels_one_class_no_rows(spark):
    docs = quality.describe(spark.createDataFrame([(1, "a b", "s", 1), (3, "c", "s", 1)], SCHEMA))
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (3, 1), (4, 1), (5, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, quality.train(docs, one)).collect()} == {1.0}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), one)).collect() == []


def test_echo_and_twin_shares():
    plain = quality.statistics("The first words. Then other words follow here, and some more.")
    shout = quality.statistics("WORDS!! WORDS!! WORDS!! WORDS!! WORDS!! WORDS!! WORDS!! WORDS!!")
    by = dict(zip(quality.NAMES, zip(plain, shout)))
    for name in ("upper", "calls", "twins", "echoes"):
        assert by[name][1] > by[name][0]
    assert by["distinct"][1] < by["distinct"][0]
