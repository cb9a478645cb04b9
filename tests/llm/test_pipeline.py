"""Stages of the pipeline against brute force, on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkgrove.llm import near_dup, packing
from inkgrove.llm.common import bound_batches, table

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
EXTRA = {"score": "text score", "n_lines": "text lines", "predicted": "p", "kept": "k", "component_id": "c", "cosine": "x", "__found": "f"}


@pytest.fixture(scope="module")
def docs(spark):
    """The documents with nulls, blanks, repeats, a shared line and columns named like results."""
    bound_batches(spark)
    own = table(spark, SF, "documents")
    rng = random.Random(1)
    rows = [(90_000, None), (90_001, ""), (90_002, " \n"), (None, "no id"), (90_003, "twice"), (90_003, "twice")]
    rows += [(91_000 + i, f"{' '.join(f'w{rng.randrange(900)}' for _ in range(30))}\n  Shared LINE x\nown {i}") for i in range(12)]
    rows += [(92_000, "long " * 30_000)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    more = more.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return own.unionByName(more).withColumns({k: F.lit(v) for k, v in EXTRA.items()}).cache()


def key(row):
    return repr(row)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_columns_and_rows_as_they_were(spark, docs, name):
    out = STAGES[name](spark, docs, SF)
    assert out.dtypes == docs.dtypes
    rows = [r.asDict() for r in out.collect()]
    assert all(r[k] == v for r in rows for k, v in EXTRA.items())
    kept = {r["doc_id"] for r in rows}
    assert {90_000, 90_001, 90_002, 91_000, 92_000} <= kept
    if name != "line_dedup":
        before = {repr(r) for r in docs.collect()}
        assert all(repr(r) in before for r in out.collect())
    assert STAGES[name](spark, docs.limit(0), SF).collect() == []


def test_shared_lines_go(spark, docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    strip = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for n, (_, text) in enumerate(rows):
        for line in text.split("\n"):
            held.setdefault(strip(line), set()).add(n)
    want = sorted(
        (repr(i), "\n".join(line for line in text.split("\n") if not strip(line) or len(held[strip(line)]) < 10)) for i, text in rows
    )
    got = STAGES["line_dedup"](spark, docs, SF).collect()
    assert sorted((repr(r.doc_id), r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_one_of_each_group_stays(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id != 92_000]

    def shingles(text):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    low, high = sorted((label[a], label[b]))
                    label = {i: low if x == high else x for i, x in label.items()}
    want = {i for i, x in label.items() if i == x} | {None, 92_000}
    assert {r.doc_id for r in STAGES["near_dedup"](spark, docs, SF).collect()} == want
    assert near_dup.Similarity(words=5, over=80, under=100).value == 0.8


def test_pieces_hold_all_that_is_left(spark):
    """The last stage packs what the fourth kept: every piece once, sequences without gaps."""
    pieces = corpus_pipeline.run(spark, SF).collect()
    by_sequence, by_document = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_document.setdefault(p.doc_id, []).append((p.piece, p.start, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    for parts in by_document.values():
        at = 0
        for n, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (n, at)
            at += length
    assert by_document.keys() <= {r.doc_id for r in table(spark, SF, "documents").collect()}
    assert packing is not None
