"""Benchmark items, copied and reworded, against search by plain products and all windows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from inkgrove.llm import decontamination as D
from inkgrove.llm.common import bound_batches, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def items(spark):
    bound_batches(spark)
    rows = table(spark, SF, "benchmark").orderBy("item_id").collect()
    return [(r.item_id, r.text) for r in rows]


def reworded(text, every, rng):
    """Every ``every``-th word replaced, the last sentence untouched."""
    words = text.split()
    keep = len(words) - len(D.answer_of(text.encode()))
    return " ".join(f"zz{rng.randrange(10**5)}" if i < keep and i % every == 0 else w for i, w in enumerate(words))


def filler(spark, n, rng):
    """Words of real documents, shuffled, so that no passage is left but all words are usual ones."""
    words = [w for r in table(spark, SF, "documents").limit(60).collect() for w in (r.text or "").split()]
    return lambda k=80: " ".join(rng.choice(words) for _ in range(k))


@pytest.mark.parametrize("every", [3, 4])
def test_recall_of_reworded_items(spark, items, every):
    rng = random.Random(every)
    around = filler(spark, 0, rng)
    rows = [(100_000 + i, f"{around()} {reworded(text, every, rng)} {around()}") for i, text in items]
    clean = [(200_000 + i, around(300)) for i in range(100)]
    docs = table(spark, SF, "documents").select("doc_id", "text").union(spark.createDataFrame(rows + clean, "doc_id long, text string"))
    found = D.matches(docs, table(spark, SF, "benchmark")).collect()
    hits = {r.doc_id - 100_000 for r in found if 100_000 <= r.doc_id < 200_000 and r.item_id == r.doc_id - 100_000}
    assert len(hits) >= 0.9 * len(items)
    assert not [r for r in found if r.doc_id >= 200_000]
    again = D.matches(docs.repartition(7), table(spark, SF, "benchmark")).collect()
    assert sorted((r.doc_id, r.item_id, r.kind, r.lcs, r.start) for r in again) == sorted(
        (r.doc_id, r.item_id, r.kind, r.lcs, r.start) for r in found
    )


def test_documents_with_copies_are_found_and_others_kept(spark, items):
    """Against all five-word runs of all documents."""
    grams = {}
    for i, text in items:
        words = D.words_of(text.encode())
        for at in range(len(words) - 4):
            grams.setdefault(tuple(words[at : at + 5]), set()).add(i)
    want = set()
    docs = table(spark, SF, "documents").select("doc_id", "text")
    for row in docs.collect():
        words, hits = D.words_of((row.text or "").encode()), {}
        for at in range(len(words) - 4):
            for i in grams.get(tuple(words[at : at + 5]), ()):
                hits[i] = hits.get(i, 0) + 1
        want |= {(row.doc_id, i) for i, n in hits.items() if n >= 0.5 * (len(dict(items)[i].split()) - 4)}
    found = {(r.doc_id, r.item_id) for r in D.matches(docs, table(spark, SF, "benchmark")).collect()}
    assert want <= found
    assert {d for d, _ in found} == {d for d, _ in want}


def test_answers_are_taken_as_they_stand():
    assert D.answer_of(b"What is it? It is Ab z.") == b"it is ab z.".split()
    assert D.answer_of(b"First. z.  ") == [b"z."]
    assert D.answer_of(b"One line\nthe answer \n") == b"the answer".split()
    assert D.answer_of(b"about 3.5 of all e.g. one, two, three four five six seven") == b"one, two, three four five six seven".split()
    assert D.answer_of(b"a b c d e f g h i j k l m n o p q r s t") == b"p q r s t".split()
    assert D.answer_of(b"") == [] and D.answer_of(b"one") == [b"one"]


def test_number_words_splits_like_bytes():
    texts = ["", " ", "a B", "  A\tb\x0bc\n", "é À\x1cb x\x85", "a" * 9, "\n\n", "b"]
    vocabulary = [b"a", b"b", b"c", "é".encode()]
    found = D.number_words(pa.array(texts), pa.array(vocabulary, pa.binary()).cast(pa.string()))
    for i, text in enumerate(texts):
        want = [vocabulary.index(w) if w in vocabulary else -1 for w in D.words_of(text.encode())]
        assert found.slice(i).tolist() == want


@pytest.mark.parametrize("rank", [4, 40])
def test_no_window_is_lost_before_the_projection(rank):
    """``near`` against the projection of every window of every text."""
    rng = random.Random(rank)
    vocabulary = {b"w%03d" % i: i for i in range(150)}
    names = sorted(vocabulary)
    items = [D.Item(k, ws := rng.choices(names, k=rng.randrange(5, 70)), ws[-3:]) for k in range(12)]
    used = sorted({vocabulary[w] for item in items for w in item.words})
    idf = np.random.default_rng(rank).uniform(0, 3, len(used)) * (np.arange(len(used)) % 7 > 0)
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((len(used), min(rank, len(used)))))[0]
    shard = D.Shard(items, vocabulary, idf, basis)
    texts = [[], [b"w001"], rng.choices(names, k=16), rng.choices(names, k=17)]
    for item in items:
        part = [w if rng.random() < 0.7 else b"foreign" for w in item.words]
        texts += [part, rng.choices(names, k=rng.randrange(90)) + part + [b"x"] * rng.randrange(60)]
    numbers = [np.array([vocabulary.get(w, -1) for w in t], np.int64) for t in texts]
    batch = D.Numbered(shard.local[np.concatenate(numbers)], np.concatenate([[0], np.cumsum(list(map(len, numbers)))]))
    want = {}
    for row in range(len(texts)):
        own = batch.slice(row)
        for k, start in enumerate(D.windows(len(own)) if len(own) else []):
            latent = sum((shard.loadings[n] for n in own[start : start + D.WIDTH] if n >= 0), np.zeros(basis.shape[1], np.float32))
            if np.linalg.norm(latent) > 1e-6:
                along = shard.queries @ latent / shard.lengths
                cosine = along / np.linalg.norm(latent)
                for p in np.flatnonzero((cosine >= D.COSINE) & (along >= D.PART * shard.lengths)):
                    want.setdefault((row, k, int(shard.owners[p])), []).append(float(cosine[p]))
    text = np.repeat(np.arange(len(texts)), np.diff(batch.starts))
    got = {}
    for row, k, i, cosine in shard.near(batch, text):
        got.setdefault((row, k, i), []).append(cosine)
    assert got and got.keys() == want.keys()
    assert all(sorted(got[k]) == pytest.approx(sorted(want[k]), abs=1e-4) for k in want)


def test_many_shards_share_their_passes(spark, monkeypatch):
    """Small shards and small groups find the same documents."""
    rng = random.Random(4)
    words = [f"b{i}" for i in range(900)]
    items = [(i, " ".join(rng.choices(words, k=40)) + ". Answer " + " ".join(rng.choices(words, k=3))) for i in range(30)]
    around = lambda n: " ".join(f"f{rng.randrange(3000)}" for _ in range(n))
    rows = [(i, f"{around(40)} {text} {around(70)}") for i, text in items] + [(100 + i, around(200)) for i in range(30)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, items[0][1]), (7, items[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (None, "x y")], "item_id long, text string")
    want = {(i, i) for i, _ in items} | {(None, 0)}
    for rank, group in ((384, 96 << 20), (12, 96 << 20), (12, 1)):
        monkeypatch.setattr(D, "RANK", rank)
        monkeypatch.setattr(D, "GROUP_BYTES", group)
        found = D.matches(docs, bench).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
        assert all(r.kind == "copy" and "run" in r.found_by for r in found)


def test_basis_counts_the_passages_of_all_documents(spark, monkeypatch):
    """Pairs of words against every passage of every document, whatever a task holds at once."""
    rng = random.Random(8)
    names = [f"w{i:02d}" for i in range(30)]
    texts = [" ".join(rng.choices([*names, "other"], k=k)) for k in (0, 1, 5, 16, 17, 31, 32, 33, 48, 49, 150)] * 120 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words, weighted = [n.encode() for n in names], [np.arange(31), np.arange(31)]
    weighted[0][[3, 30]] = weighted[1][[*range(20), 30]] = -1
    want = {}
    for text in texts:
        split = D.words_of((text or "").encode())
        numbers = np.array([words.index(w) if w in words else -1 for w in split], np.int64)
        for start in D.windows(len(numbers)) if len(numbers) else []:
            for shard, local in enumerate(weighted):
                features, times = D.tfidf(local[numbers[start : start + D.WIDTH]], np.ones(30))
                for i, a in zip(features.tolist(), times.tolist()):
                    for j, b in zip(features.tolist(), times.tolist()):
                        if i <= j:
                            want[shard, i, j] = want.get((shard, i, j), 0) + a * b
    for pairs in (1 << 22, 500):
        monkeypatch.setattr(D, "PAIRS", pairs)
        found = D.together(docs, words, weighted, "text").collect()
        assert {(r.shard, r.i, r.j): r.n for r in found} == want and len(found) == len(want)


def test_tally_holds_little():
    """Counts are right, and waiting codes take little of an executor that runs several workers."""
    import tracemalloc

    rng = np.random.default_rng(3)
    given = [rng.integers(0, 1000 * k, 1 << 18) for k in range(1, 25)]
    tally = D.Tally()
    tracemalloc.start()
    for codes in given:
        tally.add(codes.copy())
    found, n = tally.take()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want, times = np.unique(np.concatenate(given), return_counts=True)
    assert np.array_equal(found, want) and np.array_equal(n, times)
    assert not len(tally.take()[0])
    assert peak < 64 << 20


def test_basis_is_that_of_all_passages(spark):
    """Against the singular vectors of all passages, one by one."""
    rng = np.random.default_rng(5)
    idf = rng.uniform(0.5, 2, 40)
    own = [D.tfidf(rng.integers(0, 40, 20), idf) for _ in range(6)]
    corpus = [D.tfidf(rng.integers(0, 40, 20), np.ones(40)) for _ in range(50)]
    total = np.zeros((40, 40))
    for features, times in corpus:
        total[np.ix_(features, features)] += np.outer(times, times)
    pairs = [(i, j, int(total[i, j])) for i in range(40) for j in range(i, 40) if total[i, j]]
    basis = D.randomised_svd(own, spark.createDataFrame(pairs, "i long, j long, n long"), idf, 40)
    gram = np.outer(idf, idf) * total
    whole = sum(np.bincount(f, w, 40)[:, None] * np.bincount(f, w, 40) for f, w in own)
    whole = whole + gram * (D.CORPUS_ENERGY * np.trace(whole) / np.trace(gram))
    values, vectors = np.linalg.eigh(whole)
    assert np.allclose(basis.T @ whole @ basis, np.diag(values[::-1]), atol=1e-6 * values[-1])
