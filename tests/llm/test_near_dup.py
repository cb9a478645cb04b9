"""Near-duplicate groups of buckets with far members, against all pairs of sets."""

import random

import pytest

from inkgrove.llm import near_dup
from inkgrove.llm.common import bound_batches


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()


def shingles(text, size):
    words = words_of(text)
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, over, under):
    """Id to (set size, smallest id reachable), by all pairs of rows with an id."""
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if a and b and under * common >= over * (len(a) + len(b) - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def drifting(seed, families=3, members=40, length=120, change=4):
    """Families of texts that each differ a little from the one before: ends of a family are far apart."""
    rng = random.Random(seed)
    rows = []
    for family in range(families):
        words = [f"f{family}w{rng.randrange(500)}" for _ in range(length)]
        for _ in range(members):
            rows.append((len(rows) * 3 % 1009, " ".join(words)))
            at = rng.randrange(length - change)
            words[at : at + change] = [f"x{rng.randrange(10**6)}" for _ in range(change)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, shares", [(512, 16), (4, 2), (1, 1)])
def test_far_members_of_a_bucket(spark, monkeypatch, block, shares):
    bound_batches(spark)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "SHARES", shares)
    rows = drifting(block) + [(2000, None), (2001, ""), (2002, "one word"), (2003, "One  word"), (None, "one word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_dup.near_duplicates(docs, near_dup.Similarity(3, 80, 100)).collect()
    want = brute(rows, 3, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert len(got) == len(rows)


def test_plans_stay_small(spark, monkeypatch):
    """Stored tables cut the plans: none that is run holds more than some twenty exchanges."""
    plans = []
    keep = near_dup.stored

    def watched(df, *args, **options):
        plans.append(df._jdf.queryExecution().sparkPlan().toString().count("Join") + df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return keep(df, *args, **options)

    monkeypatch.setattr(near_dup, "stored", watched)
    docs = spark.createDataFrame(drifting(9, 1, 10), "doc_id long, text string")
    near_dup.near_duplicates(docs, near_dup.Similarity(3, 80, 100)).collect()
    assert plans and max(plans) <= 40
