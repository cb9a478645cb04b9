"""Documents that hold benchmark passages, also reworded ones (operator 10).

1. *Space.* Passages are windows of ``WIDTH`` words that overlap by half.  Their TF-IDF
   vectors are taken over the benchmark's vocabulary; document frequencies are counted over
   all documents, in the tasks that read them.  A randomised SVD gives a latent basis: a
   random projection is sharpened by power iterations over the passages of the benchmark and
   of all documents.  The documents' passages enter by how often two words share one, counted
   in one pass, so an iteration costs the same whatever their number.
2. *Candidates.* Every passage of every document is projected onto the basis and compared
   with every benchmark passage by cosine in the latent space, as a product of matrices.
3. *Runs.* ``RUN`` consecutive words of an item are found in every document by a rolling
   hash and compared word by word, whatever the passages' cosine.
4. *Checks.* A candidate item and the words around the passage are compared by their longest
   common subsequence.  A run of ``RUN`` words is a copy, however long the item is, and so is
   nearly all of an item.  Otherwise part of an item is a paraphrase if the item's answer, its
   last sentence unless a column names it, is found there too.

Benchmark items are handled in shards of at most ``RANK`` passages, so that the basis loses
little of any item.  As many shards as ``GROUP_BYTES`` of loadings allow share three passes
over the documents, so what is broadcast is bounded whatever the benchmark's size.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.llm.common import ASCII_LOWER, give_back, map_batches, stored, text_bytes, text_or_empty

WIDTH = 32
STEP = WIDTH // 2
RANK = 384
OVERSAMPLE = 16
ITERATIONS = 2
# Share of the energy that the documents' passages have beside the benchmark's.
CORPUS_ENERGY = 0.05
# Words that more than this share of documents hold carry no weight, if every item has others.
COMMON = 0.35
COSINE, PART = 0.4, 0.35
COPY, PARAPHRASE, ANSWER = 0.8, 0.5, 0.7
# Words at the end of an item of one sentence that count as its answer: a share, but some.
LAST_SHARE, LAST_WORDS = 0.25, 4
# Consecutive words that are a copy by themselves, half a passage.
RUN = STEP
BASE = 0x9E3779B97F4A7C15
# Bytes of the loadings that share a pass, and features summed together.
GROUP_BYTES, FEATURES = 96 << 20, 256
# Windows compared with all passages at once.
WINDOWS = 256
# Pairs of words a task holds before it adds them up or hands them on.
PAIRS = 1 << 20
# Marks of (document, word) held at once when documents are counted.
MARKS = 1 << 24

SENTENCE_END = re.compile(rb"[.!?]+[\"')\]]*\s+|\s*\n\s*")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ASCII_LOWER).split()


@dataclass(frozen=True)
class Item:
    number: int
    words: list[bytes]
    answer: list[bytes]


def answer_of(text: bytes) -> list[bytes]:
    """The words of a text's last sentence, as they stand in it; of a single one, its last words."""
    words, text = words_of(text), text.strip()
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    last = len(words_of(text[ends[-1] :])) if ends else max(LAST_WORDS, int(LAST_SHARE * len(words)))
    return words[-last:]


def shards_of(benchmark: DataFrame, id_column: str, column: str, answer_column: str | None) -> Iterator[list[Item]]:
    """Shards of items that have words; rows come to the driver a partition at a time."""
    answer = F.col(answer_column).cast("binary") if answer_column else F.lit(None).cast("binary")
    rows = benchmark.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("number"), text_bytes(column).alias("text"), answer.alias("answer")
    )
    shard: list[Item] = []
    passages = 0
    for row in rows.orderBy("number", "text").toLocalIterator():
        text = bytes(row["text"])
        words = words_of(text)
        more = len(windows(len(words)))
        if shard and passages + more > RANK:
            yield shard
            shard, passages = [], 0
        if words:
            passages += more
            named = words_of(bytes(row["answer"])) if row["answer"] else []
            shard.append(Item(row["number"], words, named or answer_of(text)))
    if shard:
        yield shard


def groups_of(shards: Iterator[list[Item]]) -> Iterator[list[list[Item]]]:
    """Shards that share their passes over the documents."""
    group: list[list[Item]] = []
    size = 0
    for shard in shards:
        more = len({w for item in shard for w in item.words}) * RANK * 4
        if group and size + more > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(shard)
        size += more
    if group:
        yield group


@dataclass(frozen=True)
class Numbered:
    """Words of a batch of texts as numbers (-1 for others), one after the other, and where each text begins."""

    numbers: np.ndarray
    starts: np.ndarray

    def slice(self, row: int) -> np.ndarray:
        return self.numbers[self.starts[row] : self.starts[row + 1]]


def number_words(texts: pa.Array, vocabulary: pa.Array) -> Numbered:
    """Split at ASCII white space, lower A-Z, and look up every word of a column of texts."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    sizes = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes[pc.equal(pc.binary_length(pc.ascii_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False)] = 0
    words = parts.flatten()
    words = words.filter(pc.greater(pc.binary_length(words), 0))
    numbers = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    return Numbered(numbers.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))


def numbers_of(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """Feature number of every word of an item."""
    return np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))


def document_frequencies(docs: DataFrame, vocabulary: list[bytes], column: str) -> tuple[int, np.ndarray]:
    """Number of documents, and for each feature of those that have it."""
    size = len(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.binary()).cast(pa.string(), safe=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        counts, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            found = number_words(batch.column(0), shared.value)
            text = np.repeat(np.arange(batch.num_rows), np.diff(found.starts))
            step = max(1, MARKS // size)
            for first in range(0, batch.num_rows, step):
                part = slice(found.starts[first], found.starts[min(first + step, batch.num_rows)])
                at = np.flatnonzero(found.numbers[part] >= 0)
                marks = np.zeros((min(step, batch.num_rows - first), size), bool)
                marks[text[part][at] - first, found.numbers[part][at]] = True
                counts += marks.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, np.flatnonzero(counts)]), pa.array(np.r_[n, counts[counts > 0]])], ["feature", "n"]
        )

    rows = docs.select(text_or_empty(column)).mapInArrow(run, "feature long, n long")
    total = {r["feature"]: r["n"] for r in rows.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    shared.destroy()
    return total.pop(-1, 0), np.array([total.get(i, 0) for i in range(size)], float)


def windows(n: int) -> np.ndarray:
    """Start of each window of ``WIDTH`` words; the last one reaches the end."""
    return np.arange(0, max(1, n - STEP), STEP)


def tfidf(numbers: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights of one passage."""
    features, times = np.unique(numbers[numbers >= 0], return_counts=True)
    return features, times * idf[features]


def together(docs: DataFrame, words: list[bytes], weighted: list[np.ndarray], column: str) -> DataFrame:
    """(shard, i, j, n): how often weighted words share a passage, over all passages of all documents.

    ``weighted`` has for each shard the feature number of every word of the group, -1 for
    words without weight.  ``n`` adds the products of the words' numbers in each passage; a
    pair is listed once, ``i <= j``.  Tasks add up their own texts; what they hold is bounded.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((pa.array(words, pa.binary()).cast(pa.string(), safe=False), weighted))
    sizes = [int(local.max(initial=-1)) + 1 for local in weighted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        vocabulary, weighted = shared.value
        totals = [Tally() for _ in weighted]

        def listed(shard: int) -> pa.RecordBatch:
            codes, n = totals[shard].take()
            columns = [np.full(len(codes), shard), codes // sizes[shard], codes % sizes[shard], n]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "i", "j", "n"])

        for batch in batches:
            whole = number_words(batch.column(0), vocabulary)
            for shard, local in enumerate(weighted):
                for codes in pairs_of(Numbered(local[whole.numbers], whole.starts), sizes[shard]):
                    totals[shard].add(codes)
                if len(totals[shard].codes) > PAIRS:
                    yield listed(shard)
        for shard in range(len(weighted)):
            yield listed(shard)
        give_back()

    rows = docs.select(text_or_empty(column)).mapInArrow(run, "shard long, i long, j long, n long")
    return stored(rows.groupBy("shard", "i", "j").agg(F.sum("n").alias("n")), "together")


class Tally:
    """Counts of codes, added up whenever ``PAIRS`` are waiting."""

    def __init__(self):
        self.codes, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.many = 0

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes)
        self.many += len(codes)
        if self.many >= PAIRS:
            self.settle()

    def settle(self) -> None:
        codes, n = np.unique(np.concatenate([np.empty(0, np.int64), *self.waiting]), return_counts=True)
        self.waiting, self.many = [], 0
        if len(self.codes) and len(codes):
            codes, n = np.concatenate([self.codes, codes]), np.concatenate([self.n, n])
            order = np.argsort(codes, kind="stable")  # merges the two sorted runs
            codes, n = codes[order], n[order]
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            codes, n = codes[first], np.add.reduceat(n, first)
        elif len(self.codes):
            return
        self.codes, self.n = codes, n

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        out = self.codes, self.n
        self.codes, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        return out


def pairs_of(batch: Numbered, size: int) -> Iterator[np.ndarray]:
    """Codes ``i * size + j`` of the pairs of words (numbers from 0 on) of each passage, i <= j.

    A passage is two blocks of ``STEP`` words: two words of one block meet in the passages of
    that block, one at either end of a text and two within, words of neighbours in one.  A
    word meets itself.
    """
    blocks = -(-np.diff(batch.starts) // STEP)
    first = np.concatenate([[0], np.cumsum(blocks)])
    at = np.flatnonzero(batch.numbers >= 0)
    text = np.searchsorted(batch.starts, at, side="right") - 1
    own = (at - batch.starts[text]) // STEP
    inner = (own > 0) & (own < blocks[text] - 1)
    # Blocks of different texts are never neighbours.
    block, numbers = first[text] + text + own, batch.numbers[at]
    yield numbers * (size + 1)
    yield numbers[inner] * (size + 1)
    for lag in range(1, WIDTH):
        apart = block[lag:] - block[:-lag]
        met = np.flatnonzero(apart <= 1)
        if not len(met):
            return
        a, b = numbers[met], numbers[met + lag]
        codes = np.minimum(a, b) * size + np.maximum(a, b)
        # A pair of equal words stands for two products.
        for codes in (codes, codes[a == b]):
            yield codes
        twice = (apart[met] == 0) & inner[met]
        codes = np.minimum(a, b)[twice] * size + np.maximum(a, b)[twice]
        for codes in (codes, codes[a[twice] == b[twice]]):
            yield codes


def randomised_svd(own: list[tuple[np.ndarray, np.ndarray]], pairs: DataFrame, idf: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal basis (size x rank) of the leading right singular vectors of the passages.

    ``own`` has features and weights of each passage of the shard; ``pairs`` (i, j, n) the
    number of times two words share a passage of the documents, all of which get
    ``CORPUS_ENERGY`` of the shard's energy.  Each iteration multiplies by A^T A, which
    the pairs hold whole: tasks take ``FEATURES`` of its rows at a time.
    """
    spark = pairs.sparkSession
    size = len(idf)
    columns = min(size, rank + OVERSAMPLE)
    basis = np.random.default_rng(7).standard_normal((size, columns))
    energy = sum(r["n"] * idf[r["i"]] ** 2 for r in pairs.where("i = j").select("i", "n").toLocalIterator())
    scale = CORPUS_ENERGY * sum(float(w @ w) for _, w in own) / energy if energy else 0.0
    both = pairs.select("i", "j", "n").union(pairs.where("i < j").select("j", "i", "n"))
    blocks = both.withColumn("block", F.floor(F.col("i") / FEATURES)).groupBy("block")

    for iteration in range(ITERATIONS + 1):
        basis = np.linalg.qr(basis)[0]
        product = np.zeros((size, columns))
        for features, weights in own:
            product[features] += np.outer(weights, weights @ basis[features])
        if energy:
            shared = spark.sparkContext.broadcast((basis, idf))

            def run(rows: pa.Table) -> pa.Table:
                basis, idf = shared.value
                i, j, n = (rows.column(c).to_numpy() for c in "ijn")
                block = int(i[0]) // FEATURES
                part = np.zeros((min(FEATURES, size - block * FEATURES), size))
                part[i - block * FEATURES, j] = n * idf[i] * idf[j]
                return pa.table({"block": pa.array([block]), "part": pa.array([(part @ basis).tobytes()], pa.binary())})

            for row in blocks.applyInArrow(run, "block long, part binary").toLocalIterator():  # one matrix in all
                start = row["block"] * FEATURES
                part = np.frombuffer(row["part"]).reshape(-1, columns)
                product[start : start + len(part)] += scale * part
            shared.destroy()
        if iteration < ITERATIONS:
            basis = product
    # Rayleigh-Ritz: rotate to the leading directions within the range found.
    values_, vectors = np.linalg.eigh(basis.T @ product)
    return np.ascontiguousarray((basis @ vectors[:, np.argsort(-values_)])[:, :rank])


class Masks:
    """An item's numbers with their places as bits, for common subsequences of at most its length."""

    def __init__(self, numbers: np.ndarray):
        self.places: dict[int, int] = {}
        for i, number in enumerate(numbers.tolist()):
            if number >= 0:
                self.places[number] = self.places.get(number, 0) | 1 << i
        self.full = (1 << len(numbers)) - 1

    def lcs(self, numbers: list[int]) -> int:
        """Length of the longest common subsequence, 64 places of the item and more at a time."""
        row, full = self.full, self.full
        for found in filter(None, map(self.places.get, numbers)):
            same = row & found
            row = ((row + same) | (row - same)) & full
        return full.bit_length() - row.bit_count()


def run_hashes(keys: np.ndarray) -> np.ndarray:
    """Hash of each ``RUN`` consecutive words; ``keys`` has 64 bits for each word."""
    n = max(0, len(keys) - RUN + 1)
    up = np.cumprod(np.full(len(keys), BASE, np.uint64))
    back = np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(keys * up)]
    return (sums[RUN:] - sums[: len(sums) - RUN][:n]) * back


class Runs:
    """The ``RUN`` consecutive words at every place of every item, for lookup in documents."""

    def __init__(self, items: list[np.ndarray], size: int):
        """``items`` are the feature numbers of each item's words, of ``size`` features."""
        self.items = items
        self.keys = np.random.default_rng(11).integers(0, 1 << 64, size, np.uint64)
        self.places: dict[int, list[tuple[int, int]]] = {}
        for i, numbers in enumerate(items):
            for at, value in enumerate(run_hashes(self.keys[numbers]).tolist()):
                self.places.setdefault(value, []).append((i, at))
        self.hashes = np.sort(np.fromiter(self.places, np.uint64, len(self.places)))

    def find(self, batch: Numbered) -> dict[tuple[int, int], list[int]]:
        """For each text and item with a run in it, the positions in the text where one begins, ascending."""
        found: dict[tuple[int, int], list[int]] = {}
        foreign = np.concatenate([[0], np.cumsum(batch.numbers < 0)])
        at = np.flatnonzero(foreign[RUN:] == foreign[:-RUN]) if len(foreign) > RUN else foreign[:0]
        row = np.searchsorted(batch.starts, at, side="right") - 1
        inside = at + RUN <= batch.starts[row + 1] if len(at) else np.empty(0, bool)
        at, row = at[inside], row[inside]
        if not len(at) or not len(self.hashes):
            return found
        values_ = run_hashes(self.keys[batch.numbers])[at]
        near = np.minimum(np.searchsorted(self.hashes, values_), len(self.hashes) - 1)
        for k in np.flatnonzero(self.hashes[near] == values_).tolist():
            begin = int(at[k])
            own = batch.numbers[begin : begin + RUN]
            for i, place in self.places[int(values_[k])]:
                held = found.setdefault((int(row[k]), i), [])
                here = begin - int(batch.starts[row[k]])
                if (not held or held[-1] != here) and np.array_equal(self.items[i][place : place + RUN], own):
                    held.append(here)
        return {k: places for k, places in found.items() if places}


class Shard:
    """What a task needs to search texts for the items of a shard."""

    def __init__(self, items: list[Item], vocabulary: dict[bytes, int], idf: np.ndarray, basis: np.ndarray):
        own = sorted({vocabulary[w] for item in items for w in item.words})
        #: Number of a word of the group within the shard; -1 for others, also for -1.
        self.local = np.full(len(vocabulary) + 1, -1, np.int64)
        self.local[own] = np.arange(len(own))
        numbers = [self.local[numbers_of(item.words, vocabulary)] for item in items]
        self.ids = [item.number for item in items]
        self.sizes = [len(n) for n in numbers]
        self.items = [Masks(n) for n in numbers]
        self.answers = [Masks(self.local[[vocabulary.get(w, -1) for w in item.answer]]) for item in items]
        self.loadings = (basis * idf[:, None]).astype(np.float32)
        self.squares = np.square(idf)
        windows_ = [(i, n[start : start + WIDTH]) for i, n in enumerate(numbers) for start in windows(len(n))]
        self.owners = np.array([i for i, _ in windows_])
        self.queries = np.array([self.loadings[n].sum(0) for _, n in windows_], np.float32)
        self.lengths = np.maximum(1e-6, np.linalg.norm(self.queries, axis=1))
        self.runs = Runs(numbers, len(own))
        # Passages by word, for inner products before the projection, and what it cuts off each.
        pairs, times = np.unique([(w, p) for p, (_, n) in enumerate(windows_) for w in n], axis=0, return_counts=True)
        word, self.passage = pairs.T
        self.listed = np.searchsorted(word, np.arange(len(own) + 1))
        self.weight = times * self.squares[word]
        whole = np.bincount(self.passage, times**2 * self.squares[word], len(windows_))
        self.cut_off = np.sqrt(np.maximum(0, whole - np.square(self.lengths))) + 1e-3 * self.lengths
        # The largest share of what a passage needs that a word brings, and that the projection takes.
        need = PART * np.square(self.lengths)
        self.most = np.zeros(len(own))
        np.maximum.at(self.most, word, self.weight / need[self.passage])
        self.slack = float((self.cut_off / need).max())

    def energies(self, numbers: np.ndarray, block: np.ndarray, size: int) -> np.ndarray:
        """Squared length of the TF-IDF vector of every block, from its words of any weight."""
        weight = self.squares[numbers]
        energy = np.bincount(block, weight, size)
        for lag in range(1, STEP):  # words of a block that are equal count once more for each pair
            same = np.flatnonzero((block[lag:] == block[:-lag]) & (numbers[lag:] == numbers[:-lag]))
            energy += 2 * np.bincount(block[same], weight[same], size)
        return energy

    def near(self, batch: Numbered, text: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """Windows near a passage of an item: text, window, item, cosine."""
        sizes = np.diff(batch.starts)
        n_blocks = -(-sizes // STEP)
        first = np.concatenate([[0], np.cumsum(n_blocks)])
        at = np.flatnonzero(batch.numbers >= 0)
        at = at[self.squares[batch.numbers[at]] > 0]
        if not len(at):
            return
        block = first[text[at]] + (at - batch.starts[text[at]]) // STEP
        energy = self.energies(batch.numbers[at], block, int(first[-1]))
        # A window is two blocks of one text; a text of one block has one window.
        owner = np.repeat(np.arange(len(sizes)), n_blocks)
        start = np.flatnonzero(np.append(owner[1:] == owner[:-1], False) | (n_blocks[owner] == 1))
        pair = n_blocks[owner[start]] > 1
        after = np.minimum(start + 1, len(energy) - 1)
        # A projection can't be longer than the passage, nor that than twice its halves.
        longest = np.sqrt(2 * (energy[start] + np.where(pair, energy[after], 0)))
        heavy = longest >= PART * self.lengths.min()
        start, last, longest = start[heavy], np.where(pair, after, start)[heavy], longest[heavy]
        # Nor can it have more of any passage than its words have, each of the passage it has most of.
        share = np.bincount(block, self.most[batch.numbers[at]], int(first[-1]))
        able = share[start] + np.where(last > start, share[last], 0) + longest * self.slack >= 1
        start, last, longest = start[able], last[able], longest[able]
        for begin in range(0, len(start), WINDOWS):
            own = slice(begin, begin + WINDOWS)
            kept = self.promising(batch.numbers, at, block, start[own], last[own], longest[own])
            for b, passage, cosine in self.compare(batch.numbers, at, block, start[own][kept], last[own][kept]):
                yield int(owner[b]), int(b - first[owner[b]]), passage, cosine

    @staticmethod
    def words_of_windows(block, start, last) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``block`` of the words of each window, one window after the other, and their number."""
        begin, end = np.searchsorted(block, start), np.searchsorted(block, last, side="right")
        size = end - begin
        return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum()), size

    def promising(self, numbers, at, block, start, last, longest) -> np.ndarray:
        """Which windows may be near a passage, by inner products with all of them.

        The projection takes at most ``cut_off`` times a window's length from a product, so
        no window is lost.
        """
        place, size = self.words_of_windows(block, start, last)
        word = numbers[at[place]]
        many = self.listed[word + 1] - self.listed[word]
        entry = np.repeat(self.listed[word] - np.cumsum(many) + many, many) + np.arange(many.sum())
        width = len(self.lengths)
        cells = np.repeat(np.repeat(np.arange(len(start)), size), many) * width + self.passage[entry]
        products = np.bincount(cells, self.weight[entry], len(start) * width).reshape(len(start), width)
        return (products + longest[:, None] * self.cut_off >= PART * np.square(self.lengths)).any(axis=1)

    def compare(self, numbers, at, block, start, last) -> Iterator[tuple[int, int, float]]:
        """(block, item, cosine) of the windows near a passage of an item."""
        latent = self.latent(numbers, at, block, start, last)
        # Foreign words lie outside the space: a window is near an item in direction, and
        # long enough to hold a good part of it.
        along = latent @ self.queries.T / self.lengths
        cosine = along / np.maximum(1e-6, np.linalg.norm(latent, axis=1))[:, None]
        for row, query in zip(*np.nonzero((cosine >= COSINE) & (along >= PART * self.lengths))):
            yield int(start[row]), int(self.owners[query]), float(cosine[row, query])

    def latent(self, numbers, at, block, start, last) -> np.ndarray:
        """Projection of each window, the words of the blocks from ``start`` to ``last``."""
        place, size = self.words_of_windows(block, start, last)
        found = np.zeros((len(start), self.loadings.shape[1]), np.float32)
        filled = size > 0
        if filled.any():
            heads = (np.cumsum(size) - size)[filled]
            found[filled] = np.add.reduceat(self.loadings[numbers[at[place]]], heads, axis=0)
        return found

    def run_windows(self, batch: Numbered, copied: dict[tuple[int, int], list[int]]) -> Iterator[tuple[int, int, int, float]]:
        """Windows where a run of an item begins: text, window, item, cosine."""
        for (row, i), places in copied.items():
            numbers = batch.slice(row)
            last = len(windows(len(numbers))) - 1
            starts = [p for p, before in zip(places, [-2, *places]) if p != before + 1]
            for window in sorted({min(p // STEP, last) for p in starts}):
                own = numbers[window * STEP : window * STEP + WIDTH]
                latent = self.loadings[own[own >= 0]].sum(0)
                along = latent @ self.queries[self.owners == i].T / self.lengths[self.owners == i]
                yield row, window, i, float(along.max() / max(1e-6, np.linalg.norm(latent)))

    def search(self, whole: Numbered, text: np.ndarray) -> Iterator[tuple]:
        """(text, item id, cosine, lcs, words of the item, answer share, start, kind, by) of every item found."""
        batch = Numbered(self.local[whole.numbers], whole.starts)
        copied = self.runs.find(batch)
        candidates: dict[tuple[int, int, int], tuple[float, set[str]]] = {}
        for way, found in (("latent", self.near(batch, text)), ("run", self.run_windows(batch, copied))):
            for row, window, i, cosine in found:
                held, ways = candidates.get((row, window, i), (cosine, set()))
                candidates[row, window, i] = max(held, cosine), ways | {way}
        best: dict[tuple[int, int], tuple] = {}
        by: dict[tuple[int, int], set[str]] = {}
        for (row, window, i), (cosine, ways) in candidates.items():
            numbers, size = batch.slice(row), self.sizes[i]
            # An item may begin up to its length before the window and end as far after it.
            start = max(0, window * STEP - size)
            region = numbers[start : window * STEP + WIDTH + size].tolist()
            length = self.items[i].lcs(region)
            share = length / size
            places = copied.get((row, i), [])
            first = bisect_left(places, start)
            copy = share >= COPY or (first < len(places) and places[first] + RUN <= start + len(region))
            if share < PARAPHRASE and not copy:
                continue
            answer = self.answers[i].lcs(region) / max(1, self.answers[i].full.bit_length())
            kind = "copy" if copy else "paraphrase" if answer >= ANSWER else None
            if kind:
                by.setdefault((row, i), set()).update(ways)
                held = best.get((row, i))
                if held is None or (length, cosine) > (held[3], held[2]):
                    best[row, i] = (row, self.ids[i], cosine, length, size, answer, start, kind)
        for key, found in sorted(best.items()):
            yield *found, "+".join(sorted(by[key]))


def weights_of(items: list[Item], frequencies: dict[bytes, float], n: int) -> tuple[list[bytes], np.ndarray]:
    """Words of a shard, sorted, and the weight of each."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for item in items for w in item.words}))}
    frequency = np.array([frequencies[w] for w in vocabulary])
    # A word that only the benchmark has weighs as much as a document's rarest.
    idf = np.log((n + 1) / (frequency + 1)) + 1e-3
    common = frequency > COMMON * n
    if all(np.count_nonzero(~common[[vocabulary[w] for w in item.words]]) >= 4 for item in items):
        idf[common] = 0
    return list(vocabulary), idf


def fit_shard(items: list[Item], words: list[bytes], idf: np.ndarray, pairs: DataFrame) -> np.ndarray:
    """Latent basis of a shard, from its own passages and those of all documents."""
    vocabulary = {w: i for i, w in enumerate(words)}
    own = []
    for item in items:
        numbers = numbers_of(item.words, vocabulary)
        own += [tfidf(numbers[start : start + WIDTH], idf) for start in windows(len(numbers))]
    return randomised_svd(own, pairs, idf, min(RANK, len(words)))


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    answer_column: str | None = None,
) -> DataFrame:
    """(id, item_id, cosine, lcs, item_words, answer_share, start, kind, found_by) of contaminated documents.

    One row for each document and item found in it, at its best place: ``start`` is the
    number of words before the region, ``lcs`` the words in common, ``kind`` copy or
    paraphrase, ``found_by`` latent, run or both.  Clean documents have no row.  Texts are
    read whole; null, empty and blank ones match nothing, nor do items without words or id.
    Repeated rows and rows with a null id are checked like all others.  Items that occur
    twice are both reported.  An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    item_kind = benchmark.schema[item_column].dataType.simpleString()
    schema = (
        f"`{id_column}` {kind}, item_id {item_kind}, cosine double, lcs int, item_words int, "
        "answer_share double, start int, kind string, found_by string"
    )
    out = spark.createDataFrame([], schema)
    for group in groups_of(shards_of(benchmark, item_column, item_text, answer_column)):
        words = sorted({w for shard in group for item in shard for w in item.words})
        n, counted = document_frequencies(docs, words, column)
        frequencies = dict(zip(words, counted.tolist()))
        vocabulary = {w: i for i, w in enumerate(words)}
        models = [weights_of(items, frequencies, n) for items in group]
        weighted = [np.full(len(words) + 1, -1, np.int64) for _ in group]  # the last entry for words of no item
        for local, (own, idf) in zip(weighted, models):
            numbers = numbers_of(own, vocabulary)
            local[numbers[idf > 0]] = np.flatnonzero(idf > 0)
        pairs = together(docs, words, weighted, column)
        shards = [
            Shard(items, vocabulary, idf, fit_shard(items, own, idf, pairs.where(F.col("shard") == k)))
            for k, (items, (own, idf)) in enumerate(zip(group, models))
        ]
        out = out.union(_search(docs, words, shards, id_column, column, schema))
    return out


def _search(docs: DataFrame, words: list[bytes], shards: list[Shard], id_column: str, column: str, schema: str) -> DataFrame:
    """All documents against the shards of a group, in one pass."""
    fields = [f.split()[0].strip("`") for f in schema.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast((pa.array(words, pa.binary()).cast(pa.string(), safe=False), shards))
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    item_arrow = arrow[schema.split("item_id ")[1].split(",")[0]]
    kinds = [item_arrow, pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.string(), pa.string()]

    def run(batch: pa.RecordBatch):
        vocabulary, shards = shared.value
        whole = number_words(batch.column(1), vocabulary)
        text = np.repeat(np.arange(batch.num_rows), np.diff(whole.starts))
        found = [row for shard in shards for row in shard.search(whole, text)]
        arrays = [pa.array([f[i + 1] for f in found], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), *arrays], fields)

    return map_batches(docs.select(id_column, text_or_empty(column)), run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """The documents without those that hold a benchmark passage; columns as they were.

    Rows that share an id go together; rows with a null id are judged as one document too.
    """
    name = "__found" + "_" * max(map(len, docs.columns))  # no column has it
    found = matches(docs, benchmark, id_column, column).select(F.col(id_column).alias(name)).distinct()
    return docs.join(found, F.col(id_column).eqNullSafe(F.col(name)), "left_anti")
