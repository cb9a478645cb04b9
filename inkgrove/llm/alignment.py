"""Alignment of two tokenizers' tokens over the bytes of a text (operator 12).

Tokenizer A reads a blank and the text, tokenizer B the text (it adds the blank itself), so
both cut the same bytes.  All tokens of both are sorted by their start; where a start
reaches the running maximum of the ends before it, a group ends: no token of either side
crosses that place.  Every A token of a group is linked with every B token of it.  How
often ids are linked is counted in documents, over the whole corpus.

A blank between two other characters is always a place where tokens of both sides end, so
texts fall into units there.  A worker aligns a unit once and remembers its groups and
links; a document is put together from its units.

Links are held as distinct id pairs of a document with their number, never one by one.
Counts of frequent pairs, at most ``FREQUENT``, are broadcast; pairs beyond them are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.llm.common import map_batches, stored, text_or_empty, values
from inkgrove.llm.token_counts import resolve

#: Pairs whose counts every task holds: two longs and a flag each.
FREQUENT = 1 << 18
#: Characters of text that are put together at once, of units that are encoded as one text,
#: and of units that a worker remembers.
CHUNK, JOINED, REMEMBERED = 1 << 20, 1 << 12, 1 << 22
#: Links of one group that are listed before equal ids are counted together.
LISTED = 4096
#: Longer texts go through the tokenizer library itself: the fast splitter's stack is finite.
SPLITTER = 100_000

BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: A blank that parts units, and white space beside which a blank doesn't.
BORDER = re.compile(r"(?<=\S) (?=\S)")
WIDE = [pair for c in map(chr, range(0x3001)) if c.isspace() for pair in (c + " ", " " + c)]


def byte_alphabet() -> dict[str, int]:
    """Character to byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; special strings are plain text.

    When the file's merges are in the order of their ids and it splits by the usual pattern,
    a quicker encoder with the same merges takes all but very long texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        added = {t["id"]: t["content"].encode() for t in content["added_tokens"]}
        vocabulary = {i: bytes(map(alphabet.__getitem__, t)) for t, i in content["model"]["vocab"].items() if i not in added}
        self.bytes = [b""] * (max([*vocabulary, *added]) + 1)
        for i, entry in {**vocabulary, **added}.items():
            self.bytes[i] = entry
        self.quick = self._quick(content, vocabulary)

    def _quick(self, content: dict, vocabulary: dict[int, bytes]):
        splitter = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in content["model"]["merges"]]
        ids = [content["model"]["vocab"]["".join(p)] for p in pairs]
        if content["normalizer"] or ids != sorted(set(ids)) or not splitter.items() <= (content["pre_tokenizer"] or {}).items():
            return None
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = {entry: i for i, entry in vocabulary.items()}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        if self.quick and len(text) <= SPLITTER:
            return self.quick(text)
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model; a piece's bytes are its text, with U+2581 as a blank."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = map(model.id_to_piece, range(model.get_piece_size()))
        self.bytes = [
            bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces
        ]
        self.encode = model.encode
        #: Whether no piece goes on past a blank.
        self.by_blanks = not any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(model.get_piece_size()))


_LOADED: dict[str, ByteLevel | Pieces] = {}


def load(name: str) -> ByteLevel | Pieces:
    """A tokenizer by path or public name, once per process."""
    if name not in _LOADED:
        path = resolve(name)
        _LOADED[name] = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    return _LOADED[name]


def coalesce(starts: np.ndarray, ends: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of intervals by (group, ``second``, start), and each one's group in that order.

    Overlapping intervals share a group; a group ends where the next start reaches the
    largest end before it.
    """
    by_start = np.lexsort((second, starts))
    reach = np.maximum.accumulate(ends[by_start])
    first = np.ones(len(starts), bool)
    first[1:] = starts[by_start][1:] >= reach[:-1]
    group = np.empty(len(starts), np.int64)
    group[by_start] = np.cumsum(first) - 1
    order = np.lexsort((starts, second, group))
    return order, group[order]


@dataclass
class Aligned:
    """Tokens of some texts in the order of ``coalesce``; ``text`` and ``group`` of each."""

    text: np.ndarray
    group: np.ndarray
    second: np.ndarray
    ids: np.ndarray
    n_texts: int

    @property
    def heads(self) -> np.ndarray:
        """Where each group begins, and the end."""
        return np.flatnonzero(np.diff(self.group, prepend=-1, append=self.group[-1] + 1 if len(self.group) else 0))


def align(texts: list[list[str]], first: ByteLevel, second: Pieces) -> Aligned:
    """Groups of the tokens of all units; those whose bytes don't come back have none.

    A text is given as its units, which blanks join; ``text`` of the result numbers the
    units of all texts.
    """
    sides: list[list[np.ndarray]] = [[], [], [], []]
    borders: list[np.ndarray] = []
    base = number = 0
    size_a, size_b = (np.fromiter(map(len, t.bytes), np.int64) for t in (first, second))
    waiting = texts[::-1]
    while waiting:
        units = waiting.pop()
        text = " ".join(units)
        whole = (" " + text).encode()
        a, b = (first.encode(" " + text), second.encode(text)) if text else ([], [])
        # Tokens of A are the text's bytes cut; pieces may differ from it.
        good = size_a[a].sum() == len(whole) and b"".join(map(second.bytes.__getitem__, b)) == whole
        if not good and len(units) > 1:
            waiting += [[u] for u in reversed(units)]
            continue
        lengths = [1 + len(u.encode()) for u in units] if good else [0] * len(units)
        borders.append(base + np.cumsum([0, *lengths[:-1]]))
        number += len(units)
        if good:
            for side, (ids, size) in enumerate(((a, size_a), (b, size_b))):
                ids = np.array(ids, np.int64)
                ends = base + np.cumsum(size[ids])
                for held, column in zip(sides, (np.full(len(ids), side), ids, ends - size[ids], ends)):
                    held.append(column)
            base += len(whole)
    side, ids, starts, ends = (np.concatenate(x) if x else np.empty(0, np.int64) for x in sides)
    order, group = coalesce(starts, ends, side)
    unit = np.searchsorted(np.concatenate(borders), starts, side="right") - 1 if borders else ids
    return Aligned(unit[order], group, side[order].astype(bool), ids[order], number)


class Writer:
    """Groups as text: ids of A, ``|``, ids of B; groups parted by ``;``, ids by commas."""

    def __init__(self, size_a: int, size_b: int):
        a, b = list(map(str, range(size_a))), list(map(str, range(size_b)))
        self.parts = [*a, *(";" + x for x in a), *("," + x for x in a), *("|" + x for x in b), *("," + x for x in b)]
        self.size_a, self.size_b = size_a, size_b

    def write(self, aligned: Aligned) -> list[str]:
        opens = np.diff(aligned.group, prepend=-1) != 0
        begins = np.diff(aligned.text, prepend=-1) != 0
        turns = aligned.second & ~np.concatenate([[False], aligned.second[:-1]]) if len(opens) else opens
        kind_a = np.where(begins, 0, np.where(opens, 1, 2)) * self.size_a
        kind_b = 3 * self.size_a + np.where(turns, 0, 1) * self.size_b
        codes = aligned.ids + np.where(aligned.second, kind_b, kind_a)
        borders = np.searchsorted(aligned.text, np.arange(aligned.n_texts + 1))
        part = self.parts.__getitem__
        return ["".join(map(part, codes[s:e].tolist())) for s, e in zip(borders, borders[1:])]


def links(aligned: Aligned, size_b: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, id pair (``a * size_b + b``) and number of links, by text and pair.

    ``span`` is above every pair.  Small groups list their links; in large ones equal ids
    are counted first, so that a group costs its distinct pairs.
    """
    heads = aligned.heads
    if len(heads) < 2:
        return (np.empty(0, np.int64),) * 3
    sums = np.concatenate([[0], np.cumsum(aligned.second)])
    n_b = sums[heads[1:]] - sums[heads[:-1]]
    n_a = np.diff(heads) - n_b
    small = n_a * n_b <= LISTED
    keys, weights = [], []

    # Links of small groups: the j-th of a group is A token j // n_b with B token j % n_b.
    at, many = heads[:-1][small], (n_a * n_b)[small]
    group = np.repeat(np.arange(len(at)), many)
    j = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
    a = at[group] + j // n_b[small][group]
    b = at[group] + n_a[small][group] + j % n_b[small][group]
    keys.append(aligned.text[a] * span + aligned.ids[a] * size_b + aligned.ids[b])
    weights.append(np.ones(len(a), np.int64))

    for g in np.flatnonzero(~small):
        middle = heads[g] + n_a[g]
        ids_a, times_a = np.unique(aligned.ids[heads[g] : middle], return_counts=True)
        ids_b, times_b = np.unique(aligned.ids[middle : heads[g + 1]], return_counts=True)
        keys.append((aligned.text[heads[g]] * span + ids_a[:, None] * size_b + ids_b).ravel())
        weights.append((times_a[:, None] * times_b).ravel())
    keys, weights = merged(np.concatenate(keys), np.concatenate(weights))
    return keys // span, keys % span, weights


def merged(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their weights."""
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[heads], np.add.reduceat(weights[order], heads) if len(heads) else weights[:0]


def chunks(texts: Iterator[str]) -> Iterator[list[str]]:
    """Consecutive texts, of about ``CHUNK`` characters or one longer text."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def lists(borders: np.ndarray, entries: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(entries, pa.int64()))


class Units:
    """What a worker knows of units: their groups and links, and how to put texts together."""

    def __init__(self, first: ByteLevel, second: Pieces):
        self.first, self.second = first, second
        self.size_b = len(second.bytes)
        self.span = len(first.bytes) * self.size_b
        self.writer = Writer(len(first.bytes), self.size_b)
        self.by_blanks = second.by_blanks and first.quick is not None
        self.forget()

    def forget(self) -> None:
        #: A unit's number; a new unit gets the next one.
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.size = 0
        self.written: list[str] = []
        #: Tokens of A, of B, and groups of each unit; none if its bytes don't come back.
        self.counts = np.empty((0, 3), np.int64)
        self.heads, self.pairs, self.times = np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def split(self, text: str) -> list[str]:
        if not self.by_blanks:
            return [text]
        if text[0].isspace() or text[-1].isspace() or any(map(text.__contains__, WIDE)):
            return BORDER.split(text)
        return text.split(" ")

    def learn(self, units: list[str]) -> None:
        """Align new units, short ones joined; those with white space at an end stand alone."""
        texts: list[list[str]] = []
        size = JOINED
        for unit in units:
            alone = not self.by_blanks or not unit or unit[0].isspace() or unit[-1].isspace()
            if alone or size + len(unit) >= JOINED:
                texts.append([])
                size = 0
            texts[-1].append(unit)
            size = JOINED if alone else size + len(unit) + 1
        aligned = align(texts, self.first, self.second)
        n = len(units)
        n_b = np.bincount(aligned.text[aligned.second], minlength=n)
        n_a = np.bincount(aligned.text, minlength=n) - n_b
        groups = np.bincount(aligned.text[aligned.heads[:-1]], minlength=n)
        owner, pairs, times = links(aligned, self.size_b, self.span)
        self.counts = np.concatenate([self.counts, np.column_stack([n_a, n_b, groups])])
        self.heads = np.concatenate([self.heads, self.heads[-1] + np.searchsorted(owner, np.arange(1, n + 1))])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])
        self.written += self.writer.write(aligned)
        self.size += sum(map(len, units)) + n

    def put_together(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts (tokens of A and B, groups) and groups as text of every text; borders, pairs and times of all."""
        if self.size > REMEMBERED:
            self.forget()
        known = len(self.number)
        parts = [list(map(self.number.__getitem__, self.split(text))) if text else [] for text in texts]
        if len(self.number) > known:
            self.learn(list(islice(self.number, known, None)))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        units = np.fromiter(chain.from_iterable(parts), np.int64, sizes.sum())
        text = np.repeat(np.arange(len(texts)), sizes)
        # One unit that doesn't come back takes its text with it.
        own = self.counts[units]
        bad = np.bincount(text[own[:, 0] == 0], minlength=len(texts)) > 0
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(own, axis=0)])
        ends = np.cumsum(sizes)
        counts = np.where(bad[:, None], 0, sums[ends] - sums[ends - sizes])
        if bad.any():
            units, text = units[~bad[text]], text[~bad[text]]
        written = ["" if b else ";".join(map(self.written.__getitem__, part)) for part, b in zip(parts, bad)]
        many = self.heads[units + 1] - self.heads[units]
        entry = np.repeat(self.heads[units] - np.cumsum(many) + many, many) + np.arange(many.sum())
        keys, times = merged(np.repeat(text, many) * self.span + self.pairs[entry], self.times[entry])
        borders = np.searchsorted(keys, np.arange(len(texts) + 1) * self.span)
        return counts, written, borders, keys % self.span, times


RESULTS = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]


def align_tokens(
    docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", column: str = "text", digest: bool = False
) -> DataFrame:
    """Every row with its aligned tokens in place of its text.

    ``n_a``, ``n_b``, ``n_groups`` and ``n_links`` count tokens, groups and links; ``groups``
    lists them (see ``Writer``; with ``digest`` its SHA-256); ``pairs`` are the distinct
    linked ids (``a * vocabulary of B + b``), ``times`` their numbers of links.

    ``first`` is a byte-level BPE file, ``second`` a sentencepiece model that adds a blank.
    Texts are read whole.  Null and empty texts, and texts whose bytes a tokenizer changes,
    have no tokens: zeros, an empty ``groups``.  Equal texts get equal results; an empty
    table gives an empty result; other columns pass through, but those named like a result
    are replaced.
    """
    kept = [c for c in docs.columns if c not in (column, *RESULTS)]
    known: list[Units] = []

    def part(texts: list[str]) -> pa.RecordBatch:
        if not known:
            known.append(Units(load(first), load(second)))
        counts, written, borders, pairs, times = known[0].put_together(texts)
        total = np.concatenate([[0], np.cumsum(times)])[borders]
        if digest:
            written = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
        arrays = [pa.array(c, pa.int64()) for c in (*counts.T, np.diff(total))]
        arrays += [pa.array(written, pa.string()), lists(borders, pairs), lists(borders, times)]
        return pa.RecordBatch.from_arrays(arrays, RESULTS)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = 0
        for texts in chunks(values(batch.column("__text"))):
            found = part(texts)
            own = batch.slice(at, len(texts))
            at += len(texts)
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), *found.columns], [*kept, *RESULTS])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    schema += "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<bigint>"
    return map_batches(docs.select(*(F.col(f"`{c}`") for c in kept), text_or_empty(column).alias("__text")), run, schema)


def count_pairs(aligned: DataFrame, held: int = 1 << 20) -> DataFrame:
    """``pair`` and ``docs``, the number of rows that hold it; tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["pair", "docs"])

        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting, size = [], 0
        for found in batches:
            waiting.append(found.column(0).flatten().to_numpy(zero_copy_only=False))
            size += len(waiting[-1])
            if size >= held:
                new = np.concatenate(waiting)
                keys, counts = merged(np.concatenate([keys, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))
                waiting, size = [], 0
                if len(keys) >= held:
                    yield batch(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        new = np.concatenate([keys[:0], *waiting])
        yield batch(*merged(np.concatenate([keys, new]), np.concatenate([counts, np.ones(len(new), np.int64)])))

    counted = aligned.select("pairs").mapInArrow(run, "pair long, docs long")
    return counted.groupBy("pair").agg(F.sum("docs").alias("docs"))


def frequent_level(counts: DataFrame, limit: int) -> int:
    """The least power of two such that at most ``limit`` pairs are in as many documents."""
    levels = counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("level")).count().collect()  # at most 63 rows
    known, least = 0, 63
    for level, n in sorted(((r["level"], r["count"]) for r in levels), reverse=True):
        known += n
        if known > limit:
            break
        least = level
    return 1 << least if least < 63 else (1 << 63) - 1


def link_counts(
    docs: DataFrame,
    first: str = "byte_bpe_50k.json",
    second: str = "piece_bpe_32k.model",
    column: str = "text",
    frequent: int = FREQUENT,
) -> DataFrame:
    """Every row with its tokens aligned and its links held against the whole corpus.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups`` (as SHA-256) are as in
    ``align_tokens``.  A pair's count is the number of rows, each one document, that hold it
    linked; ``n_best`` counts the links whose count is the highest of their A id, ties
    included, ``count_sum`` adds up the counts of all links.  Nulls, empty texts, repeated
    rows, empty tables and clashing names are as there; rows of one id are one document each.
    """
    size_b = len(load(second).bytes)
    kept = [c for c in docs.columns if c not in (column, *RESULTS, "n_best", "count_sum", "__row")]
    shown = [*kept, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), column).withColumn("__row", F.monotonically_increasing_id())
    aligned = stored(align_tokens(rows, first, second, column, digest=True), "aligned", even=False)
    counts = stored(count_pairs(aligned), "pairs")
    # At most one row for each id of A.
    highest = counts.groupBy(F.floor(F.col("pair") / size_b).alias("id")).agg(F.max("docs").alias("highest"))
    counts = counts.withColumn("id", F.floor(F.col("pair") / size_b)).join(F.broadcast(highest), "id")
    counts = counts.select("pair", "docs", (F.col("docs") == F.col("highest")).cast("long").alias("best"))
    level = frequent_level(counts, frequent)
    # At most ``frequent`` rows.
    top = counts.where(F.col("docs") >= level).orderBy("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(tuple(c.to_numpy() for c in top.columns))

    def look_up(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pairs, docs_of, best_of = shared.value
        held, times = batch.column("pairs"), batch.column("times")
        borders = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        own, n = (c.flatten().to_numpy(zero_copy_only=False) for c in (held, times))
        at = np.searchsorted(pairs, own)
        known = at < len(pairs)
        known[known] = pairs[at[known]] == own[known]
        count, best = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        count[known], best[known] = docs_of[at[known]], best_of[at[known]]
        sums = [np.diff(np.concatenate([[0], np.cumsum(n * x)])[borders]) for x in (best, count)]
        left = np.concatenate([[0], np.cumsum(~known)])[borders]
        arrays = [*(batch.column(c) for c in found_columns), *(pa.array(x, pa.int64()) for x in sums)]
        arrays += [lists(left, own[~known]), lists(left, n[~known])]
        yield pa.RecordBatch.from_arrays(arrays, [*found_columns, "n_best", "count_sum", "pairs", "times"])

    found_columns = [c for c in aligned.columns if c not in ("pairs", "times")]
    fields = [aligned.schema[c] for c in found_columns]
    long, many = T.LongType(), T.ArrayType(T.LongType())
    schema = T.StructType([*fields, *(T.StructField(c, t) for c, t in (("n_best", long), ("count_sum", long), ("pairs", many), ("times", many)))])
    found = stored(map_batches(aligned, look_up, schema), "looked-up", even=False)
    rare = found.where(F.size("pairs") > 0).select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    rare = rare.select("__row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    rare = rare.join(counts.where(F.col("docs") < level), "pair").groupBy("__row")
    rare = rare.agg(F.sum(F.col("times") * F.col("best")).alias("__best"), F.sum(F.col("times") * F.col("docs")).alias("__sum"))
    whole = found.drop("pairs", "times").join(rare, "__row", "left")
    whole = whole.withColumn("n_best", F.col("n_best") + F.coalesce("__best", F.lit(0)))
    return whole.withColumn("count_sum", F.col("count_sum") + F.coalesce("__sum", F.lit(0))).select(*(F.col(f"`{c}`") for c in shown))
