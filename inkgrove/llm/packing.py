"""Packing documents into sequences of bounded length (operator 9).

1. Documents become token pieces, inside the tasks that read them.
2. Only the *number of pieces of each length* reaches the driver: at most ``capacity``
   numbers, whatever the corpus.  Sequences are planned on these numbers.  First the
   Martello-Toth reduction fixes small sets of lengths that dominate every
   alternative; then the rest is packed best-fit, a sequence at a time and as many
   equal ones at once as the numbers allow.
3. The plan is a list of segments ("pieces of length 700, ranks 1,000 to 1,999, go to
   sequences 5,000 to 5,999 at offset 3,396").  A piece finds its place by its rank
   among the pieces of its length.

The plan holds at most ``1 + log2(capacity / s)`` kinds of sequence for each length
``s`` (the length that ran short loses more than half of what is left of it), so it is
bounded by the capacity alone.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.llm.common import give_back, stored, text_or_empty
from inkgrove.llm.token_counts import resolve
from inkgrove.plans.ordered import rank_rows

CAPACITY = 4096
END_ID = 1
CACHE_SIZE = 500_000

# Byte-level vocabularies write a byte that prints as itself, the others, in order, from 256 on.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_MARKS = dict(zip((b for b in range(256) if b not in _PRINTS), range(256, 512)))

_ENCODERS: dict[str, "ChunkIds"] = {}


class ChunkIds(dict):
    """Chunk between white space to its ids, as little-endian 32-bit bytes.

    Holds for tokenizers that drop white space and never join across it.  Memory is
    bounded by two generations of ``limit`` chunks.
    """

    def __init__(self, path: str, limit: int = CACHE_SIZE):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.old = limit, {}

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._ids(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def _ids(self, chunk: str) -> bytes:
        # Punctuation after a word is a token of its own; case is dropped.
        if len(chunk) > 1 and chunk[-1] in ".," and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self[chunk[-1]]
        if chunk.isalpha():
            # A word is one pre-token: composed, in lower case letter by letter, as byte marks.
            word = "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))
            if word.isalpha():
                if word != chunk:
                    return self[word]
                tokens = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(BYTE_MARKS))
                return np.fromiter((t.id for t in tokens), "<u4", len(tokens)).tobytes()
        return self.encode(chunk)

    def of(self, text: str) -> bytes:
        low = "<" in text and text.lower()
        # Separators that only Python takes for white space, and special strings, go the plain way.
        if low and any(s in low for s in self.specials) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> ChunkIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkIds(path)
    return _ENCODERS[path]


def pieces(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Token pieces of every document: ``piece`` from 0, ``start``, ``length``, ``ids_crc32``.

    A document's ids are those of the tokenizer, without special tokens, then the end
    id.  Documents longer than ``capacity`` are cut into full pieces and a rest.  A null
    text counts as empty: one piece that holds the end id.  ``with_ids`` adds the ids.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own = encoder(resolve(tokenizer))
        for batch in batches:
            keys, numbers, starts, lengths, sums, bodies = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = own.of(text.as_py()) + end
                total = len(ids) // 4
                for number, start in enumerate(range(0, total, capacity)):
                    body = ids[4 * start : 4 * (start + capacity)]
                    keys.append(key)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(len(body) // 4)
                    sums.append(zlib.crc32(body))
                    if with_ids:
                        bodies.append(body)
            arrays = [
                pa.array(keys, arrow),
                pa.array(numbers, pa.int32()),
                *(pa.array(v, pa.int64()) for v in (starts, lengths, sums)),
            ]
            names = [id_column, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(bodies, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        schema += ", ids binary"
    return docs.select(F.col(id_column), text_or_empty(column)).mapInArrow(run, schema)


@dataclass(frozen=True)
class Segment:
    """Pieces of ``length`` with ranks from ``rank``: ``each`` per sequence, ``sequences`` of them."""

    length: int
    rank: int
    each: int
    sequences: int
    first: int
    offset: int


class Plan:
    """Sequences for so many pieces of each length; lengths are 1 to ``capacity``."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.segments: list[Segment] = []
        self.sequences = 0
        self.fixed = 0
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _take(self, lengths: dict[int, int], times: int) -> None:
        offset = 0
        for length, each in lengths.items():
            self.segments.append(
                Segment(length, int(self.used[length]), each, times, self.sequences, offset)
            )
            self.used[length] += each * times
            self.left[length] -= each * times
            offset += each * length
        self.sequences += times

    def _largest(self, room: int) -> int:
        """The largest length left that fits; 0 if none does."""
        found = np.flatnonzero(self.left[: room + 1])
        return int(found[-1]) if len(found) else 0

    def _smallest(self, n: int, without: int) -> list[int]:
        """The ``n`` smallest pieces left when one piece of length ``without`` is set aside."""
        out: list[int] = []
        for length in np.flatnonzero(self.left)[: n + 1]:
            out += [int(length)] * min(n, int(self.left[length]) - (length == without))
        return out[:n]

    def _best_pair(self, room: int, without: int) -> int:
        """The largest sum of two pieces within ``room``."""
        lengths = np.flatnonzero(self.left[: room + 1])
        best, low, high = 0, 0, len(lengths) - 1
        while low <= high:
            a, b = int(lengths[low]), int(lengths[high])
            spare = self.left[a] - (a == without)
            possible = (spare >= 2) if a == b else (spare >= 1 and self.left[b] - (b == without) >= 1)
            if a + b > room:
                high -= 1
            else:
                if possible:
                    best = max(best, a + b)
                low += 1
        return best

    def _reduce(self) -> None:
        """Fix sets that dominate: some best packing holds them, so they may be settled now.

        For a piece of length w: alone, if nothing else fits; with its exact complement;
        with the largest that fits, if no second one could join, or if none of the pairs
        that could join instead is larger.
        """
        changed = True
        while changed:
            changed = False
            for length in np.flatnonzero(self.left)[::-1]:
                length = int(length)
                while self.left[length] > 0:
                    room = self.capacity - length
                    smallest = self._smallest(3, length)
                    if not smallest or smallest[0] > room:
                        self._take({length: 1}, int(self.left[length]))
                        changed = True
                        break
                    self.left[length] -= 1
                    partner = self._largest(room)
                    self.left[length] += 1
                    alone = len(smallest) < 2 or sum(smallest[:2]) > room
                    pairs = len(smallest) < 3 or sum(smallest) > room
                    if not (
                        partner == room
                        or alone
                        or (pairs and partner >= self._best_pair(room, length))
                    ):
                        break
                    # Taking pieces away only raises the smallest and lowers the best pair,
                    # so what holds for one pair holds for as many as there are.
                    if partner == length:
                        self._take({length: 2}, int(self.left[length]) // 2)
                    else:
                        self._take({length: 1, partner: 1}, int(min(self.left[length], self.left[partner])))
                    changed = True

    def _best_fit(self) -> None:
        """The longest piece opens a sequence; the one that leaves least room joins, again and again."""
        while length := self._largest(self.capacity):
            uses: dict[int, int] = {}
            room = self.capacity
            taken = self.left.copy()
            while length:
                n = int(min(taken[length], room // length))
                uses[length] = uses.get(length, 0) + n
                taken[length] -= n
                room -= n * length
                found = np.flatnonzero(taken[: room + 1])
                length = int(found[-1]) if len(found) else 0
            self._take(uses, int(min(self.left[s] // n for s, n in uses.items())))

    def by_length(self) -> dict[int, np.ndarray]:
        """Rows (rank, each, first, offset) by length, ordered by rank."""
        out: dict[int, list] = {}
        for s in self.segments:
            out.setdefault(s.length, []).append((s.rank, s.each, s.first, s.offset))
        return {k: np.asarray(v, np.int64) for k, v in out.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Sequences are filled without gaps from 0 and never beyond ``capacity``.  Rows of
    equal length are interchangeable; ties in ``order``, repeated rows and nulls get
    places of their own.  An empty table gives an empty result.  Other columns pass
    through; input columns named like the two results are replaced.
    """
    spark = parts.sparkSession
    parts = parts.drop("sequence_id", "offset")
    kept = stored(parts.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    numbers = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(numbers, capacity).by_length())
    ranked = rank_rows(kept, [F.col("length")], [*[F.col(c) for c in order], F.col("__row")], "__rank")
    columns = parts.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("__rank").to_numpy(zero_copy_only=False) - 1
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                segments = plan.value[int(length)]
                at = segments[np.searchsorted(segments[:, 0], ranks[rows], "right") - 1]
                i = ranks[rows] - at[:, 0]
                sequence[rows] = at[:, 2] + i // at[:, 1]
                offset[rows] = at[:, 3] + (i % at[:, 1]) * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)],
                [*columns, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack(pieces(docs, tokenizer, capacity), capacity)
