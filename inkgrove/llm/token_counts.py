"""Token counts from two tiers of pre-token lengths (operator 8).

A tokenizer's pre-tokens are encoded independently, so a text's token count is the
sum over its pre-tokens of their lengths in tokens.  Tier one is a compact table of
the corpus' frequent pre-tokens, broadcast to every task; it is bounded by
``table_size`` entries.  Tier two is a bounded cache in each Python worker, filled by
the tokenizer when a pre-token is met for the first time.  Pre-tokens are never
shuffled: the frequent ones are found with mergeable heavy-hitter summaries, one row
per task, folded in a tree.

The table only decides which lengths are looked up where; counts never depend on it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.llm.common import text_or_empty

TABLE_SIZE = 8192
FAN_IN = 32
CACHE_SIZE = 200_000
SUMMARY = "part long, tokens array<string>, counts array<long>"

_LOADED: dict[str, tuple] = {}


def load(path: str):
    """Tokenizer, splitter and special strings of a file, once per process."""
    if path not in _LOADED:
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _LOADED[path] = tokenizer, regex.compile(PATTERN), specials
    return _LOADED[path]


def resolve(name: str) -> str:
    """A tokenizer's file: a path as it is, a bare name from the public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Lengths(dict):
    """Pre-token to number of tokens: the frequent table, then a two-generation cache.

    Others come in beside the frequent entries, so that finding one again runs no Python;
    when ``limit`` of them are there, all but the frequent ones become ``old`` and the
    previous ``old`` is forgotten, so memory is bounded.
    """

    def __init__(self, frequent: dict[str, int], tokenizer, limit: int = CACHE_SIZE):
        super().__init__(frequent)
        self.frequent, self.tokenizer, self.full = frequent, tokenizer, len(frequent) + limit
        self.old: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        n = self.old.get(token)
        if n is None:
            n = len(self.tokenizer.encode(token, add_special_tokens=False))
        if len(token) > 256:
            return n
        if len(self) >= self.full:
            self.old = dict(self)
            self.clear()
            self.update(self.frequent)
        self[token] = n
        return n


def parts_of(text: str, specials: list[str]) -> tuple[list[str], int]:
    """The text between special strings, and how many of those it holds."""
    found = 0
    parts = [text]
    for special in specials:
        if special in text:
            parts = [q for p in parts for q in p.split(special)]
            found += text.count(special)
    return parts, found


def _trim(counts: Counter, size: int) -> list[tuple[str, int]]:
    """The ``size`` largest entries; the next count is taken off, as in a Misra-Gries merge."""
    # As most_common, whose heap takes longer when many entries stay.
    top = sorted(counts.items(), key=itemgetter(1), reverse=True)[: size + 1]
    floor = top[size][1] if len(top) > size else 0
    return [(t, n - floor) for t, n in top[:size] if n > floor]


def _summary(part: int, counts: Counter, size: int) -> pa.RecordBatch:
    top = _trim(counts, size)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int64()),
            pa.array([[t for t, _ in top]], pa.list_(pa.string())),
            pa.array([[n for _, n in top]], pa.list_(pa.int64())),
        ],
        ["part", "tokens", "counts"],
    )


def frequent_pretokens(docs: DataFrame, tokenizer: str, column: str = "text", size: int = TABLE_SIZE) -> list[str]:
    """At most ``size`` pre-tokens, the most frequent of the whole table.

    Summaries keep ``8 * size`` entries while a task reads and ``size`` when it ends;
    every pre-token above a share of about 1 / size of all survives each merge.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _, pattern, specials = load(resolve(tokenizer))
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in parts_of(text, specials)[0]:
                    counts.update(pattern.findall(part))
                if len(counts) > 16 * size:
                    counts = Counter(dict(_trim(counts, 8 * size)))
        yield _summary(TaskContext.get().partitionId(), Counter({t: n for t, n in counts.items() if len(t) <= 64}), size)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, Counter] = {}
        for batch in batches:
            for part, tokens, counts in zip(*(c.to_pylist() for c in batch.columns)):
                held = merged.setdefault(part, Counter())
                held.update(dict(zip(tokens, counts)))
                if len(held) > 8 * size:
                    merged[part] = Counter(dict(_trim(held, 4 * size)))
        for part, counts in merged.items():
            yield _summary(part, counts, size)

    source = docs.select(text_or_empty(column))
    width = source.rdd.getNumPartitions()
    summaries = source.mapInArrow(count, SUMMARY)
    while width > FAN_IN:
        width = -(-width // FAN_IN)
        summaries = (
            summaries.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
            .repartition(width, "part")
            .mapInArrow(fold, SUMMARY)
        )
    total: Counter = Counter()
    for row in summaries.collect():  # at most FAN_IN rows of ``size`` entries
        total.update(dict(zip(row.tokens, row.counts)))
    return [t for t, _ in _trim(total, size)]


def token_counts(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 512,
    column: str = "text",
    table_size: int = TABLE_SIZE,
) -> DataFrame:
    """``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every row, in place of its text.

    ``tokenizer`` is a byte-level BPE file of the tokenizers library, by path or by
    name in the public tokenizers.  Tokens are counted without begin, end or added
    special tokens; special strings in a text count as one token each, the library's
    default.  A null text counts as empty: 0 bytes, 0 tokens.  Texts of any length are
    encoded whole.  Rows with equal texts get equal counts; an empty table gives an
    empty result; other columns pass through, except that columns already named like
    a result are replaced.
    """
    tokenizer_object, _, _ = load(resolve(tokenizer))
    table = {
        t: len(e.ids)
        for t in frequent_pretokens(docs, tokenizer, column, table_size)
        for e in [tokenizer_object.encode(t, add_special_tokens=False)]
    }
    shared = docs.sparkSession.sparkContext.broadcast(table)

    results = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in docs.columns if c not in (*results, column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pattern, specials = load(resolve(tokenizer))
        lengths = Lengths(shared.value, own)
        length_of, find = lengths.__getitem__, pattern.findall
        for batch in batches:
            texts = batch.column("__text")
            bytes_, tokens = [], []
            for text in texts:
                text = text.as_py()
                parts, n = parts_of(text, specials)
                for part in parts:
                    n += sum(map(length_of, find(part)))
                tokens.append(n)
                bytes_.append(len(text.encode()))
            arrays = [batch.column(c) for c in kept]
            arrays += [pa.array(bytes_, pa.int64()), pa.array(tokens, pa.int64())]
            arrays.append(pa.array(np.asarray(tokens, np.int64) > limit, pa.bool_()))
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *results])

    fields = [docs.schema[c] for c in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema = f"{schema}{', ' if schema else ''}n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(column).alias("__text")).mapInArrow(run, schema)
