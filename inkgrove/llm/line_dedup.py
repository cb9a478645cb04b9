"""Removal of lines that many documents share, incremental and reversible (operator 4).

The state of a ``LineStore`` is

* an exact table of reference counts: 128-bit key of a line, number of documents that
  hold it, in shards by key;
* one cuckoo filter per shard over the keys held by at least ``min_docs`` documents.

Documents may be inserted and deleted later; counts go up and down, and keys that pass
the threshold enter or leave their shard's filter.  The result for a set of documents is
the same whatever the order of insertions and deletions.

To drop lines, tasks test each line's key against the filters where the text is.  The few
keys that pass are confirmed against the exact counts, and only these travel.  Filters are
broadcast when they take at most ``FILTER_BYTES`` in all; beyond that keys go to the exact
counts directly, with the same result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.llm.common import ASCII_LOWER, map_batches, text_bytes
from inkgrove.llm.cuckoo import CuckooFilter
from inkgrove.plans.lineage import scratch_path

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_DOCS = 10
KEYS_PER_SHARD = 1 << 18
FILTER_BYTES = 64 << 20
COUNTS = "hi long, lo long, n long"
FILTERS = "shard long, cells binary"


def keys_of(text: bytes) -> list[bytes]:
    """Key of every line: stripped of ASCII white space, A-Z in lower case."""
    return [line.strip(SPACE) for line in text.translate(ASCII_LOWER).split(b"\n")]


def _hashes(keys: Iterable[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two unsigned numbers."""
    joined = b"".join(map(xxhash.xxh3_128_digest, keys))
    return np.frombuffer(joined, ">u8").astype(np.uint64).reshape(-1, 2)


def _key_counts(docs: DataFrame, column: str, sign: int) -> DataFrame:
    """Documents per key, counted within batches before the shuffle."""

    def run(batch: pa.RecordBatch):
        counts: Counter = Counter()
        for text in batch.column(0):
            counts.update(set(keys_of(text.as_py())))
        counts.pop(b"", None)
        hashes = _hashes(counts).view(np.int64)
        n = np.fromiter(counts.values(), np.int64, len(counts)) * sign
        yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(n)], ["hi", "lo", "n"])

    return map_batches(docs.select(text_bytes(column)), run, COUNTS)


def _shard(shards: int):
    return F.pmod(F.col("hi"), F.lit(shards)).cast("long")


class LineStore:
    """Reference counts and filters below ``path``, one folder per generation."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = MIN_DOCS):
        self.spark, self.min_docs = spark, min_docs
        self.path = path or scratch_path(spark, "lines")
        self.counts = spark.createDataFrame([], COUNTS)
        self.filters = spark.createDataFrame([], FILTERS)
        self.shards = 1
        self.fresh = True

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def insert(self, docs: DataFrame, column: str = "text") -> "LineStore":
        """Count the documents' lines in.  Each row is a document; repeated rows count again."""
        return self._change(_key_counts(docs, column, 1))

    def delete(self, docs: DataFrame, column: str = "text") -> "LineStore":
        """Take documents out again that were inserted with the same texts."""
        return self._change(_key_counts(docs, column, -1))

    def _change(self, delta: DataFrame) -> "LineStore":
        changed = delta.groupBy("hi", "lo").agg(F.sum("n").alias("n"))
        if self.fresh:
            self.counts = self._written(changed.where("n > 0"), "counts")
            self.fresh = False
            self._build()
            return self
        changed = self._written(changed.where("n <> 0"), "delta")
        old = self.counts.withColumnRenamed("n", "before")
        moved = old.join(changed, ["hi", "lo"], "full").select(
            "hi", "lo", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("n", F.lit(0)).alias("n")
        )
        both = self._written(moved.select("hi", "lo", "before", (F.col("before") + F.col("n")).alias("n")), "counts")
        self.counts = both.where("n > 0").select("hi", "lo", "n")
        self._update(both)
        return self

    def _build(self) -> None:
        """Filters from the counts, with as many shards as the number of frequent keys asks for."""
        frequent = self.counts.where(F.col("n") >= self.min_docs)
        self.shards = max(1, -(-frequent.count() // KEYS_PER_SHARD))

        def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            cells = CuckooFilter.holding(rows["lo"].to_numpy().view(np.uint64)).to_bytes()
            return pd.DataFrame({"shard": [key[0]], "cells": [cells]})

        keys = frequent.select(_shard(self.shards).alias("shard"), "lo")
        self.filters = self._written(keys.groupBy("shard").applyInPandas(build, FILTERS), "filters")

    def _update(self, both: DataFrame) -> None:
        """Move keys in and out of the filters of the shards they belong to."""
        least = self.min_docs
        crossed = both.where((F.col("before") >= least) != (F.col("n") >= least))
        frequent = self.counts.where(F.col("n") >= least).count()
        if frequent > 2 * KEYS_PER_SHARD * self.shards:
            self._build()  # grown out of its shards
            return

        keys = crossed.select(_shard(self.shards).alias("shard"), "lo", (F.col("n") >= least).alias("enters"))

        def update(key: tuple, filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            held = CuckooFilter.from_bytes(filters["cells"][0]) if len(filters) else CuckooFilter.for_keys(len(rows))
            values = rows["lo"].to_numpy().view(np.uint64).tolist()
            for value, enters in zip(values, rows["enters"]):
                if not enters:
                    held.delete(value)
            full = not all([held.insert(v) for v, enters in zip(values, rows["enters"]) if enters])
            return pd.DataFrame({"shard": [key[0]], "cells": [None if full else held.to_bytes()]})

        updated = self.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(update, FILTERS)
        self.filters = self._written(updated, "filters")
        if self.filters.where("cells IS NULL").limit(1).count():
            self._build()  # a filter was full

    def frequent_of(self, docs: DataFrame, id_column: str, column: str = "text") -> DataFrame:
        """(id, hi, lo) of the frequent keys that documents hold, exact."""
        size = self.filters.agg(F.sum(F.octet_length("cells"))).first()[0] or 0
        filters = None
        if size <= FILTER_BYTES:
            rows = {r["shard"]: bytes(r["cells"]) for r in self.filters.collect()}
            filters = self.spark.sparkContext.broadcast(rows)
        shards = self.shards
        kind = docs.schema[id_column].dataType.simpleString()
        loaded: dict[int, CuckooFilter] = {}

        def run(batch: pa.RecordBatch):
            if filters is not None and not loaded:
                loaded.update({s: CuckooFilter.from_bytes(c) for s, c in filters.value.items()})
            rows, hashes = [], []
            for i, text in enumerate(batch.column(1)):
                keys = set(keys_of(text.as_py()))
                keys.discard(b"")
                own = _hashes(keys)
                hashes.append(own)
                rows.append(np.full(len(own), i))
            row, both = np.concatenate(rows), np.concatenate(hashes)
            if filters is not None:
                shard = both[:, 0].view(np.int64) % shards
                keep = np.zeros(len(both), bool)
                for s, held in loaded.items():
                    at = np.flatnonzero(shard == s)
                    keep[at] = held.contains(both[at, 1])
                row, both = row[keep], both[keep]
            both = both.view(np.int64)
            ids = batch.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(both[:, 0]), pa.array(both[:, 1])], [id_column, "hi", "lo"])

        maybe = map_batches(docs.select(id_column, text_bytes(column)), run, f"`{id_column}` {kind}, hi long, lo long")
        frequent = self.counts.where(F.col("n") >= self.min_docs).select("hi", "lo")
        return maybe.join(frequent, ["hi", "lo"], "left_semi")


def drop_shared_lines(
    docs: DataFrame, store: LineStore, id_column: str = "doc_id", column: str = "text"
) -> DataFrame:
    """Replace ``column`` by its lines whose key fewer than ``store.min_docs`` documents hold.

    Adds ``n_lines`` (before dropping) and ``n_dropped``.  Lines are split at line feeds;
    a null or empty text is one empty line, which is kept, as are all blank lines.  Lines
    that stay keep their bytes.  All lines of a frequent key go, also repeated ones within
    a document.  Rows with a null id are treated like others; rows that share an id are
    treated alike.  Texts may be of any length, tables may be empty; other columns pass
    through, those named like the two results are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    keyed = docs.withColumn("__id", F.col(id_column))
    lists = (
        store.frequent_of(keyed, "__id", column)
        .groupBy("__id")
        .agg(F.collect_set(F.struct("hi", "lo")).alias("__drop"))
        .select(F.col("__id").alias("__of"), "__drop")
    )
    joined = (
        keyed.join(lists.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("__of")), "left")
        .drop("__id", "__of")
        .withColumn("__drop", F.coalesce("__drop", F.array()))
        .withColumn(column, text_bytes(column))
    )
    carried = [c for c in docs.columns if c != column]

    def run(batch: pa.RecordBatch):
        texts, lines_before, dropped = [], [], []
        for text, drop in zip(batch.column(column), batch.column("__drop")):
            text = text.as_py()
            drop = {(d["hi"], d["lo"]) for d in drop.as_py()}
            lines_before.append(text.count(b"\n") + 1)
            if drop:
                keys = keys_of(text)
                hashes = map(tuple, _hashes(keys).view(np.int64).tolist())
                kept = [
                    line for line, key, both in zip(text.split(b"\n"), keys, hashes) if not key or both not in drop
                ]
                dropped.append(len(keys) - len(kept))
                text = b"\n".join(kept)
            else:
                dropped.append(0)
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in carried),
                pa.array(texts, pa.binary()).cast(pa.string()),
                pa.array(lines_before, pa.int64()),
                pa.array(dropped, pa.int64()),
            ],
            [*carried, column, "n_lines", "n_dropped"],
        )

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carried)
    return map_batches(joined, run, f"{schema}`{column}` string, n_lines long, n_dropped long")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """All documents into a new store, and their shared lines dropped."""
    store = LineStore(docs.sparkSession, min_docs=min_docs).insert(docs, column)
    return drop_shared_lines(docs, store, id_column, column)


def sha256_hex(column: str = "text"):
    """Lower-case hex digest of a text's UTF-8 bytes."""
    return F.sha2(F.col(column).cast("binary"), 256)


