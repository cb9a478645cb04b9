"""Helpers shared by the operators: reading and storing tables, words, 64-bit hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.plans.batches import bound_batches, give_back  # noqa: F401  (for the operators)
from inkgrove.plans.lineage import scratch_path

#: A-Z to a-z on UTF-8 bytes; no other byte changes.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a row group while it is written; tasks hold one, beside their Python workers.
ROW_GROUP = 16 << 20


def stored(df: DataFrame, label: str, even: bool = True) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back.

    Cuts the lineage like a reliable checkpoint, but in columns: later reads are
    pruned, and a lost executor costs no recomputation.  Files get an even size, unless
    ``even`` is off: then each task writes what it has, without another shuffle.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df.hint("rebalance") if even else df).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """Apply ``function`` to Arrow batches; each may give any number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)
        give_back()

    return df.mapInArrow(run, schema)


def values(column: pa.Array) -> Iterator:
    """Entries one by one, so that long texts are not all held twice."""
    return (entry.as_py() for entry in column)


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary").alias(column)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def mix(hashes: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    hashes = hashes ^ (hashes >> np.uint64(33))
    hashes = hashes * np.uint64(0xFF51AFD7ED558CCD)
    hashes = hashes ^ (hashes >> np.uint64(33))
    hashes = hashes * np.uint64(0xC4CEB9FE1A85EC53)
    return hashes ^ (hashes >> np.uint64(33))


class WordHashes(dict):
    """Word to 64-bit hash, remembered; emptied when ``limit`` words are held.

    Hashes depend on the word only, so workers agree and forgetting is harmless.
    """

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES: list[WordHashes] = []


def word_hashes() -> WordHashes:
    """The one table of this worker process."""
    if not _HASHES:
        _HASHES.append(WordHashes())
    return _HASHES[0]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words.

    With fewer words the whole sequence counts as one run; without words the
    result is empty.
    """
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(size, n)
    value = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[i : n - width + 1 + i])
    return np.unique(value)


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return values.astype(np.uint64, copy=False).view(np.int64)
