"""The note store: typed Parquet tables.

``notes`` is partitioned by ``library_id``, which replaces one database file per
library, and range-clustered by ``updated_at``, which replaces the index on it.
Folders and images are kept by library too: a change reads and rewrites the
partitions of the libraries it names, and a deleted library loses its partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.plans.lineage import shuffles_dropped
from inkgrove.schemas import FOLDERS, LIBRARIES, NOTE_IMAGES, NOTES, conform

TABLES = {"notes": NOTES, "folders": FOLDERS, "note_images": NOTE_IMAGES, "libraries": LIBRARIES}


def write_notes(
    notes: DataFrame, path: str, change: Callable[[DataFrame], DataFrame] | None = None, deal: bool = True
) -> None:
    """Write a snapshot of ``notes`` (with ``library_id``) to a fresh path.

    ``change`` rewrites columns of a row as it is written.  What is computed before rows are
    dealt out is computed twice, as the bounds of the slices come from a first pass.  Without
    ``deal`` rows are written where they are, in the order of time within each file: texts
    that were just shuffled, or are clustered already, aren't moved again.
    """
    typed = conform(notes, NOTES)
    # The id splits rows that share a time, such as those of one import.
    dealt = typed.repartitionByRange("library_id", "updated_at", "id") if deal else typed
    clustered = dealt.sortWithinPartitions("library_id", "updated_at")
    changed = clustered if change is None else conform(change(clustered), NOTES)
    with shuffles_dropped(notes.sparkSession):
        changed.write.mode("overwrite").option("compression", "zstd").partitionBy("library_id").parquet(path)


def read_notes(spark: SparkSession, path: str, library_id: str | None = None) -> DataFrame:
    """All libraries, or the partition of one."""
    schema = T.StructType([*NOTES.fields, T.StructField("library_id", T.StringType())])
    notes = spark.read.schema(schema).parquet(path)
    return notes.where(F.col("library_id") == library_id) if library_id else notes


def read_raw(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Files of any age; columns they lack get their defaults."""
    return conform(spark.read.option("mergeSchema", True).parquet(path), TABLES[table])


def union_libraries(parts: dict[str, DataFrame]) -> DataFrame:
    """S3: one table from the tables of several libraries."""
    tagged = [df.withColumn("library_id", F.lit(key)) for key, df in parts.items()]
    merged = tagged[0]
    for part in tagged[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def write_table(table: DataFrame, path: str, name: str) -> None:
    """Write a snapshot of folders, images or notes (with ``library_id``), by library."""
    if name == "notes":
        write_notes(table, path)
    else:
        typed = conform(table, TABLES[name]).repartitionByRange("library_id", "id")
        typed.write.mode("overwrite").partitionBy("library_id").parquet(path)


def read_table(spark: SparkSession, path: str, name: str, libraries: list[str] | None = None) -> DataFrame:
    """S3: a table of all libraries, or the partitions of some."""
    schema = T.StructType([*TABLES[name].fields, T.StructField("library_id", T.StringType())])
    table = spark.read.schema(schema).parquet(path)
    return table if libraries is None else table.where(F.col("library_id").isin(libraries))


def rewrite_libraries(
    spark: SparkSession, path: str, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]
) -> list[str]:
    """Apply ``change`` to the libraries that ``keys`` (library_id) names, and to no file of another.

    ``change`` gets the rows of those libraries and gives their new rows; a library that is
    left without rows loses its partition.  Returns the libraries, one name each.
    """
    named = sorted(r[0] for r in keys.select("library_id").where("library_id IS NOT NULL").distinct().collect())
    after = conform(change(read_table(spark, path, name, named)), TABLES[name])
    filled = {r[0] for r in after.select("library_id").distinct().collect()}  # at most the named ones
    if filled - set(named):
        raise ValueError(f"rows of libraries that were not named: {sorted(filled - set(named))}")
    clustered = after.repartitionByRange("library_id", "id")
    clustered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("library_id").parquet(path)
    for library_id in named:
        if library_id not in filled:
            drop_library(spark, path, library_id)
    return named


def drop_library(spark: SparkSession, path: str, library_id: str) -> bool:
    """Remove a library's partition of a table; whether there was one."""
    jvm = spark._jvm
    utils = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    partition = jvm.org.apache.hadoop.fs.Path(path, utils.getPartitionPathString("library_id", library_id))
    return partition.getFileSystem(spark._jsc.hadoopConfiguration()).delete(partition, True)
