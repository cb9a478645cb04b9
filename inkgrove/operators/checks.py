"""Quality checks implied by the declared constraints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.operators.folders import broken_paths, too_deep


def duplicate_keys(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Non-NULL references to rows that do not exist."""
    have = child.where(F.col(column).isNotNull())
    return have.join(parent.select(F.col(key).alias(column)), column, "left_anti").select(*child.columns)


def reference_report(notes: DataFrame, folders: DataFrame, images: DataFrame) -> DataFrame:
    """Broken references by kind."""
    parts = {
        "notes.folder_id": dangling(notes.select("id", "folder_id"), "folder_id", folders),
        "note_images.note_id": dangling(images.select("id", "note_id"), "note_id", notes),
        "folders.parent_id": dangling(folders.select("id", "parent_id"), "parent_id", folders),
    }
    counts = [d.agg(F.count("*").alias("broken")).select(F.lit(k).alias("reference"), "broken") for k, d in parts.items()]
    return reduce(DataFrame.unionByName, counts)


def null_report(table: DataFrame, schema: T.StructType) -> DataFrame:
    """NULLs per required column, from one scan."""
    required = [f.name for f in schema if not f.nullable]
    counts = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in required]))
    return counts.select(pairs.alias("p")).select("p.*")


def tree_report(paths: DataFrame) -> DataFrame:
    """C4: folders that are too deep, in a cycle or below a missing parent."""
    deep = too_deep(paths).select("id", F.lit("depth").alias("problem"))
    return deep.unionByName(broken_paths(paths).select("id", F.col("ending").alias("problem")))
