"""Counts and libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.operators.notes import is_active, select_notes


def library_stats(notes: DataFrame, folders: DataFrame) -> DataFrame:
    """A1: folders, active notes and deleted notes, each table scanned once."""
    count_folders = folders.agg(F.count("*")).scalar()
    return notes.agg(
        F.count_if(is_active()).alias("notes"), F.count_if(~is_active()).alias("deleted_notes")
    ).select(count_folders.alias("folders"), "notes", "deleted_notes")


def view_count(notes: DataFrame, folder_id: str = "") -> DataFrame:
    """A2: notes of a view; '' and ``smart:all`` count all."""
    if folder_id == "smart:favorites":
        kept = select_notes(notes).where("is_pinned")
    else:
        kept = select_notes(notes, "" if folder_id == "smart:all" else folder_id)
    return kept.agg(F.count("*").alias("note_count"))


def folder_count(folders: DataFrame) -> DataFrame:
    """A3."""
    return folders.agg(F.count("*").alias("folder_count"))


def list_libraries(libraries: DataFrame) -> DataFrame:
    """Libraries in creation order."""
    return libraries.orderBy("created_at", "id")


def library_note_counts(libraries: DataFrame, notes: DataFrame) -> DataFrame:
    """Active notes of each library, zero included."""
    counts = notes.where(is_active()).groupBy("library_id").agg(F.count("*").alias("n"))
    joined = libraries.join(counts, F.col("id") == F.col("library_id"), "left")
    return joined.select(*libraries.columns, F.coalesce("n", F.lit(0)).cast("bigint").alias("note_count"))


def deletable_libraries(libraries: DataFrame, notes: DataFrame) -> DataFrame:
    """A library may go when it has no active notes and is not the last.

    ``can_delete`` is the weaker test that looks at notes only.
    """
    total = libraries.agg(F.count("*")).scalar()
    counted = library_note_counts(libraries, notes)
    return counted.select(
        "id",
        (F.col("note_count") == 0).alias("can_delete"),
        ((F.col("note_count") == 0) & (total > 1)).alias("deletable"),
    )


def default_library(libraries: DataFrame) -> DataFrame:
    """The default library, else the oldest."""
    return libraries.orderBy(F.col("is_default").desc(), "created_at", "id").limit(1)
