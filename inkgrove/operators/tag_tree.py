"""Tag counts and the tag tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.functions.tags import tag_prefixes, tag_sort_key
from inkgrove.functions.text import py_strip
from inkgrove.operators.notes import is_active, notes_in_folders


def direct_tag_counts(notes: DataFrame) -> DataFrame:
    """A4: occurrences of each trimmed, non-blank tag in active notes."""
    tags = notes.where(is_active()).select(F.explode("tags").alias("raw")).select(py_strip(F.col("raw")).alias("tag"))
    return tags.where(F.col("tag") != "").groupBy("tag").agg(F.count("*").alias("count"))


def tag_tree(notes: DataFrame, folder_ids=None) -> DataFrame:
    """Every tag and every prefix of a tag, with rolled-up counts.

    Tags are counted before prefixes are exploded, so the second shuffle carries
    one row per distinct tag and level, not one per note.  ``sort_key`` gives the
    depth-first order.
    """
    if folder_ids is not None and (isinstance(folder_ids, DataFrame) or folder_ids):
        notes = notes_in_folders(notes, folder_ids)
    nodes = direct_tag_counts(notes).select(
        "count", F.size(F.split("tag", "/", -1)).alias("levels"), F.explode(tag_prefixes(F.col("tag"))).alias("parts")
    )
    rolled = nodes.groupBy("parts").agg(
        F.sum("count").alias("count"), F.max(F.col("levels") > F.size("parts")).alias("has_children")
    )
    return rolled.select(
        F.array_join("parts", "/").alias("name"),
        F.element_at("parts", -1).alias("display"),
        "count",
        (F.size("parts") - 1).cast("bigint").alias("depth"),
        "has_children",
        tag_sort_key(F.col("parts")).alias("sort_key"),
    )


def tag_tree_order() -> list[Column]:
    """O5."""
    return [F.col("sort_key").asc()]


def tag_list(notes: DataFrame, folder_ids=None) -> DataFrame:
    """The tag tree in depth-first order."""
    return tag_tree(notes, folder_ids).orderBy(*tag_tree_order())
