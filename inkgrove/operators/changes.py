"""Batch change sets (M1-M12, M14): a snapshot and changes give a new snapshot.

A key may have several changes, each of some fields, in the order of a column ``seq``:
they are folded field by field, the newest given value of each, before they meet the
snapshot.  The fold is associative, so tasks shrink a hot key before the shuffle.  Without
``seq`` a key has one change; two that differ end the job.

The change side is the small one; when it is really small Spark broadcasts it by its
measured size, and the snapshot streams through without a shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from inkgrove.functions.tags import clean_tags
from inkgrove.functions.text import py_strip
from inkgrove.operators.folders import can_have_child, descendants
from inkgrove.operators.images import (
    drop_images,
    embedded_images,
    fresh_images,
    referenced_images,
    rename_tokens,
    tokenize_notes,
)
from inkgrove.operators.notes import effectively_empty, is_active
from inkgrove.operators.stats import deletable_libraries
from inkgrove.plans.lineage import round_stored
from inkgrove.plans.ordered import rank_rows
from inkgrove.schemas import DEFAULT_FOLDER, DEFAULT_LIBRARY, FOLDERS, LIBRARIES, NOTES, conform, is_smart


def stamp(now: dt.datetime) -> Column:
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


#: The order of a key's changes, and the names of the fields that a change sets to NULL.
SEQ, CLEARED = "seq", "cleared"


def fold_changes(changes: DataFrame, fields: list[str]) -> DataFrame:
    """One row per id: each of ``fields`` as a struct of its newest given ``value``, else NULL.

    A change gives a field if its value isn't NULL, or if ``cleared`` (array of names) lists
    the field; the value is NULL then.  The newest is that of the largest ``seq``; ``seq`` is
    distinct within an id.  Without ``seq``, changes of an id that differ raise an error.
    """
    cleared = F.coalesce(F.col(CLEARED), F.array().cast("array<string>")) if CLEARED in changes.columns else None

    def given(f: str) -> Column:
        there = F.col(f).isNotNull()
        return there if cleared is None else there | F.array_contains(cleared, f)

    def value(f: str) -> Column:
        return F.col(f) if cleared is None else F.when(~F.array_contains(cleared, f), F.col(f))

    if SEQ in changes.columns:
        newest = [F.max(F.when(given(f), F.struct(SEQ, value(f).alias("value")))).alias(f) for f in fields]
        folded = changes.groupBy("id").agg(*newest)
        return folded.select("id", *[F.when(F.col(f).isNotNull(), F.struct(F.col(f)["value"].alias("value"))).alias(f) for f in fields])
    whole = F.struct(*[F.when(given(f), F.struct(value(f).alias("value"))).alias(f) for f in fields])
    folded = changes.select("id", whole.alias("__c")).groupBy("id").agg(F.max("__c").alias("__c"), F.min("__c").alias("__other"))
    error = F.raise_error(F.concat(F.lit("changes of one id need the column seq: "), "id"))
    one = F.when(F.col("__c").eqNullSafe(F.col("__other")), F.col("__c")).otherwise(error.cast(folded.schema["__c"].dataType))
    return folded.select("id", one.alias("__c")).select("id", "__c.*")


def _join_changes(table: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Table rows with folded ``new_*`` columns and ``hit`` for changed keys."""
    last = fold_changes(changes, fields) if fields else changes.select("id").distinct()
    renamed = last.select(
        *[F.col(c).alias("__id" if c == "id" else f"new_{c}") for c in last.columns], F.lit(True).alias("hit")
    )
    return table.join(renamed, F.col("id") == F.col("__id"), "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def _new(field: str, where: Column | None = None, as_stored=lambda value: value) -> Column:
    """A field's folded value if one is given, else the row's own."""
    given = F.col(f"new_{field}").isNotNull()
    return F.when(given if where is None else where & given, as_stored(F.col(f"new_{field}")["value"])).otherwise(F.col(field))


def _ordered(changes: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns, with the order and marks of the changes if there are any."""
    return changes.select(*columns, *[c for c in (SEQ, CLEARED) if c in changes.columns])


def _keys(keys: DataFrame) -> DataFrame:
    return keys.select(F.col(keys.columns[0]).alias("id")).distinct()


def _rewrite(joined: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


# -- notes -------------------------------------------------------------------


def new_notes(drafts: DataFrame, folders: DataFrame, now: dt.datetime) -> DataFrame:
    """M1: full rows from drafts (id, title, content, content_json, folder_id).

    A blank or smart folder id becomes the first regular folder.
    """
    first = folders.agg(F.min_by("id", F.struct("sort_order", "created_at", "id"))).scalar()
    asked = F.nullif(F.col("folder_id"), F.lit(""))
    rows = drafts.withColumns(
        {
            "folder_id": F.coalesce(F.when(~is_smart(asked), asked), first),
            "content_json": F.nullif(F.col("content_json"), F.lit("")),
            "created_at": stamp(now),
            "updated_at": stamp(now),
        }
    )
    return conform(rows, NOTES)


def accepted_notes(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """M1: the new rows that can be inserted, one per id that is not taken.

    Of several new rows of an id the first in the order of their columns is taken.
    """
    first = rows.groupBy("id").agg(F.min(F.struct(*[c for c in rows.columns if c != "id"])).alias("__first"))
    return first.select("id", "__first.*").join(notes.select("id"), "id", "left_anti").select(*rows.columns)


def insert_notes(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """M1: the snapshot with new rows; an id that is taken keeps its old row."""
    return notes.unionByName(accepted_notes(notes, rows), allowMissingColumns=True)


def rejected_notes(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """M1: ids that could not be inserted."""
    taken = rows.select("id").join(notes.select("id"), "id", "left_semi")
    twice = rows.groupBy("id").count().where("count > 1").select("id")
    return taken.union(twice).distinct()


def create_notes(
    notes: DataFrame, drafts: DataFrame, folders: DataFrame, now: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """M1 with I1: the new snapshot, and the image rows of the new notes."""
    rows = accepted_notes(notes, new_notes(drafts, folders, now))
    return notes.unionByName(tokenize_notes(rows), allowMissingColumns=True), embedded_images(rows, now)


def ensure_folder(folders: DataFrame, now: dt.datetime) -> DataFrame:
    """A default folder when there is none."""
    count = folders.agg(F.count("*")).scalar()
    spark = folders.sparkSession
    default = spark.createDataFrame([Row(id="default", name=DEFAULT_FOLDER, sort_order=1)]).withColumns(
        {"created_at": stamp(now), "updated_at": stamp(now)}
    )
    return folders.unionByName(conform(default, FOLDERS).where(count == 0), allowMissingColumns=True)


# Fields a partial update may carry.
NOTE_FIELDS = ("title", "content", "content_json", "folder_id", "tags")


def update_notes(notes: DataFrame, changes: DataFrame, now: dt.datetime) -> DataFrame:
    """M2, M7, M8: given fields replace those of active notes.

    Changes are (id, any of ``NOTE_FIELDS``[, seq][, cleared]), see ``fold_changes``.
    ``content_json`` = '' stores NULL.  A row without any field changes nothing; every
    other one sets ``updated_at``.
    """
    fields = [f for f in NOTE_FIELDS if f in changes.columns]
    joined = _join_changes(notes, _ordered(changes, "id", *fields), fields)
    live = F.col("hit") & is_active()
    new = {f: _new(f, live) for f in fields}
    if "content_json" in new:
        new["content_json"] = _new("content_json", live, lambda value: F.nullif(value, F.lit("")))
    any_given = F.lit(False)
    for f in fields:
        any_given = any_given | F.col(f"new_{f}").isNotNull()
    new["updated_at"] = F.when(live & any_given, stamp(now)).otherwise(F.col("updated_at"))
    return _rewrite(joined, notes.columns, new)


def merge_saves(
    notes: DataFrame, images: DataFrame, changes: DataFrame, new_images: DataFrame, now: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """M2 with I4 and M14: tokenized changes and the images they came with, in a snapshot.

    An image that is stored already keeps its id, and the tokens follow.  Images of changes
    to missing or deleted notes are left out; of a saved note, images that it no longer
    mentions go.  The notes are stored, as both results and most callers read them again.
    Which images stay is settled by ids; payloads are dealt out once, by their note.
    """
    live = notes.where(is_active()).select("id").join(changes.select("id"), "id", "left_semi")
    live = round_stored(live.select(F.col("id").alias("note_id")).distinct())
    saved = round_stored(update_notes(notes, rename_tokens(changes, images), now))
    # The texts are read for what they mention before anything joins, so that none is dealt out for it.
    mentioned = round_stored(referenced_images(saved).withColumnRenamed("image_id", "id"))
    judged = images.select("note_id", "id").join(live, "note_id", "left_semi")
    gone = round_stored(judged.join(mentioned, ["note_id", "id"], "left_anti"))
    fresh = fresh_images(images, new_images, mentioned.join(live, "note_id", "left_semi")).select(*images.columns)
    return saved, drop_images(images, gone, deal=True).unionByName(fresh)


def save_notes(
    notes: DataFrame, images: DataFrame, changes: DataFrame, now: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """M2 with I1, I4 and M14: notes and images after edits whose texts hold data URLs.

    ``changes`` has id, content, content_json and any other field of ``update_notes``.  Their
    texts are tokenized as they are merged.
    """
    return merge_saves(notes, images, tokenize_notes(changes), embedded_images(changes, now), now)


def move_notes(notes: DataFrame, moves: DataFrame, now: dt.datetime) -> DataFrame:
    """M7: (id, folder_id[, seq])."""
    return update_notes(notes, _ordered(moves, "id", "folder_id"), now)


def replace_tags(notes: DataFrame, tagged: DataFrame, now: dt.datetime) -> DataFrame:
    """M8: (id, tags[, seq]); tags are trimmed, blank ones dropped."""
    return update_notes(notes, _ordered(tagged, "id", clean_tags(F.col("tags")).alias("tags")), now)


def soft_delete(notes: DataFrame, keys: DataFrame, now: dt.datetime) -> DataFrame:
    """M3: marks active notes; ``updated_at`` stays."""
    joined = _join_changes(notes, _keys(keys), [])
    gone = F.when(F.col("hit") & is_active(), stamp(now)).otherwise(F.col("deleted_at"))
    return _rewrite(joined, notes.columns, {"deleted_at": gone})


def restore(notes: DataFrame, keys: DataFrame) -> DataFrame:
    """M4."""
    joined = _join_changes(notes, _keys(keys), [])
    return _rewrite(joined, notes.columns, {"deleted_at": F.when(~F.col("hit"), F.col("deleted_at"))})


def hard_delete(notes: DataFrame, images: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M5: removes notes and, as declared, their images."""
    ids = _keys(keys)
    kept = notes.join(ids, "id", "left_anti").select(*notes.columns)
    kept_images = images.join(ids.withColumnRenamed("id", "note_id"), "note_id", "left_anti").select(*images.columns)
    return kept, kept_images


def purge_empty(notes: DataFrame) -> DataFrame:
    """M5: drops active notes that are effectively empty; a plain filter."""
    return notes.where(~F.coalesce(is_active() & effectively_empty(), F.lit(False)))


def set_pinned(notes: DataFrame, pins: DataFrame) -> DataFrame:
    """M6: (id, is_pinned[, seq]), deleted notes included; ``updated_at`` stays."""
    joined = _join_changes(notes, _ordered(pins, "id", "is_pinned"), ["is_pinned"])
    return _rewrite(joined, notes.columns, {"is_pinned": _new("is_pinned")})


def toggle_pinned(notes: DataFrame, keys: DataFrame) -> DataFrame:
    """M6: flips the pin of active notes."""
    joined = _join_changes(notes, _keys(keys), [])
    value = F.when(F.col("hit") & is_active(), ~F.col("is_pinned")).otherwise(F.col("is_pinned"))
    return _rewrite(joined, notes.columns, {"is_pinned": value})


# -- folders -----------------------------------------------------------------


def new_folders(
    folders: DataFrame,
    drafts: DataFrame,
    now: dt.datetime,
    order: list[Column] | None = None,
    paths: DataFrame | None = None,
) -> DataFrame:
    """Full rows of drafts (id, name, color, parent_id), in the next
    sort orders.

    With ``paths`` the depth limit applies: a draft below a folder that is too
    deep is left out.  If folders and drafts have a ``library_id``, each library
    counts for itself, and the new rows have it too.
    """
    drafts = drafts.withColumn("parent_id", F.nullif(F.col("parent_id"), F.lit("")))
    if paths is not None:
        full = can_have_child(paths).where(~F.col("allowed")).select(F.col("id").alias("parent_id"))
        drafts = drafts.join(full, "parent_id", "left_anti")
    order = order or [F.col("id").asc()]
    if "library_id" in drafts.columns and "library_id" in folders.columns:
        kept = [*FOLDERS.names, "library_id"]
        tops = folders.groupBy("library_id").agg(F.max("sort_order").alias("__top"))
        ranked = rank_rows(drafts, [F.col("library_id")], order, "nth").join(tops, "library_id", "left")
        top = F.coalesce("__top", F.lit(0))
    else:
        kept = FOLDERS.names
        top = folders.agg(F.coalesce(F.max("sort_order"), F.lit(0))).scalar()
        ranked = rank_rows(drafts, [], order, "nth")
    rows = ranked.withColumns(
        {"sort_order": (top + F.col("nth")).cast("int"), "created_at": stamp(now), "updated_at": stamp(now)}
    )
    return conform(rows, FOLDERS).select(*kept)


def create_folders(
    folders: DataFrame,
    drafts: DataFrame,
    now: dt.datetime,
    order: list[Column] | None = None,
    paths: DataFrame | None = None,
) -> DataFrame:
    """M9: the snapshot with the new folders."""
    return folders.unionByName(new_folders(folders, drafts, now, order, paths), allowMissingColumns=True)


def update_folders(folders: DataFrame, changes: DataFrame, now: dt.datetime) -> DataFrame:
    """(id, name, color[, seq]), NULL meaning unchanged; a blank name rejects the row."""
    name = py_strip(F.col("name"))
    usable = changes.withColumn("name", name).where(F.coalesce(F.col("name") != "", F.lit(True)))
    usable = usable.where("name is not null or color is not null")
    joined = _join_changes(folders, _ordered(usable, "id", "name", "color"), ["name", "color"])
    new = {c: _new(c) for c in ("name", "color")}
    new["updated_at"] = F.when(F.col("hit"), stamp(now)).otherwise(F.col("updated_at"))
    return _rewrite(joined, folders.columns, new)


def delete_folder(
    folders: DataFrame, notes: DataFrame, images: DataFrame, paths: DataFrame, folder_id: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A folder, everything below it, their notes and the notes' images."""
    gone = descendants(paths, folder_id, include_self=True).select("id")
    in_gone = gone.withColumnRenamed("id", "folder_id")
    lost = notes.join(in_gone, "folder_id", "left_semi").select(F.col("id").alias("note_id"))
    return (
        folders.join(gone, "id", "left_anti").select(*folders.columns),
        notes.join(in_gone, "folder_id", "left_anti").select(*notes.columns),
        images.join(lost, "note_id", "left_anti").select(*images.columns),
    )


# -- libraries ---------------------------------------------------------------


def create_libraries(libraries: DataFrame, drafts: DataFrame, now: dt.datetime) -> DataFrame:
    """Drafts (id, name, description); a table without rows gets the default."""
    rows = drafts.withColumns({"db_path": F.lit(""), "created_at": stamp(now), "updated_at": stamp(now)})
    return libraries.unionByName(conform(rows, LIBRARIES).select(*LIBRARIES.names), allowMissingColumns=True)


def ensure_library(libraries: DataFrame, now: dt.datetime) -> DataFrame:
    """The default library when there is none."""
    name, description = DEFAULT_LIBRARY
    draft = libraries.sparkSession.createDataFrame(
        [Row(id="default", name=name, description=description, is_default=True)]
    )
    count = libraries.agg(F.count("*")).scalar()
    return create_libraries(libraries, draft.where(count == 0), now)


def update_libraries(libraries: DataFrame, changes: DataFrame, now: dt.datetime) -> DataFrame:
    """(id, name[, description][, seq]); names are trimmed, a blank one rejects the row."""
    usable = changes.withColumn("name", py_strip(F.col("name"))).where("name <> ''")
    fields = ["name"]
    if "description" in changes.columns:
        usable = usable.withColumn("description", py_strip(F.coalesce("description", F.lit(""))))
        fields.append("description")
    joined = _join_changes(libraries, _ordered(usable, "id", *fields), fields)
    new = {c: _new(c) for c in fields}
    new["updated_at"] = F.when(F.col("hit"), stamp(now)).otherwise(F.col("updated_at"))
    return _rewrite(joined, libraries.columns, new)


def delete_library(
    libraries: DataFrame,
    notes: DataFrame,
    library_id: str,
    folders: DataFrame | None = None,
    images: DataFrame | None = None,
) -> tuple[DataFrame, ...]:
    """Drops a library with its notes, folders and images when J11 allows it.

    Returns libraries and notes, then folders and images if they are given.  Folders have a
    ``library_id``; images go with their notes, whether they have one or not.
    """
    allowed = deletable_libraries(libraries, notes).where("deletable").where(F.col("id") == library_id)
    gone = allowed.select(F.col("id").alias("library_id"))
    left = [
        libraries.join(gone, F.col("id") == gone["library_id"], "left_anti").select(*libraries.columns),
        notes.join(gone, "library_id", "left_anti").select(*notes.columns),
    ]
    if folders is not None:
        left.append(folders.join(gone, "library_id", "left_anti").select(*folders.columns))
    if images is not None:
        lost = notes.join(gone, "library_id", "left_semi").select(F.col("id").alias("note_id"))
        left.append(images.join(lost, "note_id", "left_anti").select(*images.columns))
    return tuple(left)
