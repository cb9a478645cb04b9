"""The folder tree.

``folder_paths`` climbs from every folder to its root by pointer doubling: each
round joins the table with itself and doubles the known part of the path, so a
tree of depth ``d`` takes about ``log2(d)`` rounds.  Everything else here reads
its result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.functions.text import UNTITLED_FOLDER, or_else, safe_file_name
from inkgrove.operators.notes import is_active, notes_in_folders
from inkgrove.operators.numbering import subtree
from inkgrove.plans.lineage import round_stored as cut
from inkgrove.schemas import SMART_FOLDERS, is_smart

# --- fixed values: labels written into results
NO_FOLDER = "미분류"
ALL_NOTES = "모든 노트"
SMART_VIEW = "스마트 폴더"
REASON_CHILDREN = "하위 폴더가 있어 삭제할 수 없습니다."
REASON_NOTES = "노트가 있어 삭제할 수 없습니다."
MAX_PARENT_DEPTH = 2
# --- end of fixed values


def folder_order() -> list[Column]:
    """O3."""
    return [F.col("sort_order").asc(), F.col("created_at").asc(), F.col("id").asc()]


def list_folders(folders: DataFrame) -> DataFrame:
    """O3: folders by sort order, then age."""
    return folders.orderBy(*folder_order())


def folder_paths(folders: DataFrame) -> DataFrame:
    """Path of every folder to its root.

    Columns: ``id``, ``ids`` and ``steps`` (the folder first, its root last),
    ``ending``: ``root``, ``missing`` (the last parent does not exist) or
    ``cycle`` (the path stops before its first repetition).
    """
    step = F.struct("id", "name", "sort_order", "created_at")
    parent = F.nullif(F.col("parent_id"), F.lit(""))
    state = cut(
        folders.select(
            "id",
            F.array("id").alias("ids"),
            F.array(step).alias("steps"),
            parent.alias("next"),
            F.when(parent.isNull(), "root").alias("ending"),
        )
    )
    while not state.where("next is not null").isEmpty():
        hop = state.select(*[F.col(c).alias(f"hop_{c}") for c in ("id", "ids", "steps", "next", "ending")])
        # Whole paths meet nothing and are dealt by their own id.  A union of both kinds would
        # double the partitions in every round.
        climbing = F.col("next").isNotNull()
        joined = state.join(hop, (F.coalesce("next", "id") == F.col("hop_id")) & climbing, "left")
        found = F.col("hop_id").isNotNull()
        both = F.when(found, F.concat("ids", "hop_ids")).otherwise(F.col("ids"))
        once = F.array_distinct(both)
        looped = F.size(once) < F.size(both)
        steps = F.when(found, F.concat("steps", "hop_steps")).otherwise(F.col("steps"))
        ending = F.when(~found, "missing").when(looped, "cycle").otherwise(F.col("hop_ending"))
        moved = joined.select(
            "id",
            once.alias("ids"),
            # Past its first repetition a path only repeats itself.
            F.slice(steps, 1, F.size(once)).alias("steps"),
            F.when(found & ~looped, F.col("hop_next")).alias("next"),
            F.when(climbing, ending).otherwise(F.col("ending")).alias("ending"),
        )
        state = cut(moved)
    return state.drop("next")


def depth_of_path() -> Column:
    """0 for a root; a missing top parent counts as one level."""
    return (F.size("ids") - 1 + F.when(F.col("ending") == "missing", 1).otherwise(0)).cast("bigint")


def folder_depths(paths: DataFrame) -> DataFrame:
    """F22."""
    return paths.select("id", depth_of_path().alias("depth"))


def too_deep(paths: DataFrame) -> DataFrame:
    """folders below the third level, which only an import can create."""
    return folder_depths(paths).where(F.col("depth") > MAX_PARENT_DEPTH)


def can_have_child(paths: DataFrame) -> DataFrame:
    """whether a child may be created in a folder."""
    return paths.select("id", (depth_of_path() < MAX_PARENT_DEPTH).alias("allowed"))


def folder_closure(paths: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance), each folder with itself at 0."""
    return paths.select(
        F.col("id").alias("descendant"), F.posexplode("ids").alias("distance", "ancestor")
    ).select("ancestor", "descendant", F.col("distance").cast("bigint").alias("distance"))


def descendants(paths: DataFrame, folder_id: str, include_self: bool = False) -> DataFrame:
    """J6 for one folder, without building the whole closure.

    ``paths`` are those of ``folder_paths``, or the numbers of ``number_folders``, in which a
    subtree is a range.
    """
    if "first" in paths.columns:
        return subtree(paths, folder_id, include_self).select("id", "distance")
    inside = F.array_contains("ids", folder_id)
    if not include_self:
        inside = inside & (F.col("id") != folder_id)
    distance = (F.array_position("ids", folder_id) - 1).cast("bigint")
    return paths.where(inside).select("id", distance.alias("distance"))


def descendants_children_first(paths: DataFrame, folder_id: str) -> DataFrame:
    """An order in which every child comes before its parent."""
    return descendants(paths, folder_id).orderBy(F.col("distance").desc(), "id")


# -- notes and folders -------------------------------------------------------


def notes_of_subtree(notes: DataFrame, paths: DataFrame, folder_id: str) -> DataFrame:
    """Active notes of a folder and everything below it."""
    return notes_in_folders(notes, descendants(paths, folder_id, include_self=True).select("id"))


def count_by_folder(notes: DataFrame) -> DataFrame:
    """Active notes per folder; partial counts keep a hot folder small."""
    return notes.where(is_active()).groupBy("folder_id").agg(F.count("*").alias("note_count"))


def with_note_count(folders: DataFrame, notes: DataFrame) -> DataFrame:
    """Direct active notes of each folder, zero included."""
    counts = count_by_folder(notes).withColumnRenamed("folder_id", "__f")
    joined = folders.join(counts, F.col("id") == F.col("__f"), "left")
    return joined.select(*folders.columns, F.coalesce("note_count", F.lit(0)).cast("bigint").alias("note_count"))


def with_has_children(table: DataFrame, folders: DataFrame) -> DataFrame:
    """J2."""
    parents = folders.select(F.col("parent_id").alias("__p")).where("__p is not null").distinct()
    joined = table.join(parents, F.col("id") == F.col("__p"), "left")
    return joined.select(*table.columns, F.col("__p").isNotNull().alias("has_children"))


def deletable_folders(folders: DataFrame, notes: DataFrame) -> DataFrame:
    """Whether each folder may be deleted, and why not."""
    facts = with_has_children(with_note_count(folders, notes), folders)
    reason = F.when(F.col("has_children"), REASON_CHILDREN).when(F.col("note_count") > 0, REASON_NOTES).otherwise("")
    return facts.select("id", "name", (reason == "").alias("deletable"), reason.alias("reason"))


def path_text(separator: str = " / ") -> Column:
    """Names from the root to the folder."""
    names = F.transform(F.reverse(F.col("steps")), lambda s: s["name"])
    return F.array_join(names, separator)


def folder_path_names(paths: DataFrame) -> DataFrame:
    return paths.select("id", path_text().alias("folder_path"))


def note_folder_paths(notes: DataFrame, paths: DataFrame) -> DataFrame:
    """The folder path of each active note, only its keys being joined."""
    keys = notes.where(is_active()).select(F.col("id").alias("note_id"), "folder_id")
    joined = keys.join(folder_path_names(paths), F.col("folder_id") == F.col("id"), "left")
    return joined.select("note_id", F.coalesce("folder_path", F.lit(NO_FOLDER)).alias("folder_path"))


# -- the tree ----------------------------------------------------------------


def tree_key() -> Column:
    """Sort keys along the path; an array sorts before its extensions, which is
    pre-order."""
    return F.transform(
        F.reverse(F.col("steps")),
        lambda s: F.struct(s["sort_order"].alias("o"), s["created_at"].alias("c"), s["id"].alias("i")),
    )


def folder_tree(
    folders: DataFrame, notes: DataFrame, paths: DataFrame, collapsed: Sequence[str] = ()
) -> DataFrame:
    """Reachable folders with note count, depth and child flag.

    ``tree_key`` sorts them in pre-order.  Folders below a collapsed one are
    hidden; folders whose path does not end at a root never appear.  ``paths`` may be the
    numbers of ``number_folders``.
    """
    shown = paths.where(F.col("ending") == "root")
    if "first" in paths.columns:
        for closed in paths.where(F.col("id").isin(list(collapsed))).collect():  # as many as are named
            if closed["first"] is not None:
                shown = shown.where(~F.col("first").between(closed["first"] + 1, closed["last"]))
        places = shown.select(F.col("id").alias("__id"), "depth", F.col("first").alias("tree_key"))
    else:
        if collapsed:
            above = F.slice("ids", 2, F.size("ids"))
            shown = shown.where(~F.arrays_overlap(above, F.array(*map(F.lit, collapsed))))
        places = shown.select(F.col("id").alias("__id"), depth_of_path().alias("depth"), tree_key().alias("tree_key"))
    facts = with_has_children(with_note_count(folders, notes), folders)
    return facts.join(places, F.col("id") == F.col("__id")).drop("__id")


def folder_panel(
    folders: DataFrame, notes: DataFrame, paths: DataFrame, collapsed: Sequence[str] = ()
) -> DataFrame:
    """The smart folders first, then the tree, in display order."""
    tree = folder_tree(folders, notes, paths, collapsed)
    spark = folders.sparkSession
    smart = spark.createDataFrame(
        [(i, *row, 0, 0, False) for i, row in enumerate(SMART_FOLDERS)],
        "ordinal int, id string, name string, color string, note_count bigint, depth bigint, has_children boolean",
    ).withColumn("is_smart", F.lit(True))
    real = tree.select("*", F.lit(len(SMART_FOLDERS)).alias("ordinal"), F.lit(False).alias("is_smart"))
    panel = smart.unionByName(real, allowMissingColumns=True)
    return panel.orderBy("ordinal", F.col("tree_key").asc_nulls_first())


def view_labels(keys: DataFrame, folders: DataFrame) -> DataFrame:
    """the heading of the view a folder id stands for."""
    key = keys.columns[0]
    named = folders.select(F.col("id").alias("__id"), F.col("name").alias("__name"))
    smart = F.create_map(*[F.lit(x) for row in SMART_FOLDERS for x in row[:2]])
    joined = keys.join(named, F.col(key) == F.col("__id"), "left")
    label = F.when(is_smart(F.col(key)), F.coalesce(F.element_at(smart, F.col(key)), F.lit(SMART_VIEW)))
    return joined.select(*keys.columns, label.otherwise(or_else(F.col("__name"), ALL_NOTES)).alias("label"))


def first_folder(folders: DataFrame) -> DataFrame:
    """The folder new notes fall back to."""
    return folders.orderBy(*folder_order()).limit(1)


# -- export paths and checks -------------------------------------------------


def export_dirs(paths: DataFrame, root_id: str | None = None) -> DataFrame:
    """sanitized relative directory of each folder; '' for the root."""
    steps = F.col("steps")
    kept = paths
    if root_id:
        kept = paths.where(F.array_contains("ids", root_id))
        steps = F.slice(steps, 1, F.array_position("ids", root_id).cast("int") - 1)
    # An empty folder name stands for the default one before it is sanitized.
    names = F.transform(F.reverse(steps), lambda s: safe_file_name(or_else(s["name"], UNTITLED_FOLDER)))
    return kept.select("id", F.array_join(names, "/").alias("rel_dir"))


def broken_paths(paths: DataFrame) -> DataFrame:
    """C4 and Q9: folders in or below a cycle, and below a missing parent."""
    return paths.where(F.col("ending") != "root").select("id", "ending")
