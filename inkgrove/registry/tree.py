"""Queries over the folder tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrove.functions.text import folder_name
from inkgrove.operators import changes as M
from inkgrove.operators import checks as C
from inkgrove.operators import folders as T
from inkgrove.plans.ordered import with_position
from inkgrove.registry.base import query
from inkgrove.registry.datasets import NOW
from inkgrove.schemas import FOLDERS, NOTES, SMART_FOLDERS, is_smart


@query(
    "folder_counts_j1",
    "active folders",
    """SELECT f.id, f.name, (SELECT count(*) FROM active a WHERE a.folder_id = f.id) AS note_count FROM folders f""",
)
def _(d):
    return T.with_note_count(d.folders(), d.notes()).select("id", "name", "note_count")


@query(
    "has_children_j2",
    "folders",
    "SELECT id, id IN (SELECT parent_id FROM folders WHERE parent_id IS NOT NULL) AS has_children FROM folders",
)
def _(d):
    return T.with_has_children(d.folders().select("id"), d.folders())


@query(
    "subtree_notes_j5",
    "active closure",
    "SELECT id, title FROM active WHERE folder_id IN (SELECT descendant FROM closure WHERE ancestor = 'r2')",
)
def _(d):
    return T.notes_of_subtree(d.notes(), d.numbers(), "r2").select("id", "title")


@query(
    "folder_numbers_j6",
    "fpath closure",
    """SELECT p.id, row_number() OVER (ORDER BY p.orders) AS first, p.depth,
              row_number() OVER (ORDER BY p.orders) + (SELECT count(*) FROM closure c WHERE c.ancestor = p.id AND c.distance > 0) AS last
       FROM fpath p""",
)
def _(d):
    """Every folder's number in pre-order, and the last one below it."""
    return d.numbers().select("id", "first", "depth", "last")


@query("subtree_j6", "closure", "SELECT descendant AS id, distance FROM closure WHERE ancestor = 'r1' AND distance > 0")
def _(d):
    return T.descendants(d.numbers(), "r1")


@query("folder_closure_j6", "closure", "SELECT ancestor, descendant, distance FROM closure")
def _(d):
    return T.folder_closure(d.paths())


@query(
    "folder_path_j7",
    "active fpath",
    """SELECT a.id AS note_id, coalesce(array_to_string(p.names, ' / '), '미분류') AS folder_path
       FROM active a LEFT JOIN fpath p ON p.id = a.folder_id""",
)
def _(d):
    return T.note_folder_paths(d.notes(), d.paths())


@query(
    "deletable_folders_j12",
    "active folders",
    """SELECT id, name, reason = '' AS deletable, reason FROM (
         SELECT f.id, f.name, CASE WHEN f.id IN (SELECT parent_id FROM folders WHERE parent_id IS NOT NULL)
              THEN '하위 폴더가 있어 삭제할 수 없습니다.'
              WHEN f.id IN (SELECT folder_id FROM active WHERE library_id = 'de') THEN '노트가 있어 삭제할 수 없습니다.'
              ELSE '' END AS reason FROM folders f)""",
)
def _(d):
    """Notes of other languages are deleted first, so that some folders may go."""
    notes = d.notes()
    return T.deletable_folders(d.folders(), M.soft_delete(notes, notes.where("library_id <> 'de'").select("id"), NOW))


@query(
    "folder_list_o3",
    "folders",
    "SELECT id, name, row_number() OVER (ORDER BY sort_order, id) AS position FROM folders",
)
def _(d):
    rows = T.list_folders(d.folders()).select("id", "name", "sort_order", "created_at")
    return with_position(rows, T.folder_order()).select("id", "name", "position")


_TREE = """
    SELECT p.id, p.depth, (SELECT count(*) FROM active a WHERE a.folder_id = p.id) AS note_count,
           p.id IN (SELECT parent_id FROM folders WHERE parent_id IS NOT NULL) AS has_children,
           row_number() OVER (ORDER BY p.orders) AS position FROM fpath p"""


def _placed(tree):
    narrow = tree.select("id", "depth", "note_count", "has_children", "tree_key")
    return with_position(narrow, [F.col("tree_key").asc()]).drop("tree_key")


@query("folder_tree_o4", "active fpath", _TREE)
def _(d):
    return _placed(T.folder_tree(d.folders(), d.notes(), d.numbers()))


@query(
    "collapsed_tree_o4",
    "active fpath",
    _TREE
    + """ WHERE NOT EXISTS (SELECT 1 FROM folders c, folders k WHERE k.id = p.id AND c.id IN ('r0', 'n5')
                            AND (k.parent_id = c.id OR (SELECT parent_id FROM folders x WHERE x.id = k.parent_id) = c.id))""",
)
def _(d):
    return _placed(T.folder_tree(d.folders(), d.notes(), d.numbers(), ["r0", "n5"]))


@query(
    "children_first_o6",
    "closure",
    """SELECT descendant AS id, row_number() OVER (ORDER BY distance DESC, descendant) AS position
       FROM closure WHERE ancestor = 'r1' AND distance > 0""",
)
def _(d):
    rows = T.descendants_children_first(d.paths(), "r1")
    return with_position(rows, [F.col("distance").desc(), F.col("id").asc()]).drop("distance")


@query("first_folder_o7", "folders", "SELECT id, name FROM folders ORDER BY sort_order, id LIMIT 1")
def _(d):
    return T.first_folder(d.folders()).select("id", "name")


_SMART = " UNION ALL ".join(f"SELECT '{i}' AS id, '{n}' AS name, {p} AS part" for p, (i, n, _) in enumerate(SMART_FOLDERS))


@query(
    "folder_panel_u1",
    "active fpath",
    f""", tree AS ({_TREE.replace("p.id, p.depth", "p.id, p.names[len(p.names)] AS name, p.depth")}),
       smart AS ({_SMART})
       SELECT id, name, true AS is_smart, CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS note_count, part + 1 AS position
       FROM smart UNION ALL SELECT id, name, false, depth, note_count, position + 2 FROM tree""",
)
def _(d):
    panel = T.folder_panel(d.folders(), d.notes(), d.paths())
    narrow = panel.select("id", "name", "is_smart", "depth", "note_count", "ordinal", "tree_key")
    order = [F.col("ordinal").asc(), F.col("tree_key").asc_nulls_first()]
    return with_position(narrow, order).drop("ordinal", "tree_key")


@query(
    "folder_names_f19",
    "folders",
    "SELECT id, CASE WHEN sort_order % 10 = 0 THEN '무제 폴더' ELSE name END AS name FROM folders",
)
def _(d):
    typed = F.when(F.col("sort_order") % 10 == 0, " \t ").otherwise(F.concat(F.lit(" "), "name", F.lit("\n")))
    return d.folders().select("id", folder_name(typed).alias("name"))


@query(
    "export_dirs_f21",
    "fpath closure",
    """SELECT c.descendant AS id, array_to_string(p.names[2:], '/') AS rel_dir
       FROM closure c JOIN fpath p ON p.id = c.descendant WHERE c.ancestor = 'r3'""",
)
def _(d):
    return T.export_dirs(d.paths(), "r3")


@query("export_dirs_all_f21", "fpath", "SELECT id, array_to_string(names, '/') AS rel_dir FROM fpath")
def _(d):
    return T.export_dirs(d.paths())


@query("folder_depth_f22", "fpath", "SELECT id, depth FROM fpath")
def _(d):
    return T.folder_depths(d.paths())


@query("depth_limit_f23", "fpath", "SELECT id, depth < 2 AS allowed FROM fpath")
def _(d):
    return T.can_have_child(d.paths())


@query(
    "view_labels_f25",
    "notes folders",
    """, keys AS (SELECT DISTINCT folder_id AS view FROM notes UNION ALL SELECT 'r' || n_nationkey FROM nation
                  UNION ALL SELECT 'smart:all' UNION ALL SELECT 'smart:favorites' UNION ALL SELECT 'smart:x'
                  UNION ALL SELECT '')
       SELECT k.view, CASE k.view WHEN 'smart:all' THEN '전체 노트' WHEN 'smart:favorites' THEN '즐겨 찾기'
                      WHEN 'smart:x' THEN '스마트 폴더' ELSE coalesce(f.name, '모든 노트') END AS label
       FROM keys k LEFT JOIN folders f ON f.id = k.view""",
)
def _(d):
    fixed = d.spark.createDataFrame([("smart:all",), ("smart:favorites",), ("smart:x",), ("",)], "view string")
    stored = d.notes().select(F.col("folder_id").alias("view")).distinct()
    regions = d.table("nation").select(F.concat(F.lit("r"), "n_nationkey").alias("view"))
    return T.view_labels(stored.union(regions).union(fixed), d.folders())


@query(
    "smart_flags_f26",
    "folders",
    "SELECT id, false AS is_smart FROM folders UNION ALL SELECT 'smart:' || id, true FROM folders",
)
def _(d):
    ids = d.folders().select("id")
    both = ids.union(ids.select(F.concat(F.lit("smart:"), "id")))
    return both.select("id", is_smart(F.col("id")).alias("is_smart"))


# -- checks ------------------------------------------------------------------


@query(
    "duplicate_keys_c1",
    "notes_img",
    """SELECT checksum, count(*) AS n FROM notes_img GROUP BY checksum HAVING count(*) > 1""",
)
def _(d):
    """Payloads held by several notes; within a note they are unique."""
    return C.duplicate_keys(d.images().select("checksum"), ["checksum"])


@query(
    "references_c2",
    "notes folders",
    """SELECT 'notes.folder_id' AS reference, (SELECT count(*) FROM notes WHERE folder_id NOT IN
              (SELECT id FROM folders WHERE id NOT IN ('s1', 's2', 'n3'))) AS broken
       UNION ALL SELECT 'note_images.note_id', (SELECT count(*) FROM notes WHERE deleted_at IS NOT NULL)
       UNION ALL SELECT 'folders.parent_id', (SELECT count(*) FROM folders
              WHERE parent_id = 'n3' AND id NOT IN ('s1', 's2', 'n3'))""",
)
def _(d):
    """Three folders are taken out, and images of deleted notes are moved to notes that don't exist."""
    folders = d.folders().where(~F.col("id").isin("s1", "s2", "n3"))
    notes = d.notes()
    gone = notes.where("deleted_at is not null").select(F.col("id").alias("gone"))
    moved = d.images().join(gone, F.col("note_id") == F.col("gone"), "left")
    target = F.when(F.col("gone").isNull(), F.col("note_id")).otherwise(F.concat("note_id", F.lit("-gone")))
    return C.reference_report(notes, folders, moved.withColumn("note_id", target).drop("gone"))


@query(
    "required_values_c3",
    "notes",
    """SELECT unnest(['id', 'folder_id', 'title', 'content', 'created_at', 'updated_at']) AS "column",
              unnest([count(*) FILTER (id IS NULL), count(*) FILTER (folder_id IS NULL), count(*) FILTER (title IS NULL),
                      count(*) FILTER (content IS NULL), count(*) FILTER (created_at IS NULL),
                      count(*) FILTER (updated_at IS NULL)]) AS nulls FROM notes""",
)
def _(d):
    return C.null_report(d.notes(), NOTES)


@query(
    "tree_problems_c4",
    "folders",
    """SELECT 'c' || id AS id, CASE WHEN substr(id, 1, 1) = 's' THEN 'depth' END AS problem FROM folders
       WHERE substr(id, 1, 1) = 's'
       UNION ALL SELECT id || '!', 'cycle' FROM folders
       UNION ALL SELECT id || '?', 'missing' FROM folders""",
)
def _(d):
    """Every folder also gets a copy in a cycle, and one without its parent; the
    tree itself is moved one level down, so that suppliers are too deep."""
    folders = d.folders()
    top = folders.limit(0).unionByName(
        d.spark.createDataFrame([("top", "top", None, 0)], "id string, name string, parent_id string, sort_order int")
        .withColumns({c: F.lit("2024-01-01").cast("timestamp_ntz") for c in ("created_at", "updated_at")})
        .withColumn("color", F.lit("")),
    )
    down = folders.withColumns(
        {
            "id": F.concat(F.lit("c"), "id"),
            "parent_id": F.coalesce(F.concat(F.lit("c"), "parent_id"), F.lit("top")),
        }
    )
    loops = folders.withColumns({"id": F.concat("id", F.lit("!")), "parent_id": F.concat("id", F.lit("!"))})
    loose = folders.withColumns({"id": F.concat("id", F.lit("?")), "parent_id": F.concat("id", F.lit("-gone"))})
    every = top.unionByName(down).unionByName(loops).unionByName(loose)
    return C.tree_report(T.folder_paths(every.select(*FOLDERS.names)))
