"""Queries that apply change sets to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrove.operators import changes as M
from inkgrove.registry.base import iso, iso_sql, query
from inkgrove.registry.datasets import NOW

_NOW_TEXT = "'2025-01-01 00:00:00.000000'"


def _label_keys(d, where):
    return d.table("labels").where(where).select(F.concat(F.lit("d"), "doc_id").alias("id"))


@query(
    "create_notes_m1",
    "notes",
    f"""SELECT id, folder_id, title, {iso_sql("created_at")} AS created, false AS json FROM notes
        UNION ALL SELECT 'p' || page_id, CASE WHEN page_id % 3 = 0 THEN 's1' ELSE 'r0' END, url, {_NOW_TEXT}, page_id % 2 = 0
        FROM pages""",
)
def _(d):
    """One draft per page; some ask for no folder or a smart one, some ids are taken."""
    page = F.col("page_id")
    drafts = d.table("pages").select(
        F.concat(F.lit("p"), page).alias("id"),
        F.when(page % 3 == 0, "s1").when(page % 3 == 1, "smart:all").otherwise("").alias("folder_id"),
        F.col("url").alias("title"),
        F.col("html").alias("content"),
        F.when(page % 2 == 0, "{}").otherwise("").alias("content_json"),
    )
    taken = d.notes().select("id", "folder_id", F.lit("again").alias("title"), "content", F.lit("").alias("content_json"))
    notes, _ = M.create_notes(d.notes(), drafts.unionByName(taken), d.folders(), NOW)
    return notes.select(
        "id", "folder_id", "title", iso("created_at").alias("created"), F.col("content_json").isNotNull().alias("json")
    )


@query(
    "rejected_notes_m1",
    "notes",
    "SELECT id FROM notes WHERE is_pinned UNION ALL SELECT 'p' || page_id FROM pages",
)
def _(d):
    pages = d.table("pages").select(F.concat(F.lit("p"), "page_id").alias("id"))
    rows = pages.union(pages).union(d.notes().where("is_pinned").select("id"))
    return M.rejected_notes(d.notes(), rows)


@query(
    "update_notes_m2",
    "notes",
    f"""SELECT n.id, CASE WHEN n.deleted_at IS NULL AND l.quality = 1 THEN 'Q' || n.title ELSE n.title END AS title,
               n.content, coalesce(n.deleted_at IS NULL AND l.quality = 0, false) AS json,
               CASE WHEN n.deleted_at IS NULL AND l.quality IS NOT NULL THEN {_NOW_TEXT} ELSE {iso_sql("n.updated_at")} END
               AS updated
        FROM notes n LEFT JOIN labels l ON 'd' || l.doc_id = n.id""",
)
def _(d):
    """Labelled notes change: a new title, or JSON; '' as JSON stores NULL."""
    labels = d.table("labels").select(F.concat(F.lit("d"), "doc_id").alias("id"), "quality")
    good = F.col("quality") == 1
    titles = d.notes().select("id", "title")
    changes = labels.join(titles, "id").select(
        "id",
        F.when(good, F.concat(F.lit("Q"), "title")).alias("title"),
        F.lit(None).cast("string").alias("content"),
        F.when(good, "").otherwise("{}").alias("content_json"),
        F.lit(None).cast("string").alias("folder_id"),
    )
    # Keys without any field change nothing.
    idle = d.notes().select("id").join(labels.select("id"), "id", "left_anti")
    every = changes.unionByName(idle, allowMissingColumns=True)
    return M.update_notes(d.notes(), every, NOW).select(
        "id", "title", "content", F.col("content_json").isNotNull().alias("json"), iso("updated_at").alias("updated")
    )


_STEPS = """changes AS (SELECT 'd' || (event_id // 4) AS id, event_id * 7919 % 10007 AS seq, event_id,
        CASE WHEN event_id % 4 IN (0, 3) THEN 'title ' || event_type END AS title,
        CASE WHEN event_id % 4 IN (1, 2) THEN props END AS content,
        CASE event_id % 4 WHEN 2 THEN '{}' WHEN 1 THEN '' END AS content_json,
        CASE WHEN event_id % 3 = 0 THEN 'r' || (event_id % 5) END AS folder_id,
        CASE WHEN event_id % 4 <> 1 THEN ['t' || (event_id % 7), event_type] END AS tags, event_id % 2 = 0 AS is_pinned FROM events)"""


def _steps(d):
    """Four changes for each of many notes, each of some fields, in an order of their own."""
    event, step = F.col("event_id"), F.col("event_id") % 4
    return d.table("events").select(
        F.concat(F.lit("d"), F.floor(event / 4)).alias("id"),
        (event * 7919 % 10007).alias("seq"),
        F.when(step.isin(0, 3), F.concat(F.lit("title "), "event_type")).alias("title"),
        F.when(step.isin(1, 2), F.col("props")).alias("content"),
        F.when(step == 2, "{}").when(step == 1, "").alias("content_json"),
        F.when(event % 3 == 0, F.concat(F.lit("r"), event % 5)).alias("folder_id"),
        F.when(step != 1, F.array(F.concat(F.lit("t"), event % 7), F.col("event_type"))).alias("tags"),
        (event % 2 == 0).alias("is_pinned"),
    )


def _newest(field: str) -> str:
    return f"arg_max({field}, seq) FILTER ({field} IS NOT NULL) AS new_{field}"


@query(
    "update_notes_ordered_m2",
    "notes",
    f""", {_STEPS}, folded AS (SELECT id, {", ".join(map(_newest, ("title", "content", "content_json", "folder_id", "tags")))} FROM changes GROUP BY id)
       SELECT n.id, CASE WHEN live THEN coalesce(new_title, title) ELSE title END AS title,
              CASE WHEN live THEN coalesce(new_content, content) ELSE content END AS content,
              coalesce(live AND new_content_json = '{{}}', false) AS json,
              CASE WHEN live THEN coalesce(new_folder_id, folder_id) ELSE folder_id END AS folder_id,
              array_to_string(CASE WHEN live THEN coalesce(new_tags, tags) ELSE tags END, ',') AS tags,
              CASE WHEN live THEN {_NOW_TEXT} ELSE {iso_sql("updated_at")} END AS updated
       FROM (SELECT n.*, f.* EXCLUDE (id), n.deleted_at IS NULL AND f.id IS NOT NULL AS live FROM notes n LEFT JOIN folded f ON f.id = n.id) n""",
)
def _(d):
    """Several partial changes of a note: the newest of each field counts, none is lost."""
    out = M.update_notes(d.notes(), _steps(d).drop("is_pinned"), NOW)
    return out.select(
        "id", "title", "content", F.col("content_json").isNotNull().alias("json"), "folder_id",
        F.array_join("tags", ",").alias("tags"), iso("updated_at").alias("updated"),
    )


@query(
    "set_pinned_ordered_m6",
    "notes",
    f""", {_STEPS} SELECT n.id, coalesce(f.pin, n.is_pinned) AS is_pinned FROM notes n
        LEFT JOIN (SELECT id, arg_max(is_pinned, seq) AS pin FROM changes GROUP BY id) f ON f.id = n.id""",
)
def _(d):
    return M.set_pinned(d.notes(), _steps(d).select("id", "is_pinned", "seq")).select("id", "is_pinned")


@query(
    "move_notes_ordered_m7",
    "notes",
    f""", {_STEPS} SELECT n.id, CASE WHEN n.deleted_at IS NULL THEN coalesce(f.folder, n.folder_id) ELSE n.folder_id END AS folder_id FROM notes n
        LEFT JOIN (SELECT id, arg_max(folder_id, seq) FILTER (folder_id IS NOT NULL) AS folder FROM changes GROUP BY id) f ON f.id = n.id""",
)
def _(d):
    return M.move_notes(d.notes(), _steps(d).select("id", "folder_id", "seq"), NOW).select("id", "folder_id")


@query(
    "update_folders_ordered_m10",
    "folders",
    """, changes AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey ELSE 'r' || (c_custkey % 5) END AS id, c_custkey * 7919 % 1000003 AS seq,
            CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 5 = 1 THEN c_mktsegment END AS color FROM customer),
        folded AS (SELECT id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(color, seq) FILTER (color IS NOT NULL) AS color
            FROM changes GROUP BY id)
        SELECT f.id, coalesce(c.name, f.name) AS name, coalesce(c.color, '#3B82F6') AS color FROM folders f LEFT JOIN folded c ON c.id = f.id""",
)
def _(d):
    """Customers rename and recolour their nation's folder, one after the other."""
    key = F.col("c_custkey")
    changes = d.table("customer").select(
        F.when(key % 2 == 0, F.concat(F.lit("n"), "c_nationkey")).otherwise(F.concat(F.lit("r"), key % 5)).alias("id"),
        (key * 7919 % 1000003).alias("seq"),
        F.when(key % 3 == 0, F.col("c_name")).alias("name"),
        F.when(key % 5 == 1, F.col("c_mktsegment")).alias("color"),
    )
    return M.update_folders(d.folders(), changes, NOW).select("id", "name", "color")


@query(
    "soft_delete_m3",
    "notes",
    f"""SELECT id, {iso_sql("updated_at")} AS updated, CASE WHEN deleted_at IS NULL AND id IN
               (SELECT 'd' || doc_id FROM labels) THEN {_NOW_TEXT} ELSE {iso_sql("deleted_at")} END AS deleted FROM notes""",
)
def _(d):
    out = M.soft_delete(d.notes(), _label_keys(d, "true"), NOW)
    return out.select("id", iso("updated_at").alias("updated"), iso("deleted_at").alias("deleted"))


@query(
    "restore_m4",
    "notes",
    f"""SELECT id, {iso_sql("updated_at")} AS updated, CASE WHEN id IN (SELECT 'd' || doc_id FROM labels WHERE quality = 0)
               THEN '' ELSE {iso_sql("deleted_at")} END AS deleted FROM notes""",
)
def _(d):
    out = M.restore(d.notes(), _label_keys(d, "quality = 0"))
    return out.select("id", iso("updated_at").alias("updated"), iso("deleted_at").alias("deleted"))


@query(
    "hard_delete_m5",
    "notes_img",
    """SELECT id AS note_id, checksum FROM notes_img WHERE id NOT IN (SELECT 'd' || doc_id FROM labels WHERE toxic = 1)""",
)
def _(d):
    notes, images = M.hard_delete(d.notes(), d.images(), _label_keys(d, "toxic = 1"))
    kept = images.join(notes.select(F.col("id").alias("note_id")), "note_id", "left_semi")
    return kept.select("note_id", "checksum")


@query(
    "purge_empty_m5",
    "notes",
    "SELECT id FROM notes WHERE NOT (deleted_at IS NULL AND id IN (SELECT 'd' || doc_id FROM labels WHERE quality = 0))",
)
def _(d):
    """Notes of low quality are emptied first."""
    low = _label_keys(d, "quality = 0").withColumn("low", F.lit(True))
    notes = d.notes().join(low, "id", "left")
    emptied = notes.withColumns(
        {
            "title": F.when(F.col("low"), "새 노트").otherwise(F.col("title")),
            "content": F.when(F.col("low"), "<div><br></div>").otherwise(F.col("content")),
        }
    )
    return M.purge_empty(emptied).select("id")


@query(
    "toggle_pinned_m6",
    "notes",
    f"""SELECT id, CASE WHEN deleted_at IS NULL AND id IN (SELECT 'd' || doc_id FROM labels) THEN NOT is_pinned
               ELSE is_pinned END AS is_pinned, {iso_sql("updated_at")} AS updated FROM notes""",
)
def _(d):
    out = M.toggle_pinned(d.notes(), _label_keys(d, "true"))
    return out.select("id", "is_pinned", iso("updated_at").alias("updated"))


@query(
    "set_pinned_m6",
    "notes",
    "SELECT n.id, coalesce(l.quality = 1, n.is_pinned) AS is_pinned FROM notes n LEFT JOIN labels l ON 'd' || l.doc_id = n.id",
)
def _(d):
    pins = d.table("labels").select(F.concat(F.lit("d"), "doc_id").alias("id"), (F.col("quality") == 1).alias("is_pinned"))
    return M.set_pinned(d.notes(), pins).select("id", "is_pinned")


@query(
    "move_notes_m7",
    "notes",
    f"""SELECT id, CASE WHEN moved THEN 'r4' ELSE folder_id END AS folder_id,
               CASE WHEN moved THEN {_NOW_TEXT} ELSE {iso_sql("updated_at")} END AS updated
        FROM (SELECT *, deleted_at IS NULL AND is_pinned AS moved FROM notes)""",
)
def _(d):
    moves = d.notes().where("is_pinned").select("id", F.lit("r4").alias("folder_id"))
    return M.move_notes(d.notes(), moves, NOW).select("id", "folder_id", iso("updated_at").alias("updated"))


@query(
    "replace_tags_m8",
    "notes",
    """SELECT id, CASE WHEN deleted_at IS NULL AND is_pinned THEN 'kept,' || library_id ELSE array_to_string(tags, ',') END
              AS tags FROM notes""",
)
def _(d):
    tagged = d.notes().where("is_pinned").select(
        "id", F.array(F.lit(" kept"), F.lit("\t"), F.concat("library_id", F.lit(" "))).alias("tags")
    )
    return M.replace_tags(d.notes(), tagged, NOW).select("id", F.array_join("tags", ",").alias("tags"))


@query(
    "create_folders_m9_a8_w2",
    "folders",
    """SELECT id, coalesce(parent_id, '') AS parent_id, name, sort_order FROM folders
       UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'n' || c_nationkey ELSE '' END, c_name,
              (SELECT max(sort_order) FROM folders) + row_number() OVER (ORDER BY c_name, c_custkey) FROM customer""",
)
def _(d):
    """One folder per customer, below its nation or at the root."""
    drafts = d.table("customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.lit("#000000").alias("color"),
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("n"), "c_nationkey")).otherwise("").alias("parent_id"),
        "c_custkey",
    )
    out = M.create_folders(d.folders(), drafts, NOW, [F.col("name").asc(), F.col("c_custkey").asc()])
    return out.select(
        "id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "name", F.col("sort_order").cast("bigint").alias("sort_order")
    )


@query(
    "create_folders_limited_m9_f23",
    "folders",
    """SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS parent_id FROM customer WHERE c_acctbal >= 0""",
)
def _(d):
    """Customers in debt ask for a parent on the third level, and are refused."""
    suppliers = d.table("supplier").agg(F.count("*")).scalar()
    key = F.col("c_custkey")
    drafts = d.table("customer").select(
        F.concat(F.lit("c"), key).alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("n"), "c_nationkey"))
        .otherwise(F.concat(F.lit("s"), key % suppliers))
        .alias("parent_id"),
    )
    out = M.create_folders(d.folders(), drafts, NOW, paths=d.paths())
    return out.where(F.col("id").startswith("c")).select("id", "parent_id")


@query(
    "update_folders_m10",
    "folders",
    """SELECT id, CASE substr(id, 1, 1) WHEN 'n' THEN lower(name) ELSE name END AS name,
              CASE substr(id, 1, 1) WHEN 's' THEN '#111111' ELSE '#3B82F6' END AS color,
              substr(id, 1, 1) <> 'r' AS changed FROM folders""",
)
def _(d):
    """Nations are renamed, suppliers recoloured; blank names for regions are refused."""
    kind = F.substring("id", 1, 1)
    changes = d.folders().select(
        "id",
        F.when(kind == "n", F.concat(F.lit(" "), F.lower("name"), F.lit("\n"))).when(kind == "r", " \t").alias("name"),
        F.when(kind != "n", "#111111").alias("color"),
    )
    out = M.update_folders(d.folders(), changes, NOW)
    return out.select("id", "name", "color", (F.col("updated_at") == M.stamp(NOW)).alias("changed"))


@query(
    "delete_folder_m11",
    "notes_img closure",
    """, gone AS (SELECT descendant AS id FROM closure WHERE ancestor = 'r0')
       SELECT 'folder' AS kind, id AS key FROM folders WHERE id NOT IN (SELECT id FROM gone)
       UNION ALL SELECT 'note', id FROM notes WHERE folder_id NOT IN (SELECT id FROM gone)
       UNION ALL SELECT 'image', checksum FROM notes_img WHERE folder_id NOT IN (SELECT id FROM gone)""",
)
def _(d):
    images = d.images()
    folders, notes, images = M.delete_folder(d.folders(), d.notes(), images, d.numbers(), "r0")
    return (
        folders.select(F.lit("folder").alias("kind"), F.col("id").alias("key"))
        .union(notes.select(F.lit("note"), "id"))
        .union(images.select(F.lit("image"), "checksum"))
    )


@query(
    "create_libraries_m12",
    "libraries",
    "SELECT id, id AS name, '' AS description FROM libraries UNION ALL SELECT 'new-' || n_name, n_name, 'of a nation' FROM nation",
)
def _(d):
    drafts = d.table("nation").select(
        F.concat(F.lit("new-"), "n_name").alias("id"), F.col("n_name").alias("name"), F.lit("of a nation").alias("description")
    )
    return M.create_libraries(d.libraries(), drafts, NOW).select("id", "name", "description")


@query(
    "update_libraries_m12",
    "libraries",
    """SELECT id, CASE WHEN id = 'fr' THEN id ELSE 'Library ' || id END AS name,
              CASE WHEN id = 'fr' THEN '' ELSE 'about' END AS description FROM libraries""",
)
def _(d):
    changes = d.libraries().select(
        "id",
        F.when(F.col("id") == "fr", " ").otherwise(F.concat(F.lit(" Library "), "id")).alias("name"),
        F.lit(" about ").alias("description"),
    )
    return M.update_libraries(d.libraries(), changes, NOW).select("id", "name", "description")


@query(
    "delete_library_m12",
    "notes libraries",
    """SELECT 'library' AS kind, id AS key FROM libraries WHERE id <> 'es'
       UNION ALL SELECT 'note', id FROM notes WHERE library_id <> 'es'""",
)
def _(d):
    """The notes of one library are deleted first; then it may go."""
    gone = d.notes("es").select("id")
    notes = M.soft_delete(d.notes(), gone, NOW)
    libraries, notes = M.delete_library(d.libraries(), notes, "es")
    return libraries.select(F.lit("library").alias("kind"), F.col("id").alias("key")).union(
        notes.select(F.lit("note"), "id")
    )


_BY_KEY = "['de', 'en', 'es', 'fr'][{} % 4 + 1]"


def _library(key):
    return F.get(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (key % 4).cast("int"))


def _library_folders(d):
    """Every folder in the library that its number names."""
    return d.folders().withColumn("library_id", _library(F.substring("id", 2, 20).cast("bigint")))


@query(
    "delete_library_whole_m12",
    "notes_img libraries folders",
    f"""SELECT 'library' AS kind, id AS key FROM libraries WHERE id <> 'es'
       UNION ALL SELECT 'note', id FROM notes WHERE library_id <> 'es'
       UNION ALL SELECT 'folder', id FROM folders WHERE {_BY_KEY.format("CAST(substr(id, 2) AS BIGINT)")} <> 'es'
       UNION ALL SELECT 'image', checksum FROM notes_img WHERE library_id <> 'es'""",
)
def _(d):
    """A library goes with its notes, folders and images."""
    notes = M.soft_delete(d.notes(), d.notes("es").select("id"), NOW)
    libraries, notes, folders, images = M.delete_library(d.libraries(), notes, "es", _library_folders(d), d.images())
    return (
        libraries.select(F.lit("library").alias("kind"), F.col("id").alias("key"))
        .union(notes.select(F.lit("note"), "id"))
        .union(folders.select(F.lit("folder"), "id"))
        .union(images.select(F.lit("image"), "checksum"))
    )


@query(
    "create_folders_libraries_m9",
    "folders",
    f"""SELECT id, {_BY_KEY.format("CAST(substr(id, 2) AS BIGINT)")} AS library_id, sort_order FROM folders
       UNION ALL SELECT 'c' || c_custkey, lib, coalesce((SELECT max(sort_order) FROM folders
                  WHERE {_BY_KEY.format("CAST(substr(id, 2) AS BIGINT)")} = lib), 0) + row_number() OVER (PARTITION BY lib ORDER BY c_name, c_custkey)
       FROM (SELECT *, {_BY_KEY.format("c_nationkey")} AS lib FROM customer)""",
)
def _(d):
    """New folders of several libraries: each goes on after the last of its own."""
    drafts = d.table("customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.lit("#000000").alias("color"),
        F.lit("").alias("parent_id"),
        _library(F.col("c_nationkey")).alias("library_id"),
        "c_custkey",
    )
    out = M.create_folders(_library_folders(d), drafts, NOW, [F.col("name").asc(), F.col("c_custkey").asc()])
    return out.select("id", "library_id", F.col("sort_order").cast("bigint").alias("sort_order"))
