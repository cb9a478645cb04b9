"""Queries over notes: scans, lists, searches, views, orders, counts, tags."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from inkgrove.functions.tags import add_tag, parse_tags, remove_tag, write_tags
from inkgrove.operators import changes as M
from inkgrove.operators import notes as N
from inkgrove.operators import stats as S
from inkgrove.operators import tag_tree as G
from inkgrove.plans.ordered import with_position
from inkgrove.registry.base import iso, iso_sql, query
from inkgrove.registry.datasets import NOW
from inkgrove.schemas import NOTES, conform

_IDS = "SELECT id, title, {u} AS updated FROM active".format(u=iso_sql("updated_at"))


def _ids(notes):
    return notes.select("id", "title", iso("updated_at").alias("updated"))


# -- sources -----------------------------------------------------------------


@query(
    "table_scan_s1",
    "notes",
    f"""SELECT id, folder_id, library_id, title, content, 'markdown' AS content_format, '' AS summary, is_pinned,
               {iso_sql("created_at")} AS created, {iso_sql("updated_at")} AS updated,
               {iso_sql("deleted_at")} AS deleted, array_to_string(tags, ',') AS tags FROM notes""",
)
def _(d):
    return d.notes().select(
        "id",
        "folder_id",
        "library_id",
        "title",
        "content",
        "content_format",
        "summary",
        "is_pinned",
        iso("created_at").alias("created"),
        iso("updated_at").alias("updated"),
        iso("deleted_at").alias("deleted"),
        F.array_join("tags", ",").alias("tags"),
    )


@query(
    "schema_migration_s2",
    "",
    """SELECT 'd' || doc_id AS id, text AS content, 'markdown' AS content_format, false AS is_pinned,
              true AS json_is_null, CAST(0 AS BIGINT) AS tags FROM documents""",
)
def _(d):
    old = d.table("documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("").alias("folder_id"), F.col("text").alias("content")
    )
    return conform(old, NOTES).select(
        "id",
        "content",
        "content_format",
        "is_pinned",
        F.col("content_json").isNull().alias("json_is_null"),
        F.size("tags").cast("bigint").alias("tags"),
    )


@query("library_scan_s3", "notes", "SELECT id, title, library_id FROM notes WHERE library_id = 'en'")
def _(d):
    return d.notes("en").select("id", "title", "library_id")


@query(
    "library_list_s4",
    "libraries",
    "SELECT id, id AS name, id = 'en' AS is_default, row_number() OVER (ORDER BY id) AS position FROM libraries",
)
def _(d):
    order = [F.col("created_at").asc(), F.col("id").asc()]
    return with_position(S.list_libraries(d.libraries()).select("id", "name", "is_default", "created_at"), order).drop(
        "created_at"
    )


# -- lists and predicates ----------------------------------------------------


@query("note_list_p1", "active", f"{_IDS} WHERE folder_id = 's7'")
def _(d):
    return _ids(N.note_list(d.notes(), "s7"))


@query(
    "note_list_all_p1",
    "notes",
    f"SELECT id, {iso_sql('deleted_at')} AS deleted FROM notes",
)
def _(d):
    return N.note_list(d.notes(), "", include_deleted=True).select("id", iso("deleted_at").alias("deleted"))


@query(
    "tag_filter_p2",
    "active",
    f"{_IDS} WHERE len(list_filter(tags, lambda t: t = 'en/src1' OR starts_with(t, 'en/src1/'))) > 0",
)
def _(d):
    return _ids(N.note_list(d.notes(), tag="en/src1"))


@query("folder_set_p3", "active", f"{_IDS} WHERE folder_id IN ('s1', 's2', 's3', 's5', 's8')")
def _(d):
    return _ids(N.notes_in_folders(d.notes(), ["s1", "s2", "s3", "s5", "s8"]))


@query(
    "folder_table_p3",
    "active",
    f"{_IDS} WHERE folder_id IN (SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey = 3)",
)
def _(d):
    wanted = d.table("supplier").where("s_nationkey = 3").select(F.concat(F.lit("s"), "s_suppkey").alias("folder_id"))
    return _ids(N.notes_in_folders(d.notes(), wanted))


@query("pinned_p4", "active", f"{_IDS} WHERE is_pinned")
def _(d):
    return _ids(N.pinned(d.notes()))


@query(
    "pinned_with_current_u2",
    "active",
    f"""SELECT id, is_pinned, row_number() OVER (ORDER BY is_pinned, updated_at DESC, id) AS position
        FROM active WHERE is_pinned OR id = 'd3'""",
)
def _(d):
    order = [F.col("is_pinned").asc(), *N.newest_first()]
    rows = N.pinned(d.notes(), "d3").select("id", "is_pinned", "updated_at")
    return with_position(rows, order).drop("updated_at")


@query(
    "recent_p5",
    "active",
    f"""{_IDS} WHERE date_trunc('second', updated_at)
        >= date_trunc('second', TIMESTAMP '2024-01-03 00:34:56.7') - INTERVAL 1 DAY""",
)
def _(d):
    return _ids(N.recent(d.notes(), 1, dt.datetime(2024, 1, 3, 0, 34, 56, 700000)))


@query(
    "key_lookup_p6",
    "active",
    f"{_IDS} WHERE id IN (SELECT 'd' || doc_id FROM labels WHERE quality = 1)",
)
def _(d):
    keys = d.table("labels").where("quality = 1").select(F.concat(F.lit("d"), "doc_id").alias("id"))
    return _ids(N.lookup(d.notes(), keys, active_only=True))


@query(
    "existence_p7_o8",
    "active folders",
    """SELECT f.id, f.id IN (SELECT folder_id FROM active) AS has_notes,
              f.id IN (SELECT parent_id FROM folders WHERE parent_id IS NOT NULL) AS has_children FROM folders f""",
)
def _(d):
    flagged = N.exists_flags(
        d.folders().select("id"), d.notes().where(N.is_active()), "folder_id", "has_notes"
    )
    return N.exists_flags(flagged, d.folders(), "parent_id", "has_children")


_FOLD = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _like_sql(pattern: str) -> str:
    return f"({_FOLD.format(c='title')} LIKE '%{pattern}%' OR {_FOLD.format(c='content')} LIKE '%{pattern}%')"


@query("like_search_p8", "active", f"{_IDS} WHERE {_like_sql('th_re%on a')}")
def _(d):
    return _ids(N.search(d.notes(), "TH_re%ON a"))


@query("like_search_folder_p8", "active", f"{_IDS} WHERE {_like_sql('an')} AND folder_id = 's4'")
def _(d):
    return _ids(N.search(d.notes(), "AN", "s4"))


@query("term_search_p9", "active", f"{_IDS} WHERE {_like_sql('eaux')} OR {_like_sql('sch er')} OR {_like_sql('*')}")
def _(d):
    return _ids(N.search_terms(d.notes(), ["eaux", "SCH er", "*"]))


@query(
    "keyword_p10",
    "active",
    f"{_IDS} WHERE contains(lower(title), 'éré') OR contains(lower(content), 'éré')",
)
def _(d):
    return _ids(N.note_view(d.notes(), N.ViewSpec(keyword="  ÉRÉ ")))


@query(
    "date_range_p11",
    "active",
    f"{_IDS} WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-02'",
)
def _(d):
    return _ids(
        N.note_view(d.notes(), N.ViewSpec(from_date="2024-01-01", to_date="2024-01-02", sort_field="created_at"))
    )


_VIEW_SQL = f"""
    SELECT n.id, n.title, {iso_sql("n.updated_at")} AS updated FROM active n
    WHERE n.folder_id IN (SELECT 's' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
                          WHERE n_regionkey = 1)
      AND len(list_filter(n.tags, lambda t: t = 'en' OR starts_with(t, 'en/'))) > 0
      AND (contains(lower(n.title), 'the') OR contains(lower(n.content), 'the'))
      AND CAST(n.updated_at AS DATE) >= DATE '2024-01-01'"""


@query("note_view_p12", "active", _VIEW_SQL)
def flagship(d):
    """Notes below a region's folder, tagged ``en``, with a keyword, newest first."""
    below = G.notes_in_folders(d.notes(), _subtree(d, "r1"))
    return _ids(N.note_view(below, N.ViewSpec(tag="en", keyword="The", from_date="2024-01-01")))


def _subtree(d, folder_id):
    from inkgrove.operators.folders import descendants

    return descendants(d.paths(), folder_id, include_self=True).select("id")


@query(
    "favorites_view_p12",
    "active",
    f"{_IDS} WHERE (is_pinned OR id = 'd5') AND len(list_filter(tags, lambda t: t = 'en' OR starts_with(t, 'en/'))) > 0",
)
def _(d):
    return _ids(N.note_view(d.notes(), N.ViewSpec(folder_id="smart:favorites", tag="en", current_note_id="d5")))


@query("empty_notes_p14", "active", "SELECT id FROM active WHERE library_id IN ('de', 'fr')")
def _(d):
    """Notes of two languages hold placeholders only, those of a third an image."""
    lang = F.col("library_id")
    image = F.when(F.col("is_pinned"), "![a](data:image/png;base64,AA==)").otherwise('<img src="http://x/y.png">')
    return N.empty_notes(
        d.notes().withColumns(
            {
                "title": F.when(lang == "de", "").when(lang == "fr", "새 노트").when(lang == "es", "").otherwise(F.col("title")),
                "content": F.when(lang == "de", "<p></p>")
                .when(lang == "fr", "<p>&nbsp; \u200b<br></p>")
                .when(lang == "es", image)
                .otherwise(F.col("content")),
            }
        )
    ).select("id")


@query(
    "list_rows_p16",
    "active",
    """SELECT id, title, left(content, 80) || CASE WHEN length(content) > 80 THEN '...' ELSE '' END AS preview,
              strftime(created_at, '%Y.%m.%d %H:%M') AS created, strftime(updated_at, '%Y.%m.%d %H:%M') AS updated,
              array_to_string(tags, ',') AS tags, is_pinned FROM active""",
)
def _(d):
    return N.list_rows(N.note_list(d.notes())).withColumn("tags", F.array_join("tags", ","))


# -- orders ------------------------------------------------------------------


@query(
    "default_order_o1",
    "active",
    "SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) AS position FROM active",
)
def _(d):
    return with_position(N.select_notes(d.notes()).select("id", "updated_at"), N.newest_first()).drop("updated_at")


def _order_query(name: str, field: str, descending: bool, key: str) -> None:
    way = "DESC" if descending else "ASC"
    sql = f"SELECT id, row_number() OVER (ORDER BY {key} {way}, updated_at DESC, id) AS position FROM active"

    @query(name, "active", sql)
    def _(d):
        # Only the sort key is carried, not the text it is taken from.
        rows = N.select_notes(d.notes())
        value = {"title": F.lower("title"), "content": F.length("content")}.get(field, F.col(field))
        narrow = rows.select("id", "updated_at", value.alias("key"))
        first = F.col("key").desc() if descending else F.col("key").asc()
        return with_position(narrow, [first, *N.newest_first()]).select("id", "position")


_order_query("title_order_asc_o2", "title", False, "lower(title)")
_order_query("title_order_desc_o2", "title", True, "lower(title)")
_order_query("length_order_desc_o2", "content", True, "length(content)")
_order_query("created_order_asc_o2", "created_at", False, "created_at")


# -- counts ------------------------------------------------------------------


@query(
    "stats_a1",
    "notes folders",
    """SELECT (SELECT count(*) FROM folders) AS folders, count(*) FILTER (deleted_at IS NULL) AS notes,
              count(*) FILTER (deleted_at IS NOT NULL) AS deleted_notes FROM notes""",
)
def _(d):
    return S.library_stats(d.notes(), d.folders())


@query(
    "view_counts_a2",
    "active",
    """SELECT 'all' AS view, count(*) AS note_count FROM active
       UNION ALL SELECT 'favorites', count(*) FROM active WHERE is_pinned
       UNION ALL SELECT 's3', count(*) FROM active WHERE folder_id = 's3'
       UNION ALL SELECT 'none', count(*) FROM active""",
)
def _(d):
    views = {"all": "smart:all", "favorites": "smart:favorites", "s3": "s3", "none": ""}
    counts = [S.view_count(d.notes(), f).select(F.lit(v).alias("view"), "note_count") for v, f in views.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("folder_count_a3", "folders", "SELECT count(*) AS folder_count FROM folders")
def _(d):
    return S.folder_count(d.folders())


@query(
    "library_counts_j10",
    "active libraries",
    "SELECT l.id, (SELECT count(*) FROM active a WHERE a.library_id = l.id) AS note_count FROM libraries l",
)
def _(d):
    return S.library_note_counts(d.libraries(), d.notes()).select("id", "note_count")


@query(
    "deletable_libraries_j11",
    "active libraries",
    """SELECT l.id, c.n = 0 AS can_delete, c.n = 0 AND (SELECT count(*) FROM libraries) > 1 AS deletable
       FROM libraries l JOIN (SELECT l.id, count(a.id) AS n FROM libraries l
            LEFT JOIN active a ON a.library_id = l.id AND l.id <> 'de' GROUP BY l.id) c ON c.id = l.id""",
)
def _(d):
    """The German library is emptied first, so that one may go."""
    notes = d.notes()
    emptied = M.soft_delete(notes, notes.where("library_id = 'de'").select("id"), NOW)
    return S.deletable_libraries(d.libraries(), emptied)


@query("default_library_o7", "libraries", "SELECT id FROM libraries ORDER BY id = 'en' DESC, id LIMIT 1")
def _(d):
    return S.default_library(d.libraries()).select("id")


# -- tags --------------------------------------------------------------------


@query(
    "direct_tags_a4",
    "active",
    "SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM active) GROUP BY tag",
)
def _(d):
    return G.direct_tag_counts(d.notes())


_TREE_SQL = """
    , used AS (SELECT string_split(t, '/') AS p FROM (SELECT unnest(tags) AS t FROM {source})),
    nodes AS (SELECT p, unnest(generate_series(1, len(p))) AS i FROM used),
    rolled AS (SELECT array_to_string(p[1:i], '/') AS name, count(*) AS count, max(len(p)) > i AS has_children, i,
                      p[1:i] AS parts FROM nodes GROUP BY i, p[1:i])
    SELECT name, parts[i] AS display, count, CAST(i - 1 AS BIGINT) AS depth, has_children{extra} FROM rolled"""


@query("tag_tree_a5_a7", "active", _TREE_SQL.format(source="active", extra=""))
def _(d):
    return G.tag_list(d.notes()).drop("sort_key")


@query(
    "tag_tree_folders_a6",
    "active",
    _TREE_SQL.format(source="active WHERE folder_id IN ('s1', 's2', 's3')", extra=""),
)
def _(d):
    return G.tag_list(d.notes(), ["s1", "s2", "s3"]).drop("sort_key")


@query(
    "tag_order_o5",
    "active",
    _TREE_SQL.format(
        source="active",
        extra=", row_number() OVER (ORDER BY list_transform(parts, lambda s: [lower(s), s])) AS position",
    ),
)
def _(d):
    return with_position(G.tag_tree(d.notes()), G.tag_tree_order()).drop("sort_key")


@query(
    "parse_tags_f1",
    "",
    """SELECT 'd' || doc_id AS id, array_to_string(CASE doc_id % 5 WHEN 0 THEN CAST([] AS VARCHAR[])
              WHEN 1 THEN CAST([] AS VARCHAR[]) WHEN 2 THEN [lang, source] WHEN 3 THEN CAST([] AS VARCHAR[])
              ELSE [lang] END, ',') AS tags FROM documents""",
)
def _(d):
    shape = F.col("doc_id") % 5
    raw = (
        F.when(shape == 0, "")
        .when(shape == 1, F.concat(F.lit('{"k": "'), "lang", F.lit('"}')))
        .when(shape == 2, F.to_json(F.array("lang", "source")))
        .when(shape == 3, F.concat(F.lit("["), "lang"))
        .otherwise(F.concat(F.lit('["'), "lang", F.lit('", null]')))
    )
    return d.table("documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.array_join(parse_tags(raw), ",").alias("tags")
    )


@query(
    "write_tags_f2",
    "",
    """SELECT 'd' || doc_id AS id, '["' || lang || '","' || source || '"]' AS tags FROM documents""",
)
def _(d):
    tags = F.array(F.concat(F.lit(" "), "lang", F.lit("\t")), F.lit(" \n"), F.concat("source", F.lit("　")))
    return d.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), write_tags(tags).alias("tags"))


@query(
    "edit_tags_f20",
    "notes",
    """SELECT id, array_to_string(CASE WHEN list_contains(tags, 'en') THEN tags ELSE list_append(tags, 'en') END, ',')
              AS added,
              array_to_string(list_filter(tags, lambda t: t <> library_id), ',') || ',' || library_id AS removed
       FROM notes""",
)
def _(d):
    twice = F.concat(F.col("tags"), F.array("library_id"))
    twice = F.when(F.size("tags") == 0, F.array(F.lit(""), F.col("library_id"))).otherwise(
        remove_tag(twice, F.col("library_id"))
    )
    return d.notes().select(
        "id",
        F.array_join(add_tag(F.col("tags"), F.lit(" #en ")), ",").alias("added"),
        F.array_join(twice, ",").alias("removed"),
    )
