"""Queries that export notes to files and import them again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgrove.functions.splice import matches
from inkgrove.functions.text import plain_text_body
from inkgrove.operators.naming import unique_names
from inkgrove.plans.lineage import cut, scratch_path
from inkgrove.registry.base import query
from inkgrove.registry.datasets import NOW
from inkgrove.registry.texts import html_sql, plain_sql
from inkgrove.sources import export as E
from inkgrove.sources import files as S

_SPACE = "' ' || chr(9) || chr(10) || chr(13)"
_BASE = rf"""left(coalesce(nullif(trim(regexp_replace(trim(coalesce(nullif(title, ''), '무제'), {_SPACE}),
        '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' .'), ''), '무제'), 120)"""


def _named(tables: str, source: str, directory: str) -> str:
    """Rows of ``source`` with ``directory`` and unique ``file_base``."""
    return f"""{tables}
        placed AS (SELECT a.*, {_BASE} AS base, {directory} AS directory FROM {source}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY directory, lower(base) ORDER BY updated_at DESC, id) AS k
                   FROM placed),
        named AS (SELECT *, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS file_base FROM ranked)"""


_ALL = _named(",", "notes_img a JOIN fpath p ON p.id = a.folder_id WHERE a.deleted_at IS NULL", "'전체 노트/' || array_to_string(p.names, '/')")
_REGION = _named(
    ",",
    "notes_img a JOIN fpath p ON p.id = a.folder_id JOIN closure c ON c.descendant = a.folder_id"
    " WHERE a.deleted_at IS NULL AND c.ancestor = 'r1'",
    "(SELECT name FROM folders WHERE id = 'r1') || CASE WHEN len(p.names) > 1 THEN '/' || array_to_string(p.names[2:], '/')"
    " ELSE '' END",
)
_FAVORITES = _named(",", "notes_img a WHERE a.deleted_at IS NULL AND a.is_pinned", "'즐겨 찾기'")
_CHOSEN = _named(
    ",", "notes_img a WHERE a.deleted_at IS NULL AND a.id IN (SELECT 'd' || doc_id FROM labels WHERE quality = 0)", "''"
)


def _md_body(plain_column: str = "plain") -> str:
    # The embedded image follows the text after one line end, whatever the text ends with.
    return html_sql(f"{plain_column} || chr(10) || '![img](' || file_base || '_img_001.png)'")


def _manifest(d, scope, fmt="md"):
    rows = E.export_manifest(scope, fmt, d.images())
    return rows.select("note_id", "directory", "file_name", "body", F.size("images").cast("bigint").alias("images"))


_MANIFEST = f"SELECT id AS note_id, directory, file_base || '.md' AS file_name, {_md_body()} AS body, CAST(1 AS BIGINT) AS images FROM named"


@query("export_all_s11_s12", "notes_img fpath", f"{_ALL} {_MANIFEST}")
def _(d):
    return _manifest(d, E.all_scope(d.tokenized(), d.folders(), d.paths()))


@query("export_folder_s11", "notes_img fpath closure", f"{_REGION} {_MANIFEST}")
def _(d):
    return _manifest(d, E.folder_scope(d.tokenized(), d.folders(), d.paths(), "r1"))


@query("export_favorites_s10", "notes_img", f"{_FAVORITES} {_MANIFEST}")
def _(d):
    return _manifest(d, E.favorites_scope(d.tokenized()))


@query("export_chosen_s16", "notes_img", f"{_CHOSEN} {_MANIFEST}")
def _(d):
    keys = d.table("labels").where("quality = 0").select(F.concat(F.lit("d"), "doc_id").alias("id"))
    return _manifest(d, E.chosen_scope(d.tokenized(), keys))


@query(
    "plain_text_body_s13",
    "notes",
    f"""SELECT id, CASE WHEN title <> '' THEN title || chr(10) || chr(10) ELSE '' END || {plain_sql(html_sql("content"))} AS body
        FROM notes""",
)
def _(d):
    return d.notes().select("id", plain_text_body(F.col("title"), F.col("content")).alias("body"))


@query(
    "unique_names_w1",
    "notes_img fpath",
    f"{_ALL} SELECT id, directory AS rel_dir, file_base FROM named".replace("'전체 노트/' || ", ""),
)
def _(d):
    return E.file_names(E.all_scope(d.notes(), d.folders(), d.paths()))


@query(
    "unique_names_collisions_w1",
    "",
    """WITH RECURSIVE files AS (
        SELECT doc_id AS id, 'x' || (doc_id // 25) AS rel_dir, ['scan', 'Scan_2', 'scan', 'scan_3', 'scan_2_2', 'SCAN', 'other_2', 'scan_11'][doc_id % 8 + 1] AS base,
               row_number() OVER (PARTITION BY doc_id // 25 ORDER BY doc_id * 7919 % 10007, doc_id) AS pos FROM documents),
    step AS (
        SELECT DISTINCT rel_dir, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS name FROM files
        UNION ALL
        SELECT rel_dir, pos, list_append(used, lower(name)), id, name FROM (
            SELECT s.rel_dir, f.pos, s.used, f.id, CASE WHEN NOT list_contains(s.used, lower(f.base)) THEN f.base
                ELSE f.base || '_' || list_filter(range(2, len(s.used) + 3), lambda k: NOT list_contains(s.used, lower(f.base) || '_' || k))[1] END AS name
            FROM step s JOIN files f ON f.rel_dir = s.rel_dir AND f.pos = s.pos + 1))
    SELECT id, rel_dir, name AS file_base FROM step WHERE pos > 0""",
)
def _(d):
    """Titles that look like each other's numbered names, among 25 files of a directory."""
    names = F.array(*map(F.lit, ("scan", "Scan_2", "scan", "scan_3", "scan_2_2", "SCAN", "other_2", "scan_11")))
    doc = F.col("doc_id")
    files = d.table("documents").select(
        doc.alias("id"),
        F.concat(F.lit("x"), F.floor(doc / 25)).alias("rel_dir"),
        F.get(names, (doc % 8).cast("int")).alias("base"),
        (doc * 7919 % 10007).alias("key"),
    )
    named = unique_names(files, ["key", "id"], [F.col("key").asc(), F.col("id").asc()])
    return named.select("id", "rel_dir", "file_base")


# -- files -------------------------------------------------------------------


def _exported(d, by_id: bool = False):
    """Every active note written once per application: the directory, the report."""

    def make():
        out = scratch_path(d.spark, "export").removeprefix("file:")
        notes = d.tokenized()
        if by_id:
            notes = notes.withColumn("title", F.col("id"))
        scope = E.all_scope(notes, d.folders(), d.paths())
        return out, E.export_files(scope, "md", out, d.images())

    return d.once(f"export {by_id}", make)


def _imported(d):
    """An export with ids as titles, imported again: an image link in Markdown ends
    at its first space, so images of other titles would not be found."""

    def make():
        out, _ = _exported(d, by_id=True)
        # One office file per label lies among the notes.
        office = d.table("labels").select(
            F.col("doc_id").cast("string").alias("note_id"),
            F.lit("").alias("title"),
            F.lit(E.LABEL_ALL).alias("directory"),
            F.concat(F.lit("_"), "doc_id", F.when(F.col("toxic") == 1, ".HWPX").otherwise(".docx")).alias("file_name"),
            F.lit("").alias("body"),
            F.array().cast("array<struct<file:string,data:binary>>").alias("images"),
        )
        cut(E.write_files(office, out))
        return S.import_directory(d.spark, f"{out}/{E.LABEL_ALL}", d.folders(), NOW, parent_folder_id="r1")

    return d.once("import", make)


@query(
    "export_files_s9",
    "notes_img fpath",
    f"{_ALL} SELECT id AS note_id, title, '/' || directory || '/' || file_base || '.md' AS path, true AS ok FROM named",
)
def _(d):
    out, report = _exported(d)
    return report.select("note_id", "title", F.substring("path", len(out) + 1, 1 << 20).alias("path"), "ok")


@query(
    "export_summary_s14",
    "active",
    "SELECT '전체 노트' AS label, count(*) AS count, CAST(0 AS BIGINT) AS failed_count, count(*) = 0 AS nothing_to_export FROM active",
)
def _(d):
    out, report = _exported(d)
    return E.export_summary(report, E.LABEL_ALL, out).drop("output_dir")


_TEXT = html_sql("plain || chr(10) || '![img](data:image/png;base64,' || payload || ')'")


@query(
    "import_tree_s5_j8_j9",
    "notes_img fpath",
    f"""{_ALL} SELECT id AS title, '# ' || id || chr(10) || chr(10) || {_TEXT} AS content,
        string_split(directory, '/')[-1] AS folder, 'markdown' AS content_format FROM named""",
)
def _(d):
    """What was exported comes back: text, inlined images, folders."""
    got = _imported(d)
    folders = got.folders.select(F.col("id").alias("folder_id"), F.col("name").alias("folder"))
    return got.notes_beside(folders).select("title", "content", "folder", "content_format")


@query(
    "import_folders_m13",
    "active fpath closure",
    """, used AS (SELECT DISTINCT c.ancestor AS id FROM active a JOIN closure c ON c.descendant = a.folder_id),
       dirs AS (SELECT f.depth, f.names, f.names[len(f.names)] AS name FROM fpath f WHERE f.id IN (SELECT id FROM used))
       SELECT '전체 노트' AS name, (SELECT name FROM folders WHERE id = 'r1') AS parent,
              (SELECT max(sort_order) FROM folders) + 1 AS sort_order
       UNION ALL SELECT name, CASE WHEN depth = 0 THEN '전체 노트' ELSE names[len(names) - 1] END,
              (SELECT max(sort_order) FROM folders) + 1
              + row_number() OVER (ORDER BY list_transform(names[:len(names) - 1], lambda n: n), name) FROM dirs""",
)
def _(d):
    """The export mirrored as folders below an existing one."""
    made = _imported(d).folders
    parents = made.unionByName(d.folders()).select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return made.join(parents, "parent_id").select("name", "parent", F.col("sort_order").cast("bigint").alias("sort_order"))


@query(
    "import_summary_s14",
    "active fpath closure",
    """SELECT (SELECT count(*) FROM active) AS note_count,
              (SELECT count(DISTINCT c.ancestor) + 1 FROM active a JOIN closure c ON c.descendant = a.folder_id) AS folder_count,
              (SELECT count(*) FROM labels) AS failed_count""",
)
def _(d):
    return S.import_summary(_imported(d))


def _flat_import(d):
    def make():
        out = scratch_path(d.spark, "favorites").removeprefix("file:")
        cut(E.write_files(E.export_manifest(E.favorites_scope(d.tokenized()), "txt"), out))
        return S.import_directory(d.spark, f"{out}/{E.LABEL_FAVORITES}", d.folders(), NOW, "smart:all", include_subfolders=False)

    return d.once("flat", make)


@query(
    "import_flat_s6_f18",
    "notes_img",
    f"""{_FAVORITES}, texts AS (SELECT *, {html_sql("plain")} AS body FROM named)
        SELECT file_base AS title, '# ' || file_base || chr(10) || chr(10) || title || chr(10) || chr(10) || {plain_sql("body")}
               || chr(10) || '[이미지:img]' AS content, '가져온 문서' AS folder FROM texts""",
)
def _(d):
    got = _flat_import(d)
    folders = got.folders.select(F.col("id").alias("folder_id"), F.col("name").alias("folder"))
    return got.notes.join(folders, "folder_id").select("title", "content", "folder")


@query("decode_utf8_s7", "", "SELECT 'd' || doc_id AS id, text FROM documents")
def _(d):
    """Texts as files with a byte-order mark and Windows line ends."""
    raw = F.concat(F.lit("\ufeff"), F.replace("content", F.lit("\n"), F.lit("\r\n"))).cast("binary")
    return d.notes().select("id", S.decode_text(raw).alias("text"))


@query("decode_legacy_s7")
def _(d):
    """Texts as Latin-1 bytes, through the whole chain of encodings."""
    return d.notes().select("id", S.decode_text(F.encode("content", "ISO-8859-1")).alias("text"))


# The first 25 syllables of the national standard, B0A1 to B0B9, and one that only its extension has, 8141.
_HANGUL = "가각간갇갈갉갊감갑값갓갔강갖갗같갚갛개객갠갤갬갭갯갂"


def korean_bytes(text: Column) -> Column:
    """Letters as two bytes, B0A1 to B0B9 for a to y and 8141 for z; spaces and line ends stay.

    Each byte is the Latin-1 character of its number until the end, so that whole texts are
    rewritten a few times, not letter by letter.
    """
    # Finding what stays takes a third of the time of removing the rest.
    letters = F.lower(F.array_join(matches(text, "[A-Za-z \n]+"), ""))
    first = F.replace(F.regexp_replace(letters, "([a-y])", "\u00b0$1"), F.lit("z"), F.lit("\u0081A"))
    second = "".join(chr(0xA1 + i) for i in range(25))
    return F.encode(F.translate(first, "abcdefghijklmnopqrstuvwxy", second), "ISO-8859-1")


@query(
    "decode_korean_s7",
    "",
    rf"""SELECT 'd' || doc_id AS id, translate(lower(regexp_replace(text, '[^A-Za-z \n]', '', 'g')),
                'abcdefghijklmnopqrstuvwxyz', '{_HANGUL}') AS text FROM documents""",
)
def _(d):
    """The letters of every text as two-byte Korean syllables, by the bytes of the old encodings."""
    # A column of its own: decoding asks for the bytes more than once.
    raw = d.notes().select("id", korean_bytes(F.col("content")).alias("raw"))
    return raw.select("id", S.decode_text(F.col("raw")).alias("text"))


@query(
    "import_failures_s8",
    "",
    """SELECT '/전체 노트/_' || doc_id || CASE WHEN toxic = 1 THEN '.HWPX' ELSE '.docx' END AS path,
              'unsupported format' AS error FROM labels""",
)
def _(d):
    failures = _imported(d).failures
    out, _ = _exported(d, by_id=True)
    return failures.withColumn("path", F.substring("path", len(out) + 1, 1 << 20))
