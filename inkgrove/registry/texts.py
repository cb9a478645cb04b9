"""Queries over text functions and Markdown structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrove.functions import media as M
from inkgrove.functions import text as X
from inkgrove.functions.entities import unescape
from inkgrove.operators import blocks as B
from inkgrove.registry.base import query

_DOC = "'d' || doc_id AS id"


def _docs(d, *columns):
    notes = d.notes().select("id", F.col("content").alias("text"), F.col("library_id").alias("lang"))
    return notes.select("id", *columns)


def _pages(d, *columns):
    return d.table("pages").select("page_id", *columns)



# SQL forms of the shared steps, over a text expression.
_UNESCAPE = (
    "replace(replace(replace(replace(replace(replace(replace({t}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'),"
    " '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
)
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_BREAKS = (
    r"regexp_replace(regexp_replace({t}, '(?i)<br\s*/?>', chr(10), 'g'),"
    r" '(?i)</(p|div|li|ul|ol|h[1-6]|section|article|blockquote|pre)>', chr(10), 'g')"
)
_TAGS = "regexp_replace({t}, '<[^>]+>', '', 'g')"
_SQUEEZE = f"trim(regexp_replace({{t}}, chr(10) || '{{{{3,}}}}', chr(10) || chr(10), 'g'), {_SPACES})"


def unescape_sql(t: str) -> str:
    return _UNESCAPE.format(t=t)


def html_sql(t: str) -> str:
    return _SQUEEZE.format(t=unescape_sql(_TAGS.format(t=_BREAKS.format(t=t))))


def plain_sql(t: str) -> str:
    """F6 for text without images."""
    for pattern, new in [
        (r"(?m)^#{1,6}\s*", ""),
        (r"\*\*([^*]+)\*\*", r"\1"),
        (r"\*([^*]+)\*", r"\1"),
        (r"`([^`]+)`", r"\1"),
        (r"(?m)^\s*[-*+]\s+", "• "),
        (r"(?m)^\s*\d+\.\s+", "• "),
    ]:
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    return t


def inline_sql(t: str) -> str:
    for pattern in (r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"`([^`]+)`"):
        t = rf"regexp_replace({t}, '{pattern}', '\1', 'g')"
    return t


# -- previews, dates ---------------------------------------------------------


@query(
    "list_preview_f3",
    "",
    f"SELECT {_DOC}, left(text, 80) || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS preview FROM documents",
)
def _(d):
    return _docs(d, X.list_preview(F.col("text")).alias("preview"))


@query(
    "word_preview_f4",
    "",
    rf"""SELECT {_DOC}, CASE WHEN length(flat) <= 80 THEN flat
              ELSE regexp_replace(left(flat, 80), ' [^ ]*$', '') || '...' END AS preview
         FROM (SELECT doc_id, trim(regexp_replace(translate(text, '#*`', ''), '\s+', ' ', 'g')) AS flat FROM documents)""",
)
def _(d):
    return _docs(d, X.word_preview(F.col("text"), 80).alias("preview"))


@query(
    "date_display_f8",
    "",
    """SELECT event_id, strftime(ts, '%Y.%m.%d %H:%M') AS shown, 'on ' || event_type AS other FROM events""",
)
def _(d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    odd = F.concat(F.lit("on "), "event_type")
    return d.table("events").select("event_id", X.display_date(text).alias("shown"), X.display_date(odd).alias("other"))


# -- HTML --------------------------------------------------------------------


@query("html_to_markdown_f5", "", f"SELECT page_id, {html_sql('html')} AS markdown FROM pages")
def _(d):
    return _pages(d, X.html_to_markdown(F.col("html")).alias("markdown"))


@query("normalize_pages_f7", "", f"SELECT page_id, {html_sql('html')} AS markdown FROM pages")
def _(d):
    return _pages(d, X.normalize_for_export(F.col("html")).alias("markdown"))


_LINE = rf"trim(regexp_replace({{t}}, '[\s' || chr(160) || ']+', ' ', 'g'))"


@query(
    "normalize_tables_f7",
    "",
    rf"""SELECT conv_id, turn, '| role | text | ' || chr(10) || '| --- | --- |' AS head_shape,
                {_SQUEEZE.format(t="'| role | text |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || role || ' | ' || "
                                   + _LINE.format(t="text") + " || ' |' || chr(10) || '| ' || turn || ' |  |' || chr(10) || text")}
                AS markdown FROM conversations""",
)
def _(d):
    """Each conversation turn as an HTML table with unequal rows, then as text."""
    table = F.concat(
        F.lit('<TABLE class="t"><tr><th>role</th><th>te<b>xt</b></th></tr>\n<tr><td>'),
        "role",
        F.lit("</td><td>"),
        "text",
        F.lit("</td></tr><tr><td>"),
        F.col("turn").cast("string"),
        F.lit("</td></tr></TABLE><br>"),
        "text",
    )
    return d.table("conversations").select(
        "conv_id",
        "turn",
        F.lit("| role | text | \n| --- | --- |").alias("head_shape"),
        X.normalize_for_export(table).alias("markdown"),
    )


@query("unescape_f9", "", f"SELECT page_id, {unescape_sql('html')} AS text FROM pages")
def _(d):
    return _pages(d, unescape(F.col("html")).alias("text"))


@query(
    "html_to_line_f10",
    "",
    rf"""SELECT page_id, {_LINE.format(t=unescape_sql(_TAGS.format(
        t=r"regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g')")))} AS line FROM pages""",
)
def _(d):
    return _pages(d, X.html_to_line(F.col("html")).alias("line"))


# -- Markdown ----------------------------------------------------------------


@query("markdown_to_plain_f6", "", f"SELECT {_DOC}, {plain_sql('text')} AS plain FROM documents")
def _(d):
    return _docs(d, X.markdown_to_plain(F.col("text")).alias("plain"))


@query(
    "markdown_marks_f6",
    "",
    f"""SELECT {_DOC}, {plain_sql("'## ' || text || chr(10) || '- **d' || doc_id || '**' || chr(10) || ' 12. `' || lang || '`'")}
        || chr(10) || '[이미지:image] [이미지:' || lang || ']' AS plain FROM documents""",
)
def _(d):
    marked = F.concat(
        F.lit("## "), "text", F.lit("\n- **"), "id", F.lit("**\n 12. `"), "lang", F.lit("`\n![](a b) !["), "lang", F.lit("](x)")
    )
    return _docs(d, X.markdown_to_plain(marked).alias("plain"))


@query("strip_inline_f11", "", f"SELECT {_DOC}, {inline_sql('text')} AS plain FROM documents")
def _(d):
    return _docs(d, X.strip_inline(F.col("text")).alias("plain"))


@query(
    "image_links_f24",
    "notes_img",
    "SELECT id, 'data:image/png;base64,' || payload AS links FROM notes_img",
)
def _(d):
    return d.notes_img().select("id", F.array_join(X.image_links(F.col("content")), " ").alias("links"))


# -- names and titles --------------------------------------------------------


@query(
    "safe_names_f12",
    "",
    r"""SELECT page_id, left(trim(regexp_replace(trim(url), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' .'), 120) AS name,
               left(regexp_replace(trim(html, ' ' || chr(10)), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), 120) AS long_name,
               '무제' AS blank_name FROM pages""",
)
def _(d):
    return _pages(
        d,
        X.safe_file_name(F.concat(F.lit(" "), "url", F.lit(". "))).alias("name"),
        X.safe_file_name(F.col("html")).alias("long_name"),
        X.safe_file_name(F.lit(" .. ")).alias("blank_name"),
    )


_KINDS = ["image/png", "image/JPEG", "image/jpg", "image/gif", "image/webp", "image/x-ms-bmp", "image/svg+xml", "text/css"]
_EXTS = ["png", "jpg", "jpg", "gif", "webp", "bmp", "svg", "png"]
_FILES = ["PNG", "jpg", "Jpeg", "gif", "webp", "bmp", "svg", "css"]
_MIMES = ["png", "jpeg", "jpeg", "gif", "webp", "bmp", "svg+xml", ""]


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    "image_types_f13",
    "",
    f"""SELECT event_id, {_sql_list(_EXTS)}[event_id % 8 + 1] AS extension, {_sql_list(_MIMES)}[event_id % 8 + 1] AS mime
        FROM events""",
)
def _(d):
    def pick(values):
        return F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % 8 + 1).cast("int"))

    return d.table("events").select(
        "event_id",
        M.extension_of_mime(pick(_KINDS)).alias("extension"),
        F.coalesce(M.mime_of_extension(pick(_FILES)), F.lit("")).alias("mime"),
    )


@query(
    "checksum_f14",
    "",
    f"SELECT {_DOC}, sha256('image/png:' || to_base64(encode(text))) AS checksum FROM documents",
)
def _(d):
    # Spark breaks base64 lines by default; the checksum must not see that.
    return _docs(d, M.checksum(F.lit("image/png"), F.base64(F.col("text").cast("binary"))).alias("checksum"))


_FIRST = "trim(split_part(ltrim({t}, ' ' || chr(9) || chr(10) || chr(13)), chr(10), 1))"


@query(
    "editor_title_f15",
    "",
    rf"""SELECT {_DOC}, left(trim(translate(regexp_replace(regexp_replace(regexp_replace(
             {_FIRST.format(t="text")}, '^#{{1,6}}\s*', ''), '^\*+\s*', ''), '^[-+]\s*', ''), '*_`~', '')), 100) AS title
         FROM documents""",
)
def _(d):
    return _docs(d, X.editor_title(F.col("text")).alias("title"))


_BARE = r"trim(translate(regexp_replace(trim(x), '^#{1,6}\s+', ''), '*`', ''))"


@query(
    "draft_title_f16",
    "",
    rf"""SELECT {_DOC}, CASE WHEN lang = 'en' THEN 'd' || doc_id ELSE coalesce(left(list_filter(list_transform(
             string_split('# ** ' || chr(10) || text, chr(10)), lambda x: {_BARE}), lambda x: x <> '')[1], 100), '')
             END AS title FROM documents""",
)
def _(d):
    typed = F.when(F.col("lang") == "en", F.concat(F.lit(" "), "id", F.lit("\n"))).otherwise(" ")
    return _docs(d, X.draft_title(typed, F.concat(F.lit("# ** \n"), F.col("text"))).alias("title"))


@query(
    "fallback_title_f17",
    "",
    rf"""SELECT {_DOC}, CASE WHEN line IS NULL THEN '제목 없는 노트' WHEN length(line) > 50 THEN left(line, 50) || '...'
              ELSE line END AS title
         FROM (SELECT doc_id, translate(list_filter(list_transform(string_split('# ' || text, chr(10)), lambda x: trim(x)),
               lambda x: x <> '' AND NOT regexp_matches(x, '^#{{1,6}}\s'))[1], '*`[]()', '') AS line FROM documents)""",
)
def _(d):
    return _docs(d, X.fallback_title(F.concat(F.lit("# "), F.col("text"))).alias("title"))


# -- blocks ------------------------------------------------------------------

# Every document, framed by one line of each kind and a table.
_MARKED_SQL = """
    , lines AS (
        SELECT 'd' || doc_id AS note_id, string_split('# d' || doc_id || chr(10) || '#### deep' || chr(10) || chr(10)
               || ' - *one*' || chr(10) || '12. two' || chr(10) || '![alt](x.png)' || chr(10) || text, chr(10)) AS ls,
               lang FROM documents),
    numbered AS (SELECT note_id, unnest(range(len(ls))) AS pos, rtrim(unnest(ls), ' ' || chr(9)) AS line, len(ls) AS n, lang
                 FROM lines)"""

_BULLET = r"^\s*([-*+]|\d+\.)\s+(.*)$"
_HEAD = r"^(#{1,3})\s+(.*)$"


@query(
    "note_blocks_b1",
    "",
    rf"""WITH {_MARKED_SQL.strip().lstrip(",")},
         blocks AS (SELECT note_id, pos, CASE WHEN regexp_full_match(trim(line), '!\[([^\]]*)\]\(([^)]+)\)') THEN 'image'
             WHEN regexp_matches(line, '{_HEAD}') THEN 'heading'
             WHEN regexp_matches(line, '{_BULLET}')
               THEN CASE WHEN regexp_matches(line, '^\s*\d+\.') THEN 'numbered' ELSE 'bullet' END
             WHEN trim(line) <> '' THEN 'paragraph' ELSE 'blank' END AS kind, line FROM numbered)
         SELECT note_id, pos, kind, CASE WHEN kind = 'heading' THEN length(regexp_extract(line, '{_HEAD}', 1)) ELSE 0 END AS level,
                CASE kind WHEN 'image' THEN regexp_extract(line, '!\[([^\]]*)\]', 1)
                     WHEN 'heading' THEN {inline_sql(f"regexp_extract(line, '{_HEAD}', 2)")}
                     WHEN 'bullet' THEN {inline_sql(f"regexp_extract(line, '{_BULLET}', 2)")}
                     WHEN 'numbered' THEN {inline_sql(f"regexp_extract(line, '{_BULLET}', 2)")}
                     ELSE {inline_sql("line")} END AS text
         FROM blocks
         UNION ALL SELECT DISTINCT note_id, n, 'blank', 0, '' FROM numbered
         UNION ALL SELECT DISTINCT note_id, n + 1, 'table', 0, '' FROM numbered""",
)
def _(d):
    return B.note_blocks(_marked(d))


def _marked(d):
    head = F.concat(F.lit("# "), "id", F.lit("\n#### deep\n\n - *one*\n12. two\n![alt](x.png)\n"))
    table = F.concat(F.lit("\n\n| lang | **note** |\n|---|:---:|\n| "), "lang", F.lit(" | "), "id", F.lit(" |\n"))
    return _docs(d, F.concat(head, F.col("text"), table).alias("content"))


@query(
    "note_tables_b2",
    "",
    """SELECT 'd' || doc_id AS note_id, CAST(1 AS BIGINT) AS table_no, CAST(0 AS BIGINT) AS row_no, 'lang~note' AS cells
       FROM documents
       UNION ALL SELECT 'd' || doc_id, 1, 1, lang || '~d' || doc_id FROM documents""",
)
def _(d):
    return B.note_tables(_marked(d)).withColumn("cells", F.array_join("cells", "~"))
