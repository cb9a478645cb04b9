"""Note lists, searches and views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.functions.patterns import HTML_MEDIA, HTML_TAG
from inkgrove.functions.splice import drop_all
from inkgrove.functions.tags import has_tag
from inkgrove.functions.text import DEFAULT_TITLES, blank, display_timestamp, list_preview, py_strip

SORT_FIELDS = ("updated_at", "created_at", "title", "content")


def is_active() -> Column:
    return F.col("deleted_at").isNull()


def newest_first() -> list[Column]:
    """O1, made total by the id."""
    return [F.col("updated_at").desc(), F.col("id").asc()]


def select_notes(
    notes: DataFrame, folder_id: str | None = None, include_deleted: bool = False, tag: str | None = None
) -> DataFrame:
    """P1 without its order: an empty folder id or tag filters nothing."""
    if folder_id:
        notes = notes.where(F.col("folder_id") == folder_id)
    if not include_deleted:
        notes = notes.where(is_active())
    if tag:
        notes = notes.where(has_tag(F.col("tags"), tag))
    return notes


def note_list(
    notes: DataFrame, folder_id: str | None = None, include_deleted: bool = False, tag: str | None = None
) -> DataFrame:
    """Notes of a folder, newest first."""
    return select_notes(notes, folder_id, include_deleted, tag).orderBy(*newest_first())


def notes_in_folders(
    notes: DataFrame, folder_ids: Sequence[str] | DataFrame, include_deleted: bool = False
) -> DataFrame:
    """Notes whose folder is in the set; an empty set gives no rows.

    A list becomes a pushed-down IN; a table of ids becomes a semi join.
    """
    if not include_deleted:
        notes = notes.where(is_active())
    if isinstance(folder_ids, DataFrame):
        ids = folder_ids.select(F.col(folder_ids.columns[0]).alias("folder_id")).distinct()
        return notes.join(ids, "folder_id", "left_semi").select(*notes.columns)
    if not folder_ids:
        return notes.limit(0)
    return notes.where(F.col("folder_id").isin(list(folder_ids)))


def pinned(notes: DataFrame, ensure_note_id: str | None = None) -> DataFrame:
    """Pinned notes, plus one wanted note, in one scan."""
    wanted = F.col("is_pinned")
    order = newest_first()
    if ensure_note_id:
        wanted = wanted | (F.col("id") == ensure_note_id)
        order = [F.col("is_pinned").asc(), *order]
    return notes.where(is_active() & wanted).orderBy(*order)


def recent(notes: DataFrame, days: int, as_of: dt.datetime) -> DataFrame:
    """P5: changed within ``days`` before ``as_of``, to the second, inclusive.

    The bound has no fraction, so comparing whole seconds is the same as
    comparing the column itself, and the filter reaches the scan.
    """
    bound = as_of.replace(microsecond=0) - dt.timedelta(days=days)
    newer = F.col("updated_at") >= F.lit(bound.isoformat(sep=" ")).cast("timestamp_ntz")
    return notes.where(is_active() & newer).orderBy(*newest_first())


def lookup(table: DataFrame, keys: DataFrame, key: str = "id", active_only: bool = False) -> DataFrame:
    """Rows whose key is in ``keys``."""
    if active_only:
        table = table.where(is_active())
    wanted = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
    return table.join(wanted, key, "left_semi").select(*table.columns)


def exists_flags(keys: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    """``keys`` with a flag telling whether ``table`` has the key."""
    key = keys.columns[0]
    present = table.select(F.col(column).alias("__k")).where("__k is not null").distinct()
    joined = keys.join(present, F.col(key) == F.col("__k"), "left")
    return joined.select(*keys.columns, F.col("__k").isNotNull().alias(name))


# -- searches ----------------------------------------------------------------


def like_either(query: str) -> Column:
    """``%query%`` on title or content; ``%`` and ``_`` of the query stay live.

    Java's ``(?i)`` folds ASCII letters only, as SQLite's LIKE does.  The parts
    between ``%`` are found leftmost first in atomic groups, so that a text is
    read once whether it matches or not.
    """
    parts = [p for p in query.split("%") if p]
    spelled = ["".join("." if c == "_" else c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in p) for p in parts]
    pattern = spelled[0] if len(spelled) == 1 else "^" + "".join(f"(?>.*?{p})" for p in spelled)
    return F.col("title").rlike(f"(?is){pattern}") | F.col("content").rlike(f"(?is){pattern}")


def search(notes: DataFrame, query: str, folder_id: str | None = None) -> DataFrame:
    """LIKE search, case folded for ASCII letters only, newest first."""
    return select_notes(notes, folder_id).where(like_either(query)).orderBy(*newest_first())


def search_terms(notes: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Any of the terms; no terms, no rows.

    ``DISTINCT`` over whole rows changes nothing, since the id is in the row.
    """
    if not terms:
        return notes.limit(0)
    return notes.where(is_active()).where(reduce(or_, map(like_either, terms))).orderBy(*newest_first())


def has_keyword(keyword: str) -> Column:
    """P10: lower-case substring of title or content."""
    needle = keyword.strip().lower()
    return F.lower(blank(F.col("title"))).contains(needle) | F.lower(blank(F.col("content"))).contains(needle)


def in_dates(field: str, first: str = "", last: str = "") -> Column:
    """Days ``first`` to ``last``, both included, as a pushable range."""
    kept = F.lit(True)
    if first:
        kept = kept & (F.col(field) >= _midnight(first))
    if last:
        kept = kept & (F.col(field) < _midnight(last, 1))
    return kept


def _midnight(day: str, later: int = 0) -> Column:
    date = dt.date.fromisoformat(day.strip()) + dt.timedelta(days=later)
    return F.lit(f"{date} 00:00:00").cast("timestamp_ntz")


# -- views -------------------------------------------------------------------


@dataclass(frozen=True)
class ViewSpec:
    """What the note list shows: a folder or smart folder, filters, an order."""

    folder_id: str = ""
    tag: str = ""
    keyword: str = ""
    from_date: str = ""
    to_date: str = ""
    sort_field: str = "updated_at"
    descending: bool = True
    current_note_id: str = ""

    def __post_init__(self) -> None:
        if self.sort_field not in SORT_FIELDS:
            raise ValueError(f"unknown sort field: {self.sort_field}")


def view_order(sort_field: str = "updated_at", descending: bool = True) -> list[Column]:
    """O2: the chosen key; ties stay newest first in both directions."""
    key = {
        "title": F.lower(blank(F.col("title"))),
        "content": F.length(blank(F.col("content"))),
    }.get(sort_field, F.col(sort_field))
    return [key.desc() if descending else key.asc(), *newest_first()]


def filter_view(notes: DataFrame, spec: ViewSpec) -> DataFrame:
    """P12 without its order; every filter is one predicate over one scan."""
    if spec.folder_id == "smart:favorites":
        wanted = F.col("is_pinned")
        if spec.current_note_id:
            wanted = wanted | (F.col("id") == spec.current_note_id)
        kept = select_notes(notes, tag=spec.tag).where(wanted)
    else:
        folder = "" if spec.folder_id == "smart:all" else spec.folder_id
        kept = select_notes(notes, folder, tag=spec.tag)
    if spec.keyword.strip():
        kept = kept.where(has_keyword(spec.keyword))
    if spec.sort_field in ("created_at", "updated_at"):
        kept = kept.where(in_dates(spec.sort_field, spec.from_date, spec.to_date))
    return kept


def note_view(notes: DataFrame, spec: ViewSpec) -> DataFrame:
    """Dispatch, tag, keyword, dates, order."""
    return filter_view(notes, spec).orderBy(*view_order(spec.sort_field, spec.descending))


def list_rows(notes: DataFrame) -> DataFrame:
    """What one row of the list shows."""
    return notes.select(
        "id",
        "title",
        list_preview(F.col("content")).alias("preview"),
        display_timestamp(F.col("created_at")).alias("created"),
        display_timestamp(F.col("updated_at")).alias("updated"),
        "tags",
        "is_pinned",
    )


def effectively_empty() -> Column:
    """Default title and nothing visible in the content."""
    title, content = blank(F.col("title")), blank(F.col("content"))
    shown = content.rlike(HTML_MEDIA) | content.contains("note-image://") | content.contains("data:image/")
    plain = F.regexp_replace(content, HTML_TAG, "")
    plain = F.replace(plain, F.lit("&nbsp;"), F.lit(" "))
    plain = drop_all(F.replace(plain, F.lit("\u00a0"), F.lit(" ")), "\u200b")
    return title.isin(*DEFAULT_TITLES) & ~shown & (py_strip(plain) == "")


def empty_notes(notes: DataFrame) -> DataFrame:
    """Active notes that are effectively empty."""
    return notes.where(is_active() & effectively_empty())
