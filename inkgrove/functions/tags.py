"""Tag lists and tag paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgrove.functions.text import js_trim, py_strip

TAG_LIST = "array<string>"


def parse_tags(raw: Column) -> Column:
    """tags of a JSON array; anything else gives an empty list."""
    parsed = F.filter(F.from_json(raw, TAG_LIST), lambda t: t.isNotNull())
    return F.coalesce(parsed, F.array().cast(TAG_LIST))


def clean_tags(tags: Column) -> Column:
    return F.filter(F.transform(tags, py_strip), lambda t: t != "")


def write_tags(tags: Column) -> Column:
    """the JSON array of trimmed tags, blanks dropped."""
    return F.to_json(clean_tags(tags))


def add_tag(tags: Column, typed: Column) -> Column:
    """append what was typed, without one leading ``#``, unless present."""
    tag = F.regexp_replace(js_trim(typed), "^#", "")
    return F.when((tag == "") | F.array_contains(tags, tag), tags).otherwise(F.array_append(tags, tag))


def remove_tag(tags: Column, tag: Column) -> Column:
    """drop the first occurrence only."""
    at = F.array_position(tags, tag).cast("int")
    kept = F.concat(F.slice(tags, 1, F.greatest(at - 1, F.lit(0))), F.slice(tags, at + 1, F.size(tags)))
    return F.when(at == 0, tags).otherwise(kept)


def has_tag(tags: Column, tag: str) -> Column:
    """The tag itself, or one below it."""
    return F.exists(tags, lambda t: (t == tag) | t.startswith(tag + "/"))


def tag_prefixes(tag: Column) -> Column:
    """``a/b/c`` → ``[[a], [a, b], [a, b, c]]``; empty segments count."""
    parts = F.split(tag, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.slice(parts, 1, i))


def tag_sort_key(parts: Column) -> Column:
    """Depth-first order, siblings by lower-case name."""
    return F.transform(parts, lambda s: F.struct(F.lower(s).alias("folded"), s.alias("raw")))
