"""Declared schemas (S2) and the typed form of raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.functions.tags import parse_tags

_S, _N, _B = T.StringType(), T.TimestampNTZType(), T.BooleanType()


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


FOLDERS = _schema(
    ("id", _S, False),
    ("name", _S, False),
    ("color", _S, True),
    ("created_at", _N, False),
    ("updated_at", _N, False),
    ("parent_id", _S, True),
    ("sort_order", T.IntegerType(), True),
)
NOTES = _schema(
    ("id", _S, False),
    ("folder_id", _S, False),
    ("title", _S, False),
    ("content", _S, False),
    ("content_format", _S, True),
    ("summary", _S, True),
    ("is_pinned", _B, True),
    ("created_at", _N, False),
    ("updated_at", _N, False),
    ("deleted_at", _N, True),
    ("content_json", _S, True),
    ("tags", T.ArrayType(_S), True),
)
NOTE_IMAGES = _schema(
    ("id", _S, False),
    ("note_id", _S, False),
    ("mime_type", _S, False),
    ("data_base64", _S, False),
    ("checksum", _S, False),
    ("created_at", _N, False),
)
LIBRARIES = _schema(
    ("id", _S, False),
    ("name", _S, False),
    ("description", _S, True),
    ("db_path", _S, False),
    ("created_at", _N, False),
    ("updated_at", _N, False),
    ("is_default", _B, True),
)
NOTE_EDITS = _schema(
    ("note_id", _S, False),
    ("ts", T.TimestampType(), False),
    ("version", T.LongType(), False),
    ("kind", _S, False),
    ("title", _S, True),
    ("content", _S, True),
    ("content_json", _S, True),
)

# --- fixed values: column defaults and names with a meaning
DEFAULTS = {
    "color": "#3B82F6",
    "sort_order": 0,
    "title": "",
    "content": "",
    "content_format": "markdown",
    "summary": "",
    "is_pinned": False,
    "description": "",
    "is_default": False,
}
DEFAULT_FOLDER = "내 노트"
DEFAULT_LIBRARY = ("내 서재", "기본 서재입니다")
SMART_PREFIX = "smart:"
SMART_FOLDERS = [
    ("smart:all", "전체 노트", "#64748B"),
    ("smart:favorites", "즐겨 찾기", "#F59E0B"),
]
# --- end of fixed values


def conform(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed rows from raw ones: missing columns are added, defaults filled in.

    Raw storage may hold ISO text for times, 0/1 for flags and JSON text for
    tags; a column absent from old files becomes its default or NULL.
    """
    kinds = dict(raw.dtypes)

    def column(field: T.StructField) -> Column:
        if field.name not in kinds:
            value = F.lit(DEFAULTS.get(field.name))
            if field.name == "tags":
                value = F.array()
            return value.cast(field.dataType)
        value = F.col(field.name)
        if field.name == "tags" and kinds["tags"] == "string":
            return parse_tags(value)
        if field.name == "tags":
            return F.coalesce(value, F.array().cast("array<string>"))
        value = value.cast(field.dataType)
        if field.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[field.name]).cast(field.dataType))
        return value

    extra = [c for c in raw.columns if c not in schema.names]
    return raw.select(*[column(f).alias(f.name) for f in schema], *extra)


def is_smart(folder_id: Column) -> Column:
    """a built-in view rather than a stored folder."""
    return F.coalesce(folder_id.startswith(SMART_PREFIX), F.lit(False))
