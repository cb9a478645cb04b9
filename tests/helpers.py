"""Small tables for tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from inkgrove.schemas import FOLDERS, NOTE_IMAGES, NOTES

DAY = dt.datetime(2024, 5, 1)
NOW = dt.datetime(2025, 1, 1)


def notes(spark, rows):
    """Rows are dicts; missing fields get plain values."""
    base = dict(
        folder_id="f",
        title="",
        content="",
        content_format="markdown",
        summary="",
        is_pinned=False,
        created_at=DAY,
        updated_at=DAY,
        deleted_at=None,
        content_json=None,
        tags=[],
    )
    full = [{**base, "id": f"n{i}", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f] for f in NOTES.names) for r in full], NOTES)


def folders(spark, rows):
    """Rows are (id, parent_id, sort_order)."""
    return spark.createDataFrame([(i, i.upper(), "#fff", DAY, DAY, p, o) for i, p, o in rows], FOLDERS)


def images(spark, rows):
    """Rows are (id, note_id, mime, data)."""
    made = spark.createDataFrame([(i, n, m, b, "", DAY) for i, n, m, b in rows], NOTE_IMAGES)
    return made.withColumn("checksum", F.sha2(F.concat("mime_type", F.lit(":"), "data_base64"), 256))


def ids(df, column="id"):
    return [r[column] for r in df.collect()]
