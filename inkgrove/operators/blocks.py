"""Markdown structure: blocks and tables (B1, B2).

Lines are exploded in place.  Only notes that contain a table rule go through
the window that finds table rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrove.functions.patterns import IMAGE_LINK, PY_SPACE, PY_SPACE_CHARS, TABLE_RULE
from inkgrove.functions.text import lines, or_else, py_strip, strip_inline

_BULLET = rf"(?s)^{PY_SPACE}*([-*+]|\p{{Nd}}+\.){PY_SPACE}+(.*)$"
_HEADING = rf"(?s)^(#{{1,3}}){PY_SPACE}+(.*)$"
_IMAGE_LINE = f"^{IMAGE_LINK}$"
_MAY_HOLD_RULE = rf"-{{3,}}:?{PY_SPACE}*\|"


def note_lines(notes: DataFrame) -> DataFrame:
    """(note_id, pos, line) with trailing white space removed."""
    split = notes.select(F.col("id").alias("note_id"), F.posexplode(lines(F.col("content"))).alias("pos", "line"))
    return split.withColumn("line", F.rtrim(F.col("line"), F.lit(PY_SPACE_CHARS)))


def _with_tables(rows: DataFrame) -> DataFrame:
    """Add ``table_start``: position of the header of the line's table, or NULL.

    A table runs from a header line (the next line is a rule) to the last of the
    consecutive lines that contain a pipe.
    """
    note = Window.partitionBy("note_id").orderBy("pos")
    piped = F.col("line").contains("|")
    rows = rows.withColumn(
        "head", piped & F.coalesce(py_strip(F.lead("line").over(note)).rlike(TABLE_RULE), F.lit(False))
    )
    rows = rows.withColumn("run", F.sum(F.when(piped, 0).otherwise(1)).over(note))
    # The first line of a run number may be the line that broke the run before.
    inside = Window.partitionBy("note_id", "run")
    first = F.min(F.when(F.col("head"), F.col("pos"))).over(inside)
    return rows.withColumn("table_start", F.when(piped & (F.col("pos") >= first), first)).drop("head", "run")


def _classify(rows: DataFrame) -> DataFrame:
    """Add kind, level and text of lines outside tables; the order matters.

    Cheap tests of the first character spare most lines the regular expressions.
    """
    line = F.col("line")
    rows = rows.withColumn("bare", py_strip(line))
    may_be_list = F.left("bare", F.lit(1)).rlike(r"[-*+\p{Nd}]")
    rows = rows.withColumns(
        {
            "image": F.col("bare").startswith("![") & F.col("bare").rlike(_IMAGE_LINE),
            "marks": F.when(line.startswith("#"), F.regexp_extract(line, _HEADING, 1)).otherwise(""),
            "bullet": F.when(may_be_list, F.regexp_extract(line, _BULLET, 1)).otherwise(""),
        }
    )
    kind = (
        F.when(F.col("image"), "image")
        .when(F.col("marks") != "", "heading")
        .when(F.col("bullet").endswith("."), "numbered")
        .when(F.col("bullet") != "", "bullet")
        .when(F.col("bare") != "", "paragraph")
        .otherwise("blank")
    )
    rows = rows.withColumn("kind", kind)
    inner = (
        F.when(F.col("kind") == "heading", F.regexp_extract(line, _HEADING, 2))
        .when(F.col("bullet") != "", F.regexp_extract(line, _BULLET, 2))
        .otherwise(line)
    )
    alt = or_else(F.regexp_extract("bare", _IMAGE_LINE, 1), "image")
    return rows.withColumns(
        {
            "level": F.when(F.col("kind") == "heading", F.length("marks")).otherwise(0),
            "text": F.when(F.col("image"), alt).otherwise(strip_inline(inner)),
        }
    )


def _split_on_tables(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    may = F.coalesce(F.col("content").rlike(_MAY_HOLD_RULE), F.lit(False))
    return note_lines(notes.where(~may)), _with_tables(note_lines(notes.where(may)))


def note_blocks(notes: DataFrame) -> DataFrame:
    """B1: (note_id, pos, kind, level, text), a table being one block."""
    plain, tabled = _split_on_tables(notes)
    rows = plain.withColumn("table_start", F.lit(None).cast("int")).unionByName(tabled)
    rows = rows.where(F.col("table_start").isNull() | (F.col("table_start") == F.col("pos")))
    is_table = F.col("table_start").isNotNull()
    return _classify(rows).select(
        "note_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.when(is_table, "table").otherwise(F.col("kind")).alias("kind"),
        F.when(is_table, 0).otherwise(F.col("level")).cast("bigint").alias("level"),
        F.when(is_table, "").otherwise(F.col("text")).alias("text"),
    )


def table_cells(line: Column) -> Column:
    """Cells of a table row, one outer pipe on each side dropped."""
    inner = F.regexp_replace(F.regexp_replace(py_strip(line), r"^\|", ""), r"\|\z", "")
    return F.transform(F.split(inner, r"\|", -1), lambda c: strip_inline(py_strip(c)))


def note_tables(notes: DataFrame) -> DataFrame:
    """B2: (note_id, table_no, row_no, cells); the rule row is dropped."""
    _, tabled = _split_on_tables(notes)
    rows = tabled.where("table_start is not null and pos <> table_start + 1")
    note = Window.partitionBy("note_id").orderBy("table_start")
    row_no = F.col("pos") - F.col("table_start") - F.when(F.col("pos") > F.col("table_start"), 1).otherwise(0)
    return rows.select(
        "note_id",
        F.dense_rank().over(note).cast("bigint").alias("table_no"),
        row_no.cast("bigint").alias("row_no"),
        table_cells(F.col("line")).alias("cells"),
    )
