"""Reference tables derived from the driver tables, as FIXTURES.md describes.

``notes`` is joined once per application and written as a note store below the
shared scratch folder; queries then scan it with pruned columns and pushed-down
filters.  Everything else is derived on the fly.
"""

from __future__ import annotations

import datetime as dt
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.functions.media import base64_line
from inkgrove.operators.folders import folder_paths
from inkgrove.operators.images import embedded_images, tokenize_notes
from inkgrove.operators.numbering import number_folders
from inkgrove.plans.lineage import scratch_path
from inkgrove.schemas import FOLDERS, LIBRARIES, NOTE_IMAGES, conform
from inkgrove.sources.store import read_notes, write_notes

NOW = dt.datetime(2025, 1, 1)
EPOCH = "2024-01-01 00:00:00"


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


class Data:
    """Tables of one scale factor in one application."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, object] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def once(self, key: str, make):
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    # -- the note store ------------------------------------------------------

    def raw_notes(self) -> DataFrame:
        """One note per document, tags as JSON text.  Texts are dealt out once and not sorted."""
        docs, labels = self.table("documents"), self.table("labels")
        events = self.table("events").select(F.col("event_id").alias("doc_id"), "ts")
        suppliers = self.table("supplier").agg(F.count("*")).scalar()
        doc = F.col("doc_id")
        tag2 = F.concat_ws("/", "lang", "source")
        tag3 = F.concat_ws("/", tag2, (doc % 3).cast("string"))
        updated = F.col("ts") + F.make_dt_interval(secs=F.col("n_chars"))
        return (
            docs.join(events.hint("shuffle_hash"), "doc_id")
            .join(labels.hint("shuffle_hash"), "doc_id", "left")
            .select(
                F.concat(F.lit("d"), doc).alias("id"),
                F.concat(F.lit("s"), doc % suppliers).alias("folder_id"),
                F.left(F.substring_index("text", "\n", 1), F.lit(40)).alias("title"),
                F.col("text").alias("content"),
                F.when(doc % 4 == 0, "[]").otherwise(F.to_json(F.array("lang", tag2, tag3))).alias("tags"),
                F.coalesce((F.col("quality") == 1) & (doc % 5 == 0), F.lit(False)).alias("is_pinned"),
                F.col("ts").alias("created_at"),
                updated.alias("updated_at"),
                F.when(F.col("toxic") == 1, updated).alias("deleted_at"),
                F.col("lang").alias("library_id"),
            )
        )

    def _store(self) -> str:
        path = scratch_path(self.spark, "notes")
        write_notes(self.raw_notes(), path, deal=False)
        return path

    def notes(self, library_id: str | None = None) -> DataFrame:
        return read_notes(self.spark, self.once("store", self._store), library_id)

    def tokenized(self) -> DataFrame:
        """``notes_img`` as it is saved: tokens in the text, payloads in ``images``."""
        return read_notes(self.spark, self.once("tokenized", self._tokenized))

    def _tokenized(self) -> str:
        path = scratch_path(self.spark, "tokenized")
        write_notes(self.notes(), path, lambda notes: tokenize_notes(self.with_image(notes)), deal=False)
        return path

    def images(self, library_id: str | None = None) -> DataFrame:
        """The images of all notes, or of those of one library, stored for themselves."""
        path = self.once(f"images {library_id or ''}", lambda: self._images(library_id))
        return self.spark.read.schema(NOTE_IMAGES).parquet(path)

    def _images(self, library_id: str | None) -> str:
        path = scratch_path(self.spark, "images")
        rows = embedded_images(self.with_image(self.notes(library_id)), NOW)
        rows.write.option("compression", "zstd").parquet(path)
        return path

    def notes_img(self) -> DataFrame:
        """Every note with its whole text once more, as an embedded image."""
        return self.with_image(self.notes())

    @staticmethod
    def with_image(notes: DataFrame) -> DataFrame:
        link = F.concat(
            F.col("content"),
            F.lit("\n![img](data:image/png;base64,"),
            base64_line(F.col("content").cast("binary")),
            F.lit(")"),
        )
        return notes.withColumn("content", link)

    # -- small tables --------------------------------------------------------

    def folders(self) -> DataFrame:
        def level(table: str, mark: str, key: str, parent: Column, name: str, first: int) -> DataFrame:
            return self.table(table).select(
                F.concat(F.lit(mark), key).alias("id"),
                F.col(name).alias("name"),
                parent.cast("string").alias("parent_id"),
                (F.col(key) + first).cast("int").alias("sort_order"),
            )

        rows = (
            level("region", "r", "r_regionkey", F.lit(None), "r_name", 1)
            .union(level("nation", "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"), "n_name", 100))
            .union(level("supplier", "s", "s_suppkey", F.concat(F.lit("n"), "s_nationkey"), "s_name", 1000))
        )
        return conform(rows.withColumns({"created_at": _ntz(EPOCH), "updated_at": _ntz(EPOCH)}), FOLDERS)

    def paths(self) -> DataFrame:
        return self.once("paths", lambda: folder_paths(self.folders()))

    def numbers(self) -> DataFrame:
        """Folder numbers, stored in their order, so that a subtree prunes row groups."""
        return self.spark.read.parquet(self.once("numbers", self._numbers))

    def _numbers(self) -> str:
        path = scratch_path(self.spark, "numbers")
        number_folders(self.folders()).repartitionByRange("first").sortWithinPartitions("first").write.parquet(path)
        return path

    def libraries(self) -> DataFrame:
        langs = self.table("documents").select(F.col("lang").alias("id")).distinct()
        rows = langs.select(
            "id",
            F.col("id").alias("name"),
            F.lit("").alias("db_path"),
            _ntz(EPOCH).alias("created_at"),
            _ntz(EPOCH).alias("updated_at"),
            (F.col("id") == "en").alias("is_default"),
        )
        return conform(rows, LIBRARIES)

    # -- edits ---------------------------------------------------------------

    @staticmethod
    def as_edits(events: DataFrame) -> DataFrame:
        return events.select(
            F.concat(F.lit("u"), "user_id").alias("note_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_id").alias("version"),
            F.lit("edit").alias("kind"),
            F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("title"),
            F.col("props").alias("content"),
            F.lit(None).cast("string").alias("content_json"),
        )

    def edits(self) -> DataFrame:
        return self.as_edits(self.table("events"))

    def edit_stream(self) -> DataFrame:
        schema = self.table("events").schema
        events = self.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(self.sf_dir)
        return self.as_edits(events)


@cache
def _data(application: str, sf_dir: str) -> Data:
    return Data(SparkSession.active(), sf_dir)


def data(spark: SparkSession, sf_dir: str) -> Data:
    return _data(spark.sparkContext.applicationId, sf_dir)
