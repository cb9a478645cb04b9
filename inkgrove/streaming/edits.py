"""Edit bursts: batch form and stream.

An edit row is (note_id, ts, version, kind, title, content, content_json); a NULL
field was not edited.  A burst ends when the next edit of the note is more than
``gap`` later, as in ``session_window``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from inkgrove.operators.changes import merge_saves
from inkgrove.operators.images import embedded_images, tokenize_notes
from inkgrove.plans.ordered import last_before

# --- fixed values: the editor's pause before it saves, and its second timer
SAVE_GAP = "1500 milliseconds"
AUTOSAVE_GAP = "1200 milliseconds"
# --- end of fixed values

FIELDS = ("title", "content", "content_json")
# Cells per block: bounds the rows a window sees for one (note, block).
_BLOCK = 4096


def latest_fields() -> list[Column]:
    """Newest value of each field that was edited, and the newest version."""
    newest = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("version"))).alias(f) for f in FIELDS]
    return [F.max("version").alias("version"), *newest]


def _newest() -> list[Column]:
    """Like ``latest_fields``, each value with its version, so that results can be
    combined again."""
    pairs = [
        F.max(F.when(F.col(f).isNotNull(), F.struct(F.col("version").alias("v"), F.col(f).alias("value")))).alias(f)
        for f in FIELDS
    ]
    return [F.max("version").alias("version"), *pairs]


def latest_per_note(edits: DataFrame) -> DataFrame:
    """One row per note; partial results shrink a hot note early."""
    return edits.groupBy("note_id").agg(*latest_fields())


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def burst_saves(edits: DataFrame, gap_ms: int) -> DataFrame:
    """T1 and T2 for a table: one save per burst.

    Edits are first reduced to one row per (note, cell of gap length): edits in a
    cell are never in different bursts.  Burst starts are found within blocks of
    cells, then carried over block borders.  So no task sees more than one block
    of a note, however many edits the note has; a note's blocks are few, as their
    number depends on its time span only.
    """
    gap = gap_ms * 1000
    at = _micros(F.col("ts"))
    cells = edits.groupBy(
        "note_id", (at - F.pmod(at, F.lit(gap * _BLOCK))).alias("block"), (at - F.pmod(at, F.lit(gap))).alias("cell")
    ).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("edits"), *_newest())
    blocks = cells.groupBy("note_id", "block").agg(F.max("last").alias("block_last"))
    by_block = Window.partitionBy("note_id").orderBy("block")
    carried = blocks.withColumn("carried", F.lag("block_last").over(by_block)).drop("block_last")
    in_block = Window.partitionBy("note_id", "block").orderBy("cell")
    spans = cells.select("note_id", "block", "cell", "first", "last").join(carried, ["note_id", "block"])
    before = F.coalesce(F.lag("last").over(in_block), F.col("carried"))
    spans = spans.withColumn("starts", F.when(F.col("first") - before <= gap, 0).otherwise(1))
    # A burst is named by its first microsecond: the latest start so far.
    start = F.when(F.col("starts") == 1, F.col("first"))
    spans = spans.withColumn("local", F.max(start).over(in_block))
    block_start = (
        spans.groupBy("note_id", "block")
        .agg(F.max("local").alias("last_start"))
        .withColumn("open", F.max("last_start").over(by_block.rowsBetween(Window.unboundedPreceding, -1)))
        .drop("last_start")
    )
    named = spans.join(block_start, ["note_id", "block"]).select(
        "note_id", "block", "cell", F.coalesce("local", "open").alias("burst")
    )
    joined = cells.join(named, ["note_id", "block", "cell"])
    saves = joined.groupBy("note_id", "burst").agg(
        F.max("last").alias("last"),
        F.sum("edits").alias("edits"),
        F.max("version").alias("version"),
        *[F.max(f)["value"].alias(f) for f in FIELDS],
    )
    return saves.select(
        "note_id",
        F.timestamp_micros("burst").alias("burst_start"),
        F.timestamp_micros("last").alias("last_edit"),
        "edits",
        "version",
        *FIELDS,
    )


def effective_edits(edits: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """T5: edits that change at least one field of their note.

    Each field is compared with its last non-NULL value before, by version; ``base``, the
    stored notes (id and fields), comes before a note's first edit.  Fields are compared by
    their digests, so what one slice of a hot note hands to the next is short.
    """
    digests = {f"__{f}": F.unhex(F.sha2(f, 256)) for f in FIELDS}
    rows = edits.withColumns({**digests, "__edit": F.lit(True)})
    if base is not None:
        stored = base.select(F.col("id").alias("note_id"), *FIELDS)
        stored = stored.join(edits.select("note_id").distinct(), "note_id", "left_semi")
        stored = stored.withColumns({**digests, "__edit": F.lit(False)}).drop(*FIELDS)
        rows = rows.unionByName(stored, allowMissingColumns=True)
    names = list(digests)
    known = last_before(rows, [F.col("note_id")], ["__edit", "version", *names], names)
    changed = F.lit(False)
    for d in names:
        changed = changed | (F.col(d).isNotNull() & ~F.col(d).eqNullSafe(F.col(f"before_{d}")))
    return known.where(F.col("__edit") & changed).select(*edits.columns)


# -- stream ------------------------------------------------------------------


def stream_saves(edits: DataFrame, gap: str = SAVE_GAP, delay: str = "15 seconds") -> DataFrame:
    """T1 and T2 on a stream: a save appears when the watermark passes its burst.

    Edits later than ``delay`` (ten gaps by default) are dropped.
    """
    bursts = edits.withWatermark("ts", delay).groupBy("note_id", F.session_window("ts", gap).alias("burst"))
    return bursts.agg(F.count("*").alias("edits"), *latest_fields()).select(
        "note_id",
        F.col("burst.start").alias("burst_start"),
        F.col("burst.end").alias("burst_end"),
        "edits",
        "version",
        *FIELDS,
    )


SAVE_SCHEMA = "note_id string, version bigint, title string, content string, content_json string"


# Pending fields of a note, each with the version that set it, and the newest
# edit time in microseconds.
_PENDING = "version bigint, edited bigint, " + ", ".join(f"{f} string, {f}_version bigint" for f in FIELDS)


# Rows of one note that a worker holds before it puts them aside.
_HELD = 4096
_ROWS = "ts array<bigint>, version array<bigint>, flush array<boolean>, " + ", ".join(f"{f} array<string>" for f in FIELDS)


class SaveGate(StatefulProcessor):
    """Saves in version order.

    A note's edits are taken by (time, version).  A pause longer than the gap, or a
    ``flush``, ends a save; a flush carries no edit and comes after the edits of its time.
    Edits not newer than the saves before are stale: they hold a save open, but change
    nothing.  State per note: the last saved version and the open save.  A timer stands for
    the pause when nothing follows.

    A worker holds at most ``held`` rows of a note.  When a micro-batch has more, they are
    put aside in map state, in cells as long as the gap, and then taken cell by cell in the
    order of time; so memory is bounded by ``held``, an Arrow batch and the rows of one cell.
    """

    def __init__(self, gap_ms: int, held: int = _HELD):
        self.gap_ms, self.held = gap_ms, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("saved", "version bigint")
        self.pending = handle.getValueState("pending", _PENDING)
        self.aside = handle.getMapState("aside", "cell bigint, part int", _ROWS)

    def _due(self, pending: list) -> int:
        return pending[1] // 1000 + self.gap_ms

    @staticmethod
    def _saves(key, pendings: list[list]) -> pd.DataFrame:
        rows = [(key[0], p[0], *p[2::2]) for p in pendings]
        return pd.DataFrame(rows, columns=["note_id", "version", *FIELDS])

    @staticmethod
    def _rows(batch: pd.DataFrame) -> list[tuple]:
        """(time, version, flush, *fields) of a batch; missing fields are None."""
        at = batch["ts"].to_numpy("datetime64[us]").astype("int64")
        fields = (batch[f].astype(object).where(batch[f].notna(), None) for f in FIELDS)
        return list(zip(at.tolist(), batch["version"].tolist(), (batch["kind"] == "flush").tolist(), *fields))

    def _put_aside(self, rows: list[tuple], parts: dict[int, int]) -> None:
        cells: dict[int, list[tuple]] = {}
        for row in rows:
            cells.setdefault(row[0] // (self.gap_ms * 1000), []).append(row)
        for cell, own in cells.items():
            part = parts.get(cell, 0)
            parts[cell] = part + 1
            self.aside.updateValue((cell, part), tuple(map(list, zip(*own))))

    def _take_back(self, parts: dict[int, int]) -> Iterator[list[tuple]]:
        for cell in sorted(parts):
            rows: list[tuple] = []
            for part in range(parts[cell]):
                rows += zip(*self.aside.getValue((cell, part)))
                self.aside.removeKey((cell, part))
            yield rows

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        parts: dict[int, int] = {}
        for batch in rows:
            held += self._rows(batch)
            if len(held) > self.held:
                self._put_aside(held, parts)
                held = []
        if parts:
            self._put_aside(held, parts)
        saved = self.saved.get()[0] if self.saved.exists() else -1
        pending = list(self.pending.get()) if self.pending.exists() else None
        for own in self._take_back(parts) if parts else [held]:
            done = []
            for time, version, flush, *fields in sorted(own, key=lambda r: r[:3]):
                if pending and (flush or time - pending[1] > self.gap_ms * 1000):
                    done.append(pending)
                    saved, pending = pending[0], None
                if flush:
                    continue
                if pending:
                    pending[1] = max(pending[1], time)
                if version <= saved:
                    continue
                pending = pending or [version, time] + [None, -1] * len(FIELDS)
                pending[0] = max(pending[0], version)
                for i, value in enumerate(fields):
                    if value is not None and version > pending[3 + 2 * i]:
                        pending[2 + 2 * i : 4 + 2 * i] = [value, version]
            if done:
                self.saved.update((saved,))
                yield self._saves(key, done)
        if pending:
            self.pending.update(tuple(pending))
            self.handle.registerTimer(self._due(pending))
        else:
            self.pending.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            pending = list(self.pending.get())
            # Timers of earlier edits of the burst are left behind; they mean nothing.
            if self._due(pending) <= expiredTimerInfo.getExpiryTimeInMs():
                self.saved.update((pending[0],))
                self.pending.clear()
                yield self._saves(key, [pending])

    def close(self) -> None:
        pass


def gate_saves(edits: DataFrame, gap_ms: int = 1500, delay: str = "15 seconds", held: int = _HELD) -> DataFrame:
    """T3, T4 on a stream of edits; needs the RocksDB state store.

    Pauses are measured in event time: as long as a note's edits arrive in order, the saves
    do not depend on how the stream is cut into micro-batches.
    """
    return (
        edits.withWatermark("ts", delay)
        .groupBy("note_id")
        .transformWithStateInPandas(
            statefulProcessor=SaveGate(gap_ms, held), outputStructType=SAVE_SCHEMA, outputMode="append", timeMode="eventTime"
        )
    )


# -- applying saves ----------------------------------------------------------


def log_saves(saves: DataFrame, path: str, now: dt.datetime) -> DataStreamWriter:
    """Each micro-batch goes to its own folder of a change log.

    Images are tokenized before the log is written.  A repeated batch overwrites
    its folder, so every save is logged once.  ``apply_log`` reads the result;
    notes are not rewritten per batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # The batch is computed once for both writes.
        rows = batch.select(F.col("note_id").alias("id"), "version", *FIELDS).persist(StorageLevel.DISK_ONLY)
        try:
            if not rows.isEmpty():
                embedded_images(rows, now).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/images/batch={batch_id}")
                tokenize_notes(rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/saves/batch={batch_id}")
        finally:
            rows.unpersist()

    return saves.writeStream.foreachBatch(write)


def apply_log(
    notes: DataFrame, images: DataFrame, saves: DataFrame, saved_images: DataFrame, now: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """Notes and images with the newest saved fields of each note.

    ``saves`` and ``saved_images`` are the two folders of the log.
    """
    newest = latest_per_note(saves.withColumnRenamed("id", "note_id")).withColumnRenamed("note_id", "id")
    return merge_saves(notes, images, newest, saved_images, now)
