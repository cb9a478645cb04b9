"""Queries over the edit log, as tables and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrove.functions.media import base64_line
from inkgrove.operators.images import hydrate
from inkgrove.plans.lineage import scratch_path
from inkgrove.registry.base import iso, iso_sql, query
from inkgrove.registry.datasets import NOW
from inkgrove.schemas import NOTE_IMAGES
from inkgrove.streaming import edits as E

HOUR_MS = 3_600_000

_SESSIONS = """
    , flagged AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS starts
                  FROM edits WINDOW w AS (PARTITION BY note_id ORDER BY ts, version)),
    numbered AS (SELECT *, sum(starts) OVER (PARTITION BY note_id ORDER BY ts, version) AS burst FROM flagged),
    saves AS (SELECT note_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS edits, max(version) AS version,
                     arg_max(title, version) FILTER (title IS NOT NULL) AS title, arg_max(content, version) AS content
              FROM numbered GROUP BY note_id, burst)"""


def _strings(df):
    return df.withColumns({"title": F.coalesce("title", F.lit("")), "content": F.coalesce("content", F.lit(""))})


@query(
    "edit_bursts_t1_t2",
    "edits",
    f"""{_SESSIONS} SELECT note_id, {iso_sql("first_ts")} AS burst_start, {iso_sql("last_ts")} AS last_edit, edits, version,
        coalesce(title, '') AS title, coalesce(content, '') AS content FROM saves""",
)
def _(d):
    saves = E.burst_saves(d.edits(), HOUR_MS)
    utc = {c: iso(F.col(c).cast("timestamp_ntz")) for c in ("burst_start", "last_edit")}
    return _strings(saves.drop("content_json").withColumns(utc))


@query(
    "latest_edit_t2_w4",
    "edits",
    """SELECT note_id, max(version) AS version, coalesce(arg_max(title, version) FILTER (title IS NOT NULL), '') AS title,
              arg_max(content, version) AS content FROM edits GROUP BY note_id""",
)
def _(d):
    return _strings(E.latest_per_note(d.edits())).drop("content_json")


@query(
    "effective_edits_t5",
    "",
    """WITH known AS (SELECT *, lag(content) OVER w AS old_content,
                   last_value(title IGNORE NULLS) OVER (PARTITION BY note_id ORDER BY version
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_title
                   FROM (SELECT 'u' || user_id AS note_id, event_id AS version, event_type AS content,
                                CASE WHEN event_id % 3 = 0 THEN event_type END AS title FROM events)
                   WINDOW w AS (PARTITION BY note_id ORDER BY version))
       SELECT note_id, version FROM known
       WHERE content IS DISTINCT FROM old_content OR (title IS NOT NULL AND title IS DISTINCT FROM old_title)""",
)
def _(d):
    """The event type is the content, so that equal ones often follow each other."""
    events = d.table("events").withColumn("props", F.col("event_type"))
    return E.effective_edits(d.as_edits(events)).select("note_id", "version")


@query(
    "effective_edits_base_t5",
    "",
    """WITH base AS (SELECT 'u' || c_custkey AS note_id, CASE WHEN c_custkey % 2 = 0 THEN 'click' END AS title,
                            CASE WHEN c_custkey % 3 = 0 THEN 'view' ELSE 'error' END AS content FROM customer),
       rows AS (SELECT 'u' || user_id AS note_id, event_id AS version, event_type AS content,
                       CASE WHEN event_id % 3 = 0 THEN event_type END AS title FROM events
                UNION ALL SELECT note_id, -1, content, title FROM base),
       known AS (SELECT *, last_value(content IGNORE NULLS) OVER w AS old_content, last_value(title IGNORE NULLS) OVER w AS old_title
                 FROM rows WINDOW w AS (PARTITION BY note_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT note_id, version FROM known WHERE version >= 0
         AND (content IS DISTINCT FROM old_content OR (title IS NOT NULL AND title IS DISTINCT FROM old_title))""",
)
def _(d):
    """Edits against the notes as they are stored: a first edit that repeats the stored note changes nothing."""
    events = d.table("events").withColumn("props", F.col("event_type"))
    key = F.col("c_custkey")
    base = d.table("customer").select(
        F.concat(F.lit("u"), key).alias("id"),
        F.when(key % 2 == 0, "click").alias("title"),
        F.when(key % 3 == 0, "view").otherwise("error").alias("content"),
        F.lit(None).cast("string").alias("content_json"),
    )
    return E.effective_edits(d.as_edits(events), base).select("note_id", "version")


def _run(writer, checkpoint):
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query(
    "stream_bursts_t1",
    "edits",
    f"""{_SESSIONS} SELECT note_id, {iso_sql("first_ts")} AS burst_start, edits, version, coalesce(title, '') AS title,
        coalesce(content, '') AS content FROM saves
        WHERE last_ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM edits) - INTERVAL 10 HOUR""",
)
def _(d):
    """The stream replayed to its end; bursts the watermark has not passed stay open."""
    out = scratch_path(d.spark, "bursts")
    saves = E.stream_saves(d.edit_stream(), "1 hour", "10 hours")
    _run(saves.writeStream.format("parquet").option("path", f"{out}/saves"), f"{out}/checkpoint")
    done = d.spark.read.schema(saves.schema).parquet(f"{out}/saves")
    start = iso(F.col("burst_start").cast("timestamp_ntz"))
    return _strings(done.drop("burst_end", "content_json").withColumn("burst_start", start))


@query(
    "stream_apply_t6",
    "edits notes_img",
    f"""{_SESSIONS}, closed AS (SELECT 'd' || substr(note_id, 2) AS id, arg_max(content, version) AS content,
             arg_max(title, version) FILTER (title IS NOT NULL) AS title FROM saves
             WHERE last_ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM edits) - INTERVAL 10 HOUR GROUP BY note_id),
        merged AS (SELECT n.*, c.title AS new_title, c.content AS new, to_base64(encode(c.content)) AS image,
                          n.deleted_at IS NULL AND c.id IS NOT NULL AS hit
                   FROM notes_img n LEFT JOIN closed c ON c.id = n.id)
        SELECT id, CASE WHEN hit THEN coalesce(new_title, title) ELSE title END AS title,
               CASE WHEN hit THEN new || chr(10) || '![i](data:image/png;base64,' || image || ')' ELSE plain END AS content,
               CASE WHEN hit THEN '2025-01-01 00:00:00.000000' ELSE {iso_sql("updated_at")} END AS updated,
               CASE WHEN hit THEN sha256('image/png:' || image) ELSE checksum END AS image
        FROM merged""",
)
def _(d):
    """Saves of the stream, each with an image, go to a change log, which is applied to
    the notes and their images; a saved note loses the image it had."""
    out = scratch_path(d.spark, "log")
    link = F.concat(F.lit("\n![i](data:image/png;base64,"), base64_line(F.col("content").cast("binary")), F.lit(")"))
    as_notes = d.edit_stream().withColumns(
        {"note_id": F.concat(F.lit("d"), F.substr("note_id", F.lit(2))), "content": F.concat("content", link)}
    )
    saves = E.stream_saves(as_notes, "1 hour", "10 hours")
    _run(E.log_saves(saves, out, NOW), f"{out}/checkpoint")
    log = d.spark.read.schema("id string, version bigint, title string, content string, content_json string")
    pictures = d.spark.read.schema(NOTE_IMAGES).parquet(f"{out}/images")
    notes, images = E.apply_log(d.notes(), d.images(), log.parquet(f"{out}/saves"), pictures, NOW)
    held = images.select(F.col("note_id").alias("id"), F.col("checksum").alias("image"))
    beside = notes.select("id").join(held, "id", "left")
    shown = hydrate(notes, images, beside)
    return shown.select("id", "title", "content", iso("updated_at").alias("updated"), "image")


@query(
    "save_gate_t3_t4",
    "edits",
    """, marked AS (SELECT *, version % 100 = 99 AS flush FROM edits),
    flagged AS (SELECT *, CASE WHEN NOT lag(flush) OVER w AND ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS starts
                FROM marked WINDOW w AS (PARTITION BY note_id ORDER BY ts, version)),
    parted AS (SELECT *, sum(starts) OVER (PARTITION BY note_id ORDER BY ts, version) AS part FROM flagged),
    parts AS (SELECT note_id, part, max(version) FILTER (NOT flush) AS newest, bool_or(flush) AS flushed,
                     max(ts) FILTER (NOT flush) AS last_ts FROM parted GROUP BY note_id, part),
    known AS (SELECT *, coalesce(max(newest) OVER (PARTITION BY note_id ORDER BY part
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS saved,
                     flushed OR lead(part) OVER (PARTITION BY note_id ORDER BY part) IS NOT NULL
                         OR last_ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM edits) - INTERVAL 10 HOUR AS ended FROM parts)
    SELECT p.note_id, max(p.version) AS version, coalesce(arg_max(title, p.version) FILTER (title IS NOT NULL), '') AS title,
           coalesce(arg_max(content, p.version), '') AS content
    FROM parted p JOIN known k ON k.note_id = p.note_id AND k.part = p.part
    WHERE NOT flush AND p.version > saved AND ended GROUP BY p.note_id, p.part""",
)
def _(d):
    """A pause or every hundredth event ends a save; stale versions are dropped."""
    flush = F.when(F.col("version") % 100 == 99, "flush").otherwise(F.col("kind"))
    out = scratch_path(d.spark, "gate")
    saves = E.gate_saves(d.edit_stream().withColumn("kind", flush), HOUR_MS, "10 hours")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = d.spark.conf.get(setting)
    d.spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _run(saves.writeStream.format("parquet").option("path", f"{out}/saves"), f"{out}/checkpoint")
    finally:
        d.spark.conf.set(setting, before)
    return _strings(d.spark.read.schema(E.SAVE_SCHEMA).parquet(f"{out}/saves").drop("content_json"))
