"""Queries over images of notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrove.functions.media import image_tokens
from inkgrove.operators import images as I
from inkgrove.operators.changes import save_notes
from inkgrove.registry.base import query
from inkgrove.registry.datasets import NOW

_ID = "sha256(id || checksum)"


@query(
    "tokenize_i1",
    "notes_img",
    f"SELECT id, plain || chr(10) || '![img](note-image://' || {_ID} || ')' AS content FROM notes_img",
)
def _(d):
    return I.tokenize_notes(d.notes_img()).select("id", "content")


@query(
    "image_rows_i1",
    "notes_img",
    f"""SELECT {_ID} AS id, id AS note_id, 'image/png' AS mime_type, payload AS data_base64, checksum FROM notes_img""",
)
def _(d):
    return I.embedded_images(d.notes_img(), NOW).drop("created_at")


@query("image_tokens_i2", "notes_img", f"SELECT id, {_ID} AS token FROM notes_img")
def _(d):
    return d.tokenized().select("id", F.explode(image_tokens(F.col("content"))).alias("token"))


@query(
    "hydrate_j3_i3",
    "notes_img",
    "SELECT id, plain || chr(10) || '![img]('|| CASE WHEN deleted_at IS NULL THEN 'data:image/png;base64,' || payload ELSE '' END"
    " || ')' AS content FROM notes_img",
)
def _(d):
    """Images of deleted notes are missing, so their tokens become empty."""
    live = d.images().join(
        d.notes().where("deleted_at is null").select(F.col("id").alias("note_id")), "note_id", "left_semi"
    )
    return I.hydrate(d.tokenized(), live).select("id", "content")


@query(
    "distinct_tokens_a9_u3",
    "notes_img",
    f"SELECT id, {_ID} || ',' || left(sha256(id), 16) AS tokens FROM notes_img",
)
def _(d):
    """Content and JSON share one token and the JSON repeats another."""
    token = F.concat(F.lit("note-image://"), F.left(F.sha2("id", 256), F.lit(16)), F.lit(" "))
    notes = d.tokenized().withColumn("content_json", F.concat(token, "content", token))
    other = notes.withColumn("content", F.concat("content", F.lit(" "), token))
    return other.select("id", F.array_join(I.note_tokens(), ",").alias("tokens"))


@query(
    "unreferenced_images_j4_u4",
    "notes_img",
    f"SELECT {_ID} AS id, id AS note_id FROM notes_img WHERE is_pinned",
)
def _(d):
    """Pinned notes lost their image link."""
    plain = F.when(F.col("is_pinned"), F.lit("")).otherwise(F.col("content"))
    return I.unreferenced_images(d.images(), d.tokenized().withColumn("content", plain))


@query(
    "collect_garbage_i4",
    "notes_img",
    f"SELECT {_ID} AS id, id AS note_id, payload AS data_base64 FROM notes_img WHERE NOT is_pinned",
)
def _(d):
    plain = F.when(F.col("is_pinned"), F.lit("")).otherwise(F.col("content"))
    kept = I.collect_garbage(d.images(), d.tokenized().withColumn("content", plain))
    return kept.select("id", "note_id", "data_base64")


@query(
    "orphan_images_i5",
    "notes_img",
    f"SELECT {_ID} AS id, id AS note_id FROM notes_img WHERE deleted_at IS NOT NULL",
)
def _(d):
    return I.orphan_images(d.images(), d.notes().where("deleted_at is null"))


@query(
    "upsert_images_a10_m14",
    "notes_img",
    f"""SELECT id AS note_id, checksum, CASE WHEN deleted_at IS NULL THEN {_ID} ELSE 'old-' || id END AS id FROM notes_img""",
)
def _(d):
    """Images of deleted notes are stored already, under other ids; new ones come twice."""
    images = d.images()
    gone = d.notes().where("deleted_at is not null").select(F.col("id").alias("note_id"))
    stored = images.join(gone, "note_id", "left_semi").withColumn("id", F.concat(F.lit("old-"), "note_id"))
    merged = I.upsert_images(stored.select(*images.columns), images.union(images))
    return merged.select("note_id", "checksum", "id")


@query(
    "save_images_i1_m14",
    "notes_img",
    f"""SELECT id, CASE WHEN deleted_at IS NULL THEN content ELSE plain END AS content,
               CASE WHEN library_id = 'de' THEN 'old-' || id WHEN deleted_at IS NULL THEN {_ID} ELSE '' END AS image
        FROM notes_img""",
)
def _(d):
    """Every note is saved with an image; those of one library are stored already, under other ids."""
    stored = d.images("de").withColumn("id", F.concat(F.lit("old-"), "note_id"))
    changes = d.notes_img().select("id", "content", "content_json")
    notes, kept = save_notes(d.notes(), stored, changes, NOW)
    held = kept.select(F.col("note_id").alias("id"), F.col("id").alias("image"))
    beside = notes.select("id").join(held, "id", "left")
    shown = I.hydrate(notes.select("id", "content", "content_json"), kept, beside)
    return shown.select("id", "content", F.coalesce("image", F.lit("")).alias("image"))


@query(
    "numbered_images_i6_w3",
    "notes_img",
    """SELECT id, 'b_img_001.png,b_img_003.jpg' AS files, plain || chr(10) || '![img](b_img_001.png) ![x](http://h/i.png)'
              || ' ![bad](data:image/gif;base64,AAA) ![two](b_img_003.jpg)' AS content,
              CAST(octet_length(encode(plain)) AS BIGINT) AS bytes FROM notes_img""",
)
def _(d):
    """The note's image, a web link, a payload that does not decode, a second image."""
    more = F.lit(" ![x](http://h/i.png) ![bad](data:image/gif;base64,AAA) ![two]( data:image/jpeg;base64,AAAA)")
    bodies = d.notes_img().select("id", F.concat("content", more).alias("content"), F.lit("b").alias("base"))
    done = I.extract_images(bodies, "content", "base")
    files = F.filter("images", lambda x: x["data"].isNotNull())
    return done.select(
        "id",
        F.array_join(F.transform(files, lambda x: x["file"]), ",").alias("files"),
        "content",
        F.octet_length(files[0]["data"]).cast("bigint").alias("bytes"),
    )
