"""Images of notes.

Payloads are large, so they are moved as rarely as possible: tokenizing and
checksums happen inside the note's row, and only notes that hold tokens take
part in the join that puts payloads back.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.functions.media import (
    TOKEN_PREFIX,
    checksum,
    data_urls,
    extension_of_mime,
    image_id,
    image_tokens,
    packed,
    unpacked,
    url_mime,
    url_payload,
)
from inkgrove.functions.patterns import DATA_URL, IMAGE_LINK, IMAGE_TOKEN, PY_SPACE
from inkgrove.functions.splice import let, matches, put_back, substitute
from inkgrove.functions.text import blank
from inkgrove.plans.lineage import round_stored


def _token(note_id: Column, url: Column) -> Column:
    return F.concat(F.lit(TOKEN_PREFIX), image_id(note_id, checksum(url_mime(url), url_payload(url))))


def _tokenize(note_id: Column, text: Column) -> Column:
    swapped = substitute(text, DATA_URL, lambda url: _token(note_id, url))
    return F.when(text.contains(";base64,"), swapped).otherwise(text)


def tokenize_notes(notes: DataFrame) -> DataFrame:
    """Notes with every data URL replaced by ``note-image://id``."""
    return notes.withColumns(
        {
            "content": _tokenize(F.col("id"), F.col("content")),
            "content_json": _tokenize(F.col("id"), F.col("content_json")),
        }
    )


def embedded_images(notes: DataFrame, now: dt.datetime) -> DataFrame:
    """One ``note_images`` row per note and distinct payload.

    Repeats inside a note collapse in its own row, so there is no shuffle.
    """
    urls = F.concat(data_urls(F.col("content")), data_urls(F.col("content_json")))
    even = F.array_distinct(F.transform(urls, lambda u: F.struct(url_mime(u).alias("mime"), url_payload(u).alias("data"))))
    holders = notes.where(F.col("content").contains(";base64,") | F.col("content_json").contains(";base64,"))
    rows = holders.select(F.col("id").alias("note_id"), F.explode(even).alias("image"))
    digest = checksum(F.col("image.mime"), F.col("image.data"))
    return rows.select(
        image_id(F.col("note_id"), digest).alias("id"),
        "note_id",
        F.col("image.mime").alias("mime_type"),
        F.col("image.data").alias("data_base64"),
        digest.alias("checksum"),
        F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz").alias("created_at"),
    )


def note_tokens() -> Column:
    """Distinct tokens of content and JSON, in order."""
    return F.array_union(image_tokens(F.col("content")), image_tokens(F.col("content_json")))


def referenced_images(notes: DataFrame) -> DataFrame:
    """(note_id, image_id) for every token a note mentions."""
    holders = notes.where(F.col("content").contains(TOKEN_PREFIX) | F.col("content_json").contains(TOKEN_PREFIX))
    return holders.select(F.col("id").alias("note_id"), F.explode(note_tokens()).alias("image_id"))


def hydrate(notes: DataFrame, images: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """Tokens replaced by their data URLs; unknown ids become ''.

    Each note asks for each image once.  Notes without tokens skip the joins.  An image goes
    straight to the note it belongs to; only tokens of another note's image, whose ids are
    found and stored first, look for it by its id.

    ``beside`` (id and other columns) joins the notes, and leaves out those it does not have,
    before the images are in place: what joins after would deal these out once more.
    """
    holds = F.coalesce(
        F.col("content").contains(TOKEN_PREFIX) | blank(F.col("content_json")).contains(TOKEN_PREFIX), F.lit(False)
    )
    image = F.struct(F.col("id").alias("image_id"), "mime_type", packed(F.col("data_base64")).alias("data")).alias("__image")
    own = images.where("id IS NOT NULL AND note_id IS NOT NULL").select(F.col("note_id").alias("__note"), image)
    keys = images.select("note_id", F.col("id").alias("image_id"))
    foreign = round_stored(referenced_images(notes).join(keys, ["note_id", "image_id"], "left_anti"))
    payloads = own
    if not foreign.isEmpty():
        if beside is not None:
            foreign = foreign.join(beside.select(F.col("id").alias("note_id")), "note_id", "left_semi")
        found = images.select(F.col("id").alias("image_id"), image)
        payloads = own.unionByName(foreign.withColumnRenamed("note_id", "__note").join(found, "image_id").select("__note", "__image"))

    def entry(x: Column) -> Column:
        return F.struct(x["image_id"], F.concat(F.lit("data:"), x["mime_type"], F.lit(";base64,"), unpacked(x["data"])))

    # A map per note is no larger than the note it is written into.
    entries = F.transform(F.collect_list("__image"), entry)
    urls = payloads.groupBy("__note").agg(F.map_from_entries(entries).alias("__urls"))
    placed = notes if beside is None else notes.join(beside, "id")
    joined = placed.where(holds).join(urls, F.col("id") == F.col("__note"), "left")

    def fill(text: Column) -> Column:
        ids = matches(text, IMAGE_TOKEN, 1)
        return put_back(text, IMAGE_TOKEN, F.transform(ids, lambda i: F.coalesce(F.col("__urls")[i], F.lit(""))))

    filled = joined.withColumns({"content": fill(F.col("content")), "content_json": fill(F.col("content_json"))})
    return placed.where(~holds).unionByName(filled.select(*placed.columns))


def unreferenced_images(images: DataFrame, notes: DataFrame) -> DataFrame:
    """Images their note no longer mentions.

    Images of notes outside ``notes`` are not judged.  Payloads stay out of the
    joins.
    """
    keys = images.select("id", "note_id")
    judged = keys.join(notes.select(F.col("id").alias("note_id")), "note_id", "left_semi")
    used = referenced_images(notes).withColumnRenamed("image_id", "id")
    return judged.join(used, ["note_id", "id"], "left_anti").select("id", "note_id")


def _pack(images: DataFrame) -> DataFrame:
    return images.withColumn("data_base64", packed(F.col("data_base64")))


def _unpack(images: DataFrame) -> DataFrame:
    return images.withColumn("data_base64", unpacked(F.col("data_base64")))


def drop_images(images: DataFrame, gone: DataFrame, deal: bool = False) -> DataFrame:
    """The images without those of ``gone`` (id, note_id), a narrow table.

    They meet by their note alone, as images meet their notes: payloads that are dealt out
    stay where their note's other rows go.  ``deal`` puts them there in any case.
    """
    of_note = gone.groupBy(F.col("note_id").alias("__note")).agg(F.collect_set("id").alias("__gone"))
    rows = _pack(images).repartition("note_id") if deal else _pack(images)
    marked = rows.join(of_note, F.col("note_id") == F.col("__note"), "left")
    return _unpack(marked.where(~F.coalesce(F.array_contains("__gone", F.col("id")), F.lit(False)))).select(*images.columns)


def collect_garbage(images: DataFrame, notes: DataFrame) -> DataFrame:
    """I4: the images that stay.  What goes is found and stored first, by ids alone."""
    return drop_images(images, round_stored(unreferenced_images(images, notes)))


def orphan_images(images: DataFrame, notes: DataFrame) -> DataFrame:
    """Images whose note does not exist."""
    return images.join(notes.select(F.col("id").alias("note_id")), "note_id", "left_anti").select("id", "note_id")


def fresh_images(stored: DataFrame, new: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row per (note_id, checksum) of ``new`` that is not stored.

    Payloads are dealt out once, by their note.  With ``wanted`` (id, note_id) only those of it.
    """
    dealt = _pack(new).repartition("note_id")
    if wanted is not None:
        of_note = wanted.groupBy(F.col("note_id").alias("__of")).agg(F.collect_set("id").alias("__wanted"))
        dealt = dealt.join(of_note, F.col("note_id") == F.col("__of")).where(F.array_contains("__wanted", F.col("id")))
    held = stored.groupBy(F.col("note_id").alias("__note")).agg(F.collect_set("checksum").alias("__held"))
    once = dealt.select(*new.columns).dropDuplicates(["note_id", "checksum"])
    marked = once.join(held, F.col("note_id") == F.col("__note"), "left")
    return _unpack(marked.where(~F.coalesce(F.array_contains("__held", F.col("checksum")), F.lit(False)))).select(*new.columns)


def upsert_images(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (note_id, checksum); a stored row wins."""
    return stored.unionByName(fresh_images(stored, new).select(*stored.columns))


def rename_tokens(notes: DataFrame, images: DataFrame) -> DataFrame:
    """I1 with M14: tokens of images that are stored under another id, renamed to it.

    ``tokenize_notes`` computes ids; an image stored before keeps the one it has.  Texts of
    notes without such an image stay as they are.
    """
    computed = image_id(F.col("note_id"), F.col("checksum"))
    other = images.where(F.col("id") != computed).groupBy("note_id", computed.alias("image_id"))
    # Ids alone: the texts are read once, where they are rewritten.
    names = (
        other.agg(F.min("id").alias("kept"))
        .groupBy(F.col("note_id").alias("__note"))
        .agg(F.map_from_entries(F.collect_list(F.struct("image_id", "kept"))).alias("__names"))
    )
    joined = notes.join(names, F.col("id") == F.col("__note"), "left")

    def rename(text: Column) -> Column:
        tokens = F.transform(
            matches(text, IMAGE_TOKEN, 1), lambda i: F.concat(F.lit(TOKEN_PREFIX), F.coalesce(F.col("__names")[i], i))
        )
        return F.when(F.col("__names").isNotNull(), put_back(text, IMAGE_TOKEN, tokens)).otherwise(text)

    renamed = {c: rename(F.col(c)) for c in ("content", "content_json")}
    return joined.withColumns(renamed).select(*notes.columns)


# -- numbered files ----------------------------------------------------------


_EMBEDDED = f"(?s)^!\\[[^\\]]*\\]\\({PY_SPACE}*({DATA_URL})"


def _embedded(link: Column) -> Column:
    """What one image link holds; ``payload`` is NULL unless it is a data URL."""
    # Padding ends the payload; what follows it is ignored.
    return let(
        F.when(link.contains(";base64,"), F.regexp_extract(link, _EMBEDDED, 1)),
        lambda url: F.struct(
            link.alias("link"),
            F.when(url != "", url_mime(url)).alias("mime"),
            F.when(url != "", F.regexp_extract(url_payload(url), "^[A-Za-z0-9+/]*={0,2}", 0)).alias("payload"),
        ),
    )


def numbered_images(text: Column, base: Column) -> Column:
    """An array with one entry per image link.

    Entries of embedded images carry ``file`` and, when the payload decodes,
    ``data``; a bad payload still uses up its number.
    """
    found = F.transform(matches(text, IMAGE_LINK), _embedded)

    def number(x: Column) -> Column:
        name = F.concat(
            base,
            F.lit("_img_"),
            F.when(x["n"] < 1000, F.lpad(x["n"].cast("string"), 3, "0")).otherwise(x["n"].cast("string")),
            F.lit("."),
            extension_of_mime(x["mime"]),
        )
        whole = F.length(x["payload"]) % 4 == 0
        return F.struct(
            x["link"].alias("link"),
            F.when(x["payload"].isNotNull(), name).alias("file"),
            F.when(whole, F.try_to_binary(x["payload"], F.lit("base64"))).alias("data"),
        )

    def count(acc: Column, x: Column) -> Column:
        n = acc["n"] + F.when(x["payload"].isNotNull(), 1).otherwise(0)
        entry = F.struct(*[x[k].alias(k) for k in ("link", "mime", "payload")], n.alias("n"))
        return F.struct(n.alias("n"), F.array_append(acc["out"], entry).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.array().cast(_COUNTED).alias("out"))
    counted = F.aggregate(found, start, count, lambda acc: acc["out"])
    return F.transform(counted, number)


_COUNTED = "array<struct<link:string,mime:string,payload:string,n:int>>"


def extract_images(bodies: DataFrame, text: str, base: str) -> DataFrame:
    """Add ``images`` (see ``numbered_images``) and rewrite links in ``text``."""
    numbered = bodies.withColumn("images", numbered_images(F.col(text), F.col(base)))
    links = F.transform(
        F.col("images"),
        lambda x: F.when(
            x["data"].isNotNull(), F.concat(F.regexp_extract(x["link"], r"^!\[[^\]]*\]\(", 0), x["file"], F.lit(")"))
        ).otherwise(x["link"]),
    )
    return numbered.withColumn(text, put_back(F.col(text), IMAGE_LINK, links))
