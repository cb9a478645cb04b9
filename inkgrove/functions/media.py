"""Images inside notes: data URLs, tokens, checksums, file types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgrove.functions.patterns import DATA_URL, IMAGE_TOKEN
from inkgrove.functions.splice import drop_all, let, matches
from inkgrove.functions.text import blank

TOKEN_PREFIX = "note-image://"

# --- fixed values: image types
MIME_MARKS = [("png", "png"), ("jpeg", "jpg"), ("jpg", "jpg"), ("gif", "gif"), ("webp", "webp"), ("bmp", "bmp"), ("svg", "svg")]
MIME_OF_EXTENSION = {
    "png": "png",
    "jpg": "jpeg",
    "jpeg": "jpeg",
    "gif": "gif",
    "webp": "webp",
    "bmp": "bmp",
    "svg": "svg+xml",
}
# --- end of fixed values


def extension_of_mime(mime: Column) -> Column:
    """file extension by substring, ``png`` when nothing fits."""
    mime = F.lower(blank(mime))
    found = [F.when(mime.contains(mark), F.lit(ext)) for mark, ext in MIME_MARKS]
    return F.coalesce(*found, F.lit("png"))


def mime_of_extension(extension: Column) -> Column:
    """image subtype of a file extension; NULL when it is no image."""
    pairs = [F.lit(x) for pair in MIME_OF_EXTENSION.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.lower(extension))


def data_urls(text: Column) -> Column:
    return matches(blank(text), DATA_URL)


def url_mime(url: Column) -> Column:
    return F.regexp_extract(url, "^data:([^;]+);", 1)


def url_payload(url: Column) -> Column:
    """The base64 text without line ends."""
    return drop_all(F.substring_index(url, ";base64,", -1), "\r\n")


def checksum(mime: Column, payload: Column) -> Column:
    """F14."""
    return F.sha2(F.concat(mime, F.lit(":"), drop_all(payload, "\r\n")), 256)


def image_id(note_id: Column, digest: Column) -> Column:
    """Deterministic id, so that a retried task writes the same row."""
    return F.sha2(F.concat(note_id, digest), 256)


def image_tokens(text: Column) -> Column:
    """Ids of all image tokens, in order."""
    return matches(blank(text), IMAGE_TOKEN, 1)


def base64_line(data: Column) -> Column:
    """Base64 without line breaks, whatever the session setting."""
    return drop_all(F.base64(data), "\r\n")


_RAW, _TEXT = b"\x01", b"\x00"


def packed(payload: Column) -> Column:
    """A payload as its bytes, a quarter less to deal out; one that bytes would not give back stays as it is."""

    def pack(raw: Column) -> Column:
        same = F.coalesce(base64_line(raw) == payload, F.lit(False))
        return F.when(same, F.concat(F.lit(_RAW), raw)).otherwise(F.concat(F.lit(_TEXT), payload.cast("binary")))

    return let(F.try_to_binary(payload, F.lit("base64")), pack)


def unpacked(data: Column) -> Column:
    """The payload that ``packed`` was given."""
    rest = F.substring(data, 2, (1 << 31) - 1)
    return F.when(F.substring(data, 1, 1) == F.lit(_RAW), base64_line(rest)).otherwise(rest.cast("string"))
