"""Tokens, payloads and numbered files."""

import base64
import hashlib

from helpers import DAY, NOW, images, notes
from pyspark.sql import functions as F

from inkgrove.operators import blocks as B
from inkgrove.operators import images as I


def url(data, mime="image/png"):
    return f"data:{mime};base64,{data}"


def token(note, data, mime="image/png"):
    digest = hashlib.sha256(f"{mime}:{data}".encode()).hexdigest()
    return "note-image://" + hashlib.sha256((note + digest).encode()).hexdigest()


def test_tokenize_and_hydrate_round_trip(spark):
    content = f"a ![x]({url('AAAA')}) b ![y]({url('AAAABBBB')}) {url('AAAA')}"
    table = notes(
        spark,
        [
            {"content": content, "content_json": f'{{"src":"{url("AAAA")}"}}'},
            {"content": f"![w]({url('AA' + chr(13) + chr(10) + 'AA')})"},
            {"content": "none", "content_json": None},
        ],
    )
    saved = {r.id: r for r in I.tokenize_notes(table).collect()}
    assert saved["n0"].content == f"a ![x]({token('n0', 'AAAA')}) b ![y]({token('n0', 'AAAABBBB')}) {token('n0', 'AAAA')}"
    assert saved["n0"].content_json == f'{{"src":"{token("n0", "AAAA")}"}}'
    # Line ends in a payload do not change its checksum.
    assert saved["n1"].content == f"![w]({token('n1', 'AAAA')})"
    assert saved["n2"].content == "none" and saved["n2"].content_json is None
    rows = I.embedded_images(table, NOW)
    assert sorted((r.note_id, r.data_base64) for r in rows.collect()) == [
        ("n0", "AAAA"),
        ("n0", "AAAABBBB"),
        ("n1", "AAAA"),
    ]
    back = {r.id: r.content for r in I.hydrate(I.tokenize_notes(table), rows).collect()}
    assert back["n0"] == content and back["n2"] == "none"


def test_unknown_tokens_become_empty(spark):
    table = notes(spark, [{"content": "x note-image://nope y", "content_json": "note-image://i1"}])
    row = I.hydrate(table, images(spark, [("i1", "n0", "image/gif", "QQ==")])).first()
    assert (row.content, row.content_json) == ("x  y", url("QQ==", "image/gif"))


def test_garbage_and_orphans(spark):
    table = notes(spark, [{"content": "note-image://i1"}, {"content_json": "note-image://i3"}])
    stored = images(
        spark,
        [("i1", "n0", "m", "a"), ("i2", "n0", "m", "b"), ("i3", "n1", "m", "c"), ("i4", "n1", "m", "d"), ("i5", "zz", "m", "e")],
    )
    assert sorted(r.id for r in I.unreferenced_images(stored, table).collect()) == ["i2", "i4"]
    assert sorted(r.id for r in I.collect_garbage(stored, table).collect()) == ["i1", "i3", "i5"]
    assert [r.id for r in I.orphan_images(stored, table).collect()] == ["i5"]


def test_numbered_images(spark):
    data = base64.b64encode(b"hello").decode()
    text = f"![a]({url(data)}) ![web](http://x/a.png) ![bad]({url('AAA')}) ![c]( {url(data, 'image/svg+xml')} \"t\") ![]({url('QQ==QQ')})"
    df = spark.createDataFrame([(text, "b")], "body string, base string")
    row = I.extract_images(df, "body", "base").first()
    assert row.body == (
        f"![a](b_img_001.png) ![web](http://x/a.png) ![bad]({url('AAA')}) ![c](b_img_003.svg) ![](b_img_004.png)"
    )
    held = [(x["file"], bytes(x["data"])) for x in row.images if x["data"] is not None]
    assert held == [("b_img_001.png", b"hello"), ("b_img_003.svg", b"hello"), ("b_img_004.png", b"A")]


MARKDOWN = """# T *x*
#### deep
#no
| a | b |
|---|:---:|
| 1 | **2** |
x | y
text
  - item
3. three
![alt](u.png)
![](u.png) tail

| p | q |
not a table
a | b | c
--- | --- | ---
| d"""


def test_blocks_and_tables(spark):
    table = notes(spark, [{"content": MARKDOWN}, {"content": "\n"}, {"content": ""}])
    got = [tuple(r)[1:] for r in B.note_blocks(table).where("note_id = 'n0'").orderBy("pos").collect()]
    assert got == [
        (0, "heading", 1, "T x"),
        (1, "paragraph", 0, "#### deep"),
        (2, "paragraph", 0, "#no"),
        (3, "table", 0, ""),
        (7, "paragraph", 0, "text"),
        (8, "bullet", 0, "item"),
        (9, "numbered", 0, "three"),
        (10, "image", 0, "alt"),
        (11, "paragraph", 0, "![](u.png) tail"),
        (12, "blank", 0, ""),
        (13, "paragraph", 0, "| p | q |"),
        (14, "paragraph", 0, "not a table"),
        (15, "table", 0, ""),
    ]
    assert B.note_blocks(table).where("note_id <> 'n0'").count() == 1
    cells = [tuple(r)[1:] for r in B.note_tables(table).orderBy("table_no", "row_no").collect()]
    assert cells == [
        (1, 0, ["a", "b"]),
        (1, 1, ["1", "2"]),
        (1, 2, ["x", "y"]),
        (2, 0, ["a", "b", "c"]),
        (2, 1, ["d"]),
    ]


def test_images_go_straight_to_their_note(spark):
    """A payload is dealt out once, by its note, unless a token names another note's image."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = notes(spark, [{"content": "![a](note-image://i0)"}, {"content": "![b](note-image://i1) ![c](note-image://none)"}])
        rows = images(spark, [("i0", "n0", "image/png", "AAAA"), ("i1", "n1", "image/png", "BBBB"), ("i2", "n1", "image/png", "CCCC")])
        own = I.hydrate(table.where("id = 'n0'"), rows)
        text = own._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(image_id" not in text and text.count("Exchange hashpartitioning") == 2
        assert own.first().content == "![a](data:image/png;base64,AAAA)"
        shared = table.withColumn("content", F.concat("content", F.lit(" ![d](note-image://i1)")))
        got = {r.id: r.content for r in I.hydrate(shared, rows).collect()}
        assert got["n0"] == "![a](data:image/png;base64,AAAA) ![d](data:image/png;base64,BBBB)"
        assert got["n1"] == "![b](data:image/png;base64,BBBB) ![c]() ![d](data:image/png;base64,BBBB)"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
