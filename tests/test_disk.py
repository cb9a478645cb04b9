"""What is dealt out on the way to a result, and what stays on disk."""

import re

import pytest
from helpers import NOW, images, notes
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)

from inkgrove.functions.media import packed, unpacked
from inkgrove.operators import images as I
from inkgrove.operators.changes import save_notes
from inkgrove.plans.lineage import cut, round_stored
from inkgrove.registry.base import QUERIES

SF = "/root/testdata/sf0.001"
PAYLOAD = {"data_base64", "__image", "payload"}


@pytest.fixture
def joins_deal(spark):
    """Joins as on large tables: nothing is broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def dealt(df) -> list[set[str]]:
    """The columns of each exchange of a frame's plan."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    rows = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]$", text, flags=re.M)
    return [set(re.findall(r"(\w+)#\d+", r)) for r in rows]


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toList()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


@pytest.mark.parametrize("store", [round_stored, cut])
def test_a_stored_table_leaves_no_shuffle_files(spark, joins_deal, store):
    before = shuffle_files(spark)
    counted = store(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert not shuffle_files(spark) - before
    assert counted.agg(F.sum("n")).first()[0] == 1000


def test_saved_texts_and_payloads_are_dealt_out_once(spark, joins_deal):
    """Each by its note: texts with tokens and those without, payloads that were stored and those of the changes."""
    moved = dealt(QUERIES["save_images_i1_m14"](spark, SF))
    assert sum("content" in columns for columns in moved) == 2
    assert sum(bool(PAYLOAD & columns) for columns in moved) == 2
    assert not [columns for columns in moved if "content" in columns and PAYLOAD & columns]


def test_what_saves_keep_and_drop(spark, joins_deal):
    """A stored image stays as long as its note mentions it; one of a note that is not saved stays in any case."""
    url = "data:image/png;base64,"
    table = notes(
        spark,
        [
            {"content": f"{I.TOKEN_PREFIX}old0 {I.TOKEN_PREFIX}gone"},
            {"content": "no image"},
            {"content": f"{I.TOKEN_PREFIX}far", "deleted_at": NOW},
            {"content": ""},
        ],
    )
    rows = [("old0", "n0", "AAAA"), ("gone", "n0", "BBBB"), ("kept", "n1", "CCCC"), ("far", "n2", "DDDD"), ("loose", "n3", "EEEE")]
    stored = images(spark, [(i, n, "image/png", data) for i, n, data in rows])
    edits = [("n0", f"a {url}AAAA b {url}FFFF c {url}FFFF"), ("n2", f"{url}GGGG"), ("n3", "plain"), ("n9", f"{url}HHHH")]
    changes = spark.createDataFrame([(*e, None) for e in edits], "id string, content string, content_json string")
    after, left = save_notes(table, stored, changes, NOW)
    kept = sorted((r.note_id, r.data_base64, len(r.id) == 64) for r in left.collect())
    assert kept == [("n0", "AAAA", False), ("n0", "FFFF", True), ("n1", "CCCC", False), ("n2", "DDDD", False)]
    shown = {r.id: r.content for r in I.hydrate(after, left).collect()}
    assert shown == {"n0": f"a {url}AAAA b {url}FFFF c {url}FFFF", "n1": "no image", "n2": f"{url}DDDD", "n3": "plain"}
    # What stands beside a note joins it before the images are in place, and leaves the others out.
    beside = spark.createDataFrame([("n0", 1), ("n2", 2), ("n2", 3)], "id string, k int")
    both = sorted((r.id, r.k, r.content) for r in I.hydrate(after, left, beside).collect())
    assert both == [("n0", 1, shown["n0"]), ("n2", 2, shown["n2"]), ("n2", 3, shown["n2"])]


def test_payloads_come_back_as_they_were(apply):
    """Also those that are no proper base64: bad length, bits that bytes do not hold, line ends, padding inside."""
    texts = ["", "AAAA", "QQ==", "QR==", "QQ", "QQ=", "A", "QQ==QQ==", "AA\r\nAA", "AAAA\n", "+/+/", "é", "\x01", None]
    assert apply(lambda c: unpacked(packed(c)), texts) == texts
    assert apply(lambda c: F.length(packed(c)), ["AAAA", "A" * 400]) == [4, 301]


def test_an_import_deals_out_no_image(spark, joins_deal):
    """Image files are read where their documents are; texts with images in place meet no folders."""
    moved = dealt(QUERIES["import_tree_s5_j8_j9"](spark, SF))
    assert not [columns for columns in moved if {"images", "urls", "url", "content"} & columns]
    assert sum("text" in columns for columns in moved) == 2  # documents with images and those without


def test_image_reader(tmp_path, monkeypatch):
    """Every document gets the files it shows, in batches of bounded size; what can't be read is left out."""
    import pyarrow as pa

    from inkgrove.sources import files as S

    monkeypatch.setattr(S, "_BATCH_BYTES", 100)
    monkeypatch.setattr(S, "_RECENT", 2)
    for name in "abcd":
        (tmp_path / f"{name}.png").write_bytes(name.encode() * 40)
    (tmp_path / "dir.png").mkdir()
    at = {n: f"{tmp_path}/{n}.png" for n in ("a", "b", "c", "d", "dir", "none")}
    shown = [["a", "b", "a"], None, [], ["dir", "none", None], ["c", "d", "a"], ["a", "b", "c", "d"], ["a"], [None]]
    targets = [None if names is None else [n and at[n] for n in names] for names in shown]
    batch = pa.RecordBatch.from_pydict({"path": [f"{i}" for i in range(8)], "text": list("ABCDEFGH"), "targets": targets})
    parts = list(S._image_reader(str(tmp_path))(iter([batch, batch.slice(6)])))
    assert [p.num_rows for p in parts] == [5, 1, 2, 2]
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["text"] for r in rows] == list("ABCDEFGHGH")
    for r in rows:
        names = dict.fromkeys(n for n in shown["ABCDEFGH".index(r["text"])] or () if n in ("a", "b", "c", "d"))
        assert [(x["path"], x["data"]) for x in r["images"]] == [(at[n], n.encode() * 40) for n in names]


def test_notes_beside_what_joins_them(spark, tmp_path):
    """An inner join by folder, before images are in place; shown beside the notes as they are."""
    from inkgrove.schemas import FOLDERS
    from inkgrove.sources import files as S

    for d in ("x", "y"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "n.md").write_text(f"{d} ![i](../p.png)")
        (tmp_path / d / "t.txt").write_text(d)
    (tmp_path / "p.png").write_bytes(b"pix")
    got = S.import_directory(spark, str(tmp_path), spark.createDataFrame([], FOLDERS), NOW)
    names = got.folders.where("name <> 'y'").select(F.col("id").alias("folder_id"), F.col("name").alias("folder"))
    want = got.notes.join(names, "folder_id")
    both = got.notes_beside(names.union(names.where("folder = 'x'")))
    assert set(both.columns) == set(want.columns)
    rows = sorted(tuple(r) for r in want.select("id", "title", "content", "folder").collect())
    assert [r[1:] for r in sorted(rows, key=lambda r: r[1])] == [("n", "# n\n\nx ![i](data:image/png;base64,cGl4)", "x"), ("t", "# t\n\nx", "x")]
    assert sorted(tuple(r) for r in both.select("id", "title", "content", "folder").collect()) == sorted(rows * 2)


def test_an_export_deals_out_texts_by_their_note_alone(spark, joins_deal):
    """Not by their folder; names of all notes and what a token of another note shows are settled by ids."""
    moved = dealt(QUERIES["export_all_s11_s12"](spark, SF))
    assert sum("content" in columns for columns in moved) == 2  # notes with tokens and those without
    assert sum(bool(PAYLOAD & columns) or "buf" in columns and "__note" in columns for columns in moved) == 1


def test_an_export_in_rounds_is_the_whole_export(spark, joins_deal, tmp_path, monkeypatch):
    """Whatever the rounds: the same names, files and report."""
    from helpers import folders

    from inkgrove.operators.folders import folder_paths
    from inkgrove.sources import export as E

    tree = folders(spark, [("top", None, 1), ("kid", "top", 2)])
    rows = [{"folder_id": ("top", "kid", "nowhere")[i % 3], "title": "same", "content": f"{i} ![i](note-image://i{i % 5})"} for i in range(30)]
    table = notes(spark, [*rows, {"folder_id": "kid", "title": "same", "content": "plain"}])
    stored = images(spark, [(f"i{i}", f"n{i}", "image/png", "AAAA") for i in range(4)])
    scope = E.all_scope(table, tree, folder_paths(tree))
    rounds = []
    write = E.write_files
    monkeypatch.setattr(E, "write_files", lambda manifest, out: rounds.append(out) or write(manifest, out))
    got = {}
    for size in (1 << 30, 50):
        out = tmp_path / str(size)
        report = E.export_files(scope, "md", str(out), stored, round_bytes=size)
        assert sorted((r.note_id, r.path.removeprefix(f"{out}/"), r.ok) for r in report.collect()) == sorted(
            (r.note_id, f"{r.directory}/{r.file_name}", True) for r in E.export_manifest(scope, "md", stored).collect()
        )
        files = {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file()}
        got[size] = files
        assert E.export_summary(report, "x", str(out)).first()["count"] == 21
    assert got[50] == got[1 << 30] and len(got[50]) == 21 + 16
    assert rounds.count(str(tmp_path / "50")) > 3 and rounds.count(str(tmp_path / str(1 << 30))) == 1


def test_applied_saves_deal_out_texts_and_payloads_once(spark, joins_deal):
    """Texts with tokens and those without, payloads that were stored and those of the log; never both in one row."""
    moved = dealt(QUERIES["stream_apply_t6"](spark, SF))
    assert sum("content" in columns for columns in moved) == 2
    assert sum(bool(PAYLOAD & columns) for columns in moved) == 2
    assert not [columns for columns in moved if "content" in columns and PAYLOAD & columns]
