"""Edit bursts, as tables and as streams."""

import datetime as dt
import random

import pytest
from helpers import NOW, ids, images, notes
from pyspark.sql import functions as F

from inkgrove.plans import ordered
from inkgrove.schemas import NOTE_EDITS
from inkgrove.streaming import edits as E

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def edits(spark, rows):
    """Rows are (note, milliseconds, version, kind, title, content)."""
    made = [(n, START + dt.timedelta(milliseconds=ms), v, k, t, c, None) for n, ms, v, k, t, c in rows]
    return spark.createDataFrame(made, NOTE_EDITS)


def bursts_rule(rows, gap):
    out = []
    for note in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == note), key=lambda r: r[1])
        groups = [[mine[0]]]
        for row in mine[1:]:
            if row[1] - groups[-1][-1][1] <= gap:
                groups[-1].append(row)
            else:
                groups.append([row])
        for group in groups:
            newest = {}
            for row in sorted(group, key=lambda r: r[2]):
                newest.update({i: row[i] for i in (4, 5) if row[i] is not None})
            out.append((note, len(group), max(r[2] for r in group), newest.get(4), newest.get(5)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_bursts(spark, monkeypatch, seed):
    # Small blocks, so that bursts cross their borders.
    monkeypatch.setattr(E, "_BLOCK", 3)
    rng = random.Random(seed)
    rows = [
        (rng.choice("ab"), rng.randrange(-60_000, 60_000), v, "edit", rng.choice([None, f"t{v}"]), rng.choice([None, f"c{v}"]))
        for v in range(150)
    ]
    rows += [("edge", 0, 1000, "edit", None, "x"), ("edge", 1500, 1001, "edit", "t", None), ("edge", 3001, 1002, "edit", None, "y")]
    got = E.burst_saves(edits(spark, rows), 1500)
    assert sorted(((r.note_id, r.edits, r.version, r.title, r.content) for r in got.collect()), key=repr) == bursts_rule(rows, 1500)


def test_a_title_survives_later_edits(spark):
    rows = [("a", 0, 1, "edit", "t", "c"), ("a", 10, 2, "edit", None, "d")]
    row = E.latest_per_note(edits(spark, rows)).first()
    assert (row.version, row.title, row.content) == (2, "t", "d")


def test_edits_without_effect(spark):
    rows = [("a", 0, v, "edit", None if v % 3 else f"t{v // 9}", f"c{v // 2}") for v in range(40)]
    rows += [("b", 0, 1, "edit", None, None), ("b", 0, 2, "edit", None, "x"), ("b", 0, 9, "edit", None, None), ("b", 0, 17, "edit", None, "x")]
    want, known = [], {}
    for note, _, v, _, title, content in sorted(rows, key=lambda r: (r[0], r[2])):
        new = {k: x for k, x in ((4, title), (5, content)) if x is not None}
        if any(known.get((note, k)) != x for k, x in new.items()):
            want.append((note, v))
        known.update({(note, k): x for k, x in new.items()})
    got = E.effective_edits(edits(spark, rows))
    assert sorted((r.note_id, r.version) for r in got.collect()) == want


def test_edits_against_the_stored_notes(spark):
    """The stored note is compared with the first edits; other notes' rows play no part."""
    stored = notes(spark, [{"id": "a", "title": "t", "content": "c"}, {"id": "b", "content": "x"}, {"id": "unedited"}])
    rows = [
        ("a", 0, 1, "edit", "t", "c"), ("a", 0, 2, "edit", None, "c"), ("a", 0, 3, "edit", "u", None), ("a", 0, 4, "edit", "u", "c"),
        ("b", 0, 1, "edit", None, "y"), ("b", 0, 2, "edit", None, "y"), ("new", 0, 1, "edit", "t", None), ("new", 0, 2, "edit", None, None),
    ]
    got = sorted((r.note_id, r.version) for r in E.effective_edits(edits(spark, rows), stored).collect())
    assert got == [("a", 3), ("b", 1), ("new", 1)]
    assert E.effective_edits(edits(spark, []), stored).collect() == []


def test_a_hot_note_is_scanned_in_slices(spark, monkeypatch):
    """A note with most of the edits covers several slices, and little is handed on."""
    seen = []
    keep = ordered.carried_values

    def watched(placed, keys, order, values):
        carried = keep(placed, keys, order, values)
        slices = placed.where("note_id = 'hot'").select("__slice").distinct().count()
        seen.append((slices, carried.count(), placed.select("__slice").distinct().count(), len(carried.columns)))
        return carried

    monkeypatch.setattr(ordered, "carried_values", watched)
    rng = random.Random(4)
    rows = [("hot", 0, v, "edit", rng.choice([None, "t", "u"]), rng.choice([None, None, "c", "d"])) for v in range(3000)]
    rows += [(f"n{i % 50}", 0, v, "edit", "t", "c") for i, v in enumerate(range(3000, 3400))]
    want, known = [], {}
    for note, _, v, _, *fields in sorted(rows, key=lambda r: (r[0], r[2])):
        new = {k: x for k, x in enumerate(fields) if x is not None}
        if any(known.get((note, k)) != x for k, x in new.items()):
            want.append((note, v))
        known.update({(note, k): x for k, x in new.items()})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = E.effective_edits(edits(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.note_id, r.version) for r in got) == sorted(want)
    hot, carried, slices, _ = seen[0]
    assert hot >= 3 and carried <= slices


def run(spark, tmp_path, batches, make, writer=None):
    """Feed each list of rows as one micro-batch."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    (tmp_path / "src").mkdir()
    stream = spark.readStream.schema(NOTE_EDITS).parquet(src)
    for rows in batches:
        edits(spark, rows).coalesce(1).write.mode("append").parquet(src)
        df = make(stream)
        write = writer(df) if writer else df.writeStream.format("parquet").option("path", out)
        write.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.schema(df.schema).parquet(out).collect() if writer is None else None


def test_stream_bursts_drop_late_edits(spark, tmp_path):
    batches = [
        [("a", 0, 1, "edit", "t", "c1"), ("a", 1000, 2, "edit", None, "c2"), ("b", 90_000, 3, "edit", None, "z")],
        [("a", 500, 4, "edit", None, "late")],
        [("b", 300_000, 5, "edit", None, "end")],
    ]
    got = run(spark, tmp_path, batches, E.stream_saves)
    assert sorted((r.note_id, r.edits, r.version, r.title, r.content) for r in got) == [("a", 2, 2, "t", "c2"), ("b", 1, 3, None, "z")]


def test_gate(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    batches = [
        # A flush saves at once; the other note waits.
        [("a", 0, 1, "edit", "t1", "c1"), ("a", 5, 3, "edit", None, "c3"), ("a", 6, 2, "edit", "t2", "c2"), ("a", 7, 3, "flush", None, None), ("b", 0, 9, "edit", None, "w")],
        # Stale versions of a saved note are dropped.
        [("a", 1000, 2, "edit", "old", "old"), ("a", 1001, 3, "flush", None, None)],
        # Time passes: the waiting note is saved.
        [("c", 400_000, 20, "edit", None, "later")],
        [("c", 900_000, 21, "flush", None, None)],
    ]
    got = run(spark, tmp_path, batches, lambda s: E.gate_saves(s, 1500, "2 seconds"))
    assert sorted((r.note_id, r.version, r.title, r.content) for r in got) == [("a", 3, "t2", "c3"), ("b", 9, None, "w"), ("c", 20, None, "later")]


@pytest.mark.parametrize("cuts", [[], [2], [1, 2, 3, 4, 5, 6, 7]])
def test_gate_does_not_depend_on_batches(spark, tmp_path, cuts):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rows = [
        ("a", 0, 1, "edit", "t1", "c1"),
        ("a", 10, 1, "flush", None, None),
        ("a", 100_000, 2, "edit", None, "c2"),
        # 1,500 ms later is within the pause, 1,501 is not.
        ("a", 101_500, 4, "edit", None, "c4"),
        ("a", 103_001, 3, "edit", "stale", "stale"),
        ("a", 103_002, 5, "edit", "t5", None),
        ("b", 500_000, 6, "edit", None, "b6"),
        ("b", 900_000, 6, "flush", None, None),
    ]
    borders = [0, *cuts, len(rows)]
    batches = [rows[i:j] for i, j in zip(borders, borders[1:])]
    got = run(spark, tmp_path, batches, lambda s: E.gate_saves(s, 1500, "2 seconds"))
    assert sorted((r.note_id, r.version, r.title, r.content) for r in got) == [
        ("a", 1, "t1", "c1"), ("a", 4, None, "c4"), ("a", 5, "t5", None), ("b", 6, None, "b6")]


@pytest.mark.parametrize("batches", [1, 3])
@pytest.mark.parametrize("held", [1, 7, 4096])
def test_a_hot_note_is_put_aside(spark, tmp_path, held, batches):
    """The same saves, however few rows of a note a worker may hold, in whatever order they lie in a file."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rng = random.Random(6)
    rows, ms = [], 0
    for v in range(240):
        ms += rng.choice([1, 400, 1500, 1501, 9000])
        kind = "flush" if rng.random() < 0.05 else "edit"
        fields = (None, None) if kind == "flush" else (rng.choice([None, f"t{v}"]), rng.choice([None, f"c{v}"]))
        rows.append((rng.choice(["hot", "hot", "hot", "cold"]), ms, v + rng.choice([0, 0, 0, -3]), kind, *fields))
    rows.append(("end", 10_000_000, 999, "edit", None, None))
    want, state = [], {}
    for note, at, version, kind, title, content in sorted(rows, key=lambda r: (r[1], r[2], r[3] == "flush")):
        saved, open_, last = state.get(note, (-1, None, None))
        if open_ and (kind == "flush" or at - last > 1500):
            want.append((note, open_[0], open_[1].get("t", (0, None))[1], open_[1].get("c", (0, None))[1]))
            saved, open_ = open_[0], None
        if kind != "flush":
            last = at if open_ is None or at > last else last
            if version > saved:
                open_ = open_ or [version, {}]
                open_[0] = max(open_[0], version)
                for name, value in (("t", title), ("c", content)):
                    if value is not None and version > open_[1].get(name, (-1, None))[0]:
                        open_[1][name] = (version, value)
        state[note] = (saved, open_, last)
    want += [(n, o[0], o[1].get("t", (0, None))[1], o[1].get("c", (0, None))[1]) for n, (_, o, _) in state.items() if o and n != "end"]
    size = -(-len(rows) // batches)
    parts = [rng.sample(rows[i : i + size], len(rows[i : i + size])) for i in range(0, len(rows), size)]
    got = run(spark, tmp_path, parts, lambda s: E.gate_saves(s, 1500, "2 seconds", held))
    assert sorted((r.note_id, r.version, r.title, r.content) for r in got if r.note_id != "end") == sorted(want, key=lambda r: r)


def test_saves_reach_the_notes(spark, tmp_path):
    image = "data:image/png;base64,AAAA"
    batches = [
        [("n0", 0, 1, "edit", "new", f"![i]({image})"), ("x", 100_000, 2, "edit", None, "-")],
        [("n0", 200_000, 3, "edit", None, "second"), ("x", 400_000, 4, "edit", None, "-")],
    ]
    log = str(tmp_path / "log")
    run(spark, tmp_path, batches, E.stream_saves, lambda df: E.log_saves(df, log, NOW))
    saves, logged = spark.read.parquet(f"{log}/saves"), spark.read.parquet(f"{log}/images")
    before = notes(spark, [{"title": "old", "content": "old"}, {}])
    stored = images(spark, [("kept", "n0", "image/png", "AAAA"), ("other", "n1", "image/png", "AAAA")])
    after, left = E.apply_log(before, stored, saves, logged, NOW)
    row = after.where("id = 'n0'").first()
    assert (row.title, row.content, row.updated_at) == ("new", "second", NOW)
    # The second save no longer mentions the image; the other note was not saved.
    assert ids(left) == ["other"]
    # After the first save alone, the token names the image as it is stored.
    after, left = E.apply_log(before, stored, saves.where("version < 3"), logged, NOW)
    assert after.where("id = 'n0'").first().content == "![i](note-image://kept)"
    assert sorted(ids(left)) == ["kept", "other"]
    assert logged.where("note_id = 'n0'").count() == 1
    assert saves.where(F.col("content").contains("note-image://")).count() == 1
