"""Change sets on hand-written rows."""

import pytest
from helpers import DAY, NOW, folders, images, notes
from pyspark.sql import Row

from inkgrove.operators import changes as M
from inkgrove.operators import folders as T
from inkgrove.schemas import NOTES, conform


def by_id(df):
    return {r.id: r for r in df.collect()}


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_update(spark):
    table = notes(spark, [{"title": "t", "content_json": "{}"}, {"deleted_at": DAY}, {"title": "same"}])
    changes = spark.createDataFrame(
        [("n0", None, "c", "", None, ["x"]), ("n1", "no", None, None, None, None), ("n2", None, None, None, None, None), ("zz", "t", None, None, None, None)],
        "id string, title string, content string, content_json string, folder_id string, tags array<string>",
    )
    got = by_id(M.update_notes(table, changes, NOW))
    assert (got["n0"].title, got["n0"].content, got["n0"].content_json, got["n0"].tags) == ("t", "c", None, ["x"])
    assert got["n0"].updated_at == NOW
    assert got["n1"].title == "" and got["n1"].updated_at == DAY
    assert got["n2"].updated_at == DAY and len(got) == 3


def test_changes_are_folded_in_order(spark):
    """Field by field, the newest given value; a field can be set to NULL; the order of rows means nothing."""
    table = notes(spark, [{"title": "t", "content": "c", "content_json": "{}"}, {"title": "u"}])
    rows = [
        ("n0", 3, "third", None, None, None), ("n0", 1, "first", "one", "{1}", None), ("n0", 4, None, None, None, ["content_json"]),
        ("n0", 2, None, "two", "{2}", None), ("n1", 9, None, None, "{}", None), ("n1", 7, "z", None, None, ["content_json"]),
    ]
    schema = "id string, seq long, title string, content string, content_json string, cleared array<string>"
    for some in (rows, rows[::-1]):
        got = by_id(M.update_notes(table, spark.createDataFrame(some, schema).repartition(3), NOW))
        assert (got["n0"].title, got["n0"].content, got["n0"].content_json) == ("third", "two", None)
        assert (got["n1"].title, got["n1"].content_json) == ("z", "{}")
    pins = spark.createDataFrame([("n0", True, 1), ("n0", False, 2), ("n1", False, 1), ("n1", True, 2)], "id string, is_pinned boolean, seq int")
    assert {k: r.is_pinned for k, r in by_id(M.set_pinned(table, pins)).items()} == {"n0": False, "n1": True}


def test_changes_without_an_order_are_one_per_key(spark):
    table = notes(spark, [{"title": "t"}])
    schema = "id string, title string, content string"
    same = spark.createDataFrame([("n0", "a", None)] * 2, schema)
    assert by_id(M.update_notes(table, same, NOW))["n0"].title == "a"
    two = spark.createDataFrame([("n0", "a", None), ("n0", None, "b")], schema)
    with pytest.raises(Exception, match="need the column seq"):
        M.update_notes(table, two, NOW).collect()


def test_a_hot_key_shrinks_before_the_shuffle(spark):
    """Changes are aggregated in the tasks that read them: two aggregations, one exchange below the join."""
    changes = spark.range(1000).selectExpr("'n0' as id", "id as seq", "cast(id as string) as title")
    plan = M.fold_changes(changes, ["title"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_max" in plan


def test_delete_and_restore(spark):
    table = notes(spark, [{}, {"deleted_at": DAY}, {}])
    gone = by_id(M.soft_delete(table, keys(spark, "n0", "n1"), NOW))
    assert (gone["n0"].deleted_at, gone["n1"].deleted_at, gone["n2"].deleted_at) == (NOW, DAY, None)
    assert gone["n0"].updated_at == DAY
    back = by_id(M.restore(table, keys(spark, "n1", "n2")))
    assert back["n1"].deleted_at is None and back["n1"].updated_at == DAY
    kept, pictures = M.hard_delete(table, images(spark, [("i", "n0", "m", "d"), ("j", "n2", "m", "d")]), keys(spark, "n0"))
    assert sorted(by_id(kept)) == ["n1", "n2"] and list(by_id(pictures)) == ["j"]


def test_pins(spark):
    table = notes(spark, [{}, {"deleted_at": DAY}])
    flipped = by_id(M.toggle_pinned(table, keys(spark, "n0", "n1")))
    assert (flipped["n0"].is_pinned, flipped["n1"].is_pinned) == (True, False)
    pins = spark.createDataFrame([("n1", True)], "id string, is_pinned boolean")
    assert by_id(M.set_pinned(table, pins))["n1"].is_pinned


def test_create(spark):
    table, tree = notes(spark, [{"title": "old"}]), folders(spark, [("f2", None, 2), ("f1", None, 1)])
    drafts = spark.createDataFrame(
        [
            Row(id="a", title="A", content="![i](data:image/png;base64,AAAA)", content_json="", folder_id=""),
            Row(id="b", title="B", content="", content_json="{}", folder_id="smart:all"),
            Row(id="c", title="C", content="", content_json="", folder_id="f2"),
            Row(id="n0", title="new", content="", content_json="", folder_id="f2"),
        ]
    )
    made, pictures = M.create_notes(table, drafts, tree, NOW)
    got = by_id(made)
    assert [got[k].folder_id for k in "abc"] == ["f1", "f1", "f2"]
    assert got["n0"].title == "old" and got["a"].content_json is None and got["b"].content_json == "{}"
    assert "note-image://" in got["a"].content and pictures.count() == 1
    assert [r.id for r in M.rejected_notes(table, drafts).collect()] == ["n0"]


def test_folders(spark):
    table = folders(spark, [("a", None, 1), ("b", "a", 7), ("c", "b", 3), ("x", None, 2)])
    drafts = spark.createDataFrame([("k2", "two", "", "c"), ("k1", "one", "", "a"), ("k3", "three", "", "")], "id string, name string, color string, parent_id string")
    paths = T.folder_paths(table)
    made = by_id(M.create_folders(table, drafts, NOW, paths=paths))
    assert {k: made[k].sort_order for k in made if k.startswith("k")} == {"k1": 8, "k3": 9}
    assert made["k3"].parent_id is None
    renamed = by_id(M.update_folders(table, spark.createDataFrame([("a", " N ", None), ("b", " ", "red"), ("c", None, "blue")], "id string, name string, color string"), NOW))
    assert (renamed["a"].name, renamed["b"].color, renamed["c"].color) == ("N", "#fff", "blue")
    left = M.delete_folder(table, notes(spark, [{"folder_id": "c"}, {"folder_id": "x"}]), images(spark, [("i", "n0", "m", "d"), ("j", "n1", "m", "d")]), paths, "b")
    assert [sorted(by_id(df)) for df in left] == [["a", "x"], ["n1"], ["j"]]
    assert [r.name for r in M.ensure_folder(table.limit(0), NOW).collect()] == ["내 노트"]
    assert M.ensure_folder(table, NOW).count() == 4


def test_libraries(spark):
    none = M.create_libraries(M.ensure_library(_no_libraries(spark), NOW), spark.createDataFrame([("l2", "Two")], "id string, name string"), NOW)
    assert sorted((r.id, r.name, r.is_default) for r in none.collect()) == [("default", "내 서재", True), ("l2", "Two", False)]
    changed = by_id(M.update_libraries(none, spark.createDataFrame([("l2", " New "), ("default", "  ")], "id string, name string"), NOW))
    assert (changed["l2"].name, changed["default"].name) == ("New", "내 서재")
    full = notes(spark, [{}]).selectExpr("*", "'default' as library_id")
    kept, _ = M.delete_library(none, full, "default")
    assert kept.count() == 2
    assert [r.id for r in M.delete_library(none, full, "l2")[0].collect()] == ["default"]


def _no_libraries(spark):
    from inkgrove.schemas import LIBRARIES

    return spark.createDataFrame([], LIBRARIES)


def test_old_rows_conform(spark, tmp_path):
    old = spark.createDataFrame([("n", "f", "t", 1, "2024-01-02T03:04:05.000006", '["a"]')], "id string, folder_id string, title string, is_pinned int, created_at string, tags string")
    row = conform(old, NOTES).first()
    assert (row.is_pinned, row.tags, row.content, row.content_json) == (True, ["a"], "", None)
    assert row.created_at.microsecond == 6
