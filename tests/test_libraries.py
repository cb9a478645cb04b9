"""Libraries as partitions of all tables."""

import glob
import os

import pytest
from helpers import NOW, folders, images, notes
from pyspark.sql import functions as F

from inkgrove.operators import changes as M
from inkgrove.sources import store as S


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/*.parquet")}


def of(path, library):
    return {f for f in files(path) if f"library_id={library}/" in f}


@pytest.fixture
def tables(spark, tmp_path):
    """Three libraries; the id of one needs escaping in a path."""
    library = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c/1")), F.substring("id", 2, 1).cast("int") % 3 + 1)
    made = {
        "folders": folders(spark, [(f"f{i}", None, i) for i in range(6)]),
        "notes": notes(spark, [{"id": f"n{i}", "folder_id": f"f{i}"} for i in range(6)]),
        "note_images": images(spark, [(f"i{i}", f"n{i}", "image/png", "AAAA") for i in range(6)]),
    }
    paths = {}
    for name, df in made.items():
        paths[name] = str(tmp_path / name)
        S.write_table(df.withColumn("library_id", library), paths[name], name)
    return paths


def test_a_change_rewrites_its_library_only(spark, tables):
    path = tables["notes"]
    before = files(path)
    keys = spark.createDataFrame([("a", "n0", "new", 1), ("a", "n3", "other", 1), ("a", "n0", "newest", 2)], "library_id string, id string, title string, seq int")
    changes = keys.drop("library_id")
    assert S.rewrite_libraries(spark, path, "notes", keys, lambda rows: M.update_notes(rows, changes, NOW)) == ["a"]
    after = files(path)
    assert {f for f in after if after[f] != before.get(f)} == of(path, "a") and not of(path, "a") & set(before)
    titles = {r.id: r.title for r in S.read_table(spark, path, "notes").collect()}
    assert titles == {"n0": "newest", "n1": "", "n2": "", "n3": "other", "n4": "", "n5": ""}


def test_partitions_are_pruned(spark, tables):
    plan = S.read_table(spark, tables["folders"], "folders", ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and S.read_table(spark, tables["folders"], "folders", ["b"]).count() == 2


def test_a_library_goes_from_all_tables(spark, tables):
    for name, path in tables.items():
        assert S.drop_library(spark, path, "c/1") and not S.drop_library(spark, path, "none")
        assert {r.library_id for r in S.read_table(spark, path, name).select("library_id").collect()} == {"a", "b"}


def test_an_emptied_library_loses_its_partition(spark, tables):
    path = tables["note_images"]
    keys = spark.createDataFrame([("b",), ("a",)], "library_id string")
    S.rewrite_libraries(spark, path, "note_images", keys, lambda rows: rows.where("library_id = 'a'"))
    assert not of(path, "b") and of(path, "a")
    assert S.read_table(spark, path, "note_images").count() == 4
    with pytest.raises(ValueError, match="not named"):
        S.rewrite_libraries(spark, path, "note_images", keys, lambda rows: rows.withColumn("library_id", F.lit("z")))
    assert S.read_table(spark, path, "note_images").count() == 4
