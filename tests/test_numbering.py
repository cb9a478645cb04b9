"""Folder numbers against a walk of the tree."""

import random

from helpers import folders, images, notes
from pyspark.sql import functions as F

from inkgrove.operators import changes as M
from inkgrove.operators import folders as T
from inkgrove.operators import numbering as N


def walk(rows):
    """id -> (first, last, depth, ending), by a plain depth-first walk."""
    by_id = {i: (p or None, o) for i, p, o in rows}
    children, found, number = {}, {}, [0]
    for i, (p, o) in by_id.items():
        children.setdefault(p if p in by_id else None, []).append((p is not None, o, i))

    def enter(i, depth, ending):
        number[0] += 1
        first = number[0]
        for *_, c in sorted(children.get(i, [])):
            enter(c, depth + 1, ending)
        found[i] = (first, number[0], depth, ending)

    for missing, _, i in sorted(children.get(None, [])):
        enter(i, int(missing), "missing" if missing else "root")
    return {i: found.get(i, (None, None, None, "cycle")) for i in by_id}


def numbered(spark, rows):
    return {r.id: (r.first, r.last, r.depth, r.ending) for r in N.number_folders(folders(spark, rows)).collect()}


def test_random_forest(spark):
    rng = random.Random(1)
    rows = [(f"f{i:03}", rng.choice([None, "", "gone", *(f"f{j:03}" for j in range(max(0, i - 8), i))]), rng.randrange(4)) for i in range(40)]
    rows += [("x", "y", 0), ("y", "z", 0), ("z", "x", 0), ("below", "x", 1), ("self", "self", 2)]
    rng.shuffle(rows)
    assert numbered(spark, rows) == walk(rows)


def test_a_chain(spark, monkeypatch):
    """Every table on the way to the numbers of a chain has at most two rows a folder."""
    seen = []
    keep = N.cut

    def counted(df):
        out = keep(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(N, "cut", counted)
    rows = [(f"f{i:04}", f"f{i - 1:04}" if i else None, 0) for i in range(100)]
    assert numbered(spark, rows) == {f"f{i:04}": (i + 1, 100, i, "root") for i in range(100)}
    assert max(seen) <= 200 and len(seen) <= 25


def test_no_folders(spark):
    assert numbered(spark, []) == {}


def test_a_subtree_is_a_pushed_range(spark, tmp_path):
    rows = [("a", None, 1), ("b", "a", 1), ("c", "b", 1), ("d", "a", 2), ("e", None, 2), ("o", "p", 1), ("p", "o", 1)]
    path = str(tmp_path / "numbers")
    N.number_folders(folders(spark, rows)).write.parquet(path)
    numbers = spark.read.parquet(path)
    below = N.subtree(numbers, "a")
    assert {(r.id, r.distance) for r in below.collect()} == {("b", 1), ("c", 2), ("d", 1)}
    plan = below._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(first" in plan and "LessThanOrEqual(first" in plan
    assert [r.id for r in N.children_first(numbers, "a").collect()] == ["d", "c", "b"]
    assert N.subtree(numbers, "o").count() == N.subtree(numbers, "nowhere").count() == 0
    assert [r.id for r in N.subtree(numbers, "e", include_self=True).collect()] == ["e"]


def test_operators_take_numbers(spark):
    """J5, O4 and M11 give the same on paths and on numbers."""
    rows = [("a", None, 2), ("b", "a", 1), ("c", "b", 1), ("d", "a", 0), ("e", None, 1), ("m", "gone", 1)]
    tree = folders(spark, rows)
    paths, numbers = T.folder_paths(tree), N.number_folders(tree)
    table = notes(spark, [{"folder_id": f} for f in "abcdem"])
    pictures = images(spark, [(f"i{k}", f"n{k}", "m", "d") for k in range(6)])
    for some in ("a", "m"):
        left, right = (sorted(r.id for r in T.notes_of_subtree(table, p, some).collect()) for p in (paths, numbers))
        assert left == right
        by_path, by_number = ([sorted(r.id for r in df.collect()) for df in M.delete_folder(tree, table, pictures, p, some)] for p in (paths, numbers))
        assert by_path == by_number
    for collapsed in ((), ("b", "e")):
        shown = [
            [(r.id, r.depth, r.note_count, r.has_children) for r in T.folder_tree(tree, table, p, collapsed).orderBy("tree_key").collect()]
            for p in (paths, numbers)
        ]
        assert shown[0] == shown[1] and shown[0][0][0] == "e"
    assert T.folder_panel(tree, table, numbers).select(F.col("id")).count() == 7


def test_rounds_stay_small(spark, monkeypatch):
    """Each round is stored in few partitions and hands on no constraints, whatever their number."""
    from inkgrove.operators import folders as T
    from inkgrove.operators import numbering as N

    seen = []

    def watched(df, keep=N.cut):
        out = keep(df)
        seen.append((out.rdd.getNumPartitions(), out._jdf.queryExecution().optimizedPlan().constraints().size()))
        return out

    for module in (N, T):
        monkeypatch.setattr(module, "cut", watched)
    schema = "id string, name string, parent_id string, sort_order int, created_at timestamp_ntz"
    for n, fan in ((100, 1), (300, 10)):
        rows = [(f"f{i}", "x", f"f{(i - 1) // fan}" if i else None, i, None) for i in range(n)]
        folders = spark.createDataFrame(rows, schema).repartition(2)
        first = {r.id: (r.first, r.depth) for r in N.number_folders(folders).collect()}
        depth = {r.id: len(r.ids) - 1 for r in T.folder_paths(folders).collect()}
        assert {i: d for i, (_, d) in first.items()} == depth
        assert sorted(f for f, _ in first.values()) == list(range(1, n + 1))
    assert max(p for p, _ in seen) <= 16 and max(c for _, c in seen) == 0
