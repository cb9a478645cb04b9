"""Lists, searches, orders, tags and trees on hand-written rows."""

import datetime as dt
from itertools import chain

import pytest
from helpers import DAY, folders, ids, notes

from inkgrove.operators import checks, folders as T, notes as N, stats, tag_tree as G
from inkgrove.plans.ordered import with_position

HOUR = dt.timedelta(hours=1)


def test_like_search_keeps_wildcards_and_folds_ascii_only(spark):
    table = notes(
        spark,
        [
            {"title": "100% Sure"},
            {"title": "a_b"},
            {"title": "axb"},
            {"title": "back\\slash"},
            {"title": "É"},
            {"title": "é"},
            {"content": "one\ntwo"},
            {"title": "\u212a"},
        ],
    )

    def found(query):
        return sorted(ids(N.search(table, query)))

    assert found("sure") == ["n0"]
    assert found("a_b") == ["n1", "n2"]
    assert found("k\\s") == ["n3"]
    assert found("É") == ["n4"]
    assert found("ONE%TWO") == ["n6"]
    assert found("two%one") == []
    assert found("k") == ["n3"]
    assert len(found("%")) == 8 == len(found(""))
    assert found("a%a") == ["n3"]
    assert N.search_terms(table, []).count() == 0
    assert sorted(ids(N.search_terms(table, ["sure", "É"]))) == ["n0", "n4"]


def test_keyword_folds_unicode_and_is_literal(spark):
    table = notes(spark, [{"title": "É_x"}, {"content": "éyx"}, {"title": "ΟΔΟΣ"}, {"title": "100%"}])

    def found(keyword):
        return sorted(ids(N.note_view(table, N.ViewSpec(keyword=keyword))))

    assert found(" é_ ") == ["n0"]
    assert found("É") == ["n0", "n1"]
    assert found("οδος") == ["n2"]
    assert found("%") == ["n3"]
    assert len(found("  ")) == 4


def test_sort_is_stable_in_both_directions(spark):
    rows = [
        {"title": "b", "updated_at": DAY},
        {"title": "A", "updated_at": DAY + HOUR},
        {"title": "a", "updated_at": DAY + 2 * HOUR},
        {"title": "B", "updated_at": DAY + HOUR},
    ]
    table = notes(spark, rows)
    # The reference sorts a newest-first list with a stable sort.
    first = sorted(range(4), key=lambda i: rows[i]["updated_at"], reverse=True)
    for down in (False, True):
        want = sorted(first, key=lambda i: rows[i]["title"].lower(), reverse=down)
        got = ids(N.note_view(table, N.ViewSpec(sort_field="title", descending=down)))
        assert got == [f"n{i}" for i in want]
    with pytest.raises(ValueError):
        N.ViewSpec(sort_field="colour")


def test_dates_are_inclusive_and_only_for_date_fields(spark):
    table = notes(spark, [{"updated_at": dt.datetime(2024, 5, d, 23, 59, 59, 999999)} for d in (1, 2, 3)])
    spec = dict(from_date="2024-05-02", to_date="2024-05-02")
    assert ids(N.note_view(table, N.ViewSpec(**spec))) == ["n1"]
    assert N.note_view(table, N.ViewSpec(sort_field="title", **spec)).count() == 3


def test_recent_compares_whole_seconds(spark):
    as_of = dt.datetime(2024, 5, 10, 12, 0, 0, 900000)
    edge = dt.datetime(2024, 5, 3, 12, 0, 0)
    table = notes(spark, [{"updated_at": edge}, {"updated_at": edge - dt.timedelta(microseconds=1)}])
    assert ids(N.recent(table, 7, as_of)) == ["n0"]


def test_pinned_puts_the_wanted_note_first(spark):
    table = notes(
        spark,
        [{"is_pinned": True, "updated_at": DAY + HOUR}, {"updated_at": DAY}, {"deleted_at": DAY}, {"is_pinned": True}],
    )
    assert ids(N.pinned(table)) == ["n0", "n3"]
    assert ids(N.pinned(table, "n1")) == ["n1", "n0", "n3"]
    assert ids(N.pinned(table, "n2")) == ["n0", "n3"]
    assert ids(N.pinned(table, "n3")) == ["n0", "n3"]


def test_empty_notes(spark):
    empty = ["", "<p></p>", "<P><BR></P>", "&nbsp;", " ", "​", "<div>\n​&nbsp;</div>", "<imgx>"]
    full = ['<img src="http://x/y.png">', "![a](data:image/png;base64,AA==)", "note-image://x", "<video>", "a < b"]
    rows = [{"content": c, "title": t} for t in ("", "새 노트", "제목 없는 노트") for c in empty]
    rows += [{"content": c} for c in full] + [{"title": "kept"}, {"deleted_at": DAY}]
    got = sorted(ids(N.empty_notes(notes(spark, rows))), key=lambda i: int(i[1:]))
    assert got == [f"n{i}" for i in range(3 * len(empty))]


def test_folder_set(spark):
    table = notes(spark, [{"folder_id": "a"}, {"folder_id": "b"}, {"folder_id": "a", "deleted_at": DAY}])
    assert N.notes_in_folders(table, []).count() == 0
    assert ids(N.notes_in_folders(table, ["a"])) == ["n0"]
    wanted = spark.createDataFrame([("a",), ("a",), ("z",)], "x string")
    assert ids(N.notes_in_folders(table, wanted)) == ["n0"]
    assert N.notes_in_folders(table, wanted, include_deleted=True).count() == 2


# -- tags --------------------------------------------------------------------


def tree_rule(lists):
    """The tag tree, stated with dictionaries."""
    direct = {}
    for tag in chain.from_iterable(lists):
        tag = tag.strip()
        if tag:
            direct[tag] = direct.get(tag, 0) + 1
    nodes = {"/".join(t.split("/")[: i + 1]) for t in direct for i in range(len(t.split("/")))}

    def visit(path, depth):
        below = [n for n in nodes if n.startswith(path + "/")]
        kids = [n for n in below if n.count("/") == path.count("/") + 1]
        yield path, path.split("/")[-1], sum(direct.get(n, 0) for n in [path, *below]), depth, bool(kids)
        for kid in sorted(kids, key=lambda k: (k.lower(), k)):
            yield from visit(kid, depth + 1)

    for root in sorted((n for n in nodes if "/" not in n), key=lambda k: (k.lower(), k)):
        yield from visit(root, 0)


def test_tag_tree(spark):
    lists = [
        ["dev", "dev-ops", "dev/python", "Dev/a"],
        ["/a", "a/", "a//b"],
        [" x/y ", "\t", "x/y/z", "x/Y"],
        ["dev/python", "dev/python"],
    ]
    table = notes(spark, [{"tags": t} for t in lists] + [{"tags": ["gone"], "deleted_at": DAY}])
    rows = [tuple(r) for r in G.tag_list(table).drop("sort_key").collect()]
    assert rows == list(tree_rule(lists))
    assert sorted(ids(N.note_list(table, tag="dev"))) == ["n0", "n3"]


# -- folders -----------------------------------------------------------------

TREE = [
    ("a", None, 2),
    ("b", "", 1),
    ("c", "a", 5),
    ("d", "c", 1),
    ("e", "d", 1),
    ("f", "a", 4),
    ("loose", "gone", 0),
    ("under", "loose", 0),
    ("self", "self", 0),
    ("p", "q", 0),
    ("q", "p", 0),
    ("in", "p", 0),
]


@pytest.fixture(scope="module")
def tree(spark):
    table = folders(spark, TREE)
    return table, T.folder_paths(table)


def test_paths(tree):
    got = {r.id: (r.ids, r.ending) for r in tree[1].collect()}
    assert got["e"] == (["e", "d", "c", "a"], "root")
    assert got["b"] == (["b"], "root")
    assert got["under"] == (["under", "loose"], "missing")
    assert got["self"] == (["self"], "cycle")
    assert got["p"] == (["p", "q"], "cycle")
    assert got["in"] == (["in", "p", "q"], "cycle")


def test_depths_and_limits(tree):
    depth = {r.id: r.depth for r in T.folder_depths(tree[1]).collect()}
    assert [depth[k] for k in ("a", "c", "e", "loose", "under")] == [0, 1, 3, 1, 2]
    assert ids(T.too_deep(tree[1])) == ["e"]
    assert {r.problem for r in checks.tree_report(tree[1]).collect()} == {"depth", "missing", "cycle"}


def test_long_chain(spark):
    n = 100
    table = folders(spark, [(f"k{i}", f"k{i - 1}" if i else None, i) for i in range(n)])
    paths = T.folder_paths(table)
    assert T.folder_closure(paths).count() == n * (n + 1) // 2
    assert T.folder_depths(paths).agg({"depth": "max"}).first()[0] == n - 1


def test_tree_order_and_collapse(spark, tree):
    table, paths = tree
    none = notes(spark, [{"folder_id": "d"}, {"folder_id": "d", "deleted_at": DAY}])

    def order(collapsed=()):
        shown = T.folder_tree(table, none, paths, collapsed)
        return ids(shown.orderBy("tree_key"))

    assert order() == ["b", "a", "f", "c", "d", "e"]
    assert order(["c"]) == ["b", "a", "f", "c"]
    panel = T.folder_panel(table, none, paths).collect()
    assert [r.id for r in panel[:3]] == ["smart:all", "smart:favorites", "b"]
    assert {r.id: r.note_count for r in panel}["d"] == 1
    assert ids(T.descendants_children_first(paths, "a"))[0] == "e"


def test_export_dirs(tree):
    whole = {r.id: r.rel_dir for r in T.export_dirs(tree[1]).collect()}
    below = {r.id: r.rel_dir for r in T.export_dirs(tree[1], "c").collect()}
    assert (whole["e"], whole["under"]) == ("A/C/D/E", "LOOSE/UNDER")
    assert below == {"c": "", "d": "D", "e": "D/E"}


def test_note_paths(spark, tree):
    table = notes(spark, [{"folder_id": "d"}, {"folder_id": "nowhere"}, {"folder_id": "in"}])
    got = {r.note_id: r.folder_path for r in T.note_folder_paths(table, tree[1]).collect()}
    assert got == {"n0": "A / C / D", "n1": "미분류", "n2": "Q / P / IN"}


def test_deletable_folders(spark, tree):
    table = tree[0]
    got = {r.id: r.reason for r in T.deletable_folders(table, notes(spark, [{"folder_id": "f"}])).collect()}
    assert got["b"] == "" and "하위" in got["a"] and "노트" in got["f"]


def test_last_library_stays(spark):
    one = spark.createDataFrame([("l",)], "id string")
    empty = notes(spark, [{"deleted_at": DAY}]).selectExpr("*", "'l' as library_id")
    assert [tuple(r) for r in stats.deletable_libraries(one, empty).collect()] == [("l", True, False)]


def test_positions(spark):
    table = spark.range(0, 1000).selectExpr("id % 7 as k", "id")
    got = with_position(table, [table.k.desc(), table.id.asc()]).collect()
    rows = sorted(((r.k, r.id) for r in got), key=lambda r: (-r[0], r[1]))
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.position)] == rows
    assert sorted(r.position for r in got) == list(range(1, 1001))
