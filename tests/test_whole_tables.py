"""Queries hand whole tables to their operators."""

import pytest

import __spark_entry__ as entry
from inkgrove.operators import checks, folders, stats

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name,module,operator,taken",
    [
        ("deletable_folders_j12", folders, "deletable_folders", {1: 200}),
        ("deletable_libraries_j11", stats, "deletable_libraries", {1: 200}),
        ("references_c2", checks, "reference_report", {0: 200, 2: 200}),
    ],
)
def test_operator_gets_all_rows(spark, monkeypatch, name, module, operator, taken):
    seen = []
    plain = getattr(module, operator)

    def spy(*tables):
        seen.append({i: tables[i].count() for i in taken})
        return plain(*tables)

    monkeypatch.setattr(module, operator, spy)
    got = entry.queries()[name](spark, SF)
    assert seen == [taken]
    if operator == "reference_report":
        assert got.where("reference = 'note_images.note_id'").first().broken > 0
