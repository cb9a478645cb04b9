"""What plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)

from inkgrove.operators import folders as T
from inkgrove.operators import notes as N
from inkgrove.operators import stats, tag_tree
from inkgrove.registry.base import QUERIES
from inkgrove.registry.datasets import data

SF = "/root/testdata/sf0.001"


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def d(spark):
    return data(spark, SF)


def test_view_filters_reach_the_scan(d):
    text = plan(N.note_view(d.notes("en"), N.ViewSpec(folder_id="s3", from_date="2024-01-01", to_date="2024-01-02")))
    pushed = re.search(r"PushedFilters: (.*)", text)[1]
    assert "IsNull(deleted_at)" in pushed and "EqualTo(folder_id,s3)" in pushed and "GreaterThanOrEqual(updated_at" in pushed
    assert "PartitionFilters: [" in text and "library_id" in re.search(r"PartitionFilters: (.*)", text)[1]


@pytest.mark.parametrize("make", [lambda d: stats.library_stats(d.notes(), d.folders()), lambda d: tag_tree.tag_tree(d.notes()), lambda d: T.with_note_count(d.folders(), d.notes())])
def test_counts_do_not_read_texts(d, make):
    for schema in re.findall(r"ReadSchema: (struct<.*deleted_at.*>)", plan(make(d))):
        assert "content" not in schema and "title" not in schema


def test_text_queries_stay_in_the_jvm(spark):
    for name in ("note_view_p12", "like_search_p8", "tag_tree_a5_a7", "markdown_to_plain_f6", "tokenize_i1", "note_blocks_b1"):
        text = plan(QUERIES[name](spark, SF))
        assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text, name


def test_no_query_uses_a_cross_join(spark):
    for name in ("stats_a1", "deletable_libraries_j11", "create_notes_m1", "hydrate_j3_i3", "folder_tree_o4"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, SF)), name


def test_store_needs_a_shared_folder_on_a_cluster(monkeypatch, spark):
    from inkgrove.plans import lineage

    class Context:
        master = "spark://host:1"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        lineage.scratch_root(Session())


def test_korean_bytes_are_built_once_and_without_a_function_per_letter(spark):
    from inkgrove.registry.transfers import korean_bytes

    texts = ["Abc xyz\nZ", "", None, "\u00e9\u00df\uac00 9a", "a\r\nb", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    two = {chr(97 + i): bytes([0xB0, 0xA1 + i]) for i in range(25)} | {"z": b"\x81\x41", " ": b" ", "\n": b"\n"}
    kept = [None if t is None else "".join(c for c in t if c in " \n" or c.isascii() and c.isalpha()).lower() for t in texts]
    want = [None if t is None else b"".join(two[c] for c in t) for t in kept]
    got = [r[1] for r in sorted(df.select("i", korean_bytes(F.col("t"))).collect())]
    assert [None if g is None else bytes(g) for g in got] == want
    text = QUERIES["decode_korean_s7"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in text and text.count("translate(") == 1


def test_python_workers_are_handed_small_batches(spark):
    """What a worker holds does not grow with the rows of its task."""
    import pyarrow as pa

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    for name in names:
        spark.conf.unset(name)
    QUERIES["decode_legacy_s7"](spark, SF)

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    short = spark.range(0, 3000, 1, 1).mapInArrow(seen, "rows long, bytes long").agg(F.max("rows")).first()[0]
    long = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), F.lit(1 << 20)).alias("t"))
    assert short <= 500
    assert long.mapInArrow(seen, "rows long, bytes long").agg(F.max("bytes")).first()[0] <= 20 << 20


def test_texts_move_once_into_the_store(spark, monkeypatch):
    """Joined with the events without a sort, texts are written where they are; the tokenized store moves none."""
    from inkgrove.registry.datasets import Data
    from inkgrove.sources.store import read_notes

    dealt = []
    kind = type(spark.range(1))
    deal = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *a: dealt.append(self.columns) or deal(self, *a))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        data = Data(spark, "/root/testdata/sf0.001")
        assert "SortMergeJoin" not in data.raw_notes()._jdf.queryExecution().executedPlan().toString()
        assert data.tokenized().count() == data.table("documents").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert not [columns for columns in dealt if "content" in columns]
    rows = read_notes(spark, data._made["store"]).selectExpr("library_id", "updated_at", "input_file_name() AS file").collect()
    files = {}
    for r in rows:
        files.setdefault((r.file, r.library_id), []).append(r.updated_at)
    assert all(times == sorted(times) for times in files.values())


def test_saved_notes_are_computed_once(d):
    """What is read of saved notes again and again holds no join, and no text is tokenized again for it."""
    from inkgrove.operators.changes import save_notes
    from inkgrove.registry.datasets import NOW

    changes = d.notes_img().select("id", "content", "content_json")
    notes, kept = save_notes(d.notes(), d.images().limit(0), changes, NOW)
    assert "Join" not in plan(notes) and "sha2" not in plan(notes)
    live = d.notes().where("deleted_at IS NULL").count()
    assert notes.count() == d.notes().count() and kept.count() == live
    assert notes.where("content LIKE '%note-image://%'").count() == live
