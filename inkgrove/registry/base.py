"""Registration of queries, and the shared parts of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.plans.batches import bound_batches
from inkgrove.registry.datasets import Data, data

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TABLES = {
    "folders": """
        SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name,
               CAST(r_regionkey + 1 AS BIGINT) AS sort_order FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 100 + n_nationkey FROM nation
        UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, 1000 + s_suppkey FROM supplier""",
    "notes": """
        SELECT 'd' || d.doc_id AS id, 's' || (d.doc_id % (SELECT count(*) FROM supplier)) AS folder_id,
               d.lang AS library_id, left(split_part(d.text, chr(10), 1), 40) AS title, d.text AS content,
               CASE WHEN d.doc_id % 4 = 0 THEN CAST([] AS VARCHAR[])
                    ELSE [d.lang, d.lang || '/' || d.source, d.lang || '/' || d.source || '/' || (d.doc_id % 3)]
               END AS tags,
               coalesce(l.quality = 1 AND d.doc_id % 5 = 0, false) AS is_pinned,
               e.ts AS created_at, e.ts + to_seconds(d.n_chars) AS updated_at,
               CASE WHEN l.toxic = 1 THEN e.ts + to_seconds(d.n_chars) END AS deleted_at
        FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "active": "SELECT * FROM notes WHERE deleted_at IS NULL",
    "notes_img": """
        SELECT * REPLACE (content || chr(10) || '![img](data:image/png;base64,' || to_base64(encode(content)) || ')'
                          AS content), content AS plain, to_base64(encode(content)) AS payload,
               sha256('image/png:' || to_base64(encode(content))) AS checksum
        FROM notes""",
    "closure": """
        SELECT id AS ancestor, id AS descendant, CAST(0 AS BIGINT) AS distance FROM folders
        UNION ALL SELECT c.ancestor, f.id, c.distance + 1 FROM closure c JOIN folders f ON f.parent_id = c.descendant""",
    "fpath": """
        SELECT id, [name] AS names, [sort_order] AS orders, CAST(0 AS BIGINT) AS depth FROM folders
        WHERE parent_id IS NULL
        UNION ALL SELECT f.id, list_append(p.names, f.name), list_append(p.orders, f.sort_order), p.depth + 1
        FROM fpath p JOIN folders f ON f.parent_id = p.id""",
    "libraries": "SELECT DISTINCT lang AS id FROM documents",
    "edits": """
        SELECT 'u' || user_id AS note_id, ts, event_id AS version, props AS content,
               CASE WHEN event_id % 3 = 0 THEN event_type END AS title FROM events""",
}
_NEEDS = {"active": ["notes"], "notes_img": ["notes"], "closure": ["folders"], "fpath": ["folders"]}


def with_tables(names: str, body: str) -> str:
    """SQL ``body`` preceded by the named tables and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in order) + "\n" + body


def query(name: str, tables: str = "", sql: str | None = None):
    """Register a function of ``Data``, with its SQL counterpart if there is one."""

    def register(make: Callable[[Data], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bound_batches(spark)
            return make(data(spark, sf_dir))

        run.__name__, run.__doc__ = name, make.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_tables(tables, sql)
        return make

    return register


def iso(column: str | Column) -> Column:
    """Times as text, '' for NULL, so that both engines print them alike."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))


def iso_sql(column: str) -> str:
    return f"coalesce(strftime({column}, '%Y-%m-%d %H:%M:%S.%f'), '')"


