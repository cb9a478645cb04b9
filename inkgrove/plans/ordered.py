"""Order-based operators that never put one group into one task.

``row_number`` over a window sends a whole group to a single task.  Here the
rows are range-partitioned on (group, order) instead, so a hot group covers many
slices.  Only the first group of a slice can have started in an earlier slice;
so at most one offset per slice is needed to turn positions within slices into
positions within groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrove.plans.lineage import cut


def _key(i: int) -> str:
    return f"__g{i}"


def _place(df: DataFrame, groups: Sequence[Column], order: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """Rows range-partitioned on (group, order), with their slice and the group as key columns.

    They are written once, because the slice a row falls in depends on sampled bounds and
    must not change when a task is run again.
    """
    # A constant group stands in when the whole table is one group.
    groups = list(groups) or [F.lit(0)]
    keys = [_key(i) for i in range(len(groups))]
    keyed = df.select("*", *[g.alias(k) for g, k in zip(groups, keys)])
    by_range = keyed.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order)
    return cut(by_range.withColumn("__slice", F.spark_partition_id())), keys


def _join_carried(local: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slices with what earlier slices of their first group left; ``carried`` has a row a slice."""
    named = carried.withColumnsRenamed({k: f"{k}o" for k in [*keys, "__slice"]})
    same = F.col("__slice") == F.col("__sliceo")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}o"))
    return local.join(F.broadcast(named), same, "left")


def rank_rows(
    df: DataFrame,
    groups: Sequence[Column],
    order: Sequence[Column],
    name: str,
) -> DataFrame:
    """Add ``name``: the 1-based position of each row within its group.

    ``order`` must make the rows of a group distinct.  Pass narrow rows: they are written
    once.
    """
    placed, keys = _place(df, groups, order)
    counts = placed.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    # One row per (group, slice): a group has at most as many rows as slices exist.
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    # A group continues into a slice only as its first group, so this keeps at
    # most one row per slice, whatever the data.
    offsets = counts.withColumn("__before", F.sum("__n").over(earlier)).where(F.col("__before").isNotNull()).drop("__n")
    within = Window.partitionBy(*keys, "__slice").orderBy(*order)
    joined = _join_carried(placed.withColumn("__pos", F.row_number().over(within)), offsets, keys)
    rank = (F.col("__pos") + F.coalesce(F.col("__before"), F.lit(0))).cast("bigint")
    return joined.select(*df.columns, rank.alias(name))


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Add the position of each row in the total order of the table."""
    return rank_rows(df, [], order, name)


def carried_values(placed: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """For each slice whose first group began in an earlier one: the last non-NULL values there.

    At most one row per slice, whatever the data.
    """
    newest = [F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(v) for v in values]
    parts = placed.groupBy(*keys, "__slice").agg(*newest)
    # One row per (group, slice): a group has at most as many rows as slices exist.
    by_slice = Window.partitionBy(*keys).orderBy("__slice")
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    into = [F.last(v, ignorenulls=True).over(earlier).alias(f"__c_{v}") for v in values]
    return parts.select(*keys, "__slice", *into, F.lag("__slice").over(by_slice).alias("__prev")).where("__prev IS NOT NULL").drop("__prev")


def last_before(df: DataFrame, groups: Sequence[Column], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add ``before_<v>`` for each of ``values``: its last non-NULL value earlier in the group.

    A segmented scan: windows see one slice, and each slice takes over at most one row from
    the slices before it.  ``order`` names ascending columns that make the rows of a group
    distinct; ``values`` are short, digests rather than texts, as the rows taken over are
    broadcast.
    """
    placed, keys = _place(df, groups, [F.col(c) for c in order])
    within = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"__l_{v}": F.last(v, ignorenulls=True).over(within) for v in values})
    joined = _join_carried(local, carried_values(placed, keys, order, values), keys)
    return joined.select(*df.columns, *[F.coalesce(f"__l_{v}", f"__c_{v}").alias(f"before_{v}") for v in values])
