"""Folder trees as ranges (J5, J6, O4, O6, M11 on trees of any depth).

An Euler tour enters every folder once and leaves it once, children in list order.  The
tour is a linked list of arcs; pointer jumping ranks it in about ``log2`` of its length
rounds of narrow joins.  The rank of a folder's entering arc is its number in pre-order,
and the arcs between entering and leaving give the last number of its subtree.  So a
subtree is the range ``first .. last``: rows grow with the folders, not with their depth,
and a stored table is pruned by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.plans.lineage import round_stored as cut
from inkgrove.plans.ordered import rank_rows


def climb(folders: DataFrame) -> DataFrame:
    """(id, parent, sort_order, created_at, depth, ending) of every folder.

    ``parent`` is NULL for a root and for a folder whose parent doesn't exist; ``ending``
    tells where the path up ends: ``root``, ``missing`` or ``cycle`` (in or below one).
    Each round doubles the known distance, so a tree of depth d takes about log2(d) rounds.
    """
    asked = F.nullif(F.col("parent_id"), F.lit(""))
    known = folders.select(F.col("id").alias("__p"))
    nodes = folders.select("id", "sort_order", "created_at", asked.alias("asked"))
    nodes = nodes.join(known, F.col("asked") == F.col("__p"), "left")
    start = F.when(F.col("asked").isNull(), "root").when(F.col("__p").isNull(), "missing")
    nodes = cut(nodes.select("id", "sort_order", "created_at", F.col("__p").alias("parent"), start.alias("ending")))
    far = nodes.select("id", F.col("parent").alias("hop"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("bigint").alias("steps"), "ending")
    rounds = max(1, nodes.count()).bit_length() + 1
    for _ in range(rounds):
        if far.where("ending is null").isEmpty():
            break
        ahead = far.select(*[F.col(c).alias(f"n_{c}") for c in far.columns])
        # Rows that have arrived meet nothing and are dealt by their own id.  A union of both
        # kinds would double the partitions in every round.
        climbs = F.col("ending").isNull()
        met = far.join(ahead, (F.when(climbs, F.col("hop")).otherwise(F.col("id")) == F.col("n_id")) & climbs, "left")
        further = {"hop": F.col("n_hop"), "steps": F.col("steps") + F.col("n_steps"), "ending": F.col("n_ending")}
        far = cut(met.select("id", *[F.when(climbs, v).otherwise(F.col(c)).alias(c) for c, v in further.items()]))
    places = far.select("id", "steps", F.coalesce("ending", F.lit("cycle")).alias("ending"))
    depth = F.when(F.col("ending") != "cycle", F.col("steps") + F.when(F.col("ending") == "missing", 1).otherwise(0))
    return nodes.drop("ending").join(places, "id").withColumn("depth", depth.cast("bigint")).drop("steps")


def _arcs(nodes: DataFrame) -> DataFrame:
    """The tour: (arc, next, downs), an arc ``>id`` into each folder and one ``<id`` out of it.

    ``downs`` counts the arcs into folders from ``arc`` to before ``next``.
    """
    order = [F.col(c).asc() for c in ("kind", "sort_order", "created_at", "id")]
    # Roots are siblings; those whose parent is missing come last.
    rows = nodes.select("id", "parent", "sort_order", "created_at", (F.col("ending") == "missing").alias("missing"))
    kind = F.when(F.col("parent").isNull() & F.col("missing"), 1).otherwise(0)
    nth = cut(rank_rows(rows.withColumn("kind", kind), [F.col("parent")], order, "nth").select("id", "parent", "nth"))
    after = nth.select(F.col("parent").alias("a_parent"), (F.col("nth") - 1).alias("a_nth"), F.col("id").alias("sibling"))
    child = nth.where("nth = 1 AND parent IS NOT NULL").select(F.col("parent").alias("c_parent"), F.col("id").alias("child"))
    joined = nth.join(after, F.col("parent").eqNullSafe(F.col("a_parent")) & (F.col("nth") == F.col("a_nth")), "left")
    joined = joined.join(child, F.col("id") == F.col("c_parent"), "left")
    enter, leave = F.concat(F.lit(">"), "id"), F.concat(F.lit("<"), "id")
    down = joined.select(enter.alias("arc"), F.coalesce(F.concat(F.lit(">"), "child"), leave).alias("next"), F.lit(1).cast("bigint").alias("downs"))
    # Past the last root the tour ends.
    onwards = F.coalesce(F.concat(F.lit(">"), "sibling"), F.concat(F.lit("<"), "parent"))
    up = joined.select(leave.alias("arc"), onwards.alias("next"), F.lit(0).cast("bigint").alias("downs"))
    return cut(down.union(up))


def _rank(arcs: DataFrame) -> DataFrame:
    """(arc, downs): arcs into folders from each arc to the end of the tour."""
    state = arcs
    for _ in range(arcs.count().bit_length()):  # each round doubles the known part
        ahead = state.select(*[F.col(c).alias(f"n_{c}") for c in state.columns])
        # Arcs ranked already meet nothing and are dealt by their own name, as in ``climb``.
        met = state.join(ahead, (F.coalesce("next", "arc") == F.col("n_arc")) & F.col("next").isNotNull(), "left")
        downs = F.col("downs") + F.coalesce("n_downs", F.lit(0))
        state = cut(met.select("arc", F.col("n_next").alias("next"), downs.alias("downs")))
    return state.select("arc", "downs")


def number_folders(folders: DataFrame) -> DataFrame:
    """(id, first, last, depth, ending) of every folder.

    ``first`` is the folder's number in pre-order, siblings by sort order, age and id, from 1
    on; ``last`` is the largest number below it.  Folders in or below a cycle have neither,
    and no depth.
    """
    nodes = cut(climb(folders))
    ranked = _rank(_arcs(nodes.where("ending <> 'cycle'")))
    enter = ranked.where(F.col("arc").startswith(">")).select(F.substring("arc", 2, 1 << 30).alias("id"), F.col("downs").alias("e"))
    leave = ranked.where(F.col("arc").startswith("<")).select(F.substring("arc", 2, 1 << 30).alias("id"), F.col("downs").alias("l"))
    total = enter.agg(F.count("*").alias("n"))
    # One row.
    places = enter.join(leave, "id").join(F.broadcast(total))
    first = F.col("n") - F.col("e") + 1
    places = places.select("id", first.alias("first"), (first + F.col("e") - F.col("l") - 1).alias("last"))
    return nodes.select("id", "depth", "ending").join(places, "id", "left").select("id", "first", "last", "depth", "ending")


def subtree(numbers: DataFrame, folder_id: str, include_self: bool = False) -> DataFrame:
    """J6 for one folder: (id, first, distance) of the folders below it, as a range of numbers."""
    found = numbers.where(F.col("id") == folder_id).select("first", "last", "depth").first()
    if found is None or found["first"] is None:
        return numbers.where("false").select("id", "first", F.col("depth").alias("distance"))
    low = found["first"] if include_self else found["first"] + 1
    rows = numbers.where(F.col("first").between(low, found["last"]))
    return rows.select("id", "first", (F.col("depth") - found["depth"]).alias("distance"))


def children_first(numbers: DataFrame, folder_id: str) -> DataFrame:
    """The folders below one, every child before its parent."""
    return subtree(numbers, folder_id).orderBy(F.col("first").desc())
