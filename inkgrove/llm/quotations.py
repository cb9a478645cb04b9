"""Conversations from messages that quote each other (operator 6).

Lines that begin with ``>`` are quoted, their number of marks is the level.  Quoted
passages, runs of lines of one level without a blank line, are normalised and hashed, whole
and line by line, and joined to the messages of the same scope that wrote them.  The message
whose text is quoted most at the lowest level that is found at all is the one replied to.
Following replies up gives each conversation's root; messages are then put in reply order,
each after the one it answers, without their quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.llm.common import map_batches, stored, text_or_empty, values
from inkgrove.plans.ordered import rank_rows

MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
# A line that introduces the quote below it.
INTRODUCTION = re.compile(r"^(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$", re.I)


def split_levels(text: str) -> list[tuple[int, str]]:
    """(level, line without its marks) of every line; level 0 is the message's own."""
    out = []
    for line in text.split("\n"):
        m = MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def passages(lines: list[tuple[int, str]]) -> Iterator[tuple[int, list[str]]]:
    """(level, lines) of the runs of lines of one level without a blank line."""
    level, run = -1, []
    for at, line in [*lines, (-1, "")]:
        if at != level or not line.strip():
            if run:
                yield level, run
            level, run = at, []
        if line.strip():
            run.append(line)


def body_of(lines: list[tuple[int, str]]) -> str:
    """The message's own lines; introductions of quotes and surrounding blank lines go."""
    own = []
    for i, (level, line) in enumerate(lines):
        after = next((at for at, rest in lines[i + 1 : i + 3] if rest.strip()), 0)
        if level == 0 and not (after > 0 and INTRODUCTION.match(line.strip())):
            own.append(line)
    return "\n".join(own).strip("\n")


def units(text: str) -> list[tuple[int, int, int, int]]:
    """(level, high hash, low hash, characters) of every passage, and of its lines."""
    out = []
    for level, run in passages(split_levels(text)):
        lines = [" ".join(line.split()).casefold() for line in run]
        whole = " ".join(lines)
        for text_ in {whole, *lines}:
            high, low = np.frombuffer(xxhash.xxh3_128_digest(text_.encode()), ">i8").tolist()
            out.append((level, high, low, len(text_)))
    return out


def link_quotes(
    messages: DataFrame, id_column: str = "msg_id", scope: str = "scope", order: str = "sent", column: str = "text"
) -> DataFrame:
    """Messages in reply order, without quotes.

    ``messages`` has an id (long, unique), a scope in which quotes are looked for (any type;
    null is a scope like others), an order (long; a message can only answer an earlier one,
    ties by id) and a text.  Returns id, scope, ``reply_to`` (id or null), ``root``,
    ``depth`` (0 for a root), ``position`` (from 1 within the conversation, by depth, order
    and id), ``body``, ``n_quoted`` and ``n_linked`` (quoted passages and lines, and those
    found).

    A passage that several earlier messages wrote is credited to the first.  Null, empty and
    blank texts quote nothing and have empty bodies; quotes of unknown messages are dropped
    from the body and link nothing; rows with a null id or order are left out of linking and
    come back as roots of their own with a null position.  Repeated rows are taken as one.
    Empty tables give empty results; other columns are ignored.
    """
    rows = messages.select(
        F.col(id_column).cast("long").alias("id"), F.col(scope).cast("string").alias("scope"),
        F.col(order).cast("long").alias("sent"), text_or_empty(column).alias("text"),
    ).distinct()
    listed = "id long, scope string, sent long, body string, units array<struct<level:int,high:long,low:long,size:int>>"

    def parse(batch: pa.RecordBatch):
        found, bodies = [], []
        for text in values(batch.column("text")):
            bodies.append(body_of(split_levels(text)))
            found.append([dict(zip(("level", "high", "low", "size"), u)) for u in units(text)])
        kind = pa.list_(pa.struct([("level", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("size", pa.int32())]))
        arrays = [*(batch.column(c) for c in ("id", "scope", "sent")), pa.array(bodies, pa.string()), pa.array(found, kind)]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "scope", "sent", "body", "units"])

    parsed = stored(map_batches(rows, parse, listed), "messages")
    known = parsed.where("id IS NOT NULL AND sent IS NOT NULL")
    single = known.select("id", "scope", "sent", F.explode("units").alias("u")).select("id", "scope", "sent", "u.*")
    # However often a passage was written, one row of it is joined: its first author.
    written = single.where("level = 0").groupBy("scope", "high", "low").agg(F.min(F.struct("sent", "id")).alias("by"))
    quoted = single.where("level > 0")
    earlier = F.col("by") < F.struct("sent", "id")
    written = written.select(F.col("scope").alias("s2"), F.col("high").alias("h2"), F.col("low").alias("l2"), "by")
    same = F.col("scope").eqNullSafe(F.col("s2")) & (F.col("high") == F.col("h2")) & (F.col("low") == F.col("l2"))
    found = quoted.join(written, same)
    found = found.where(earlier)
    weighed = found.groupBy("id", "level", "by").agg(F.sum("size").alias("chars"), F.count("*").alias("n"))
    best = F.min(F.struct(F.col("level"), (-F.col("chars")).alias("chars"), (-F.col("by.sent")).alias("late"), F.col("by.id").alias("to")))
    parents = stored(weighed.groupBy("id").agg(best["to"].alias("reply_to"), F.sum("n").alias("n_linked")), "parents")

    # Pointer doubling: after k rounds every message points 2^k replies up, or to its root.
    ups = known.select("id").distinct().join(parents.select("id", "reply_to"), "id", "left")
    ups = ups.select("id", F.coalesce("reply_to", "id").alias("up"), F.col("reply_to").isNotNull().cast("long").alias("depth"))
    ups = stored(ups, "replies")
    finished, pending = ups.where("id = up"), ups.where("id <> up")
    while pending.limit(1).count():
        # Messages that have reached their root take no further part.
        reached = finished.union(pending)
        above = reached.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        joined = stored(pending.join(above, "up"), "replies")
        finished = finished.union(joined.where("further = up").select("id", "up", "depth"))
        pending = joined.where("further <> up").select("id", F.col("further").alias("up"), F.expr("depth + more AS depth"))
    ups = finished

    placed = known.select("id", "sent").join(ups.withColumnRenamed("up", "root"), "id")
    placed = rank_rows(placed, [F.col("root")], [F.col("depth"), F.col("sent"), F.col("id")], "position")
    n_quoted = F.size(F.filter("units", lambda u: u.level > 0)).cast("long")
    own = parsed.select("id", "scope", "body", n_quoted.alias("n_quoted"))
    out = own.join(placed.select("id", "root", "depth", "position"), "id", "left").join(parents, "id", "left")
    return out.select(
        F.col("id").alias(id_column), F.col("scope").alias(scope), "reply_to", F.coalesce("root", "id").alias("root"),
        F.coalesce("depth", F.lit(0)).alias("depth"), "position", "body", "n_quoted",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )


def quoting(conversations: DataFrame) -> DataFrame:
    """(msg_id, scope, sent, text): turns as messages that quote the two turns before them.

    ``conversations`` has conv_id, turn and text.  The turn before is quoted at level one,
    the one before that at level two, above the turn's own text.  Turns that occur twice are
    taken once.
    """
    turns = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(
        F.min(F.coalesce("text", F.lit(""))).alias("text")
    )

    def before(n: int) -> DataFrame:
        marks = ">" * n + " "
        quoted = F.concat(F.lit(marks), F.replace("text", F.lit("\n"), F.lit("\n" + marks)), F.lit("\n"))
        return turns.select("conv_id", (F.col("turn") + n).alias("turn"), quoted.alias(f"quoted{n}"))

    both = turns.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    blank = F.lit("")
    text = F.concat(F.coalesce("quoted2", blank), F.coalesce("quoted1", blank), F.lit("\n"), "text")
    number = F.shiftleft(F.col("conv_id"), 20) + F.col("turn")
    return both.select(number.alias("msg_id"), F.col("conv_id").alias("scope"), F.col("turn").alias("sent"), text.alias("text"))
