"""Near-duplicate groups with HyperMinHash sketches (operator 1).

A document is its set of word shingles.

1. *Sketch.* Shingle hashes fall into buckets by their leading bits; each bucket's
   register keeps the leading-zero count of its smallest hash and the mantissa bits that
   follow, 16 bits in all.  Empty registers borrow from buckets chosen by a fixed hash, so
   that small sets fill all bands alike.
2. *Classes.* Documents with equal sets become one class; only classes are compared.
3. *Bands.* Four registers make one band key.  Classes that share a band key are
   candidates.  In each bucket of candidates the member that shares most elsewhere becomes
   the centre, and every other member is paired with it: a star, never all pairs.
4. *Estimate.* The share of equal registers, corrected for registers that are equal by
   collision, splits pairs into near and far.
5. *Confirm.* Near pairs are compared on their full sets, which also gives each member's
   difference to the centre.
6. *The rest of a bucket.* Two members of a star that are not both linked to its centre
   c can be similar only if their differences to c meet: with A what of c is missing and B
   what is new, their overlap is |c| - |A1| - |A2| + |A1 n A2| + |B1 n B2|.  A join on the
   rarest elements of the differences therefore finds all such pairs, and the differences
   give their exact similarity.  Members far from the centre are compared with the whole bucket by sketch,
   in blocks of bounded size; only pairs that look near leave a block.
7. Linked classes are joined to components.

A pair at the threshold is missed if it shares none of the 32 bands, with probability
(1 - t^4)^32, below 1e-10 for 0.85 and 1e-7 for 0.8, or if its estimate is off by more
than the margin, six standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.llm.common import (
    ASCII_LOWER,
    map_batches,
    mix,
    shingle_hashes,
    signed,
    stored,
    text_bytes,
    values,
    word_hashes,
)
from inkgrove.llm.components import components
from inkgrove.plans.lineage import cut

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
ROWS = 4
BANDS = REGISTERS // ROWS
BLOCK = 512
# Parts of a star that take its centre's number apart from each other.
SHARES = 16
# Python tasks are sized by the number of classes; smaller tasks only start more workers.
CLASSES_PER_TASK = 4000


@dataclass(frozen=True)
class Similarity:
    """Shingle size in words, and the threshold as a fraction ``over / under``."""

    words: int = 5
    over: int = 80
    under: int = 100

    @property
    def value(self) -> float:
        return self.over / self.under

    @property
    def least_size(self) -> int:
        """Smaller sets can only be linked to equal ones."""
        n = 1
        while self.under * n < self.over * (n + 1):
            n += 1
        return n

    @property
    def cut(self) -> float:
        """Estimates below it count as far: six standard deviations under the threshold."""
        return self.value - 6 * float(np.sqrt(self.value * (1 - self.value) / REGISTERS))


def _donors() -> np.ndarray:
    """For each bucket, the order in which it looks for a register to borrow."""
    rank = mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(0xD0)).reshape(REGISTERS, REGISTERS)
    return np.argsort(rank, axis=1)


DONORS = _donors()


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted distinct 64-bit hashes; all zero without any."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = (hashes[first] << np.uint64(BUCKET_BITS)) | np.uint64(1)
    zeros = 64 - np.frexp(rest.astype(np.float64))[1]
    zeros = np.maximum(zeros, 0)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out[bucket[first]] = (zeros << MANTISSA_BITS) + mantissa.astype(np.int64) + 1
    empty = np.flatnonzero(out == 0)
    if len(empty):
        filled = out != 0
        order = DONORS[empty]
        lender = order[np.arange(len(empty)), np.argmax(filled[order], axis=1)]
        out[empty] = out[lender]
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The registers, four to a 64-bit number."""
    return registers(hashes).view(np.int64)


def bucket_keys(bands: np.ndarray) -> np.ndarray:
    """One key for a band's place and its registers, from rows of band keys."""
    place = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return signed(mix(mix(bands.view(np.uint64)) + place))


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of sets of n and m elements are equal without a common minimum."""
    rho = np.arange(0, 50)
    high, low = 1 - 0.5 ** (rho + 1), 1 - 0.5 ** np.maximum(rho, 0)

    def zeros(size):
        each = np.maximum(1.0, size[:, None] / REGISTERS)
        return high**each - np.where(rho > 0, low, 0.0) ** each

    return (zeros(n) * zeros(m)).sum(1) / (1 << MANTISSA_BITS)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity from registers (rows of uint16) and set sizes."""
    equal = (a == b).mean(1)
    chance = collision_rate(n, m)
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; words are runs without ASCII white space."""
    return shingle_hashes(word_hashes().of(text.translate(ASCII_LOWER).split()), words)


def _digest(hashes: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), ">i8").astype(np.int64)


def sketches(docs: DataFrame, words: int, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, n, hi, lo, bands): set size, digest of the set and band keys of every row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        rows = batch.num_rows
        sizes, digests, keys = np.zeros(rows, np.int64), np.zeros((rows, 2), np.int64), np.zeros((rows, BANDS), np.int64)
        for i, text in enumerate(batch.column(1)):
            hashes = shingles(text.as_py(), words)
            sizes[i], digests[i], keys[i] = len(hashes), _digest(hashes), band_keys(hashes)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
        arrays = [batch.column(0), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1]), bands]
        yield pa.RecordBatch.from_arrays(arrays, [id_column, "n", "hi", "lo", "bands"])

    schema = f"`{id_column}` {kind}, n long, hi long, lo long, bands array<long>"
    return map_batches(docs.select(id_column, text_bytes(column)), run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """Registers, one row per entry, of a column of band keys."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, REGISTERS)


def _members(batch: pa.RecordBatch):
    """(key, node) of every bucket that the classes (node, bands) fall into."""
    bands = batch.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
    node = np.repeat(batch.column("node").to_numpy(), BANDS)
    yield pa.RecordBatch.from_arrays([pa.array(bucket_keys(bands).ravel()), pa.array(node)], ["key", "node"])


def _near(pairs: DataFrame, classes: DataFrame, cut: float, tasks: int) -> DataFrame:
    """Add ``near`` to pairs (u, v): whether the estimated similarity reaches ``cut``."""
    sides = [classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bands").alias(f"b_{s}")) for s in "uv"]

    def run(batch: pa.RecordBatch):
        size = [batch.column(f"n_{s}").to_numpy().astype(float) for s in "uv"]
        near = estimate(_matrix(batch.column("b_u")), _matrix(batch.column("b_v")), *size) >= cut
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(near)], ["u", "v", "near"])

    return map_batches(pairs.join(sides[0], "u").join(sides[1], "v").coalesce(tasks), run, "u long, v long, near boolean")


def _blocks(members: DataFrame, classes: DataFrame, cut: float, tasks: int) -> DataFrame:
    """Near pairs (u, v) with a far member, among (key, node, size, fars, far) of whole buckets.

    A bucket is dealt into blocks of about ``BLOCK`` members, its far members once more into
    blocks of guests.  A block meets a block of guests in one bounded group; a bucket with
    few far members is copied once.  A pair leaves the group of the first bucket it shares.
    """
    def place(seed, n):
        return F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")

    blocks, guests = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("size", "fars"))
    home = members.select("*", F.lit(False).alias("guest"), place(0, blocks).alias("i"), F.explode(F.sequence(F.lit(0), guests - 1)).alias("j"))
    guest = members.where("far").select(
        "*", F.lit(True).alias("guest"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), place(1, guests).alias("j")
    )
    dealt = home.union(guest).select("key", "i", "j", "node", "far", "guest").join(classes.select("node", "n", "bands"), "node")

    def compare(bucket, nodes, far, guest, sizes, bands):
        regs, keys = np.ascontiguousarray(bands).view(np.uint16), bucket_keys(bands)
        for at in np.flatnonzero(guest):
            # Two far members meet once: the smaller as guest.
            other = np.flatnonzero(~guest & (~far | (nodes > nodes[at])))
            if len(other):
                mine = np.broadcast_to(regs[at], (len(other), REGISTERS))
                same = estimate(regs[other], mine, sizes[other], np.full(len(other), sizes[at]))
                first = np.argmax(bands[other] == bands[at], axis=1)
                other = other[(same >= cut) & (keys[at, first] == bucket)]
                yield np.full(len(other), nodes[at]), nodes[other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "node", "far", "guest", "n")]
                rows.append(batch.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS))
                held = rows if held is None else [np.concatenate(c) for c in zip(held, rows)]
                if not len(held[0]):
                    continue
            if held is None:
                return
            key, i, j = held[:3]
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            ends = np.r_[starts[1:], len(key)]
            whole = len(starts) - (batch is not None)  # the last group may go on in the next batch
            found = [pair for s, e in zip(starts[:whole], ends[:whole]) for pair in compare(key[s], *(c[s:e] for c in held[3:]))]
            held = [c[starts[-1] :] for c in held]
            u, v = (np.concatenate([np.empty(0, np.int64), *side]) for side in (zip(*found) if found else [(), ()]))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    sorted_ = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").coalesce(tasks)
    return sorted_.mapInArrow(run, "u long, v long")


def _confirm(pairs: DataFrame, texts: DataFrame, like: Similarity, tasks: int) -> DataFrame:
    """Compare pairs (u, v, star) on full sets: adds n_u, n_v, missing, linked and diff.

    ``missing`` counts the elements of v that u lacks; ``diff`` holds these, then the
    elements that only u has, for pairs of a star.
    """
    words, over, under = like.words, like.over, like.under
    schema = "u long, v long, star boolean, n_u long, n_v long, missing long, linked boolean, diff array<long>"

    def run(batch: pa.RecordBatch):
        sets: dict[int, np.ndarray] = {}

        def of(node, text, hi):
            if node not in sets:
                hashes = shingles(text, words)
                # Rows may share an id; only the text the class was made from counts.
                sets[node] = hashes if _digest(hashes)[0] == hi else None
            return sets[node]

        out, diffs = [], []
        columns = ("u", "v", "star", "t_u", "t_v", "h_u", "h_v")
        for u, v, star, t_u, t_v, h_u, h_v in zip(*(values(batch.column(c)) for c in columns)):
            a, b = of(u, t_u, h_u), of(v, t_v, h_v)
            sets.pop(u, None)
            if a is None or b is None:
                sets.pop(v, None)
                continue
            common = len(np.intersect1d(a, b, assume_unique=True))
            linked = under * common >= over * (len(a) + len(b) - common)
            sides = (np.setdiff1d(b, a, assume_unique=True), np.setdiff1d(a, b, assume_unique=True)) if star else ()
            diffs.append(signed(np.concatenate([np.empty(0, np.uint64), *sides])))
            out.append((u, v, star, len(a), len(b), len(b) - common, linked))
        fields = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.bool_()]
        arrays = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, fields)]
        ends = np.cumsum([0, *map(len, diffs)]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *diffs]))))
        yield pa.RecordBatch.from_arrays(arrays, [p.split()[0] for p in schema.split(", ")])

    sides = [
        texts.select(F.col("node").alias(s), F.col("text").alias(f"t_{s}"), F.col("hi").alias(f"h_{s}")) for s in "uv"
    ]
    return map_batches(pairs.join(sides[0], "u").join(sides[1], "v").coalesce(tasks), run, schema)


def _beside_centre(stars: DataFrame, like: Similarity) -> DataFrame:
    """Linked pairs (a, b) of members of a star of which one or both aren't linked to its centre.

    Let a member lack ``a`` elements of the centre's ``n`` and have ``b`` others.  Members
    1 and 2 are linked if their differences share at least

        (under * (a1 + a2) + over * (b1 + b2) - n * (under - over)) / (under + over)

    elements.  Without member 2's terms this is positive exactly if member 1 isn't linked to
    the centre.  So each member must find one of its rarest elements, as many as it has beyond
    the least number it must share, in the other's difference; and both must have enough
    elements, missing and new, that some other member has too.
    """
    over, under = like.over, like.under
    own = under * F.col("a") + over * F.col("b")
    rows = stars.select("v", "u", "n_u", "n_v", "linked", "diff", F.col("missing").alias("a"))
    rows = rows.withColumn("b", F.size("diff") - F.col("a")).withColumn("own", own)
    rows = rows.withColumn("base", F.col("n_v") * (under - over))
    loose = rows.where("NOT linked").groupBy("v").agg(F.min(F.col("own") - F.col("base")).alias("excess"))
    # A centre's one number goes to all shares of its star.
    loose = loose.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    rows = rows.withColumn("share", F.pmod(F.xxhash64("u"), F.lit(SHARES)).cast("int")).join(loose, ["v", "share"])
    rows = rows.withColumn("least", F.ceil((F.col("excess") + F.col("own")) / (over + under)))

    single = rows.select("v", "u", "linked", "least", "own", "base", "a", F.posexplode("diff").alias("i", "x"))
    spread = single.groupBy("v", "x").agg(F.count("*").alias("held"))
    rated = single.join(spread, ["v", "x"])
    both_have = F.col("held") > 1
    listed = rated.groupBy("v", "u", "linked", "least", "own", "base").agg(
        F.sort_array(F.collect_list(F.struct("held", "x"))).alias("xs"),
        F.count_if(both_have & (F.col("i") < F.col("a"))).alias("sa"),
        F.count_if(both_have & (F.col("i") >= F.col("a"))).alias("sb"),
    )
    listed = listed.where(F.col("sa") + F.col("sb") >= F.col("least"))
    # Elements in one order for the whole star: after a first common one, at most the rest can follow.
    listed = listed.select("*", F.posexplode("xs").alias("i", "e")).where("e.held > 1")
    listed = stored(listed.withColumn("rest", F.size("xs") - F.col("i")).drop("i", "xs"), "listed")
    left = listed.where("NOT linked").select("v", "u", "own", "base", "sa", "sb", "rest", "e")
    rarest = listed.where("rest >= least")
    right = rarest.select("v", "e", *[F.col(c).alias(f"{c}2") for c in ("u", "own", "sa", "sb", "rest")])
    most = F.least(F.least("sa", "sa2") + F.least("sb", "sb2"), "rest", "rest2")
    enough = F.col("own") + F.col("own2") - F.col("base") <= (over + under) * most
    right = right.withColumnsRenamed({"v": "v2", "e": "e2"})
    same = (F.col("v") == F.col("v2")) & (F.col("e.x") == F.col("e2.x")) & (F.col("u") != F.col("u2"))
    met = left.join(right, same & enough)
    pairs = met.select("v", F.least("u", "u2").alias("u"), F.greatest("u", "u2").alias("u2")).distinct()
    sides = stars.select("v", "u", "n_u", "n_v", F.col("missing").alias("a"), "diff")
    other = sides.select("v", *[F.col(c).alias(f"{c}2") for c in ("u", "n_u", "a", "diff")])
    both = stored(pairs, "met").join(sides, ["v", "u"]).join(other, ["v", "u2"])
    common = F.col("n_v") - F.col("a") - F.col("a2") + F.size(F.array_intersect("diff", "diff2"))
    union = F.col("n_u") + F.col("n_u2") - common
    return both.where(under * common >= over * union).select(F.col("u").alias("a"), F.col("u2").alias("b"))


def links(
    classes: DataFrame, docs: DataFrame, like: Similarity, id_column: str, column: str
) -> DataFrame:
    """Linked pairs (a, b) of classes (node, n, hi, bands); a node is the class' smallest id.

    Tables that several steps read are stored, the wide ones row by row: writing columns takes
    more of an executor's memory.  So no plan repeats the steps before it.
    """
    tasks = max(16, classes.count() // CLASSES_PER_TASK)
    large = classes.where(F.col("n") >= like.least_size).select("node", "bands").coalesce(tasks)
    members = map_batches(large, _members, "key long, node long")
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(members.join(sizes, "key"))
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighted = members.join(weights, "node")
    centres = weighted.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("v"))
    around = cut(members.join(centres, "key").where("node <> v").drop("size"))

    pairs = around.select(F.col("node").alias("u"), "v").distinct()
    rated = stored(_near(pairs, classes, like.cut, tasks), "rated")
    apart = rated.where("NOT near").select("u", F.col("v").alias("centre"))
    far = around.join(apart, (F.col("node") == F.col("u")) & (F.col("v") == F.col("centre")), "left_semi")
    far = stored(far.select("key", "node", F.lit(True).alias("far")), "far")
    mixed = members.join(far.groupBy("key").agg(F.count("*").alias("fars")), "key")
    mixed = mixed.join(far, ["key", "node"], "left").withColumn("far", F.coalesce("far", F.lit(False)))
    extra = stored(_blocks(mixed, classes, like.cut, tasks).distinct(), "extra")

    stars = rated.where("near").select("u", "v", F.lit(True).alias("star"))
    wanted = stars.union(extra.withColumn("star", F.lit(False)))
    nodes = wanted.select(F.col("u").alias("node")).union(wanted.select("v")).distinct()
    # Only candidates' texts are moved.
    known = classes.join(nodes, "node", "left_semi").select("node", "hi")
    texts = docs.select(F.col(id_column).alias("node"), text_bytes(column).alias("text"))
    texts = texts.join(known.hint("shuffle_hash"), "node").select("node", "hi", "text")
    compared = stored(_confirm(wanted, texts, like, tasks), "compared")
    straight = compared.where("linked").select(F.col("u").alias("a"), F.col("v").alias("b"))
    return straight.union(_beside_centre(compared.where("star"), like))


def near_duplicates(
    docs: DataFrame, like: Similarity = Similarity(), id_column: str = "doc_id", column: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Rows are linked when their sets of word shingles have a similarity of at least
    ``like``; ``component_id`` is the smallest id reachable over links, a row's own
    included, and ``kept`` marks the row that bears it.  Rows without words (null, empty
    or blank texts) are linked with nothing.  Rows with a null id take no part: their
    component is null and they are kept.  Repeated rows (same id) share a component.
    Texts are used whole.  An empty table gives an empty result; other columns of
    ``docs`` are ignored.  Ids are integers.
    """
    found = cut(sketches(docs, like.words, id_column, column).withColumnRenamed(id_column, "id"))
    rows = found.where("id IS NOT NULL AND n > 0")
    classes = rows.groupBy("hi", "lo").agg(F.min(F.struct("id", "n", "bands")).alias("r"))
    classes = cut(classes.select("hi", "lo", F.col("r.id").alias("node"), "r.n", "r.bands"))
    linked = components(links(classes, docs, like, id_column, column))
    labels = classes.select("hi", "lo", "node").join(linked, "node", "left")
    labels = labels.select("hi", "lo", F.coalesce("component", "node").alias("label"))
    label = F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("id"))
    out = found.drop("bands").join(labels, ["hi", "lo"], "left")
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), label))
    out = out.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
    return stored(out, "near-duplicates")
