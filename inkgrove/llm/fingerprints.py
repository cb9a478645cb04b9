"""Document fingerprints: bottom-k sketches of shingle hashes (operator 7).

A sketch is the sorted array of the ``k`` smallest distinct hashes of a text's word
shingles.  Sketches merge (the k smallest of both), so a long text may be sketched in
parts.  Two sketches estimate resemblance, containment and the number of distinct
shingles.  Everything here is a Column expression; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5
SPACE = " \t\n\u000b\f\r"
ROWS_PER_SLICE = 256
MAX_SLICES = 4096


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the runs of ``words`` words, in order, with repeats.

    A text with fewer words is one run; a null or blank text has none.
    """
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    parts = F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+", -1)

    def runs(hashes: Column) -> Column:
        last = F.size(hashes) - words
        rolling = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(words)]),
        )
        return F.when(last >= 0, rolling).otherwise(F.array(F.xxhash64(hashes)))

    hashed = _bind(F.transform(parts, lambda w: F.xxhash64(w)), runs)
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(hashed)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Sketch of a text; empty without words."""
    return bottom_k(shingle_hashes(text, words), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of both parts together."""
    return bottom_k(F.concat(a, b), k)


def merge_groups(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group of parts.

    Parts are merged within each input partition first, so a group gathers at most ``k``
    hashes for each partition, however many parts it has.
    """
    local = sketches.select(*keys, column).withColumn("__part", F.spark_partition_id())
    merged = local.groupBy(*keys, "__part").agg(bottom_k(F.flatten(F.collect_list(column)), k).alias(column))
    return merged.groupBy(*keys).agg(bottom_k(F.flatten(F.collect_list(column)), k).alias(column))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    kth = (F.element_at(s, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / kth)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both, 0 to 1; exact for small sets.

    Two empty sketches resemble each other fully, an empty and another not at all.
    """
    both = merge(a, b, k)
    share = _bind(both, lambda m: F.size(F.array_intersect(F.array_intersect(m, a), b)) / F.size(m))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, 0 to 1."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(s: Column) -> Column:
    """A sketch as hex digits, 16 per hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _slice_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``, by binary search."""
    steps = [1 << i for i in reversed(range(max(1, len(bounds).bit_length())))]
    array = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    n = len(bounds)

    def step(found: Column, size: Column) -> Column:
        further = found + size
        fits = (further <= n) & (F.get(array, further - 1) <= key)
        return F.when(fits, further).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def with_next(docs: DataFrame, columns: dict[str, Column], id_column: str = "doc_id") -> DataFrame:
    """Add ``columns``, computed for each row, and the same of the next row as ``next_…``.

    The next row is that of the next smaller id; after the last comes the first, so a
    single row is its own next.  Null ids come last; rows that share an id follow each
    other in an order of their contents.

    Rows are dealt into slices of neighbouring ids, at most ``MAX_SLICES``, each sorted
    on its own; the first row of a slice is also put at the end of the slice before, so
    that the table is shuffled once and no slice is special.
    """
    key = F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(2**63)))
    docs = docs.withColumn("__key", key)
    n = docs.count()
    slices = max(1, min(MAX_SLICES, n // ROWS_PER_SLICE))
    bounds: list[int] = []
    if slices > 1:
        shares = [i / slices for i in range(1, slices)]
        bounds = sorted(set(docs.agg(F.percentile_approx("__key", shares, 20 * slices)).first()[0]))
    cut = docs.withColumn("__slice", _slice_of(F.col("__key"), bounds))
    # At most MAX_SLICES rows: the first id of each slice, and the slice it is shown to.
    heads = sorted(tuple(r) for r in cut.groupBy("__slice").agg(F.max("__key")).collect())
    shown = [(head, heads[(i + 1) % len(heads)][0]) for i, (_, head) in enumerate(heads)]
    spark = docs.sparkSession
    ahead = spark.createDataFrame(shown, "__key long, __shown int")
    places = F.array(
        F.struct(F.col("__slice").alias("at"), F.lit(False).alias("copy")),
        F.struct(F.col("__shown").alias("at"), F.lit(True).alias("copy")),
    )
    placed = cut.join(F.broadcast(ahead), "__key", "left").withColumn("__place", F.explode(places))
    placed = placed.where("__place.at IS NOT NULL").withColumn("__at", F.col("__place.at"))
    placed = placed.withColumn("__copy", F.col("__place.copy")).drop("__place", "__slice", "__shown")
    placed = placed.repartition("__at").withColumns(columns)
    values = [c for c in docs.columns if c != "__key"] + [c for c in columns if c not in docs.columns]
    order = Window.partitionBy("__at").orderBy("__copy", F.desc("__key"), F.xxhash64(*values))
    led = placed.withColumn("__next", F.lead(F.struct(*columns)).over(order)).where("NOT __copy")
    out = led.select(*values, *[F.col("__next")[c].alias(f"next_{c}") for c in columns])
    return out


def fingerprint_documents(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    The edited text has its last floor(n / 2) code points replaced by as many first ones
    of the next document's text, or all it has.  Null texts count as empty.  Of (doc_id,
    text); an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, {"body": F.col("text"), "sketch": sketch(F.col("text"), k, words)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_body", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), k, words))
    own = F.col("sketch")
    return rows.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(own, F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(own, F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(own, k).alias("n_distinct"),
        containment(F.col("edited_sketch"), own, k).alias("edited_in_own"),
    )
