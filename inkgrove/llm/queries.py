"""The operators applied to the driver's tables; SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.llm import (
    alignment,
    decontamination,
    fingerprints,
    line_dedup,
    near_dup,
    packing,
    page_text,
    quality,
    quotations,
    secrets,
    token_counts,
    toxicity,
    whitening,
)
from inkgrove.llm.common import bound_batches, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return function(spark, sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, similarity 0.85."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs, near_dup.Similarity(words=3, over=85, under=100))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in every document."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *secrets.digests())


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.line_dedup(docs, min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", line_dedup.sha256_hex("text").alias("kept_sha256"))


SQL["op4_line_dedup"] = """
    WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    lines AS (
        SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM texts),
    keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    shared AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT k.doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
    FROM keyed k LEFT JOIN shared s ON s.key = k.key GROUP BY k.doc_id"""


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, "byte_bpe_50k.json", limit=512)


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, with their places in sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of every document and of its edited text."""
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of the label toxic for every document, and whether it was held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out())
    sentences = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s.start, s.end)), ",")
    return scored.select("doc_id", "held_out", "score", "predicted", sentences.alias("offending"))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the evidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.matches(docs, table(spark, sf_dir, "benchmark"))


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_text.main_text(pages, page_text.train(pages))


@query
def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a message that quotes the turns before it, linked and without its quotes."""
    linked = quotations.link_quotes(quotations.quoting(table(spark, sf_dir, "conversations")))
    low = F.lit((1 << 20) - 1)
    return linked.select(
        F.col("scope").cast("long").alias("conv_id"),
        F.col("msg_id").bitwiseAND(low).alias("turn"),
        F.col("reply_to").bitwiseAND(low).alias("reply_to"),
        F.col("root").bitwiseAND(low).alias("root"),
        "depth",
        "position",
        "n_quoted",
        "n_linked",
        F.length("body").cast("long").alias("n_chars"),
        F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"),
    )


@query
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of the label quality for every document, and whether it was held out of training."""
    described = stored(quality.describe(table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    scored = quality.score(described, quality.train(described, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, aligned, with its links held against all documents."""
    linked = alignment.link_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return linked.select("doc_id", *counts, F.col("groups").alias("groups_sha256"))


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four components of largest variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
