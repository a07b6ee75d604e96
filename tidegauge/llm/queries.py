"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidegauge import session
from tidegauge.llm import html_render, pieces, jaccard_join, pseudo_likelihood, quality_model, quality_rules, resampling, secret_scan, simhash, templates, token_files, token_rollup, word_runs
from tidegauge.llm.catalog import QUERIES, SQL, register  # noqa: F401
from tidegauge.llm.tables import read


@register()
def op1_quality_rules(spark, sf_dir):
    """Repetition measures and verdict of every document."""
    return quality_rules.repetition(read(spark, sf_dir, "documents"))


@register()
def op2_html_render(spark, sf_dir):
    """Visible text of every page, as its SHA-256 and sizes."""
    pages = html_render.visible_text(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "n_chars", "n_blocks", F.sha2("text", 256).alias("text_sha256"))


@register()
def op4_token_rollup(spark, sf_dir):
    """Totals after three commits over all documents.

    Batch 1 inserts every document under the first tokenizer version. Batch 2 is a day of changes:
    one document in ten is deleted, one in ten recounted by the second version. It is sent twice.
    """
    versions = {name: token_rollup.byte_pair_counter(public_tokenizers.path(f"{name}.tiktoken"),
                                                     public_tokenizers.PATTERN)
                for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    rollup = token_rollup.TokenRollup(spark, session.scratch(spark, "token-rollup"), versions)
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    inserts = docs.withColumns({"seq": F.lit(0), "op": F.lit("insert"),
                                "version": F.lit("byte_bpe_50k")})
    day = docs.withColumns({
        "seq": F.lit(0), "version": F.lit("byte_bpe_multi_50k"),
        "op": F.element_at(F.create_map(F.lit(3), F.lit("revise"), F.lit(7), F.lit("delete")),
                           (F.col("doc_id") % 10).cast("int"))}).filter("op IS NOT NULL")
    rollup.commit(1, inserts)
    for _ in range(2):
        rollup.commit(2, day)
    return rollup.totals()


@register()
def op7_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate group of every document."""
    return simhash.groups(read(spark, sf_dir, "documents"))


@register(secret_scan.report_sql())
def op6_secret_scan(spark, sf_dir):
    """Secrets of every document."""
    return secret_scan.report(read(spark, sf_dir, "documents"))


@register(templates.matches_sql())
def op8_template_matches(spark, sf_dir):
    """Benchmark items that documents hold, as they are or with other values."""
    return templates.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register()
def op9_token_files(spark, sf_dir):
    """Every document's place, length and checksum, read back from the block files."""
    folder = session.scratch(spark, "token-files")
    token_files.write(read(spark, sf_dir, "documents"), folder,
                      public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.read(spark, folder)


@register()
def op3_quality_model(spark, sf_dir):
    """Quality score of every document, learned from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train(docs, read(spark, sf_dir, "labels"))
    return quality_model.scores(docs, model).select(
        "doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register()
def op5_pseudo_likelihood(spark, sf_dir):
    """Pseudo-likelihood of every document under a network trained on all of them."""
    return pseudo_likelihood.word_scored(read(spark, sf_dir, "documents"))


@register()
def op10_piece_lattice(spark, sf_dir):
    """Pieces of every document: their number, checksum, and whether they decode to the text."""
    model = pieces.Model.load(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode(read(spark, sf_dir, "documents"), model, digest=True)


@register()
def op11_word_runs(spark, sf_dir):
    """Runs of repeated words in every document, after the dealt rule has made one in ten periodic."""
    return word_runs.digests(read(spark, sf_dir, "documents"))


@register(resampling.resample_sql())
def op12_resampling(spark, sf_dir):
    """Importance of every document towards the benchmark, and the rank of those drawn."""
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register(jaccard_join.components_sql())
def op13_jaccard_join(spark, sf_dir):
    """Component of every document under shingle sets with a Jaccard similarity of 0.9 or more."""
    return jaccard_join.groups(read(spark, sf_dir, "documents"))
