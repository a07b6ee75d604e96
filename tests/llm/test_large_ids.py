"""Ids above 2^53 beside NULL ids come out of every operator and stage as they went in."""

import corpus
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_awkward_rows import OPERATORS, benchmark, folder, labels  # noqa: F401
from tidegauge import session
from tidegauge.llm import (html_render, jaccard_join, pseudo_likelihood, resampling, simhash, templates,
                           token_rollup, word_runs)

IDS = corpus.ids([{"doc_id": r[0]} for r in corpus.LARGE])
MORE = [word_runs.digests, jaccard_join.groups, lambda d: resampling.resample(d, d),
        lambda d: pseudo_likelihood.word_scored(d, rounds=1)]


@pytest.mark.parametrize("operator", [*OPERATORS, *[lambda s, d, f=f: f(d) for f in MORE]])
def test_operators(spark, operator):
    docs = corpus.large_ids(spark)
    assert corpus.ids(operator(spark, docs).collect()) == IDS


def test_groups_of_large_ids(spark):
    for out in (simhash.groups(corpus.large_ids(spark)), jaccard_join.groups(corpus.large_ids(spark))):
        assert all(r.component_id == r.doc_id for r in out.collect())


def test_templates_and_pages(spark):
    docs = corpus.large_ids(spark)
    item = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("item_id"), "text")
    held = templates.matches(docs, item).collect()
    assert {(r.doc_id, r.item_id) for r in held} >= {(i, i) for i in IDS if i > 0}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))
    out = html_render.visible_text(pages).collect()
    assert sorted(-1 if r.page_id is None else r.page_id for r in out) == IDS


def test_rollup(spark):
    counter = token_rollup.byte_pair_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                             public_tokenizers.PATTERN)
    rollup = token_rollup.TokenRollup(spark, session.scratch(spark, "large-ids"), {"v": counter})
    changes = corpus.large_ids(spark).withColumns(
        {"seq": F.when(F.col("doc_id").isNotNull(), F.col("doc_id")), "op": F.lit("insert"),
         "version": F.lit("v")})
    rollup.commit(1, changes)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in rollup.live().collect()) == IDS
    rollup.commit(2, changes.withColumn("op", F.when(F.col("doc_id") == IDS[-1], "delete").otherwise("insert")))
    assert [r.n_docs for r in rollup.totals().collect()] == [40]


@pytest.mark.parametrize("stage", [1, 2, 3, 4])
def test_stages(spark, folder, stage):  # noqa: F811
    docs = corpus.large_ids(spark)
    assert corpus.ids(corpus_pipeline.STAGES[stage][1](spark, docs, folder).collect()) == IDS
