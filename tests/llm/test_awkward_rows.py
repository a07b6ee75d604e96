"""Every operator and stage on nulls, empty and long texts, repeats, an empty table and clashing columns."""

import corpus
import public_tokenizers
import pytest

import corpus_pipeline
from tidegauge.llm import (html_render, pieces, pseudo_likelihood, quality_model, quality_rules,
                           secret_scan, simhash, templates, token_files)

ALL = corpus.ids([{"doc_id": r[0]} for r in corpus.ROWS])
MODEL = None


def labels(spark):
    rows = [(6, 1, 0), (6, 1, 0), (6, 0, 1), (4, 0, 0), (5, 1, None), (None, 1, 0), (7, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, corpus.CLEAN), (1, corpus.CLEAN), (2, ""), (3, None),
                                  (None, "An item without an id that nobody has ever copied at all")],
                                 "item_id long, text string")


def rules(spark, docs):
    return quality_rules.repetition(docs)


def quality(spark, docs):
    return quality_model.scores(docs.select("doc_id", "text"),
                                quality_model.train(docs, labels(spark)))


def likelihood(spark, docs):
    return pseudo_likelihood.word_scored(docs, rounds=1, every=2)


def secrets(spark, docs):
    return secret_scan.report(docs)


def groups(spark, docs):
    return simhash.groups(docs)


def encoded(spark, docs):
    model = pieces.Model.load(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.decode(pieces.encode(docs, model), model)


def files(spark, docs):
    from tidegauge import session

    folder = session.scratch(spark, "test-files")
    token_files.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.read(spark, folder)


OPERATORS = [rules, quality, likelihood, secrets, groups, encoded, files]


@pytest.mark.parametrize("operator", OPERATORS)
def test_one_row_for_each_row(spark, operator):
    assert corpus.ids(operator(spark, corpus.documents(spark)).collect()) == ALL


@pytest.mark.parametrize("operator", OPERATORS)
def test_empty_table(spark, operator):
    assert operator(spark, corpus.documents(spark, [])).collect() == []


def test_values_of_empty_texts(spark):
    docs = corpus.documents(spark)
    for r in rules(spark, docs).filter("doc_id IN (1, 2, 3)").collect():
        assert (r.n_words, r.n_repeat_words, r.base_failed, r.kept) == (0, 0, True, False)
    for r in likelihood(spark, docs).filter("doc_id IN (1, 2, 3)").collect():
        assert (r.n_words, r.log_likelihood, r.mean_log_probability) == (0, 0.0, None)
    for r in groups(spark, docs).filter("doc_id IN (1, 2, 3)").collect():
        assert (r.fingerprint, r.component_id) == ("0" * 16, 1)
    for r in files(spark, docs).filter("doc_id IN (1, 2)").collect():
        assert r.n_tokens == 1


def test_templates(spark):
    docs = corpus.documents(spark)
    held = templates.matches(docs, benchmark(spark)).collect()
    assert sorted((r.doc_id, r.item_id, r.share) for r in held) == [(6, 1, 1.0), (7, 1, 1.0)]
    assert templates.matches(corpus.documents(spark, []), benchmark(spark)).collect() == []
    assert templates.matches(docs, benchmark(spark).limit(0)).collect() == []


def test_pages(spark):
    rows = [(None, None), (1, ""), (2, "<p>a<p>b"), (2, "<p>a<p>b"), (3, "<div" * 9000 + ">x")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr(
        "*", "'x' AS text", "1 AS n_chars")
    out = {r.page_id: (r.text, r.n_blocks) for r in html_render.visible_text(pages).collect()}
    assert out[2] == ("a\n\nb", 2) and out[1] == ("", 0) and out[None] == ("", 0)
    assert html_render.visible_text(pages.limit(0)).collect() == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    labels(spark).write.parquet(f"{out}/labels.parquet")
    benchmark(spark).write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.mark.parametrize("rows", [corpus.ROWS, []])
@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, folder, stage, rows):
    docs = corpus.documents(spark, rows)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, folder)
    if stage < 4:
        assert out.columns == docs.columns
    got = corpus.ids(out.collect())
    if not rows:
        assert got == []
    elif stage == 1:  # empty texts are one group, both copies of the clean text another
        assert got == [-1, 1, 4, 5, 6, 7, 8]
    elif stage == 2:
        assert got == [i for i in ALL if i not in (6, 7)]
    elif stage > 2:
        assert got == ALL


def test_redaction(spark, folder):
    docs = corpus.documents(spark).withColumn("n_chars", secret_scan.F.length("text"))
    out = {r.doc_id: r for r in corpus_pipeline.redact(spark, docs, folder).collect()}
    assert out[8].text.endswith("́ [assign]") and out[8].n_chars == len(out[8].text)
    assert out[6].text == corpus.CLEAN and out[1].text is None
