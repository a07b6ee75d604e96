"""The classifier, the window network and the rollups."""

import random
import zlib
from collections import Counter

import corpus
import numpy as np
import public_tokenizers
import pytest

from tidegauge import session
from tidegauge.llm import pseudo_likelihood as P, quality_model as Q, queries, token_rollup as R
from tidegauge.llm.tables import read


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op3_quality_model"](spark, folder)
    rows = scored.join(read(spark, folder, "labels"), "doc_id").filter("held_out").collect()
    assert len(rows) > 300
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert right >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    turned = labels.withColumn("quality", Q.F.when(
        Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    a, b = Q.train(docs, labels), Q.train(docs, turned)
    assert np.allclose(a.weights, b.weights) and a.slope == pytest.approx(b.slope)


def test_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    ratios = rng.normal(0, 1, 40)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(120)]
    labels = np.array([int(ratios[r].sum() + rng.normal(0, 1) > 0) for r in rows])

    def primal(w):
        total = 0.0
        signs = np.where(labels == 1, 1, -1)
        share = [np.sum(labels == 0), np.sum(labels == 1)]
        for r, y, s in zip(rows, labels, signs):
            v = ratios[r] / np.linalg.norm(ratios[r])
            total += len(rows) / (2 * share[y]) * max(0, 1 - s * (v @ w[r] + w[-1]))
        return 0.5 * w @ w + total

    w = Q.hinge_weights(rows, labels, ratios, epochs=2000)
    for _ in range(200):
        assert primal(w) <= primal(w + rng.normal(0, 0.02, len(w))) + 2e-2


def test_shapes():
    assert [Q.shape(w) for w in ("The", "the", "THE!!!", "a1b22", "x***", "iPad", "#")] == [
        "Xx", "x", "X!!", "x9x9", "x**", "xX", "#"]


def test_gradient():
    rng = np.random.default_rng(1)
    net = P.Network.start()
    stream, places, _ = P.laid_out([bytes(rng.integers(0, 250, 40).tolist()), b"", b"\x01"])
    learner = P.Learner(net)
    steps = {}
    learner._move = lambda name, gradient: steps.__setitem__(name, gradient)
    learner.step(stream, places)

    def loss(vector):
        return -P.Network.of(vector).log_probabilities(stream, places).mean()

    flat = np.concatenate([steps[k].ravel() for k in (
        "embed", "hidden_offset", "output", "output_offset")])
    at = net.vector().astype(np.float64)
    for i in rng.permutation(np.flatnonzero(np.abs(flat) > 1e-3))[:20]:
        up, down = at.copy(), at.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(flat[i], rel=0.05, abs=2e-4)


def test_scores_are_sums_of_conditionals_and_training_helps(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = P.scored(docs, rounds=3, every=2).collect()
    words = {r.doc_id: len(P.words(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_words for r in rows} == words
    mean = sum(r.log_likelihood for r in rows) / sum(words.values())
    tokenizer = P.Tokenizer(P.vocabulary(docs))
    tokens = [tokenizer(r.text) for r in docs.collect()]
    shares = np.bincount(np.frombuffer(b"".join(tokens), np.uint8), minlength=P.TOKENS)
    shares = shares[shares > 0] / shares.sum()
    assert mean > (shares * np.log(shares)).sum()  # better than each word by itself

    net = P.Network.start(3)
    stream, places, lengths = P.laid_out(tokens[:3])
    logs = net.log_probabilities(stream, places)
    padded = bytes([P.EDGE] * 2) + tokens[1] + bytes([P.EDGE] * 2)
    for i in (0, len(tokens[1]) - 1):
        around = [padded[i], padded[i + 1], padded[i + 3], padded[i + 4]]
        h = np.tanh(sum(net.embed[k][t] for k, t in enumerate(around)) + net.hidden_offset)
        z = net.output @ h + net.output_offset
        assert logs[lengths[0] + i] == pytest.approx(
            z[tokens[1][i]] - np.log(np.exp(z).sum()), rel=1e-4)


def test_every_word_of_every_text_is_learned_from(spark):
    """A token's offset rises where it is a target and falls where it is not."""
    texts = [bytes(range(at, at + n)) for at, n in ((0, 1), (1, 7), (8, 8), (16, 40))]
    for some in (texts, texts[:2]):
        frame = spark.createDataFrame([(t,) for t in some], "tokens binary").coalesce(1)
        for rounds in (1, P.ROUNDS):
            offsets = P.train(frame, rounds).output_offset
            held = list(b"".join(some))
            assert (offsets[held] > 0).all() and (np.delete(offsets, held) < 0).all()


@pytest.mark.parametrize("stored", [P.STORE_WORDS, 300, 0])
def test_words_of_a_group_cost_as_their_counts_say(spark, sf_dir, monkeypatch, stored):
    """The query adds, for each word of a hashed group, its share of the group's occurrences."""
    monkeypatch.setattr(P, "STORE_WORDS", stored)
    monkeypatch.setattr(P, "train", lambda *_: P.Network.start(3))
    extra = corpus.documents(spark).select("doc_id", "text")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").limit(60).unionByName(extra)
    docs = spark.createDataFrame(docs.collect(), "doc_id long, text string")
    monkeypatch.setattr(queries, "read", lambda *_: docs)
    rows = queries.QUERIES["op5_pseudo_likelihood"](spark, sf_dir).collect()
    texts = [r.text for r in docs.collect()]
    counts = Counter(w for t in texts for w in P.words(t))
    known = set(sorted(counts, key=lambda w: (-counts[w], w))[:P.VOCABULARY])
    totals = Counter()
    for w, n in counts.items():
        totals[w if w in known else zlib.crc32(w) % P.GROUPS] += n

    def shares(text):
        return sum(np.log(counts[w] / totals[w if w in known else zlib.crc32(w) % P.GROUPS])
                   for w in P.words(text))

    def key(r):
        return (-1 if r.doc_id is None else r.doc_id, r.n_words)

    tokens = sorted(P.scored(docs).collect(), key=key)
    inside = sorted(zip(docs.collect(), texts), key=lambda x: (
        -1 if x[0].doc_id is None else x[0].doc_id, len(P.words(x[1]))))
    assert len(rows) == len(tokens) == len(texts)
    for got, by_token, (_, text) in zip(sorted(rows, key=key), tokens, inside):
        assert key(got) == key(by_token)
        assert got.log_likelihood - by_token.log_likelihood == pytest.approx(
            shares(text), rel=1e-6, abs=1e-6)
        assert got.mean_log_probability == (
            pytest.approx(got.log_likelihood / got.n_words) if got.n_words else None)


def test_words_of_an_empty_table(spark):
    assert P.word_scored(corpus.documents(spark, [])).collect() == []


def counters():
    return {"v1": lambda: (lambda text: len(text.split())), "v2": lambda: len}


def test_totals_follow_any_changes(spark):
    rng = random.Random(2)
    rollup = R.TokenRollup(spark, session.scratch(spark, "test-rollup"), counters())
    live = {}
    for batch in range(1, 5):
        rows = []
        for seq in range(30):
            op = rng.choice(["insert", "insert", "revise", "delete"])
            text = rng.choice([None, "", "a b c", "one two", "x" * 9])
            rows.append((rng.choice([None, *range(12)]), seq, op, rng.choice(["s", "t", None]),
                         rng.choice(["en", "de"]), text, rng.choice(["v1", "v2"])))
        if batch == 3:
            rows = []
        frame = spark.createDataFrame(rows, "doc_id long, seq long, op string, source string, "
                                            "lang string, text string, version string")
        frame = frame.withColumn("tokens", R.F.lit(1))
        assert rollup.commit(batch, frame)
        assert not rollup.commit(batch, frame)
        for doc_id, _, op, source, lang, text, version in rows:
            if op == "delete":
                live.pop(doc_id, None)
            else:
                n = counters()[version]()(text) if text else 0
                live[doc_id] = (source, lang, version, n)
        want = {}
        for source, lang, version, n in live.values():
            docs, tokens = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (docs + 1, tokens + n)
        got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
        assert got == want
    assert rollup.committed() == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        rollup.commit(0, frame)


def test_a_batch_that_failed_half_way_is_replaced(spark):
    rollup = R.TokenRollup(spark, session.scratch(spark, "test-rollup"), counters())
    rows = [(1, 0, "insert", "s", "en", "a b", "v1")]
    frame = spark.createDataFrame(rows, "doc_id long, seq long, op string, source string, "
                                        "lang string, text string, version string")
    frame.selectExpr("doc_id", "1 AS sign", "source", "lang", "version", "99L AS tokens").write.parquet(
        rollup._folder("ledger", 1))  # what a driver that died left
    assert rollup.totals().collect() == []
    assert rollup.commit(1, frame)
    assert [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()] == [(1, 2)]


def test_rollup_of_the_documents(spark, sf_dir):
    import tiktoken

    count = {v: R.byte_pair_counter(public_tokenizers.path(f"{v}.tiktoken"),
                                    public_tokenizers.PATTERN)()
             for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    want = {}
    for r in read(spark, sf_dir, "documents").collect():
        if r.doc_id % 10 == 7:
            continue
        version = "byte_bpe_multi_50k" if r.doc_id % 10 == 3 else "byte_bpe_50k"
        docs, tokens = want.get((r.source, r.lang, version), (0, 0))
        want[r.source, r.lang, version] = (docs + 1, tokens + count[version](r.text))
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens)
           for r in queries.QUERIES["op4_token_rollup"](spark, sf_dir).collect()}
    assert got == want and tiktoken


def test_log_count_ratios_are_those_of_plain_counts(spark, sf_dir):
    """Indicators of every labelled row that is not held out, counted one by one."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = Q.train(docs.select("doc_id", "text"), labels)
    label = {r.doc_id: r.quality for r in labels.collect()}
    counts = np.ones((Q.DIMENSIONS, 2))
    for row in docs.collect():
        if row.doc_id in label and zlib.crc32(str(row.doc_id).encode()) % 5:
            for feature in set(Q.features(row.text).tolist()):
                counts[feature, label[row.doc_id]] += 1
    shares = counts / counts.sum(axis=0)
    assert np.allclose(model.ratios, np.log(shares[:, 1] / shares[:, 0]))
