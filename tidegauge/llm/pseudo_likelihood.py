"""Pseudo-likelihood of texts: a window network predicts every word from both of its sides.

Words become 256 tokens: the most frequent words of the whole corpus, the rest in hashed groups. The
network adds an embedding per token and place of the two words before and the two after, squashes
the sum and predicts the hidden token by a softmax. Training goes in rounds: every task improves the
shared weights on every word of its texts by gradient steps in numpy, and the tasks' weights are
averaged by their numbers of words.

A word's probability is that of its token by the network times its share of the token's occurrences,
from the counts of all words of the corpus: a frequent word is its token, one of a hashed group has
its own count over the group's. The shares of the ``STORE_WORDS`` most frequent words go to every
task, those of the others are joined. A text's score is the sum of its words' log-probabilities.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import session
from tidegauge.llm.tables import numbered, spelled

TOKENS = 256
GROUPS = 64
EDGE = TOKENS - 1  # beyond the text's ends
VOCABULARY = TOKENS - GROUPS - 1
PLACES = (-2, -1, 1, 2)
REACH = max(PLACES)
HIDDEN = 16
ROUNDS = 3
TRAIN_EVERY = 1  # words of each text per word that a round learns from
BATCH = 512
CHUNK = 512
RATE = 0.1

_WHITE = r"[\x20\x09-\x0D]+"
_KNOWN_WORDS = 1 << 18
STORE_WORDS = 1 << 16


def words(text: str | None) -> list[bytes]:
    """A to Z in lower case, cut at white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of every word of all texts."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (docs.select(F.explode(F.split(lowered, _WHITE)).alias("word")).filter("word <> ''")
            .groupBy("word").agg(F.count("*").alias("n")))


def most_frequent(counts: DataFrame, size: int = VOCABULARY) -> list[str]:
    """The most frequent words; ties go by the word."""
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> list[str]:
    return most_frequent(word_counts(docs), size)


def log_shares(counts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``word, n, log_share``: of the words beyond the vocabulary, in their hashed groups."""
    group = F.crc32(F.col("word").cast("binary")) % GROUPS
    others = counts.filter(~F.col("word").isin(vocabulary)) if vocabulary else counts
    totals = {r.g: r.n for r in others.groupBy(group.alias("g")).agg(F.sum("n").alias("n")).collect()}
    of_groups = F.array(*[F.lit(math.log(totals.get(g, 1))) for g in range(GROUPS)])
    return others.select("word", "n", (F.log("n") - F.get(of_groups, group.cast("int"))).alias("log_share"))


def least_stored(counts: DataFrame, size: int) -> int:
    """The count from which on words are at most ``size``."""
    least, held = 1 << 62, 0
    for n, words_of in sorted(counts.groupBy("n").agg(F.count("*")).collect(), reverse=True):
        held += words_of
        if held > size:
            break
        least = n
    return least


class Tokenizer:
    """Token numbers of words; of words beyond the vocabulary a bounded store is kept."""

    def __init__(self, vocabulary: list[str]) -> None:
        self._fixed = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(vocabulary)}
        self._known = dict(self._fixed)

    def __call__(self, text: str | None) -> bytes:
        found = words(text)
        numbers = list(map(self._known.get, found))
        if None in numbers:
            if len(self._known) > _KNOWN_WORDS:
                self._known = dict(self._fixed)
            for w in found:
                if w not in self._known:
                    self._known[w] = VOCABULARY + zlib.crc32(w) % GROUPS
            numbers = list(map(self._known.__getitem__, found))
        return bytes(numbers)


@dataclass(frozen=True)
class Network:
    """``embed`` by place and token, ``output`` by token, and their offsets."""
    embed: np.ndarray
    hidden_offset: np.ndarray
    output: np.ndarray
    output_offset: np.ndarray

    @staticmethod
    def start(seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(HIDDEN)
        return Network(
            rng.normal(0, scale, (len(PLACES), TOKENS, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            rng.normal(0, scale, (TOKENS, HIDDEN)).astype(np.float32),
            np.zeros(TOKENS, np.float32))

    def vector(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (self.embed, self.hidden_offset, self.output,
                                                   self.output_offset)])

    @staticmethod
    def of(vector: np.ndarray) -> Network:
        like = Network.start()
        out, at = [], 0
        for a in (like.embed, like.hidden_offset, like.output, like.output_offset):
            out.append(vector[at:at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(*out)

    def hidden(self, stream: np.ndarray, places: np.ndarray) -> np.ndarray:
        total = np.repeat(self.hidden_offset[None], len(places), axis=0)
        for k, o in enumerate(PLACES):
            total += self.embed[k][stream[places + o]]
        return np.tanh(total, out=total)

    def log_probabilities(self, stream: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of the tokens at these places of a stream with REACH edges around each text."""
        out = np.empty(len(places), np.float64)
        # One buffer for all chunks: large arrays made anew cost more than what is done with them.
        buffer = np.empty((min(CHUNK, len(places)), TOKENS), np.float32)
        turned = np.ascontiguousarray(self.output.T)
        for at in range(0, len(places), CHUNK):
            some = places[at:at + CHUNK]
            logits = np.matmul(self.hidden(stream, some), turned, out=buffer[:len(some)])
            logits += self.output_offset
            logits -= logits.max(axis=1, keepdims=True)
            own = logits[np.arange(len(some)), stream[some]]
            out[at:at + CHUNK] = own - np.log(np.exp(logits, out=logits).sum(axis=1))
        return out


class Learner:
    """Gradient steps with a step size per weight that falls with its past gradients (Adagrad)."""

    def __init__(self, network: Network, rate: float = RATE) -> None:
        self.net = replace(network, **{k: v.copy() for k, v in vars(network).items()})
        self.past = {k: np.full_like(v, 1e-6) for k, v in vars(network).items()}
        self.rate = rate
        self._buffer = np.empty((BATCH, TOKENS), np.float32)

    def step(self, stream: np.ndarray, places: np.ndarray) -> None:
        n, net = len(places), self.net
        if n > len(self._buffer):
            self._buffer = np.empty((n, TOKENS), np.float32)
        h = net.hidden(stream, places)
        p = np.matmul(h, net.output.T, out=self._buffer[:n])
        p += net.output_offset
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True) * n
        p[np.arange(n), stream[places]] -= np.float32(1 / n)
        back = (p @ net.output) * (1 - h * h)
        self._move("output", p.T @ h)
        self._move("output_offset", p.sum(axis=0))
        self._move("hidden_offset", back.sum(axis=0))
        # Rows of the same place and token are summed next to each other.
        rows = np.concatenate([stream[places + o] + np.uint16(k * TOKENS)
                               for k, o in enumerate(PLACES)])
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        embed = np.zeros((len(PLACES) * TOKENS, HIDDEN), np.float32)
        embed[rows[first]] = np.add.reduceat(back[order % n], first)
        self._move("embed", embed.reshape(net.embed.shape))

    def _move(self, name: str, gradient: np.ndarray) -> None:
        past, weights = self.past[name], getattr(self.net, name)
        past += gradient * gradient
        weights -= self.rate * gradient / np.sqrt(past)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One stream of token texts with edges between, the places of their tokens, and their lengths."""
    edge = bytes([EDGE]) * REACH
    stream = np.frombuffer(edge + edge.join(texts) + edge, np.uint8)
    lengths = np.array(list(map(len, texts)), np.int64)
    starts = REACH + np.cumsum(lengths + REACH) - lengths - REACH
    places = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return stream, places, lengths


def batches_of(batch: pd.Series) -> Iterator[list[bytes]]:
    """Texts in bounded groups, a long text by itself."""
    group: list[bytes] = []
    size = 0
    for text in batch:
        if group and size + len(text) > 1 << 20:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def train(tokens: DataFrame, rounds: int = ROUNDS, every: int = TRAIN_EVERY) -> Network:
    """Rounds of local steps and averages over all of ``tokens (tokens binary)``.

    With ``every`` at 1 each round learns from every word of every text. A larger one leaves words
    out: a round then learns from those whose place, counted from a start that the round and the
    text's length give, divides by it, and texts of fewer words may miss rounds.
    """
    network = Network.start()
    spark = tokens.sparkSession
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(network)

        def improve(frames: Iterator[pd.DataFrame], turn=turn, shared=shared):
            learner = Learner(shared.value)
            rng = np.random.default_rng(turn)
            seen = 0
            for frame in frames:
                for texts in batches_of(frame["tokens"]):
                    stream, places, lengths = laid_out(texts)
                    inside = np.arange(len(places)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    chosen = places[(inside + np.repeat(lengths, lengths) + turn) % every == 0]
                    chosen = rng.permutation(chosen)
                    for at in range(0, len(chosen), BATCH):
                        learner.step(stream, chosen[at:at + BATCH])
                    seen += len(chosen)
            if seen:
                weights = learner.net.vector().astype(np.float64)
                yield pd.DataFrame({"i": np.arange(len(weights)), "w": weights * seen, "n": seen})

        sums = (tokens.select("tokens").mapInPandas(improve, "i int, w double, n long")
                .groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas())
        if not len(sums):
            break
        network = Network.of(sums.sort_values("i")["w"].to_numpy())
    return network


def scored(docs: DataFrame, rounds: int = ROUNDS, every: int = TRAIN_EVERY) -> DataFrame:
    """``doc_id, n_words, log_likelihood, mean_log_probability`` of each row's tokens.

    This is the network's part alone: all words of a hashed group count as the group. NULLs, repeats
    and empty tables are as in ``word_scored``.
    """
    narrow = _narrow(docs)
    rows, _ = _scored(narrow, vocabulary(narrow), None, rounds, every)
    return _named(rows, F.col("total"))


def word_scored(docs: DataFrame, rounds: int = ROUNDS, every: int = TRAIN_EVERY) -> DataFrame:
    """``doc_id, n_words, log_likelihood, mean_log_probability`` of each row of ``docs``.

    NULL, empty and wordless texts have 0 words, sum 0 and mean NULL. Repeated rows repeat and train
    as often; a NULL id stays NULL; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = session.scratch(spark, "pseudo-likelihood-counts")
    narrow = _narrow(docs)
    word_counts(narrow).write.parquet(folder)
    counts = spark.read.parquet(folder)
    known = most_frequent(counts)
    shares = log_shares(counts, known)
    least = least_stored(counts, STORE_WORDS)
    store = {r.word.encode("utf-8", "surrogatepass"): r.log_share
             for r in shares.filter(F.col("n") >= least).collect()}
    store |= {w.encode("utf-8", "surrogatepass"): 0.0 for w in known}
    rows, tokens = _scored(narrow, known, store, rounds, every)
    rare = (tokens.select("row", F.explode("rare").alias("word"))
            .join(shares.filter(F.col("n") < least), "word")
            .groupBy(F.col("row").alias("of_row")).agg(F.sum("log_share").alias("rare_total")))
    joined = rows.join(rare, F.col("row") == F.col("of_row"), "left")
    return _named(joined, F.col("total") + F.coalesce("rare_total", F.lit(0.0)))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(spelled("doc_id")[0].alias("doc_id"), F.col("text").cast("string"))


def _named(rows: DataFrame, total: Column) -> DataFrame:
    return rows.select("doc_id", "n_words", total.alias("log_likelihood"), F.when(
        F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_probability"))


def _scored(narrow: DataFrame, known: list[str], store: dict[bytes, float] | None, rounds: int,
            every: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, row, n_words, total`` with the shares in ``store``, and ``row, rare``: the words
    that it lacks. Without a store there are no shares."""
    spark = narrow.sparkSession
    folder = session.scratch(spark, "pseudo-likelihood")
    stored = spark.sparkContext.broadcast(store)

    def tokenize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, share_of = Tokenizer(known), stored.value
        for frame in frames:
            inside, rare = [], []
            for text in frame["text"]:
                logs = list(map(share_of.get, words(text))) if share_of is not None else []
                lacking = []
                if None in logs:
                    lacking = [w.decode() for w, x in zip(words(text), logs) if x is None]
                    logs = [x for x in logs if x is not None]
                inside.append(math.fsum(logs))
                rare.append(lacking)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "row": frame["row"],
                                "tokens": [tokenizer(t) for t in frame["text"]],
                                "inside": np.array(inside, np.float64), "rare": rare})

    narrow.withColumn("row", F.monotonically_increasing_id()).mapInPandas(
        tokenize, "doc_id string, row long, tokens binary, inside double, rare array<string>"
    ).write.parquet(folder)
    tokens = spark.read.parquet(folder)
    shared = spark.sparkContext.broadcast(train(tokens, rounds, every))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums, lengths = [], []
            for texts in batches_of(frame["tokens"]):
                stream, places, sizes = laid_out(texts)
                logs = np.r_[0.0, np.cumsum(shared.value.log_probabilities(stream, places))]
                ends = np.cumsum(sizes)
                sums.append(logs[ends] - logs[ends - sizes])
                lengths.append(sizes)
            if sums:
                yield pd.DataFrame({
                    "doc_id": frame["doc_id"], "row": frame["row"],
                    "n_words": np.concatenate(lengths),
                    "total": np.concatenate(sums) + frame["inside"].to_numpy()})

    rows = tokens.select("doc_id", "row", "tokens", "inside").mapInPandas(
        score, "doc_id string, row long, n_words long, total double")
    return numbered(rows, "doc_id"), tokens
