"""Resampling towards a target: n-gram buckets of corpus and target give each text an importance.

A batch of texts is lower-cased, cut at separators and flattened by Arrow kernels; its words become
dictionary indices. An n-gram is the pair of the (n-1)-gram before it and a word, so the shifted
indices name all n-grams, and a CRC is taken once for each distinct pair. Bucket counts of a task are
summed before they are shuffled: at most one row per bucket and task. The gains, one number per
bucket, go to every task; a text's weight is the sum of its n-grams' gains, plus Gumbel noise from its
id, so that the highest scores are a sample without replacement in proportion to importance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge import session
from tidegauge.llm.tables import tasks_for

# Separators, buckets, noise, and what is drawn.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_WORDS = 1
BUCKETS = 10_000
SEED = "2024"
MIN_WORDS = 20
DRAW_PERCENT = 10

SLICE_BYTES = 4 << 20  # of text that one pass of kernels takes, or one text that is longer
BROADCAST_PARTS = 1 << 20
_ROW_BYTES = 48


class Grams:
    """The n-grams of a slice of texts: bucket of each, and of which text it is."""

    def __init__(self, texts: pa.Array, max_words: int, buckets: int):
        words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
        owner = pc.list_parent_indices(words)
        flat = pc.list_flatten(words)
        real = pc.not_equal(pc.binary_length(flat), 0)
        owner = pc.filter(owner, real).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(pc.filter(flat, real))
        names = [w.encode("utf-8") for w in coded.dictionary.to_pylist()]
        words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.n_words = np.bincount(owner, minlength=len(texts))
        crcs = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
        gram, first, held, of = words, crcs, [], []
        for n in range(1, max_words + 1):
            if n > 1:  # each gram of n-1 words with the word after it, inside one text
                inside = owner[: len(gram) - 1] == owner[n - 1:]
                pairs = gram[:-1] * len(names) + words[n - 1:]
                distinct, pair = np.unique(pairs, return_inverse=True)
                left, right = np.divmod(distinct, max(len(names), 1))
                first = np.fromiter((zlib.crc32(b" " + names[w], int(first[g]))
                                     for g, w in zip(left, right)), np.uint32, len(distinct))
                gram = pair.reshape(-1)
            else:
                inside = np.ones(len(gram), bool)
            held.append((first % buckets).astype(np.int64)[gram[inside]])
            of.append(owner[: len(gram)][inside])
        if max_words > 1:
            order = np.argsort(np.concatenate(of), kind="stable")
            self.buckets, self.owner = np.concatenate(held)[order], np.concatenate(of)[order]
        else:
            self.buckets, self.owner = held[0], of[0]

    def sums(self, gains: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of n-grams and sum of gains of each text."""
        n_grams = np.bincount(self.owner, minlength=n_texts)
        sums = np.zeros(n_texts, np.int64)
        if len(self.buckets):
            some = n_grams > 0
            starts = np.cumsum(n_grams) - n_grams
            sums[some] = np.add.reduceat(gains[self.buckets], starts[some])
        return n_grams, sums


def _slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Rows of about ``SLICE_BYTES`` of text at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield at, column.slice(at, to - at)
        at = to


def bucket_counts(docs: DataFrame, text: str = "text", max_words: int = MAX_WORDS,
                  buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket; ``buckets`` rows reach the driver."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                total += np.bincount(Grams(texts, max_words, buckets).buckets, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], schema=schema)

    rows = (docs.select(F.col(text).cast("string").alias("text"))
            .mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    out = np.zeros(buckets, np.int64)
    for row in rows.collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket in target and corpus, in thousandths."""
    buckets = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text",
             max_words: int = MAX_WORDS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                grams = Grams(texts, max_words, len(gains))
                n_grams, sums = grams.sums(gains, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(grams.n_words, pa.int64()),
                     pa.array(n_grams, pa.int64()), pa.array(sums, pa.int64())], schema=schema)

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                         F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def scored(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """``rows`` with ``score``: the weight and Gumbel noise that follows from seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(
        F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise.cast("long"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text",
             max_words: int = MAX_WORDS, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
             percent: int = DRAW_PERCENT, seed: str = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each row of ``docs``; drawn rows have a rank.

    Of the rows with ``min_words`` words or more, ``percent`` in a hundred (rounded down) with the
    highest scores are drawn, ties to the smaller id. NULL and empty texts have no features, weight 0
    and are never drawn. A NULL id takes its noise from an empty id and loses ties. Repeated rows are
    rows of their own, in either order. An empty table gives no rows, an empty target gains of an
    even spread. Other columns are not read.

    Ranks need no global window: rows are dealt by ranges of score and sorted inside a part; only one
    count per part meets in one place.
    """
    spark = docs.sparkSession
    folder = session.scratch(spark, "resampling")
    gains = bucket_gains(bucket_counts(docs, text, max_words, buckets),
                         bucket_counts(target, text, max_words, buckets))
    scored(weighted(docs, gains, doc_id, text, max_words), seed).write.parquet(f"{folder}/scored")
    rows = spark.read.parquet(f"{folder}/scored")
    named = ["doc_id", "n_features", "weight", "score"]
    able = rows.filter(F.col("n_words") >= min_words).select(*named)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features"]
    parts = tasks_for(able)
    (able.repartitionByRange(parts, *order).sortWithinPartitions(*order)
     .select(*named, F.spark_partition_id().alias("part"),
             F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
     .write.parquet(f"{folder}/ordered"))
    ordered = spark.read.parquet(f"{folder}/ordered")
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    starts = F.broadcast(starts) if parts <= BROADCAST_PARTS else starts
    rank = F.col("before") + F.col("place") + 1
    ranked = ordered.join(starts, "part").select(
        *named, F.when(rank <= drawn, rank).alias("rank"))
    rest = rows.filter(F.col("n_words") < min_words).select(*named, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def resample_sql() -> str:
    """The same rows in plain SQL: a CRC table by rule, CRCs of distinct words, sums by text."""
    return f"""
WITH RECURSIVE steps AS (
  SELECT x AS byte, x AS v, 0 AS k FROM range(256) t(x)
  UNION ALL
  SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1
  FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY byte) AS entries FROM steps WHERE k = 8),
words AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 'b', 0, NULL, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')
  FROM benchmark),
each AS (SELECT side, r, unnest(w) AS word FROM words),
distinct_words AS (SELECT DISTINCT word FROM each),
hexed AS (SELECT word, hex(encode(word)) AS h FROM distinct_words),
bucketed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2),
      lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, crc.entries[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM hexed, crc),
counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
  FROM each JOIN bucketed USING (word) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS big_s, sum(t)::DOUBLE AS big_t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (big_s + {BUCKETS}))
    / ((s + 1)::DOUBLE * (big_t + {BUCKETS}))))::BIGINT AS gain FROM counts, totals),
weights AS (
  SELECT r, sum(gain) AS weight FROM each JOIN bucketed USING (word) JOIN gains USING (bucket)
  WHERE side = 'd' GROUP BY r),
scores AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' ||
      coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE side = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS}
      ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
    count(*) FILTER (n_features >= {MIN_WORDS}) OVER () AS able FROM scores)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= {MIN_WORDS} AND place <= able * {DRAW_PERCENT} // 100 THEN place END AS rank
FROM ranked"""
