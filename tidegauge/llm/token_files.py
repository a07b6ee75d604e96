"""Token ids of a corpus as files of range-coded blocks, in the order of the document ids.

Documents are dealt out by ranges of their ids and tokenized where they land; whole documents fill
raw blocks. One frequency table over all ids is shared by all blocks, which are then encoded and
decoded one by one, in any order, on any machine. Steps pass on tables in the shared folder.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidegauge.llm import rans
from tidegauge.llm.tables import spelled, tasks_for

BLOCK_IDS = 1 << 18
KNOWN_WORDS = 1 << 20
BROADCAST_PARTS = 1 << 20
RAW = "part int, block int, inside long, n_ids long, doc_ids array<string>, counts array<long>, ids binary"

# In a worker process: word ids by tokenizer file, and the coder by table.
_words: dict[str, Callable[[list[str]], list[bytes]]] = {}
_coders: dict[int, rans.Coder] = {}


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: visible ones stand for
    themselves, the others, in order, for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _plain_letters(word: str) -> bool:
    """A run of Latin letters whose normal form is itself: one piece to the tokenizer."""
    return (word.isalpha() and max(word) < "\u0250"
            and unicodedata.is_normalized("NFC", word))


def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes texts to little-endian ids by a tokenizer that drops white space between words.

    Its splits and merges never cross ASCII white space, so words are encoded by the library once
    and their ids kept. A word of plain letters, perhaps before one mark, is one or two pieces in
    lower case and goes to the library's merges directly; any other one through all of its steps.
    The store is bounded; it starts afresh when it is full.
    """
    if path in _words:
        return _words[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kind = "H" if id_type(tokenizer.get_vocab_size()) == "<u2" else "I"
    letters = _byte_letters()
    merges = tokenizer.model.tokenize
    known: dict[bytes, bytes] = {}
    stems: dict[bytes, bytes] = {}

    def packed(ids: list[int]) -> bytes:
        out = array(kind, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def merged(piece: bytes) -> bytes:
        ids = stems.get(piece)
        if ids is None:
            shown = piece.decode() if piece.isalpha() else "".join([letters[b] for b in piece])
            ids = stems[piece] = packed([t.id for t in merges(shown)])
        return ids

    def ids_of(word: bytes) -> bytes:
        stem, mark = (word[:-1], word[-1:]) if word[-1] in b".,;:!?" else (word, b"")
        if stem.isalpha():  # ASCII letters only
            return merged(stem.lower()) + (merged(mark) if mark else b"")
        text = stem.decode("utf-8", "surrogatepass")
        if stem and _plain_letters(text):
            lower = "".join([c.lower() for c in text])  # each by itself, as the tokenizer does
            if lower.isalpha():
                return merged(lower.encode()) + (merged(mark) if mark else b"")
        return packed(tokenizer.encode(word.decode("utf-8", "surrogatepass"),
                                       add_special_tokens=False).ids)

    def encode(texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass")
            # Lower case is the tokenizer's own; marks that combine (their bytes start with CC or CD)
            # could make another letter of a capital, and special tokens are matched as written.
            if b"\xcc" not in data and b"\xcd" not in data and b"<|" not in data:
                data = data.lower()
            words = data.split()
            found = list(map(known.get, words))
            if None in found:
                if len(known) > KNOWN_WORDS:
                    known.clear()
                    stems.clear()
                for w in words:
                    if w not in known:
                        known[w] = ids_of(w)
                found = list(map(known.__getitem__, words))
            out.append(b"".join(found))
        return out

    _words[path] = encode
    return encode


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def raw_blocks(docs: DataFrame, path: str, end_id: int, vocabulary: int,
               block_ids: int = BLOCK_IDS) -> DataFrame:
    """Tokenize into blocks of whole documents, in order inside a part, parts in order."""
    kind = id_type(vocabulary)
    end = np.array([end_id], kind).tobytes()
    width = len(end)
    n = tasks_for(docs, 16 << 20, docs.sparkSession.sparkContext.defaultParallelism)
    order = [F.col("doc_id"), F.xxhash64("text")]
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = (narrow.repartitionByRange(n, *order).sortWithinPartitions(*order)
             .withColumns({"part": F.spark_partition_id(), "doc_id": spelled("doc_id")[0]}))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_encoder(path)
        doc_ids: list[str | None] = []
        ids: list[bytes] = []
        part = number = size = before = 0

        def block() -> pd.DataFrame:
            counts = [len(b) // width for b in ids]
            return pd.DataFrame({"part": [part], "block": [number], "inside": [before], "n_ids": [sum(counts)],
                                 "doc_ids": [list(doc_ids)], "counts": [counts],
                                 "ids": [b"".join(ids)]})

        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            numbers = batch["doc_id"]
            for at in range(0, len(batch), 64):
                texts = batch["text"].iloc[at:at + 64].tolist()
                for doc_id, data in zip(numbers.iloc[at:at + 64], encode(texts)):
                    doc_ids.append(doc_id if isinstance(doc_id, str) else None)
                    ids.append(data + end)
                    size += len(ids[-1]) // width
                    if size >= block_ids:
                        yield block()
                        number, before, size, doc_ids, ids = number + 1, before + size, 0, [], []
        if doc_ids:
            yield block()

    return dealt.mapInPandas(blocks, RAW)


def symbol_counts(raw: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs: as many rows as the vocabulary has ids reach the driver."""
    kind = id_type(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for data in batch["ids"]:
                total += np.bincount(np.frombuffer(data, kind), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    rows = (raw.select("ids").mapInPandas(count, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(vocabulary, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def with_first(raw: DataFrame) -> DataFrame:
    """Each block with the number of ids in all blocks before it.

    A block knows its place in its part; of the parts, one row for each task that wrote one, the sums
    go to every executor, or beyond a bound meet the blocks in a shuffle.
    """
    parts = raw.groupBy("part").agg(F.sum("n_ids").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    small = raw.select("part").distinct().count() <= BROADCAST_PARTS
    return raw.join(F.broadcast(parts) if small else parts, "part").withColumn(
        "first", F.col("before") + F.col("inside"))


def _coder(table: rans.Table) -> rans.Coder:
    if table.crc not in _coders:
        _coders.clear()
        _coders[table.crc] = rans.Coder(table)
    return _coders[table.crc]


def write(docs: DataFrame, folder: str, path: str, end_id: int) -> rans.Table:
    """Tokenize ``docs``, write the block files below ``folder``, and return the shared table.

    The files are rows (part, block, data); ``data`` is a block as ``rans`` defines it. NULL and empty
    texts are documents of the end id alone. NULL ids come first; repeated rows are documents of
    their own; an empty table writes no block. Other columns are not read.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    # Ids in two bytes each hardly shrink: read twice below, they are not worth packing.
    (raw_blocks(docs, path, end_id, vocabulary).write.option("compression", "uncompressed")
     .parquet(f"{folder}/raw"))
    raw = spark.read.schema(RAW).parquet(f"{folder}/raw")
    table = rans.Table.of_counts(symbol_counts(raw, vocabulary))
    shared = spark.sparkContext.broadcast(table)
    kind = id_type(vocabulary)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(shared.value)
        for batch in batches:
            for row in batch.itertuples(index=False):
                missing = [None if d is None else int(d) for d in row.doc_ids]
                data = rans.write_block(coder, row.first, missing, row.counts,
                                        np.frombuffer(row.ids, kind))
                yield pd.DataFrame({"part": [row.part], "block": [row.block], "data": [data]})

    placed = with_first(raw)
    (placed.mapInPandas(encode, "part int, block int, data binary").write
     .option("compression", "uncompressed").parquet(f"{folder}/blocks"))
    spark.createDataFrame([(table.scale, table.frequencies.astype("<u4").tobytes())],
                          "scale int, frequencies binary").write.parquet(f"{folder}/table")
    return table


def read_table(spark: SparkSession, folder: str) -> rans.Table:
    row = spark.read.parquet(f"{folder}/table").first()
    return rans.Table(row.scale, np.frombuffer(row.frequencies, "<u4"))


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of each document in the files.

    Every block is decoded by itself after its checksum has been checked; a damaged one fails.
    """
    shared = spark.sparkContext.broadcast(read_table(spark, folder))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(shared.value)
        for batch in batches:
            for data in batch["data"]:
                block = rans.read_block(data, coder.table)
                ids = block.ids(coder)
                ends = np.cumsum(block.counts)
                starts = ends - block.counts
                raw = ids.astype("<u4").tobytes()
                out = pd.DataFrame({
                    "doc_id": pd.array(block.doc_ids, "Int64"), "start": block.first + starts,
                    "n_tokens": block.counts,
                    "ids_crc32": [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts, ends)]})
                if with_ids:
                    out["ids"] = [ids[a:b].astype(np.int64) for a, b in zip(starts, ends)]
                yield out

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    blocks = spark.read.parquet(f"{folder}/blocks").select("data")
    return blocks.mapInPandas(decode, schema + (", ids array<long>" if with_ids else ""))
