"""Interleaved range coding (asymmetric numeral systems) of token ids with one shared table.

A block holds the ids of whole documents and can be decoded by itself. Its ids go round robin to
lanes, each lane a 64-bit coder state; all lanes step together as numpy vectors. The words that
lanes give off are one stream, in the order the decoder takes them back. Every few steps a
checkpoint holds the place in the stream and the states, so that parts of a block decode in parallel.

Layout of a block, little endian: header, per document its id, a flag for NULL and its number of
ids, checkpoints, words, CRC-32 of all before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

MAGIC = b"TGIB"
VERSION = 1
LANES = 1024
CHECKPOINT_STEPS = 64
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
# magic, version, lanes, scale, steps between checkpoints, documents, ids, words, first id's place in
# the corpus, CRC of the table
_HEADER = struct.Struct("<4sHHHHIQQQI")


@dataclass(frozen=True)
class Table:
    """Symbol frequencies that add up to a power of two; symbols that never occur have none."""
    scale: int
    frequencies: np.ndarray

    @staticmethod
    def of_counts(counts: np.ndarray, scale: int = 20) -> Table:
        """Frequencies in proportion to counts, at least 1 where the count is."""
        counts = np.asarray(counts, np.int64)
        present = np.flatnonzero(counts)
        while len(present) > 1 << (scale - 1):
            scale += 1
        if scale > 30:
            raise ValueError("too many symbols")
        out = np.zeros(len(counts), np.int64)
        if len(present):
            room = (1 << scale) - len(present)
            exact = counts[present] / counts[present].sum() * room
            share = np.floor(exact).astype(np.int64)
            rest = room - int(share.sum())
            share[np.argsort(share - exact, kind="stable")[:rest]] += 1
            out[present] = share + 1
        return Table(scale, out.astype(np.uint32))

    @property
    def crc(self) -> int:
        return zlib.crc32(self.frequencies.astype("<u4").tobytes())

    def starts(self) -> np.ndarray:
        ends = np.cumsum(self.frequencies, dtype=np.uint64)
        return ends - self.frequencies

    def symbols(self) -> np.ndarray:
        """The symbol of every slot."""
        return np.repeat(np.arange(len(self.frequencies), dtype=np.uint32), self.frequencies)


class Coder:
    """Encodes and decodes blocks with one table, whose lookups it keeps."""

    def __init__(self, table: Table) -> None:
        self.table = table
        self._f = table.frequencies.astype(np.uint64)
        self._c = table.starts()
        self._symbols: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Checkpoints (words before, states) at every CHECKPOINT_STEPS, and the words."""
        scale = np.uint64(self.table.scale)
        limit = np.uint64(31 - self.table.scale + 32)
        f, c = self._f[ids], self._c[ids]
        if len(ids) and not f.all():
            raise ValueError("an id that the table has never seen")
        x = np.full(LANES, _LOW, np.uint64)
        steps = -(-len(ids) // LANES)
        given: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        total = 0
        for step in range(steps - 1, -1, -1):
            fs, cs = f[step * LANES:(step + 1) * LANES], c[step * LANES:(step + 1) * LANES]
            lane = x[:len(fs)]
            full = lane >= fs << limit
            out = lane[full].astype(np.uint32)
            lane[full] >>= _WORD
            given.append(out)
            total += len(out)
            whole = lane // fs
            lane[:] = (whole << scale) + (lane - whole * fs) + cs
            if step % CHECKPOINT_STEPS == 0:
                marks.append((total, x.copy()))
        words = np.concatenate(given[::-1]) if given else np.zeros(0, np.uint32)
        return [(total - left, states) for left, states in marks[::-1]], words

    def decode(self, n: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The next ``n`` ids from a checkpoint's states and the words from its place on."""
        if self._symbols is None:
            self._symbols = self.table.symbols()
        scale, mask = np.uint64(self.table.scale), np.uint64((1 << self.table.scale) - 1)
        x = states.copy()
        out = np.empty(n, np.uint32)
        words = words.astype(np.uint64)
        at = 0
        for begin in range(0, n, LANES):
            lane = x[:min(LANES, n - begin)]
            slot = lane & mask
            symbol = self._symbols[slot]
            out[begin:begin + len(lane)] = symbol
            lane[:] = self._f[symbol] * (lane >> scale) + slot - self._c[symbol]
            empty = lane < _LOW
            taken = int(np.count_nonzero(empty))
            lane[empty] = (lane[empty] << _WORD) | words[at:at + taken]
            at += taken
        return out


def write_block(coder: Coder, first: int, doc_ids: Sequence[int | None], counts: Sequence[int],
                ids: np.ndarray) -> bytes:
    """A block of documents whose ids follow each other; ``first`` is the corpus's ids before it."""
    marks, words = coder.encode(ids)
    head = _HEADER.pack(MAGIC, VERSION, LANES, coder.table.scale, CHECKPOINT_STEPS, len(doc_ids),
                        len(ids), len(words), first, coder.table.crc)
    parts = [head, np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
             np.array([d is None for d in doc_ids], "u1").tobytes(),
             np.array(counts, "<u8").tobytes()]
    for place, states in marks:
        parts += [struct.pack("<Q", place), states.astype("<u8").tobytes()]
    parts.append(words.astype("<u4").tobytes())
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass
class Block:
    """A block that has been read and checked, not yet decoded."""
    first: int
    doc_ids: list[int | None]
    counts: np.ndarray
    n_ids: int
    marks: list[tuple[int, np.ndarray]]
    words: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.marks)

    def part(self, coder: Coder, k: int) -> np.ndarray:
        """The ids from checkpoint k to the next one."""
        size = CHECKPOINT_STEPS * LANES
        place, states = self.marks[k]
        return coder.decode(min(size, self.n_ids - k * size), states, self.words[place:])

    def ids(self, coder: Coder) -> np.ndarray:
        parts = [self.part(coder, k) for k in range(self.parts)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def read_block(data: bytes, table: Table) -> Block:
    """Check and take apart a block; ValueError if it is damaged or of another table."""
    if len(data) < _HEADER.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("the block's checksum does not fit")
    (magic, version, lanes, scale, every, n_docs, n_ids, n_words, first, crc) = _HEADER.unpack_from(
        data)
    if (magic, version, lanes, every) != (MAGIC, VERSION, LANES, CHECKPOINT_STEPS):
        raise ValueError("not a block of this format")
    if (scale, crc) != (table.scale, table.crc):
        raise ValueError("the block was written with another table")
    at = _HEADER.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    numbers, missing, counts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    marks = []
    for _ in range(-(-n_ids // (LANES * CHECKPOINT_STEPS))):
        place = int(take("<u8", 1)[0])
        marks.append((place, take("<u8", LANES).astype(np.uint64)))
    words = take("<u4", n_words)
    doc_ids = [None if m else int(d) for d, m in zip(numbers, missing)]
    return Block(first, doc_ids, counts.astype(np.int64), n_ids, marks, words)
