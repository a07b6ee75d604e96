"""Quality rules on repetition: how much of a text lies inside repeated n-grams and lines.

Each text becomes a row of word numbers. A rolling hash over them, from prefix sums of powers of an
odd base modulo 2^64, gives the hash of every window of n words in one subtraction and one product,
for each length n. Windows whose hash occurs twice are compared word by word with the first of
their hash before they count, so a hash collision never shows in a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.tables import numbered, spelled

# Characters counted as symbols, and the limits of the base rules.
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Largest share of the characters of words inside windows that occur twice or more, by window length,
# and inside lines that repeat an earlier one.
MAX_SHARE = {5: 0.45, 6: 0.44, 7: 0.43, 8: 0.42, 9: 0.41, 10: 0.40}
MAX_LINE_SHARE = 0.30
MAX_SYMBOL_SHARE = 0.05

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

SCHEMA = ("doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, "
          + ", ".join(f"dup{n}_share double" for n in MAX_SHARE))


class RollingHash:
    """Window hashes of word numbers, for all window lengths from one prefix sum."""

    def __init__(self) -> None:
        self._powers = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            size = max(1024, 2 * n)
            self._powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)], dtype=np.uint64)
            self._inverse = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE_INVERSE)],
                                       dtype=np.uint64)

    def prefix(self, numbers: np.ndarray) -> np.ndarray:
        self._grow(len(numbers) + 1)
        sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(scramble(numbers) * self._powers[: len(numbers)], out=sums[1:])
        return sums

    def windows(self, prefix: np.ndarray, n: int) -> np.ndarray:
        return (prefix[n:] - prefix[:-n]) * self._inverse[: len(prefix) - n]


def scramble(numbers: np.ndarray) -> np.ndarray:
    """Spread small numbers over 64 bits."""
    x = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def repeated(hashes: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n words occur twice or more, exactly."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return np.zeros(len(hashes), bool)
    left, right = order[:-1][same], order[1:][same]
    for k in range(n):
        if (numbers[left + k] != numbers[right + k]).any():
            return _repeated_by_words(numbers, n)
    out = np.zeros(len(hashes), bool)
    out[left] = out[right] = True
    return out


def _repeated_by_words(numbers: np.ndarray, n: int) -> np.ndarray:
    rows = np.lib.stride_tricks.sliding_window_view(numbers, n)
    _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    return counts[inverse.reshape(-1)] > 1


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which words lie inside a marked window of n words."""
    steps = np.zeros(len(starts) + n, np.int64)
    steps[: len(starts)] += starts
    steps[n:] -= starts
    return np.cumsum(steps)[: len(starts) + n - 1] > 0


def measure(text: str | None, rolling: RollingHash) -> dict:
    """All measures of one text (None counts as empty)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = int(len(data) - histogram[0x80:0xC0].sum())
    words = data.split()
    n_words = len(words)
    word_chars = points - int(sum(histogram[c] for c in WHITE))
    table: dict[bytes, int] = {}
    numbers = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, n_words)
    leads = (np.frombuffer(b"".join(words), np.uint8) & 0xC0) != 0x80
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n_words))
    lengths = np.diff(np.r_[0, np.cumsum(leads)[ends - 1]]) if n_words else ends
    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in data.split(b"\n"):
        if not line.strip():
            continue
        if line in seen:
            dup_lines += 1
            dup_line_chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in line.split())
        seen.add(line)
    prefix = rolling.prefix(numbers)
    inside = {}
    for n in (3, *MAX_SHARE):  # rising: without a repeated window, no longer one repeats
        if n_words <= n:
            break
        twice = repeated(rolling.windows(prefix, n), numbers, n)
        if not twice.any():
            break
        inside[n] = covered(twice, n)
    repeat_words = int(inside[3].sum()) if 3 in inside else 0
    shares = {n: float(lengths[inside[n]].sum() / word_chars) if n in inside else 0.0
              for n in MAX_SHARE}
    symbols = int(sum(histogram[c] for c in SYMBOLS))
    line_share = dup_line_chars / word_chars if word_chars else 0.0
    base_failed = n_words < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PERCENT * n_words
    kept = (not base_failed and line_share <= MAX_LINE_SHARE
            and symbols <= MAX_SYMBOL_SHARE * word_chars
            and all(shares[n] <= limit for n, limit in MAX_SHARE.items()))
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols,
            "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": base_failed,
            "kept": kept, "dup_line_share": line_share,
            **{f"dup{n}_share": s for n, s in shares.items()}}


def repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of measures for each row of ``docs``, with the verdict ``kept``.

    NULL and empty texts have no words: all counts are 0, ``base_failed`` is true. Rows are measured
    each by itself: repeated rows give repeated results, a NULL id stays NULL, other columns are not
    read, an empty table gives no rows. Texts are read whole, one at a time.
    """
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolling = RollingHash()
        for batch in batches:
            out = pd.DataFrame([measure(t, rolling) for t in batch["text"]])
            if len(out):
                out.insert(0, "doc_id", batch["doc_id"])
                yield out

    narrow = docs.select(spelled(doc_id)[0].alias("doc_id"), F.col(text).alias("text"))
    return numbered(narrow.mapInPandas(rows, SCHEMA), "doc_id")
