"""Runs of repeated words, found on a grammar of each text.

The words of a slice of texts are numbered so that no two texts share a number; a pair of neighbours
then never spans two texts that could match. Re-Pair replaces neighbours that occur together twice or
more by a nonterminal, round by round; what is left of a text is joined two by two until one symbol
is its whole derivation. Each nonterminal's expansion is looked at once, for runs across the boundary
of its two children: for a period q, how far the words q apart agree to the right and to the left of
the boundary. Every run of a text lies across the boundary of the lowest nonterminal that holds it, so
none is missed. The runs are then moved to all places the nonterminal derives, and stretches of one
period that overlap by a period or more, which are parts of one run, are merged.

Equal stretches are compared by names of word windows of 1, 2, 4, ... words, so nothing rests on
hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The least length of a run, and the rule that makes one text in ten periodic.
MIN_LENGTH = 12
MIN_TURNS = 2

SLICE_WORDS = 200_000  # words that are looked at together, or one text of more
_CANDIDATES = 1 << 22  # pairs of boundary and period in memory at once

SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def _numbered(codes: np.ndarray) -> np.ndarray:
    """Equal codes get equal numbers, 0 and up."""
    return np.unique(codes, return_inverse=True)[1].reshape(-1).astype(np.int64)


class Names:
    """Names of all windows of 2^k words of a sequence; equal names are equal windows."""

    def __init__(self, words: np.ndarray):
        self._levels = [words]

    def level(self, k: int) -> np.ndarray:
        while len(self._levels) <= k:
            last, half = self._levels[-1], 1 << (len(self._levels) - 1)
            pairs = last[: len(last) - half] * (int(last.max(initial=0)) + 1) + last[half:]
            self._levels.append(_numbered(pairs))
        return self._levels[k]

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """How many words agree from ``a`` and ``b`` on, or back from them, ``limit`` at most."""
        def equal(rows, done, k):
            step = -(done[rows] + (1 << k)) if back else done[rows]
            names = self.level(k)
            return names[a[rows] + step] == names[b[rows] + step]

        out = np.zeros(len(a), np.int64)
        k, alive = 0, np.flatnonzero(limit >= 1)
        tops = [alive]
        while True:  # the first length at which nobody agrees any more
            alive = alive[limit[alive] >= 1 << k]
            alive = alive[equal(alive, out, k)] if len(alive) else alive
            if not len(alive):
                break
            tops.append(alive)
            k += 1
        for k in range(k - 1, -1, -1):
            rows = tops[k + 1]  # agree in 2^k words; others may do so behind words they have taken
            taken = np.flatnonzero((out > 0) & (limit - out >= 1 << k))
            rows = np.union1d(rows[out[rows] == 0], taken)
            if len(rows):
                out[rows[equal(rows, out, k)]] += 1 << k
        return out


class Grammar:
    """Rules over numbered words: children, one place, length and round of each nonterminal."""

    def __init__(self, words: np.ndarray, text_ends: np.ndarray):
        self.n_words = int(words.max(initial=-1)) + 1
        self._left: list[np.ndarray] = []
        self._right: list[np.ndarray] = []
        self._place: list[np.ndarray] = []
        self._mid: list[np.ndarray] = []
        self._end: list[np.ndarray] = []
        self.rounds: list[int] = []  # first nonterminal of each round
        self.n_symbols = self.n_words
        self.symbols = words.copy()
        self.starts = np.arange(len(words))
        self._repair(len(words))
        self.shared = self.n_symbols  # those from here on occur once
        self.places = (self.symbols.copy(), self.starts.copy())
        self._join(text_ends, len(words))
        self.left, self.right, self.place, self.mid, self.end = (
            np.concatenate(x) if x else np.zeros(0, np.int64)
            for x in (self._left, self._right, self._place, self._mid, self._end))

    def _add(self, at: np.ndarray, ends: np.ndarray) -> None:
        """Nonterminals of the symbols at ``at`` and behind them."""
        self.rounds.append(self.n_symbols)
        self._left.append(self.symbols[at])
        self._right.append(self.symbols[at + 1])
        self._place.append(self.starts[at])
        self._mid.append(self.starts[at + 1])
        self._end.append(ends[at + 1])
        self.n_symbols += len(at)

    def _repair(self, n: int) -> None:
        fresh = np.ones(max(len(self.symbols) - 1, 0), bool)  # pairs that may occur twice
        while fresh.any():
            at = np.flatnonzero(fresh)
            codes = self.symbols[at] * self.n_symbols + self.symbols[at + 1]
            _, pair, counts = np.unique(codes, return_inverse=True, return_counts=True)
            pair = pair.reshape(-1)
            twice = counts[pair] > 1
            at, pair = at[twice], pair[twice]
            fresh = np.zeros(len(fresh), bool)
            if not len(at):
                break
            # Frequent pairs first; of overlapping places of one pair, every second.
            rank = np.empty(len(counts), np.int64)
            rank[np.lexsort((np.arange(len(counts)), -counts))] = np.arange(len(counts))
            ranks = np.full(len(fresh) + 2, len(counts), np.int64)
            ranks[at + 1] = rank[pair]
            own, before, behind = ranks[at + 1], ranks[at], ranks[at + 2]
            first = np.r_[True, (np.diff(at) > 1) | (own[1:] != own[:-1])]
            stretch = np.flatnonzero(first)[np.cumsum(first) - 1]
            even = (np.arange(len(at)) - stretch) % 2 == 0
            chosen = even & (own <= before) & (own <= behind)
            # A stretch of one pair that a better neighbour cuts keeps clear of that neighbour.
            often = np.bincount(pair[chosen], minlength=len(counts)) > 1
            chosen &= often[pair]
            if not chosen.any():
                break
            picked, of = at[chosen], pair[chosen]
            distinct, where, rule = np.unique(of, return_index=True, return_inverse=True)
            ends = np.r_[self.starts[1:], n]
            base = self.n_symbols
            self._add(picked[where], ends)
            self.symbols[picked] = base + rule.reshape(-1)
            keep = np.ones(len(self.symbols), bool)
            keep[picked + 1] = False
            # Places whose pair is new, and places that lost to a neighbour, are looked at again.
            again = np.zeros(len(self.symbols), bool)
            again[at] = True
            again[picked] = True
            again[np.maximum(picked - 1, 0)] = True
            again[np.maximum(picked - 2, 0)] = True
            self.symbols, self.starts = self.symbols[keep], self.starts[keep]
            fresh = again[keep][: max(len(self.symbols) - 1, 0)]

    def _join(self, text_ends: np.ndarray, n: int) -> None:
        text = np.searchsorted(text_ends, self.starts, side="right")
        while len(self.symbols):
            counts = np.bincount(text)
            offset = (np.cumsum(counts) - counts)[text]
            inside = np.arange(len(text)) - offset
            pair = (inside % 2 == 0) & (inside + 1 < counts[text])
            at = np.flatnonzero(pair)
            if not len(at):
                break
            base = self.n_symbols
            self._add(at, np.r_[self.starts[1:], n])
            self.symbols[at] = base + np.arange(len(at))
            keep = np.ones(len(text), bool)
            keep[at + 1] = False
            self.symbols, self.starts, text = self.symbols[keep], self.starts[keep], text[keep]

    def moved(self, rule: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of what begins ``offset`` words into nonterminals: row numbers, places."""
        row_of, where = [], []
        once = rule >= self.shared
        row_of.append(np.flatnonzero(once))
        where.append(self.place[rule[once] - self.n_words] + offset[once])
        wanted = np.zeros(self.n_symbols, bool)
        wanted[rule[~once]] = True
        limits = [r for r in self.rounds if r < self.shared] + [self.shared]
        bearing = wanted.copy()
        for a, b in zip(limits, limits[1:]):  # children are of earlier rounds
            bearing[a:b] |= (bearing[self.left[a - self.n_words:b - self.n_words]]
                             | bearing[self.right[a - self.n_words:b - self.n_words]])
        symbols, starts = self.places
        held = bearing[symbols]
        symbols, starts = symbols[held], starts[held]
        found, found_at = [], []
        for a in limits[-2::-1]:  # from the last round to the first
            now = symbols >= a
            own, at = symbols[now], starts[now]
            found.append(own[wanted[own]])
            found_at.append(at[wanted[own]])
            left, right = self.left[own - self.n_words], self.right[own - self.n_words]
            step = (self.mid - self.place)[own - self.n_words]
            symbols = np.concatenate([symbols[~now], left[bearing[left]], right[bearing[right]]])
            starts = np.concatenate([starts[~now], at[bearing[left]], (at + step)[bearing[right]]])
        if found:
            owner, at = np.concatenate(found), np.concatenate(found_at)
            order = np.argsort(owner, kind="stable")
            owner, at = owner[order], at[order]
            rows = np.flatnonzero(~once)
            low = np.searchsorted(owner, rule[rows], side="left")
            many = np.searchsorted(owner, rule[rows], side="right") - low
            pick = _ranges(low, many)
            row_of.append(np.repeat(rows, many))
            where.append(at[pick] + np.repeat(offset[rows], many))
        return np.concatenate(row_of), np.concatenate(where)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``counts`` numbers of each."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def _crossing(words: np.ndarray, grammar: Grammar) -> tuple[np.ndarray, ...]:
    """Rule, offset, length and period of the runs across each nonterminal's boundary."""
    place, mid, end = grammar.place, grammar.mid, grammar.end
    size = end - place
    big = np.flatnonzero(size >= MIN_LENGTH)
    if not len(big):
        return (np.zeros(0, np.int64),) * 4
    # Six words or more agree across a boundary, so three in a row do on one of its sides.
    pairs = _numbered(words[:-2] * (int(words.max()) + 1) + words[1:-1])
    triples = np.r_[_numbered(pairs * (int(words.max()) + 1) + words[2:]), -1, -2, -6]
    padded = np.r_[-3, -4, -5, triples]  # triples ending at a word: shifted by three
    rules, marks, others = [], [], []
    half = size[big] // MIN_TURNS
    for right in (True, False):
        room = np.minimum(end[big] - mid[big] if right else mid[big] - place[big], half)
        ends = np.cumsum(room)
        at = 0
        while at < len(big):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + _CANDIDATES, side="right")))
            counts = room[at:to]
            q = _ranges(np.ones(to - at, np.int64), counts)
            rule = np.repeat(big[at:to], counts)
            low = mid[rule] if right else mid[rule] - q
            high = low + q
            near = triples[low] == triples[high]
            near |= padded[low] == padded[high]
            rules.append(rule[near])
            marks.append(low[near])
            others.append(high[near])
            at = to
    rule, low, high = map(np.concatenate, (rules, marks, others))
    if not len(rule):
        return (np.zeros(0, np.int64),) * 4
    # Names are made of the stretches concerned only.
    used = np.zeros(len(words) + 1, np.int64)
    np.add.at(used, place[rule], 1)
    np.add.at(used, end[rule], -1)
    used = np.cumsum(used[:-1]) > 0
    to_small = np.cumsum(used) - 1
    names = Names(words[used])
    a, b = to_small[low], np.where(high < len(words), to_small[np.minimum(high, len(words) - 1)], 0)
    b = np.where(high == end[rule], to_small[high - 1] + 1, b)
    ahead = names.common(a, b, end[rule] - high, back=False)
    behind = names.common(a, b, low - place[rule], back=True)
    q = high - low
    length = ahead + behind + q
    good = length >= np.maximum(MIN_LENGTH, MIN_TURNS * q)
    rule, offset, length, q = rule[good], (low - behind - place[rule])[good], length[good], q[good]
    if not len(rule):
        return rule, offset, length, q
    order = np.lexsort((q, length, offset, rule))  # the smallest period of each stretch
    rule, offset, length, q = (x[order] for x in (rule, offset, length, q))
    same = np.r_[False, (rule[1:] == rule[:-1]) & (offset[1:] == offset[:-1])
                 & (length[1:] == length[:-1])]
    return rule[~same] + grammar.n_words, offset[~same], length[~same], q[~same]


def find_runs(words: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by start, then period.

    ``words`` are the numbered words of texts one after the other, which end at ``text_ends`` and
    share no number.
    """
    none = (np.zeros(0, np.int64),) * 3
    if len(words) < MIN_LENGTH:
        return none
    grammar = Grammar(words, text_ends)
    rule, offset, length, period = _crossing(words, grammar)
    if not len(rule):
        return none
    rows, starts = grammar.moved(rule, offset)
    period, ends = period[rows], starts + length[rows]
    order = np.lexsort((-ends, starts, period))
    starts, ends, period = starts[order], ends[order], period[order]
    # Periods one after the other in one running maximum: a period's ends lie above the last one's.
    lift = period * (len(words) + 1)
    reach = np.maximum.accumulate(ends + lift)
    fresh = np.r_[True, (period[1:] != period[:-1])
                  | (starts[1:] + lift[1:] > reach[:-1] - period[1:])]
    first = np.flatnonzero(fresh)
    starts, period = starts[first], period[first]
    ends = np.maximum.reduceat(ends, first)
    order = np.lexsort((period, ends, starts))
    starts, ends, period = starts[order], ends[order], period[order]
    same = np.r_[False, (starts[1:] == starts[:-1]) & (ends[1:] == ends[:-1])]
    starts, ends, period = starts[~same], ends[~same], period[~same]
    order = np.lexsort((period, starts))
    return starts[order], ends[order], period[order]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten become periodic from some word on; a NULL id changes none."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn = words[a:a + p]
    return words[:a] + (turn * ((n - a) // p + 1))[: n - a]


def _slice_rows(ids: list, texts: list[list[bytes]]) -> list[tuple]:
    numbers = np.empty(sum(map(len, texts)), np.int64)
    ends, at = np.empty(len(texts), np.int64), 0
    base = 0
    for i, words in enumerate(texts):
        table: dict[bytes, int] = {}
        numbers[at:at + len(words)] = [table.setdefault(w, len(table) + base) for w in words]
        base += len(table)
        at += len(words)
        ends[i] = at
    starts, stops, periods = find_runs(numbers, ends)
    of = np.searchsorted(ends, starts, side="right")
    low = np.searchsorted(of, np.arange(len(texts)), side="left")
    high = np.searchsorted(of, np.arange(len(texts)), side="right")
    out = []
    for i, words in enumerate(texts):
        first = int(ends[i]) - len(words)
        a, b = low[i], high[i]
        if a == b:
            out.append((ids[i], 0, None, None, None, None, sha256(b"").hexdigest(),
                        sha256(b" ".join(words)).hexdigest()))
            continue
        s, e, q = starts[a:b] - first, stops[a:b] - first, periods[a:b]
        best = np.lexsort((q, s, s - e))[0]
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, s + q, 1)
        np.add.at(steps, e, -1)
        kept = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
        lines = "".join(f"{x},{z - x},{y}\n" for x, y, z in zip(s.tolist(), q.tolist(), e.tolist()))
        length, period = int(e[best] - s[best]), int(q[best])
        out.append((ids[i], len(s), int(s[best]), length, period, 1000 * length // period,
                    sha256(lines.encode()).hexdigest(),
                    sha256(b" ".join([words[k] for k in kept.tolist()])).hexdigest()))
    return out


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: bool = True) -> DataFrame:
    """The runs of each row of ``docs``: their number, the longest, and checksums.

    A run is a stretch of at least 12 words and two periods that no neighbouring word extends; its
    period is the smallest one. ``collapsed_sha256`` is of the words left when each run keeps its
    first period. With ``plant``, one document in ten is made periodic first, as its id says. NULL
    and empty texts have no words and no runs; a NULL id is not planted; repeated rows repeat; an
    empty table gives no rows; other columns are not read. Texts are read whole.
    """
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64())
                        for n, t in (c.split() for c in SCHEMA.split(", "))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            out = list(zip(*_slice_rows(ids, texts)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)],
                                              schema=schema)

        for batch in batches:
            ids, texts, size = [], [], 0
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (data.as_py() or b"").split()
                ids.append(key)
                texts.append(planted(key, words) if plant else words)
                size += len(words)
                if size >= SLICE_WORDS:
                    yield done()
                    ids, texts, size = [], [], 0
            if ids:
                yield done()

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                         F.col(text).cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(rows, SCHEMA)


def collapsed(docs: DataFrame, text: str = "text", into: str = "text") -> DataFrame:
    """``docs`` with each run of each text cut to its first period, words joined by one space.

    A text without runs stays as it is; NULL stays NULL.
    """
    @F.pandas_udf("string")
    def collapse(column):
        import pandas as pd

        out = []
        for whole in column:
            words = (whole or "").encode("utf-8", "surrogatepass").split()
            table: dict[bytes, int] = {}
            numbers = np.array([table.setdefault(w, len(table)) for w in words], np.int64)
            starts, ends, periods = find_runs(numbers, np.array([len(words)]))
            if not len(starts):
                out.append(whole)
                continue
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, starts + periods, 1)
            np.add.at(steps, ends, -1)
            out.append(b" ".join([words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0)])
                       .decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    return docs.withColumn(into, collapse(F.col(text)))
