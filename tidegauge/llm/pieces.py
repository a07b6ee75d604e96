"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into units that no piece of the vocabulary crosses: a run of space marks with what
follows. The distinct units of each bucket of documents spell out their substrings of bounded
length; an equi-join with the piece table leaves the lattice's edges; the edges of a unit are
grouped and folded into the unit's cuts, a bit for each place where a piece begins. Documents and
the cuts of their bucket then meet, and the cuts give the pieces.

Of a large corpus the units most frequent in a part of it go through the lattice once, and their
ids to every task; buckets ask only for the cuts of their other units.

A piece table of a unigram model is folded by Viterbi (best sum of scores). A byte-pair model's
pieces are the outcome of merges in order of score, which the best sum does not always give, so its
fold applies the best possible merge, the leftmost of equals, until none is left, to all units of an
Arrow batch at a time.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from tidegauge import session
from tidegauge.llm.tables import numbered, spelled, tasks_for

SPACE = "▁"
ALONE = r"\x00-\x0c\x0e-\x1f"  # characters in no piece of several
# No piece goes on from a Latin letter to one of these marks: a unit ends between them.
LETTER, MARK = "[A-Za-zÀ-ÖØ-öø-ɏ]", "[.,!?;:*]"
_RUN = rf"[^{SPACE}{ALONE}]"
UNIT = rf"{SPACE}*(?:{_RUN}*?{LETTER}(?={MARK})|{_RUN}+)|{SPACE}+|[{ALONE}]"
BETWEEN = "\x00"  # one of those: a unit by itself wherever it stands
LONGEST = 60  # characters of a unit whose cuts fit in one number; longer ones are merged by a heap
BUCKET_BYTES = 4 << 20
GROUPS_IN_MEMORY = 1 << 18
UNITS_AT_ONCE = 1 << 14  # units whose edges are in numpy at a time
# Units whose ids go to every task, and the buckets they are counted in. They only save work: a unit
# that is not among them goes through the lattice of its bucket.
STORE_UNITS = 1 << 18
STORE_BUCKETS = 20


@dataclass(frozen=True)
class Model:
    """Pieces by id with their scores; ``merges`` tells a byte-pair model from a unigram one."""
    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    unknown: int
    merges: bool
    ids: dict[str, int] = field(repr=False)

    @staticmethod
    def load(path: str) -> Model:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = processor.get_piece_size()
        plain = [i for i in range(n) if not (processor.is_control(i) or processor.is_unknown(i)
                                             or processor.is_unused(i) or processor.is_byte(i))]
        pieces = [processor.id_to_piece(i) for i in range(n)]
        by_byte = {pieces[i]: i for i in range(n) if processor.is_byte(i)}
        model = Model(pieces, [processor.get_score(i) for i in range(n)],
                      [by_byte[f"<0x{b:02X}>"] for b in range(256)] if by_byte else [],
                      processor.unk_id(), _is_byte_pair(path), {pieces[i]: i for i in plain})
        for piece in model.ids:
            if len(piece) > 1 and len(re.findall(UNIT, piece)) != 1:
                raise ValueError(f"a piece crosses units: {piece!r}")
        return model

    def table(self, spark: SparkSession) -> DataFrame:
        """``piece, rank, score`` of the pieces a lattice can hold; rank 0 merges first.

        Merges make pieces of two characters or more, a unigram's best path also takes single ones.
        """
        several = [p for p in self.ids if len(p) >= self.shortest()]
        ranks = {s: r for r, s in enumerate(sorted({self.scores[self.ids[p]] for p in several},
                                                   reverse=True))}
        return spark.createDataFrame(
            pd.DataFrame({"piece": several, "rank": [ranks[self.scores[self.ids[p]]]
                                                     for p in several],
                          "score": [self.scores[self.ids[p]] for p in several]}))

    def shortest(self) -> int:
        return 2 if self.merges else 1

    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    def piece_ids(self, piece: str) -> list[int]:
        """The id of a piece; of a character without one the ids of its bytes."""
        if piece in self.ids:
            return [self.ids[piece]]
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]

    @cached_property
    def _byte_of(self) -> dict[int, int]:
        return {i: b for b, i in enumerate(self.byte_ids)}

    def text(self, ids: list[int]) -> str:
        """The text of ids: bytes that make no character are replaced, the first space is dropped."""
        byte_of = self._byte_of
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            if i in byte_of:
                pending.append(byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.pieces[i])
        out.append(pending.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ").removeprefix(" ")

    @cached_property
    def _spelled(self) -> list[str]:
        return [piece.replace(SPACE, " ") for piece in self.pieces]

    @cached_property
    def _is_byte(self) -> np.ndarray:
        return np.isin(np.arange(len(self.pieces)), self.byte_ids)

    def decoded(self, ids: np.ndarray) -> str:
        """``text`` of an array of ids; where no id is a byte's, they are looked up at once."""
        if self._is_byte[ids].any():
            return self.text(ids.tolist())
        return "".join(map(self._spelled.__getitem__, ids.tolist())).removeprefix(" ")


def _is_byte_pair(path: str) -> bool:
    """From the file's trainer settings, field 2 of the model, where field 3 is the kind: 2 is BPE."""
    with open(path, "rb") as file:
        trainer = _fields(file.read(), 2)
    return any(_fields(t, 3) == [2] for t in trainer)


def _fields(data: bytes, wanted: int) -> list:
    """Values of one field of a serialized message (the wire format of protocol buffers)."""
    out, at = [], 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at:at + size]
            at += size
        if key >> 3 == wanted:
            out.append(value)
    return out


def units_of(text: str | None) -> list[str]:
    return _UNITS.findall(SPACE + text.replace(" ", SPACE)) if text else []


_UNITS = re.compile(UNIT)
# A run of space marks and what follows up to the next: units never cross the start of such a run.
_STRETCHES = re.compile(f"{SPACE}+[^{SPACE}]*")


def rests_of(text: str | None) -> list[str]:
    """The text in stretches of whole units, each without its first space mark."""
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    if SPACE * 2 in marked:
        return [stretch[1:] for stretch in _STRETCHES.findall(marked)]
    return marked.split(SPACE)[1:]  # the same, several times as fast


def units_in(stretches: Iterable[str]) -> list[str]:
    """The units of stretches, and single characters between them."""
    return _UNITS.findall(BETWEEN.join(stretches))


def lattice(units: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """Edges of each unit: every substring that is a piece of the model's table.

    ``units`` has ``keys`` and ``unit``; the edges of a unit come as one array, sorted by rank and
    then from the left. A unit without edges has no row.
    """
    spark = units.sparkSession
    table = model.table(spark)
    most = model.longest()
    size = F.length("unit")
    # Start and length of every substring, by two plain explodes: generated code passes the unit on
    # without a copy.
    least = model.shortest()
    starts = F.sequence(F.lit(1), size - (least - 1))
    sizes = F.sequence(F.lit(least), F.least(F.lit(most), size - F.col("start") + 1))
    cut = (units.filter((size >= 2) & (size <= LONGEST))
           .select(*keys, "unit", F.explode(starts).alias("start"))
           .select(*keys, "unit", "start", F.explode(sizes).alias("size"))
           .withColumn("piece", F.substring("unit", F.col("start"), F.col("size"))))
    edges = cut.join(F.broadcast(table), "piece")  # as large as the vocabulary
    if model.merges:  # one number: rank, start, size
        packed = (F.shiftleft(F.col("rank").cast("long"), 16)
                  .bitwiseOR(F.shiftleft(F.col("start").cast("long"), 8))
                  .bitwiseOR(F.col("size").cast("long")))
        return edges.groupBy(*keys, "unit").agg(F.sort_array(F.collect_list(packed)).alias("edges"))
    return edges.groupBy(*keys, "unit").agg(F.array_sort(F.collect_list(
        F.struct((F.col("start") + F.col("size")).alias("end"), "start", "score"))).alias("edges"))


def _shift(name: str, value: Column, n: Column) -> Column:
    return F.call_function(name, value, n)


def merged_masks(sizes: np.ndarray, packed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fold of a byte-pair lattice: bit i is set if a piece begins at character i (or the unit ends).

    ``sizes`` are the units' lengths, ``packed`` their edges one unit after the other, ``counts`` to a
    unit. A merge is possible if a piece begins where the edge does and where it ends, and just one
    does in between.
    """
    one = np.int64(1)
    unit = np.repeat(np.arange(len(counts)), counts)
    cuts = (one << (sizes.astype(np.int64) + 1)) - 1
    length = packed & 255
    inner = ((one << (length - 1)) - 1) << ((packed >> 8) & 255)
    ends = ((inner << 1) | (inner >> 1)) & ~inner
    while len(unit):
        now = cuts[unit]
        # An end that is gone never comes back.
        open_ends = (now & ends) == ends
        possible = np.flatnonzero(open_ends & (np.bitwise_count(now & inner) == 1))
        of_unit = unit[possible]
        best = possible[np.diff(of_unit, prepend=-1) > 0]
        cuts[unit[best]] &= ~inner[best]
        merged = np.zeros(len(cuts), bool)
        merged[unit[best]] = True
        open_ends[best] = False
        left = open_ends & merged[unit]
        unit, inner, ends = unit[left], inner[left], ends[left]
    return cuts


@F.arrow_udf(LongType())
def merged_cuts(size: pa.Array, edges: pa.Array) -> pa.Array:
    """``merged_masks`` of the units' lengths and their arrays of edges."""
    return pa.array(merged_masks(*[a.to_numpy(zero_copy_only=False) for a in (
        size, edges.flatten(), edges.value_lengths())]))


def viterbi_cuts(unit: Column, edges: Column, unknown: float) -> Column:
    """Fold of a unigram lattice, from the left: the best sum of scores up to each character.

    A character that is no piece scores ``unknown``. Of equal sums the one whose last piece is
    longest wins.
    """
    start = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(1).cast("long").alias("cuts")))

    def reach(best: Column, end: Column) -> Column:
        alone = F.struct((F.get(best, end - 1)["sum"] + unknown).alias("sum"),
                         (end - 1).alias("start"))
        ways = F.transform(F.filter(edges, lambda e: e["end"] == end + 1), lambda e: F.struct(
            (F.get(best, e["start"] - 1)["sum"] + e["score"]).alias("sum"),
            (e["start"] - 1).alias("start")))
        top = F.array_max(F.transform(F.concat(ways, F.array(alone)), lambda w: F.struct(
            w["sum"].alias("sum"), (-w["start"]).alias("back"))))
        return F.transform(F.array(top), lambda t: F.struct(
            t["sum"].alias("sum"),
            F.get(best, -t["back"])["cuts"].bitwiseOR(
                _shift("shiftleft", F.lit(1).cast("long"), end)).alias("cuts")))

    folded = F.aggregate(F.sequence(F.lit(1), F.length(unit)), start,
                         lambda best, end: F.concat(best, reach(best, end)))
    return F.element_at(folded, -1)["cuts"]


def unfolded(units: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """``keys, unit, found`` of the units that have a choice: the cuts, or what ``folded`` takes."""
    edges = lattice(units, keys, model)
    # A byte-pair lattice is folded where the ids are made: a step of its own in Python costs more.
    found = F.col("edges") if model.merges else viterbi_cuts(
        F.col("unit"), F.col("edges"), min(model.scores) - 10.0)
    return edges.select(*keys, "unit", found.alias("found"))


def folded(units: pd.Series, found: pd.Series, model: Model) -> np.ndarray:
    """The cuts of units by what was ``found``."""
    if model.merges and len(found):
        return merged_masks(units.map(len).to_numpy(), np.concatenate(found.to_list()),
                            found.map(len).to_numpy())
    return np.asarray(found, np.int64)


def cuts(units: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """``keys, unit, cuts`` of the units that have a choice; the others are single characters."""
    edges = lattice(units, keys, model)
    if model.merges:
        folded = merged_cuts(F.length("unit"), F.col("edges"))
    else:
        folded = viterbi_cuts(F.col("unit"), F.col("edges"), min(model.scores) - 10.0)
    return edges.select(*keys, "unit", folded.alias("cuts"))


def heap_pieces(unit: str, model: Model) -> list[str]:
    """Pieces of a unit too long for the fold, by the same merges in order of score."""
    if not model.merges:
        return _best_pieces(unit, model)
    parts = list(unit)
    after = list(range(1, len(parts))) + [-1]
    before = list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if j >= 0:
            both = parts[i] + parts[j]
            if both in model.ids:
                heapq.heappush(heap, (-model.scores[model.ids[both]], i, j, both))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if not parts[i] or after[i] != j or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p]


def _best_pieces(unit: str, model: Model) -> list[str]:
    worst = min(model.scores) - 10.0
    most = model.longest()
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(unit) + 1):
        ways = []
        for begin in range(max(0, end - most), end):
            piece = unit[begin:end]
            if piece in model.ids or end - begin == 1:
                score = model.scores[model.ids[piece]] if piece in model.ids else worst
                ways.append((best[begin][0] + score, -begin))
        top = max(ways)
        best.append((top[0], -top[1]))
    out, end = [], len(unit)
    while end:
        out.append(unit[best[end][1]:end])
        end = best[end][1]
    return out[::-1]


def cut_pieces(unit: str, mask: int) -> list[str]:
    places = [i for i in range(len(unit) + 1) if mask >> i & 1]
    return [unit[a:b] for a, b in zip(places, places[1:])]


def unit_ids(unit: str, mask: int | None, model: Model) -> bytes:
    """The ids of a unit by its cuts; without cuts it has one character to a piece, or is long."""
    if mask is not None:
        parts = cut_pieces(unit, mask)
    else:
        parts = heap_pieces(unit, model) if len(unit) > LONGEST else list(unit)
    return np.array([i for p in parts for i in model.piece_ids(p)], "<i4").tobytes()


def gives_back(unit: str, ids: bytes, model: Model) -> bool:
    """Whether the ids decode to the unit; a space before it keeps its own."""
    return model.text([*model.piece_ids(SPACE), *np.frombuffer(ids, "<i4").tolist()]) == unit.replace(SPACE, " ")


def ids_of_units(units: list[str], masks: np.ndarray, model: Model) -> tuple[dict[str, bytes], set[str]]:
    """The ids of units by their cuts, all at once, and the units not all of whose pieces have an id.

    The ids of the others give them back.
    """
    text = "".join(units)
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    bits = np.unpackbits(np.ascontiguousarray(masks, "<i8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")
    unit, place = np.nonzero(bits)
    place += (np.cumsum(sizes) - sizes)[unit]
    inside = unit[1:] == unit[:-1]  # a piece lies between two places of one unit
    unit = unit[1:][inside]
    get = model.ids.get
    ids = np.array([get(text[a:b], -1) for a, b in zip(
        place[:-1][inside].tolist(), place[1:][inside].tolist())], "<i4")
    ends = 4 * np.cumsum(np.bincount(unit, minlength=len(units)))
    data = ids.tobytes()
    found = {u: data[a:b] for u, a, b in zip(units, [0, *ends.tolist()], ends.tolist())}
    lacking = np.unique(unit[ids < 0]).tolist()
    for i in lacking:
        found[units[i]] = unit_ids(units[i], int(masks[i]), model)
    return found, {units[i] for i in lacking}


def ids_found(units: pd.Series, found: pd.Series, model: Model) -> tuple[dict[str, bytes], set[str]]:
    """``ids_of_units`` by what was ``found``, in parts: edges take many times the memory of ids."""
    ids: dict[str, bytes] = {}
    unsure: set[str] = set()
    for at in range(0, len(units), UNITS_AT_ONCE):
        part, of_part = units.iloc[at:at + UNITS_AT_ONCE], found.iloc[at:at + UNITS_AT_ONCE]
        some, doubtful = ids_of_units(part.tolist(), folded(part, of_part, model), model)
        ids |= some
        unsure |= doubtful
    return ids, unsure


class Store(Mapping):
    """Ids by unit, and the ``odd`` units: those that their ids do not give back.

    It is kept, and goes to the tasks, as an Arrow table ``unit, ids, odd``, and is made a look-up there.
    """

    def __init__(self, table: pa.Table) -> None:
        self._table = table

    def __getstate__(self) -> pa.Table:
        return self._table

    def __setstate__(self, table: pa.Table) -> None:
        made = Store(table)
        self.ids, self.odd = made.ids, made.odd

    @cached_property
    def ids(self) -> dict[str, bytes]:
        return dict(zip(self._table["unit"].to_pylist(), self._table["ids"].to_pylist()))

    @cached_property
    def odd(self) -> set[str]:
        return set(self._table.filter(self._table["odd"])["unit"].to_pylist())

    def __getitem__(self, unit: str) -> bytes:
        return self.ids[unit]

    def __iter__(self) -> Iterator[str]:
        return iter(self.ids)

    def __len__(self) -> int:
        return len(self.ids)


NO_STORE = pa.table({"unit": pa.array([], pa.string()), "ids": pa.array([], pa.binary()),
                     "odd": pa.array([], pa.bool_())})


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The rows of ``counts (unit, n)`` with the largest counts; ties go by the unit.

    They are found by the count that the last of them has: an ordered limit over all rows would send
    every task's share of them to the driver.
    """
    least, left = 0, 0
    for n, units_of in sorted(counts.groupBy("n").agg(F.count("*")).collect(), reverse=True):
        if units_of > size:
            least, left = n, size
            break
        size -= units_of
    above = counts.filter(F.col("n") > least)
    return above.union(counts.filter(F.col("n") == least).orderBy("unit").limit(left)) if left else above


def frequent_units(texts: DataFrame, model: Model, size: int) -> Store:
    """The ids of the most frequent units of ``texts (text)``, through the lattice."""
    def table(rests: Counter[str]) -> pd.DataFrame:
        counts: Counter[str] = Counter()
        for rest, n in rests.items():
            for unit in _UNITS.findall(SPACE + rest):
                counts[unit] += n
        return pd.DataFrame({"unit": list(counts), "n": list(counts.values())})

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for frame in frames:
            for text in frame["text"]:
                counts.update(rests_of(text))
                if len(counts) > GROUPS_IN_MEMORY:
                    yield table(counts)
                    counts.clear()
        if counts:
            yield table(counts)

    spark = texts.sparkSession
    folder = session.scratch(spark, "piece-units")
    (texts.mapInPandas(counted, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
     .filter((F.col("n") > 1) & (F.length("unit") <= LONGEST)).write.parquet(folder))
    chosen = most_frequent(spark.read.parquet(folder), size).select("unit")
    chosen = chosen.repartition(spark.sparkContext.defaultParallelism, "unit")
    choices = chosen.join(unfolded(chosen, [], model), "unit", "left")
    shared = spark.sparkContext.broadcast(model)

    def spelled_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in frames:
            alone = frame["found"].isna()
            cut = frame[~alone]
            ids, unsure = ids_found(cut["unit"], cut["found"], model)
            for unit in frame["unit"][alone]:
                ids[unit] = unit_ids(unit, None, model)
                unsure.add(unit)
            yield pd.DataFrame({
                "unit": frame["unit"], "ids": [ids[u] for u in frame["unit"]],
                "odd": [u in unsure and not gives_back(u, ids[u], model) for u in frame["unit"]]})

    return Store(choices.mapInPandas(spelled_out, "unit string, ids binary, odd boolean").toArrow())


def encode(docs: DataFrame, model: Model, digest: bool = False) -> DataFrame:
    """``doc_id, ids`` of each row of ``docs``; as a digest ``doc_id, n_pieces, ids_crc32, decodes``.

    ``ids`` are those of the SentencePiece library. For ``decodes`` the ids of every text are decoded: it
    tells whether they give the text back (a space mark in a text comes back as a space). NULL and empty texts have no pieces.
    Repeated rows repeat, a NULL id is an id, other columns are not read, an empty table gives no rows.
    """
    spark = docs.sparkSession
    # A bucket's units are grouped in memory: their number is bounded by the bucket's bytes.
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPS_IN_MEMORY))
    buckets = tasks_for(docs, BUCKET_BYTES, spark.sparkContext.defaultParallelism)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.col("doc_id").cast("long")
    narrow = docs.select(F.pmod(F.xxhash64(number, text), F.lit(buckets)).cast("int").alias("bucket"),
                         spelled(number)[0].alias("doc_id"), text.alias("text"))
    store = Store(NO_STORE)
    if buckets > STORE_BUCKETS:
        store = frequent_units(narrow.filter(F.col("bucket") < STORE_BUCKETS).select("text"), model,
                               STORE_UNITS)
    shared = spark.sparkContext.broadcast((model, store))
    routed = narrow.repartitionById(buckets, "bucket")  # one bucket to a task, never two

    def fresh_units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The units of each bucket that are not stored, repeated if they are too many to remember."""
        known = shared.value[1].ids
        seen: set[str] = set()
        bucket = None
        for frame in frames:
            for number, group in frame.groupby("bucket")["text"]:
                if number != bucket or len(seen) > GROUPS_IN_MEMORY:
                    seen.clear()
                    bucket = number
                rests: set[str] = set()
                for text in group:
                    rests.update(rests_of(text))
                rests -= seen
                seen |= rests
                # A stretch that is stored is a unit.
                fresh = set(units_in(s for s in (SPACE + r for r in rests) if s not in known))
                units = [u for u in fresh if u not in known and 2 <= len(u) <= LONGEST]
                if units:
                    yield pd.DataFrame({"bucket": np.full(len(units), number, np.int32), "unit": units})

    # The documents' columns are kept, so that one exchange of them serves both.
    units = (routed.mapInPandas(fresh_units, "bucket int, unit string")
             .repartitionById(buckets, "bucket").distinct())
    cut = unfolded(units, ["bucket"], model).withColumnRenamed("bucket", "cut_bucket")

    def join(docs_of: pd.DataFrame, cuts_of: pd.DataFrame) -> pd.DataFrame:
        model, store = shared.value
        stored = store.ids
        fresh, _ = ids_found(cuts_of["unit"], cuts_of["found"], model)

        class Known(dict):
            """Ids by stretch without its first mark."""

            def __missing__(self, rest: str) -> bytes:
                stretch = SPACE + rest
                out = []
                # A stretch that is stored or fresh is a unit.
                whole = stretch in stored or stretch in fresh
                for unit in [stretch] if whole else _UNITS.findall(stretch):
                    ids = stored.get(unit)
                    if ids is None:
                        ids = fresh.get(unit)
                    out.append(unit_ids(unit, None, model) if ids is None else ids)
                self[rest] = b"".join(out)
                return self[rest]

        known = Known()
        rows = []
        for doc_id, text in zip(docs_of["doc_id"], docs_of["text"]):
            data = b"".join(map(known.__getitem__, rests_of(text)))
            ids = np.frombuffer(data, "<i4")
            if digest:
                rows.append((doc_id, len(ids), zlib.crc32(data), model.decoded(ids) == text.replace(SPACE, " ")))
            else:
                rows.append((doc_id, ids))
        names = ["doc_id", "n_pieces", "ids_crc32", "decodes"] if digest else ["doc_id", "ids"]
        return pd.DataFrame(rows, columns=names)

    schema = ("doc_id string, n_pieces long, ids_crc32 long, decodes boolean" if digest
              else "doc_id string, ids array<int>")
    return numbered(routed.groupBy("bucket").cogroup(cut.groupBy("cut_bucket")).applyInPandas(
        join, schema), "doc_id")


def decode(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``text`` from their ``ids``; NULL ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in ids:
            yield pd.Series([shared.value.text([] if x is None else list(x)) for x in batch])

    return rows.withColumn("text", text("ids"))
