"""Joining documents whose shingle sets have a high Jaccard similarity, by parity sketches.

Every shingle of a set flips one bit of a sketch, so shingles that two sets share cancel out and the
Hamming distance of their sketches is at most the size of their symmetric difference. A similarity of
t in a hundred allows sets of a and b shingles to differ in (a + b)(100 - t) / (100 + t) shingles.
With one block more than that, two sketches agree in at least one whole block: a join on equal blocks
finds every pair. The number of blocks follows the sizes, so it is set per size band; a set also
visits the band below its own if a smaller set there could match it.

Equal sets are one class and join once. Rows of equal block are dealt by ranges of key and class, so
that a very common block is spread over tasks, and streamed in order: each class is paired with the
first of its block only (a star). Pairs pass if their folded sketches are near enough, and are then
verified on the whole sets. Blocks whose classes are still in different components after that are
joined in full, but only classes of different components whose sketches are near enough come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import session
from tidegauge.llm.components import connected_components
from tidegauge.llm.tables import tasks_for

SHINGLE_WORDS = 3
PERCENT = 90
SEED = 42
BAND_RATIO = 1.5
BROADCAST_ROWS = 1 << 20

_M1, _M2, _M3 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_CACHE = 1 << 19  # words whose hash a worker remembers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Sets of shingle hashes; words are hashed once per worker."""

    def __init__(self, shingle_words: int = SHINGLE_WORDS):
        self._n = shingle_words
        self._seen: dict[bytes, int] = {}

    def shingles(self, data: bytes | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle."""
        words = (data or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self._seen) > _CACHE:
            self._seen.clear()
        seen, digest = self._seen, xxhash.xxh64_intdigest
        for w in set(words).difference(seen):
            seen[w] = digest(w, SEED)
        hashes = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        n = min(self._n, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)  # a sequence of fewer words is no shingle
        for k in range(n):
            out = _mix((out + hashes[k:len(words) - n + 1 + k]) * _M1)
        return np.unique(out)


class Bands:
    """Size bands: their bounds, and the blocks that let every pair of a band agree in one."""

    def __init__(self, percent: int = PERCENT):
        if not 0 < percent <= 100:
            raise ValueError("the similarity is a percentage")
        self.percent = percent
        self._lows = [1]

    def band(self, size: int) -> int:
        while self._lows[-1] <= size:
            low = self._lows[-1]
            # Wide enough that a partner is never two bands away.
            self._lows.append(max(int(low * BAND_RATIO), self.most(low)) + 1)
        return int(np.searchsorted(self._lows, size, side="right")) - 1

    def most(self, size: int) -> int:
        """The largest set that may match one of ``size``."""
        return size * 100 // self.percent

    def high(self, band: int) -> int:
        while len(self._lows) <= band + 1:
            self.band(self._lows[-1])
        return self._lows[band + 1] - 1

    def blocks(self, band: int) -> int:
        high = self.high(band)
        return (high + self.most(high)) * (100 - self.percent) // (100 + self.percent) + 1

    def of(self, size: int) -> list[int]:
        """The bands a set takes part in: its own, and the one below if it has partners there."""
        own = self.band(size)
        visits = own > 0 and size <= self.most(self.high(own - 1))
        return [own, own - 1] if visits else [own]


def sketch(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The parity sketch of a set: ``blocks`` blocks of 64 bits."""
    block = (hashes >> np.uint64(32)) % np.uint64(blocks)
    bit = (block << np.uint64(6)) | (hashes & np.uint64(63))
    odd = np.bincount(bit.astype(np.int64), minlength=64 * blocks) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(blocks: np.ndarray) -> np.ndarray:
    """A sketch with eight bits a block, eight blocks to a number; it bounds the difference too."""
    x = blocks.copy()
    for shift in (32, 16, 8):
        x ^= x >> np.uint64(shift)
    out = np.zeros(-(-len(x) // 8) * 8, np.uint8)
    out[: len(x)] = x & np.uint64(255)
    return out.view("<u8")


def block_keys(blocks: np.ndarray, band: int) -> np.ndarray:
    """A hash of band, place and value of each block."""
    place = np.arange(len(blocks), dtype=np.uint64) + np.uint64(band << 40)
    return _mix(blocks ^ _mix((place + np.uint64(1)) * _M1))


_SETS = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("content", pa.int64()), ("n", pa.int64()),
    ("d1", pa.int64()), ("d2", pa.int64()), ("band", pa.int32()),
    ("keys", pa.list_(pa.int64())), ("fold", pa.list_(pa.int64())),
    ("visit_keys", pa.list_(pa.int64())), ("visit_fold", pa.list_(pa.int64()))])
_SETS_DDL = ("uid long, doc_id long, content long, n long, d1 long, d2 long, band int, "
             "keys array<long>, fold array<long>, visit_keys array<long>, visit_fold array<long>")


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_digest(hashes.tobytes(), SEED)
    return tuple(np.frombuffer(whole, "<i8").tolist())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, percent: int, shingle_words: int) -> DataFrame:
    """A row for each of ``docs (uid, doc_id, content, text)``: its set's size, digest and blocks."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bands, nothing = Hasher(shingle_words), Bands(percent), np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, digests, own, parts = [], [], [], [[], [], [], []]
                for data in part.column(3):
                    hashes = hasher.shingles(data.as_py())
                    taken = bands.of(len(hashes)) if len(hashes) else []
                    sizes.append(len(hashes))
                    digests.append(_digest(hashes))
                    own.append(taken[0] if taken else None)
                    for k in range(2):
                        blocks = sketch(hashes, bands.blocks(taken[k])) if k < len(taken) else nothing
                        parts[2 * k].append(block_keys(blocks, taken[k]) if len(blocks) else nothing)
                        parts[2 * k + 1].append(folded(blocks))
                d1, d2 = zip(*digests)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(sizes, pa.int64()),
                     pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(own, pa.int32()),
                     *map(_lists, parts)], schema=_SETS)

    return docs.select("uid", "doc_id", "content", F.col("text").cast("binary")).mapInArrow(
        rows, _SETS_DDL)


_STAR = "key long, pivot long, uid long, n long, visits boolean, band int"


def stars(keyed: DataFrame, parts: int) -> DataFrame:
    """The rows of blocks that more than one class has, each with the first class of its block.

    ``keyed`` has ``key, visits, uid, n, band``. Blocks are dealt by ranges, so one may lie in
    several tasks: each has a first class of its own there, and the first and last block of a task
    come out whatever they hold. Without a first class that is at home in the band, ``pivot`` is NULL.
    """
    schema = pa.schema([("key", pa.int64()), ("pivot", pa.int64()), ("uid", pa.int64()),
                        ("n", pa.int64()), ("visits", pa.bool_()), ("band", pa.int32())])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_pivot = held = None  # held: a row alone in its block so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {n: batch.column(n).to_numpy(zero_copy_only=False)
                    for n in ("key", "uid", "n", "visits", "band")}
            key = rows["key"]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            pivots, alone, shown = rows["uid"][starts].copy(), rows["visits"][starts].copy(), sizes > 1
            if last_key is None:
                shown[0] = True
            elif key[0] == last_key:  # the block began in an earlier batch
                shown[0] = True
                pivots[0], alone[0] = last_pivot or 0, last_pivot is None
                if held is not None:
                    yield held
            out = pa.RecordBatch.from_arrays([
                pa.array(key), pa.array(np.repeat(pivots, sizes), mask=np.repeat(alone, sizes)),
                *(pa.array(rows[n]) for n in ("uid", "n", "visits", "band"))], schema=schema)
            held = None if shown[-1] else out.slice(len(key) - 1)
            last_key, last_pivot = key[-1], None if alone[-1] else int(pivots[-1])
            yield out.filter(pa.array(np.repeat(shown, sizes)))
        if held is not None:
            yield held

    order = ["key", "visits", "uid"]
    dealt = keyed.select("key", "visits", "uid", "n", "band").repartitionByRange(
        parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(pair, _STAR)


def _apart(x: Column, y: Column) -> Column:
    """Hamming distance of two sketches."""
    bits = F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s + b)


def _may_match(na: Column, nb: Column, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _near(na: Column, nb: Column, apart: Column, percent: int) -> Column:
    """A difference of ``apart`` or more still allows the similarity."""
    return apart * (100 + percent) <= (na + nb) * (100 - percent)


class Join:
    """The join of one table of documents; its tables lie in a folder below the checkpoint folder."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 percent: int = PERCENT, shingle_words: int = SHINGLE_WORDS):
        self.spark, self.percent, self.shingle_words = docs.sparkSession, percent, shingle_words
        self.folder = session.scratch(self.spark, "jaccard-join")
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                                F.col(text).cast("string").alias("text"))
        numbered = self.docs.withColumns({"uid": F.monotonically_increasing_id(),
                                          "content": F.xxhash64("text")})
        self.rows = self.written(sketches(numbered, percent, shingle_words), "rows")
        filled = self.rows.filter("n > 0")
        self.classes = self.written(filled.groupBy("n", "d1", "d2").agg(
            F.min("uid").alias("uid"), F.min("doc_id").alias("least"),
            F.count("*").alias("copies")), "classes")

    def written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def links(self) -> DataFrame:
        """``a, b``: links between classes that connect every two classes that any link connects."""
        one_each = self.rows.join(self.classes.select("uid"), "uid", "left_semi")
        single = self.written(one_each.select(
            "uid", "doc_id", "content", "n", "d1", "d2", "band", "keys", "fold", "visit_keys",
            "visit_fold"), "single")
        own = single.select(F.explode("keys").alias("key"), F.lit(False).alias("visits"), "uid", "n",
                            "band")
        visits = single.filter(F.size("visit_keys") > 0).select(
            F.explode("visit_keys").alias("key"), F.lit(True).alias("visits"), "uid", "n",
            (F.col("band") - 1).alias("band"))
        parts = tasks_for(single, 16 << 20)
        star = self.written(stars(own.unionByName(visits), parts), "stars")
        folds = single.select("uid", "band", "fold").unionByName(
            single.filter(F.size("visit_keys") > 0).select(
                "uid", (F.col("band") - 1).alias("band"), F.col("visit_fold").alias("fold")))
        folds = self.written(folds.join(star.select("uid", "band").distinct(), ["uid", "band"],
                                        "left_semi"), "folds")
        sizes = single.select("uid", "n")
        first = star.filter("uid <> pivot").select(
            F.col("pivot").alias("a"), F.col("uid").alias("b"), "band").distinct()
        fa = folds.join(sizes, "uid").select(F.col("uid").alias("a"), "band", F.col("n").alias("na"),
                                             F.col("fold").alias("fa"))
        fb = fa.select(F.col("a").alias("b"), "band", F.col("na").alias("nb"), F.col("fa").alias("fb"))
        near = first.join(fa, ["a", "band"]).join(fb, ["b", "band"]).filter(
            _may_match(F.col("na"), F.col("nb"), self.percent)
            & _near(F.col("na"), F.col("nb"), _apart(F.col("fa"), F.col("fb")), self.percent))
        near = self.written(near.select("a", "b").distinct(), "near")
        linked = self.written(self.verified(single, near, "first"), "linked")
        roots = self.written(connected_components(linked), "first-roots")

        rooted = star.join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn(
            "root", F.coalesce("root", "uid"))
        rooted = self.written(rooted, "rooted")
        # Two classes of one first class have been compared already.
        open_keys = self.written(rooted.groupBy("key").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many"),
            F.min("pivot").alias("p"), F.max("pivot").alias("q"),
            F.max(F.col("pivot").isNull()).alias("alone")).filter(
            "low <> high AND (many > 2 OR p <> q OR alone)").select("key"), "open-keys")
        members = self.written(
            rooted.join(open_keys, "key", "left_semi").join(folds, ["uid", "band"]), "open")
        a, b = members.alias("a"), members.alias("b")
        order = (F.col("a.uid") < F.col("b.uid")) | F.col("b.visits")
        second = a.join(b, (F.col("a.key") == F.col("b.key")) & ~F.col("a.visits") & order
                        & (F.col("a.root") != F.col("b.root"))
                        & ~F.coalesce(F.col("a.pivot") == F.col("b.uid"), F.lit(False))
                        & ~F.coalesce(F.col("b.pivot") == F.col("a.uid"), F.lit(False))
                        & _may_match(F.col("a.n"), F.col("b.n"), self.percent)
                        & _near(F.col("a.n"), F.col("b.n"), _apart(F.col("a.fold"), F.col("b.fold")),
                                self.percent))
        second = self.written(second.select(F.least("a.uid", "b.uid").alias("a"),
                                            F.greatest("a.uid", "b.uid").alias("b")).distinct(), "second")
        across = self.written(self.verified(single, second, "second"), "across")
        return linked.unionByName(across)

    def verified(self, single: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs ``a, b`` whose whole sets are similar enough."""
        named = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
        wanted = self.written(single.join(named, "uid", "left_semi").select(
            "uid", "doc_id", "content", "d1", "d2"), f"{name}-wanted")
        sets = self.written(self._sets(wanted), f"{name}-sets")
        x = sets.select(F.col("uid").alias("a"), F.col("hashes").alias("x"))
        y = sets.select(F.col("uid").alias("b"), F.col("hashes").alias("y"))
        both = F.size(F.array_intersect("x", "y")).cast("long")
        union = F.size("x") + F.size("y") - F.col("both")
        return (pairs.join(x, "a").join(y, "b").withColumn("both", both)
                .filter(F.col("both") * 100 >= union * self.percent).select("a", "b"))

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """``uid, hashes`` of the documents in ``wanted``, from their texts.

        They meet by id and content; a digest of the set then says whether it is the right one.
        """
        schema = pa.schema([("uid", pa.int64()), ("hashes", pa.list_(pa.int64()))])
        n = self.shingle_words

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(n)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    uids, sets = [], []
                    for uid, d1, d2, data in zip(*(part.column(k).to_pylist() for k in range(3)),
                                                 part.column(3)):
                        hashes = hasher.shingles(data.as_py())
                        if _digest(hashes) == (d1, d2):
                            uids.append(uid)
                            sets.append(hashes)
                    yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), _lists(sets)],
                                                     schema=schema)

        ids = wanted.select("uid", F.col("doc_id").alias("id"), F.col("content").alias("c"), "d1", "d2")
        if wanted.count() <= BROADCAST_ROWS:
            ids = F.broadcast(ids)
        texts = self.docs.join(ids, (F.xxhash64("text") == F.col("c"))
                               & F.col("doc_id").eqNullSafe(F.col("id")))
        return (texts.select("uid", "d1", "d2", F.col("text").cast("binary"))
                .mapInArrow(rows, "uid long, hashes array<long>").dropDuplicates(["uid"]))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
           shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs``.

    Rows link if the shared shingles of their sets are at least ``percent`` in a hundred of both
    sets' union; ``component_id`` is the smallest doc_id reachable. NULL, empty and wordless texts
    have no shingles and link with nothing: their component is their own id. A NULL doc_id is never
    the smallest, a group without any id has component NULL. Repeated rows repeat, an empty table
    gives no rows, other columns are not read. Shingles are compared by 64-bit hashes.
    """
    join = Join(docs, doc_id, text, percent, shingle_words)
    roots = join.written(connected_components(join.links()), "roots")
    rooted = join.written(join.classes.join(roots.withColumnRenamed("node", "uid"), "uid", "left").select(
        "n", "d1", "d2", "least", F.coalesce("root", "uid").alias("root")), "class-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = join.written(rooted.join(least, "root").select("n", "d1", "d2", "component_id"), "components")
    filled = join.rows.filter("n > 0").join(found, ["n", "d1", "d2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    bare = join.rows.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return filled.unionByName(bare)


def components_sql(percent: int = PERCENT, n: int = SHINGLE_WORDS) -> str:
    """The same rows by counting the shingles that every two sets share."""
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {joined}))) END AS s
  FROM words),
classes AS (SELECT min(r) AS c, s, min(doc_id) AS least, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
each AS (SELECT c, n, unnest(s) AS shingle FROM classes),
pairs AS (
  SELECT a.c AS a, b.c AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.c < b.c
    AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent}
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
least_of AS (SELECT a AS c, min(least) AS component_id FROM reach JOIN classes ON b = c GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE component_id END AS component_id
FROM sets LEFT JOIN classes USING (s) LEFT JOIN least_of USING (c)"""
