"""Near-duplicates by SimHash fingerprints, found with pivot distance tables.

Every distinct fingerprint gets a row of distances to reference fingerprints (pivots), packed seven
to a number. By the triangle inequality two fingerprints within k bits differ by at most k in every
coordinate, so one packed comparison discards a pair for all pivots of a word at once; what survives
is verified bit by bit.

Distances to random pivots lie close together, so they cannot name the pairs to look at. These meet
by equal keys: of six bands of a fingerprint, at most four hold the four differing bits, so two
bands agree, and each pair is looked at under its first two agreeing bands only. Keys that very many
fingerprints share are not paired at all. There, two fingerprints are within 2r bits exactly if some
fingerprint is within r bits of both; each names the fingerprints within r bits of itself, and those
who name the same one are linked in a star.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import session
from tidegauge.llm.components import connected_components
from tidegauge.llm.tables import numbered, spelled

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
CROWD = 8192

_WIDTHS = (11, 11, 11, 11, 10, 10)
_OFFSETS = tuple(sum(_WIDTHS[:i]) for i in range(len(_WIDTHS)))
_TABLES = tuple(combinations(range(len(_WIDTHS)), 2))
_LANES = 7  # distances in one number; the sign bit stays free
_PIVOT_WORDS = 2


def _pivots() -> list[int]:
    """Reference fingerprints: zero, then spread evenly over all fingerprints."""
    hashes = [xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(_LANES * _PIVOT_WORDS)]
    return [0, *hashes[1:]]


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = max(len(words) - shingle_words + 1, 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in
                       zip(starts[:last].tolist(), ends[-last:].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, last, 1 << 16):  # bounded, however long the text
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` and the carried columns (of type bigint) of each row of ``docs``."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch["_text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps.astype(np.int64),
                                **{name: batch[name] for name in carry}})

    narrow = docs.select(spelled(doc_id)[0].alias("doc_id"), F.col(text).alias("_text"),
                         *[c.alias(n) for c, n in zip(spelled(*carry), carry)])
    return numbered(narrow.mapInPandas(rows, ", ".join(["doc_id string", "fp long",
                                                        *[f"{c} string" for c in carry]])),
                    "doc_id", *carry)


def _band(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, _OFFSETS[i]).bitwiseAND(F.lit((1 << _WIDTHS[i]) - 1))


def _key(fp: Column, t: int) -> Column:
    i, j = _TABLES[t]
    key = F.shiftleft(_band(fp, i), 11).bitwiseOR(_band(fp, j))
    return key.bitwiseOR(F.lit(t << 22).cast("long"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distances(fp: Column, word: int) -> Column:
    """Distances to the pivots of one word, eight bits each."""
    packed = F.lit(0).cast("long")
    for lane, pivot in enumerate(_pivots()[word * _LANES:(word + 1) * _LANES]):
        distance = F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)))).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(distance, 8 * lane))
    return packed


def _lanes(value: int) -> int:
    return sum(value << 8 * lane for lane in range(_LANES))


def _near_in_all_pivots(a: Column, b: Column, bits: int) -> Column:
    """No coordinate of two packed words differs by more than ``bits``: a lane's top bit says so."""
    bias, top = F.lit(_lanes(0x80 + bits)), F.lit(_lanes(0x80))
    return ((a + bias - b).bitwiseAND(b + bias - a)).bitwiseAND(top) == top


def _first_table(x: Column) -> Column:
    """The number of the first two bands in which the bits of ``x`` are all zero."""
    out = F.lit(len(_TABLES))
    for t in reversed(range(len(_TABLES))):
        mask = sum(((1 << _WIDTHS[b]) - 1) << _OFFSETS[b] for b in _TABLES[t])
        out = F.when(x.bitwiseAND(F.lit(_signed(mask))) == 0, t).otherwise(out)
    return out


def links(distinct: DataFrame, bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """``a, b``: enough pairs of fingerprints within ``bits`` to connect all that are.

    ``distinct`` has one column ``fp`` without repeats. Keys of up to ``crowd`` fingerprints give
    every pair within ``bits`` once; larger ones give stars with the same connected components.
    """
    if not 0 < bits <= len(_WIDTHS) - 2:
        raise ValueError("two of the bands must agree")
    spark = distinct.sparkSession
    fp = F.col("fp")
    folder = session.scratch(spark, "simhash-keys")
    keyed = distinct.select(
        fp, *[_distances(fp, w).alias(f"p{w}") for w in range(_PIVOT_WORDS)],
        F.explode(F.array(*[_key(fp, t) for t in range(len(_TABLES))])).alias("key"))
    keyed.write.parquet(folder)
    keyed = spark.read.parquet(folder)
    crowded = f"{folder}-crowded"
    keyed.groupBy("key").count().filter(F.col("count") > crowd).select("key").write.parquet(crowded)
    crowds = spark.read.parquet(crowded)
    if crowds.isEmpty():
        return _pairs(keyed, bits)
    single = keyed.join(crowds, "key", "left_anti")
    many = keyed.join(crowds, "key", "left_semi").select("key", "fp")
    return _pairs(single, bits).unionByName(_stars(many, bits))


def _pairs(keyed: DataFrame, bits: int) -> DataFrame:
    a, b = keyed.alias("a"), keyed.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    condition = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    for w in range(_PIVOT_WORDS):
        condition &= _near_in_all_pivots(F.col(f"a.p{w}"), F.col(f"b.p{w}"), bits)
    condition &= F.bit_count(x) <= bits
    condition &= _first_table(x) == F.shiftright(F.col("a.key"), 22)
    return a.join(b, condition).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _stars(many: DataFrame, bits: int) -> DataFrame:
    """Links of crowded keys through the fingerprints within half the distance."""
    near = [0]
    for r in range(1, bits // 2 + 1):
        near += [sum(1 << i for i in c) for c in combinations(range(64), r)]
    if bits % 2:  # an odd distance meets half way between r and r + 1 bits
        half = bits // 2 + 1
        wide = near + [sum(1 << i for i in c) for c in combinations(range(64), half)]
    else:
        wide = near
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in wide])
    named = many.select("fp").distinct().select(
        "fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("middle"))
    if bits % 2:
        named = named.withColumn("close", F.bit_count(
            F.col("fp").bitwiseXOR(F.col("middle"))) <= bits // 2)
        star = named.groupBy("middle").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("a"))
        star = star.filter("a IS NOT NULL")
    else:
        star = named.groupBy("middle").agg(F.min("fp").alias("a"))
    return (named.join(star, "middle").select("a", F.col("fp").alias("b"))
            .filter("a <> b").distinct())


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           carry: tuple[str, ...] = (), bits: int = MAX_BITS, crowd: int = CROWD,
           root: bool = False) -> DataFrame:
    """``doc_id, fingerprint, component_id`` and the carried columns of each row of ``docs``.

    ``root`` adds a column of that name: the smallest fingerprint of a group, which names the group
    even if none of its rows has an id.

    Fingerprints are linked at ``bits`` or fewer differing bits; ``component_id`` is the smallest
    doc_id reachable. NULL, empty and wordless texts have fingerprint zero and are linked like any
    other. A NULL doc_id is never the smallest: a group without any id has component NULL. Repeated
    rows repeat; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    folder = session.scratch(spark, "simhash")
    fingerprints(docs, doc_id, text, carry).write.parquet(f"{folder}/fingerprints")
    rows = spark.read.parquet(f"{folder}/fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes.write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    roots = connected_components(links(nodes.select("fp"), bits, crowd))
    rooted = (nodes.join(roots, nodes["fp"] == roots["node"], "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written, so that the join below reads both sides by their own shuffle and a fingerprint of very
    # many rows can be split.
    rooted.join(least, "root").select("fp", "component_id", "root").write.parquet(f"{folder}/components")
    components = spark.read.parquet(f"{folder}/components")
    return rows.join(components, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *carry,
        *(["root"] if root else []))
