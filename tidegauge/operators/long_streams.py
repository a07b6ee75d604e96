"""One long byte stream cut into frames by many tasks.

Where a frame starts is known only once the one before it has been read, but where a chain of frames
leaves a range of bytes follows from where it enters, and that can be worked out for every place of
the range at once. So each range gets a map from entry to exit, in parallel; nearly all places are no
header of an allowed length, so the map is short. One pass over the maps of a stream, in order, gives
the entry of each range, and the ranges are then cut in parallel. Frames that reach over a range's end
are put together from their pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge import schema as S
from tidegauge.operators.frames import reassemble_frames
from tidegauge.plans.segments import rank_across, running_max, running_sum
from tidegauge.session import scratch

RANGE_BYTES = 8 << 20
LONG_BYTES = 64 << 20  # a shorter stream is read by one task
HEAD = S.EDGE_HEADER_BYTES
SEGMENT_ROWS = 100_000


def next_starts(data: bytes, ahead: bytes, max_payload: int) -> np.ndarray:
    """For each place of ``data`` where the frame that starts there ends; -1 if it is no header of an
    allowed length, or if not all of it is there. ``ahead`` is what follows the data."""
    n = len(data)
    whole = np.frombuffer(data + ahead[: HEAD - 1], np.uint8)
    out = np.full(n, -1, np.int64)
    known = min(n, len(whole) - HEAD + 1)
    if known > 0:
        length = np.zeros(known, np.int64)
        for k in range(4):
            at = HEAD - 4 + k
            length = length << 8 | whole[at:at + known]
        good = length <= max_payload
        out[:known][good] = (np.arange(known) + HEAD + length)[good]
    return out


def exits(data: bytes, ahead: bytes, max_payload: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries from which a chain of frames leaves the range, and where it arrives."""
    n = len(data)
    jump = next_starts(data, ahead, max_payload)
    inside = np.flatnonzero((jump >= 0) & (jump < n))
    while len(inside):  # each step doubles how far the chains have been followed
        jump[inside] = jump[jump[inside]]
        inside = inside[(jump[inside] >= 0) & (jump[inside] < n)]
    reach = min(n, HEAD + max_payload)  # a frame from before ends no later
    entry = np.flatnonzero(jump[:reach] >= n)
    return entry, jump[entry]


_RANGES = "stream bigint, low bigint, high bigint, data binary"


def _ranges(chunks: DataFrame, range_bytes: int) -> DataFrame:
    """The chunks (stream, seq, low, high, bytes) of each range of bytes, put together.

    Chunks are sorted by the shuffle and streamed through: ranges may be many and short.
    """
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, low, high, parts = None, 0, 0, []
        for batch in batches:
            out = []
            for stream, place, start, end, data in zip(
                    batch["stream"], batch["range"], batch["low"], batch["high"], batch["bytes"]):
                if (stream, place) != key:
                    if parts:
                        out.append((key[0], low, high, b"".join(parts)))
                    key, low, high, parts = (stream, place), start, end, []
                high = max(high, end)
                parts.append(data)
            yield pd.DataFrame(out, columns=["stream", "low", "high", "data"])
        if parts:
            yield pd.DataFrame([(key[0], low, high, b"".join(parts))],
                               columns=["stream", "low", "high", "data"])

    ordered = (chunks.select("stream", F.expr(f"low DIV {range_bytes}").alias("range"), "seq", "low", "high",
                             "bytes").repartition("stream", "range")
               .sortWithinPartitions("stream", "range", "low", F.asc_nulls_last("seq")))
    return ordered.mapInPandas(join, _RANGES)


def _maps(ranges: DataFrame, max_payload: int) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [exits(bytes(d), bytes(a), max_payload) for d, a in zip(batch["data"], batch["ahead"])]
            yield pd.DataFrame({"stream": batch["stream"], "low": batch["low"], "high": batch["high"],
                                "entry": [e for e, _ in found], "exit": [x for _, x in found]})

    return ranges.mapInPandas(rows, "stream bigint, low bigint, high bigint, entry array<bigint>, "
                                    "exit array<bigint>")


def _entries(maps: DataFrame) -> DataFrame:
    """``stream, low, first``: the first place at or behind a range's start where a frame begins."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, at = None, None
        for batch in batches:
            out = []
            for name, low, high, entry, exit_ in zip(
                    batch["stream"], batch["low"], batch["high"], batch["entry"], batch["exit"]):
                if name != stream:
                    stream, at = name, 0
                if at is None:
                    continue
                out.append((name, low, at))
                if at < high:
                    k = int(np.searchsorted(entry, at - low)) if len(entry) else 0
                    at = low + int(exit_[k]) if k < len(entry) and entry[k] == at - low else None
            yield pd.DataFrame(out, columns=["stream", "low", "first"])

    ordered = maps.repartition("stream").sortWithinPartitions("stream", "low")
    return ordered.mapInPandas(rows, "stream bigint, low bigint, first bigint")


_PIECES = "stream bigint, `end` bigint, at bigint, piece binary, start bigint, bad bigint"


def _pieces(ranges: DataFrame, max_payload: int) -> DataFrame:
    """The frames of each range, and the parts of those that reach over its ends.

    ``start`` is where a frame begins that does so here; ``bad`` the place of a header that declares
    too much.
    """
    def cut(stream: int, low: int, high: int, data: bytes, ahead: bytes, first: int) -> list[tuple]:
        out, at = [], first
        if at > low:  # the rest of a frame that began earlier
            out.append((stream, at, low, data[: at - low], None, None))
        whole = data + ahead[: HEAD - 1]
        while at < high:
            begin = at - low
            if len(whole) - begin < HEAD:
                break
            length = int.from_bytes(whole[begin + HEAD - 4:begin + HEAD], "big")
            if length > max_payload:
                out.append((stream, None, at, None, None, at))
                break
            end = at + HEAD + length
            out.append((stream, end, at, data[begin:end - low], at, None))
            at = end
        return out

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for stream, low, high, data, ahead, first in zip(
                    batch["stream"], batch["low"], batch["high"], batch["data"], batch["ahead"], batch["first"]):
                out += cut(int(stream), int(low), int(high), bytes(data), bytes(ahead), int(first))
            frame = pd.DataFrame(out, columns=["stream", "end", "at", "piece", "start", "bad"])
            yield frame.astype({c: "Int64" for c in ("end", "start", "bad")})

    return ranges.mapInPandas(rows, _PIECES)


def reassemble_long(chunks: DataFrame, max_payload: int = S.EDGE_MAX_PAYLOAD_BYTES,
                    range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``stream_id, frame_no, frame`` of the chunks (stream_id, seq, bytes) of long streams."""
    spark = chunks.sparkSession
    folder = scratch(spark, "long-streams")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    named = chunks.filter(F.octet_length("bytes") > 0).select(
        F.col("stream_id").alias("stream"), "seq", "bytes")
    size = F.octet_length("bytes").cast("bigint")
    placed = written(running_sum(named, ["stream"], F.expr(f"seq DIV {SEGMENT_ROWS}"), "seq", size, "high")
                     .withColumn("low", F.col("high") - size), "chunks")
    ranges = written(_ranges(placed, range_bytes), "ranges")
    # What follows a range: of each range one short row meets those of its stream.
    following = Window.partitionBy("stream").orderBy("low").rowsBetween(1, HEAD - 1)
    heads = ranges.select("stream", "low", F.substring("data", 1, HEAD - 1).alias("head"))
    ahead = heads.select("stream", "low", F.aggregate(
        F.collect_list("head").over(following), F.lit(b""), lambda a, b: F.concat(a, b)).alias("ahead"))
    whole = ranges.join(ahead, ["stream", "low"])
    entries = written(_entries(_maps(whole, max_payload)), "entries")
    pieces = written(_pieces(whole.join(entries, ["stream", "low"]), max_payload), "pieces")

    # A chunk that overflows the buffer, or completes a header that declares too much, ends a stream:
    # what is cut from it and all that follows is dropped.
    starts = pieces.filter("start IS NOT NULL OR bad IS NOT NULL").select(
        "stream", F.coalesce("start", "bad").alias("at"), F.lit(0).alias("side"),
        F.struct(F.coalesce("start", "bad").alias("start"), "end").alias("frame"))
    tops = placed.select("stream", F.col("low").alias("at"), F.lit(1).alias("side"), "low", "high")
    both = starts.unionByName(tops, allowMissingColumns=True)
    pending = running_max(both, ["stream"], F.expr(f"at DIV {range_bytes}"), ["at", "side"],
                          F.col("frame"), "last").filter("side = 1")
    full = pending.filter((F.col("high") - F.col("last.start") > HEAD + max_payload)
                          & (F.coalesce(F.col("last.end"), F.col("high")) > F.col("low")))
    bad = pieces.filter("bad IS NOT NULL").select("stream", (F.col("bad") + HEAD - 1).alias("told"))
    told = placed.join(bad, "stream").filter((F.col("low") <= F.col("told")) & (F.col("told") < F.col("high")))
    cuts = full.select("stream", "low").unionByName(told.select("stream", "low")).groupBy("stream").agg(
        F.min("low").alias("cut"))
    lengths = placed.groupBy("stream").agg(F.max("high").alias("length"))
    limits = lengths.join(cuts, "stream", "left").select("stream", F.coalesce("cut", "length").alias("limit"))

    good = pieces.filter(F.col("end").isNotNull()).join(limits, "stream").filter(F.col("end") <= F.col("limit"))
    here = F.col("start").isNotNull() & (F.col("start") + F.octet_length("piece") == F.col("end"))
    parts = good.filter(~here).groupBy("stream", "end").agg(
        F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"), F.min("at").alias("start"))
    joined = parts.select("stream", "start", F.aggregate(
        "p", F.lit(b""), lambda a, b: F.concat(a, b["piece"])).alias("frame"))
    frames = good.filter(here).select("stream", "start", F.col("piece").alias("frame")).unionByName(joined)
    numbered = rank_across(frames, ["stream"], F.expr(f"start DIV {range_bytes}"), "start", "frame_no")
    return numbered.select(F.col("stream").alias("stream_id"), (F.col("frame_no") - 1).alias("frame_no"), "frame")


def reassemble(chunks: DataFrame, max_payload: int = S.EDGE_MAX_PAYLOAD_BYTES,
               long_bytes: int = LONG_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As ``frames.reassemble_frames``; streams of ``long_bytes`` or more are cut by many tasks."""
    sizes = chunks.groupBy("stream_id").agg(F.sum(F.octet_length("bytes")).alias("n"))
    long = sizes.filter(F.col("n") >= long_bytes).select("stream_id")
    short = reassemble_frames(chunks.join(long, "stream_id", "left_anti"), max_payload=max_payload)
    return short.unionByName(reassemble_long(chunks.join(long, "stream_id", "left_semi"), max_payload,
                                             range_bytes))
