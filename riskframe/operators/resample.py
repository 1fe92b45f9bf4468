"""Resamples with replacement, drawn by hashes, without a row for each draw.

A resample's draws are made in Arrow batches and sorted; a row holds the gaps between those that fall into one block of places, so that a draw takes a byte or two.
Blocks meet the rows that stand there, which turns draws into counts by score and label: one row for each of these and block, with the counts in all resamples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import with_position

#: Places of a block, and draws that a task holds at once.
BLOCK, SLICE = 1 << 17, 1 << 22
#: Numbers that differ in their last four digits are hashed together.
LOW = 10_000

_DIGITS = [np.frombuffer("".join(f"{i:0{w}d}" for i in range(10**w)).encode(), np.uint8).reshape(-1, w) for w in range(1, 5)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_60_bits(words: list, n: int) -> np.ndarray:
    """Of n MD5s, each of one block of 16 words: numbers where all have the same, else arrays."""
    u = np.uint32
    a, b, c, d = (np.full(n, s, u) for s in _START)
    f, t = np.empty(n, u), np.empty(n, u)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        if isinstance(words[at], np.ndarray):
            f += words[at]
            f += u(_SINES[i])
        else:
            f += u((_SINES[i] + words[at]) & 0xFFFFFFFF)
        np.left_shift(f, u(_TURNS[i]), out=t)
        f >>= u(32 - _TURNS[i])
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    a, b = a + u(_START[0]), b + u(_START[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap() >> u(4))


def hashes(head: str, tail: str, first: int, last: int) -> np.ndarray:
    """The first 60 bits of the MD5 of head, j and tail for each j from first to before last, as hash_long(hash_key()) has them."""
    out, j = np.empty(last - first, np.uint64), first
    while j < last:
        high, low = divmod(j, LOW)
        width = 4 if high else len(str(low))
        end = min(last, high * LOW + 10**width)
        digits = _DIGITS[width - 1][low : end - high * LOW]
        before, after = f"{head}{high or ''}".encode(), tail.encode()
        at, size = len(before), len(before) + width + len(after)
        if size > 55:
            raise ValueError("text and number have to fit into one block of MD5")
        block = np.frombuffer(before + bytes(width) + after + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little"), np.uint8)
        a, z = at // 4, -(-(at + width) // 4)  # words that hold the digits
        own = np.tile(block[4 * a : 4 * z], (len(digits), 1))
        own[:, at - 4 * a : at - 4 * a + width] = digits
        words = [int(w) for w in block.view("<u4")]
        words[a:z] = np.ascontiguousarray(own.view("<u4").T)
        out[j - first : end - first] = _first_60_bits(words, len(digits))
        j = end
    return out


def _gaps(drawn: np.ndarray, size: int) -> Iterator[tuple[int, int, bytes]]:
    """block, width of a number in bytes, and numbers: from the block's first place to its first draw, and from draw to draw."""
    drawn.sort()
    blocks = drawn // size
    starts = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1))
    gaps = np.diff(drawn, prepend=0)
    gaps[starts] = drawn[starts] % size
    for a, z in zip(starts, [*starts[1:], len(drawn)]):
        own = gaps[a:z]
        width = 1 if (most := own.max()) < 1 << 8 else 2 if most < 1 << 16 else 4
        yield int(blocks[a]), width, own.astype(f"<u{width}").tobytes()


def draws(reps: DataFrame, seed: int, size: int = BLOCK, most: int = SLICE) -> DataFrame:
    """rep, _block, _width and _gaps from rep and _n, by blocks of `size` places, `most` draws at once: the n places that each resample draws, place j being the hash of rep, j and seed modulo n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, n in zip(batch["rep"].to_pylist(), batch["_n"].to_pylist()):
                for first in range(0, n, most):
                    drawn = (hashes(f"{rep}:", f":{seed}", first, min(n, first + most)) % np.uint64(n)).astype(np.int64)
                    block, width, gaps = zip(*_gaps(drawn, size))
                    yield pa.RecordBatch.from_arrays([pa.array([rep] * len(block), pa.int32()), pa.array(block, pa.int64()), pa.array(width, pa.int32()), pa.array(gaps, pa.binary())], ["rep", "_block", "_width", "_gaps"])

    return reps.mapInArrow(run, "rep int, _block long, _width int, _gaps binary")


def resampled_cells(df: DataFrame, *, k: int, seed: int, row_id: str, score: str, label: str, size: int = BLOCK, most: int = SLICE) -> DataFrame:
    """rep, score, pos, neg: how often rows of that score, of either label, are in each of k resamples of as many rows as there are."""
    placed = with_position(df.select(row_id, score, label), "_p", F.md5(F.col(row_id).cast("string")), row_id)
    places = placed.select(F.expr(f"(_p - 1) div {size}").alias("_block"), ((F.col("_p") - 1) % size).cast("int").alias("_at"), F.col(score).alias("_score"), F.col(label).alias("_label"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    reps = df.sparkSession.range(0, k, 1, k).select(F.col("id").cast("int").alias("rep")).crossJoin(F.broadcast(total))

    def counted(drawn: pa.Table, there: pa.Table) -> pa.Table:
        codes = [pc.dictionary_encode(there[c], null_encoding="encode").combine_chunks() for c in ("_score", "_label")]
        codes = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in codes]
        scores, labels = (c.dictionary for c in codes)
        found, inverse = np.unique(codes[0].indices.to_numpy().astype(np.int64) * len(labels) + codes[1].indices.to_numpy(), return_inverse=True)
        cell = np.zeros(size, np.int64)
        cell[there["_at"].to_numpy()] = inverse
        times = np.zeros((k, len(found)), np.int32)
        for rep, width, gaps in zip(drawn["rep"].to_pylist(), drawn["_width"].to_pylist(), drawn["_gaps"]):
            at = np.cumsum(np.frombuffer(gaps.as_buffer(), f"<u{width}"), dtype=np.int64)
            times[rep] += np.bincount(cell[at], minlength=len(found)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(times.T).ravel()))
        return pa.table({"_score": scores.take(pa.array(found // len(labels))), "_label": labels.take(pa.array(found % len(labels))), "_times": lists})

    kinds = {f.name: f.dataType.simpleString() for f in places.schema}
    counts = draws(reps, seed, size, most).groupBy("_block").cogroup(places.groupBy("_block")).applyInArrow(counted, f"_score {kinds['_score']}, _label {kinds['_label']}, _times array<int>")
    # Dealt by score before the counts are taken apart, so that these are added up where they are.
    each = counts.repartition("_score").select("_score", "_label", F.posexplode("_times").alias("rep", "_w")).where("_w > 0")
    y, w = F.col("_label"), F.col("_w").cast("long")
    return each.groupBy("rep", "_score").agg(F.sum(w * y).alias("pos"), F.sum(w * (1 - y)).alias("neg")).withColumnRenamed("_score", score)
