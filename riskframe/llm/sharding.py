"""Minimax contiguous sharding: atomic groups in a fixed order are cut so that the largest shard is as small as can be.

Groups are equal texts, ordered by the MD5 of the text. The capacity is found by binary search; each trial walks the
ordered groups greedily. The driver holds sums of blocks of that order, not groups. Two searches over blocks enclose the
capacity: one ends shards at the ends of blocks, the other anywhere within one. Blocks in which a shard may end are parted
by more digits, until what lies in them is few groups; these are fetched, and the search is exact. A shard is then a range of MD5s, so no join deals the rows out.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK_DIGITS = 3
#: Bytes that are ordered at once, about.
RANGE_BYTES = 64 << 20


def greedy_cuts(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends of shards, as sums of sizes: each shard is as long as the capacity lets it be. ends: sums up to each group, rising. None if more shards are needed."""
    cuts, at = [], 0
    for _ in range(shards):
        if at == ends[-1]:
            cuts.append(at)
            continue
        k = bisect_right(ends, at + capacity) - 1
        if k < 0 or ends[k] <= at:
            return None
        at = ends[k]
        cuts.append(at)
    return cuts if at == ends[-1] else None


def smallest_capacity(ends: list[int], shards: int, low: int = 0, high: int | None = None) -> int:
    """The least capacity with which greedy_cuts needs no more than so many shards."""
    low, high = max(low, -(-ends[-1] // shards)), ends[-1] if high is None else high
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _sized(docs: DataFrame, doc_id: str, text: str, keep: bool = False) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    doc = [F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if keep else []
    return docs.select(*doc, F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.md5(t.cast("binary")).alias("key"))


#: The most groups that are fetched; blocks are parted until those in question hold no more.
FETCHED = 1 << 16


class _Block(NamedTuple):
    """Groups whose keys begin alike. name: the beginning."""

    name: str
    size: int
    largest: int
    groups: int


def _most_reached(ends: list[int], blocks: list[_Block], at: int) -> int:
    """The farthest that a shard may end, if it may not end beyond `at`: anywhere within a block of several groups."""
    k = bisect_right(ends, at)
    if k == len(ends):
        return ends[-1]
    return at if blocks[k].groups > 1 else ends[k] - blocks[k].size


def _least_possible(ends: list[int], blocks: list[_Block], shards: int, low: int, high: int) -> int:
    """The least capacity that isn't ruled out, whatever groups the blocks hold."""
    while low < high:
        middle, at = (low + high) // 2, 0
        for _ in range(shards):
            at = _most_reached(ends, blocks, at + middle)
        if at < ends[-1]:
            low = middle + 1
        else:
            high = middle
    return low


def _in_question(blocks: list[_Block], ends: list[int], low: int, high: int, shards: int) -> list[_Block]:
    """Blocks of several groups in which some shard may end, with any capacity from low to high. Ends rise with the capacity: the walk with the lowest that ends shards at
    ends of blocks, and that with the highest that ends them anywhere, enclose them."""
    a = b = 0
    out: dict[str, _Block] = {}
    for _ in range(shards):
        first = min(bisect_right(ends, a + low), len(blocks) - 1)
        last = min(bisect_right(ends, b + high), len(blocks) - 1)
        out |= {x.name: x for x in blocks[first : last + 1] if x.groups > 1}
        a, b = ends[first] - blocks[first].size, _most_reached(ends, blocks, b + high)
    return list(out.values())


def cut_keys(rows: DataFrame, shards: int, block_digits: int = BLOCK_DIGITS, fetched: int = FETCHED) -> tuple[list[str], int]:
    """The last key of each shard, and the sum of all sizes. rows: key (a hexadecimal digest) and size."""
    scratch = Scratch(rows.sparkSession, "shards")
    groups = scratch.table(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")

    def parted(own: DataFrame, digits: int) -> list[_Block]:
        found = own.groupBy(F.substring("key", 1, digits).alias("b")).agg(F.sum("size"), F.max("size"), F.count(F.lit(1)))
        return [_Block(*r) for r in found.collect()]

    # 16 ** block_digits rows at most, whatever the input; and as many of each block that is parted later on.
    blocks = sorted(parted(groups, block_digits))
    if not blocks:
        scratch.drop(groups)
        return [], 0
    total = sum(x.size for x in blocks)
    low, high = max(-(-total // shards), max(x.largest for x in blocks)), total
    while True:
        ends = list(accumulate(x.size for x in blocks))
        high = smallest_capacity(ends, shards, low, high)
        low = _least_possible(ends, blocks, shards, low, high)
        wanted = _in_question(blocks, ends, low, high, shards)
        digits = max((len(x.name) for x in wanted), default=0)
        if sum(x.groups for x in wanted) <= fetched or digits >= 32:
            break
        coarse = {x.name for x in wanted if len(x.name) == min(len(y.name) for y in wanted)}
        own = min(len(x) for x in coarse)
        blocks = sorted([x for x in blocks if x.name not in coarse] + parted(groups.where(F.substring("key", 1, own).isin(sorted(coarse))), own + block_digits))
    names = {x.name for x in wanted}
    found: list[tuple[str, int]] = []
    for n in sorted({len(x) for x in names}):
        found += [(r["key"], r["size"]) for r in groups.where(F.substring("key", 1, n).isin(sorted(x for x in names if len(x) == n))).collect()]
    # Above each digest in a block that isn't fetched: its name and a letter behind all digits.
    pieces = sorted(found + [(x.name + "g", x.size) for x in blocks if x.name not in names])
    ends = list(accumulate(size for _, size in pieces))
    cuts = greedy_cuts(ends, smallest_capacity(ends, shards, low, high), shards)
    scratch.drop(groups)
    return [pieces[bisect_right(ends, c) - 1][0] for c in cuts], total


def shard(docs: DataFrame, shards: int = 8, *, bin_digits: int | None = None, keep: bool = False, doc_id: str = "doc_id", text: str = "text", block_digits: int = BLOCK_DIGITS, fetched: int = FETCHED) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: the law doesn't foresee it); a row for each row of docs.

    size: UTF-8 bytes plus 1; a null text counts as empty and goes with empty texts. Equal texts share a shard, even where
    they outweigh a fair share. Slots count from 0 in each shard, in the order of the MD5 of id and text; identical rows are
    interchangeable. Rows are ordered within ranges of it, 16 ** bin_digits a shard (by
    bytes, if not given), so that no task orders a whole shard; the ranges don't change the slots. No rows: no rows. keep: column doc has the row.
    """
    rows = _sized(docs, doc_id, text, keep)
    cuts, total = cut_keys(_sized(docs, doc_id, text), shards, block_digits, fetched)
    if bin_digits is None:
        bin_digits = 2
        while total > shards * 16**bin_digits * RANGE_BYTES:
            bin_digits += 1
    doc = ["doc"] if keep else []
    number = F.lit(0)
    for c in cuts[:-1]:
        number = number + (F.col("key") > c).cast("int")
    rows = rows.select(*doc, "doc_id", "size", "text_crc32", number.alias("shard"), F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "key")).alias("_o"))
    rows = rows.withColumn("_b", F.substring("_o", 1, bin_digits))
    counts = rows.drop("doc").groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_o", "doc_id")))
    return rows.join(bases, ["shard", "_b"]).select(*doc, "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_base") + F.col("_r") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Rows of docs with size, text_crc32, law, shard and slot; columns of docs with these names give way to them."""
    added = ["size", "text_crc32", "law", "shard", "slot"]
    out = shard(docs, shards, keep=True)
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in added], *added)
