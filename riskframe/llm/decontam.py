"""Benchmark decontamination by a prefix-filtered set join, verified exactly over item-sized windows.

A window is `window` consecutive words of a benchmark item (all of them, if it has fewer). A document contains a window
only if it holds all of the window's shingles, so one of them, the rarest in the corpus, is a sufficient prefix: only
positions of documents with such a shingle give candidates. Of these, the position must leave room for the whole window
(length and positional bounds), and its words must equal the window's.

The benchmark is dealt into blocks of bounded size. Documents pass by the blocks one after the other, with whatever
earlier blocks have found; one block (the usual case) is one pass. Documents are never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BY_LETTERS, Scratch, Words, gram_hashes, small_batches, text_bytes

WINDOW = 10
SHINGLE = 3
#: UTF-8 bytes of items in a block, at most; it bounds what is broadcast, which is about twelve times as much as the block. Blocks hold half of this on average.
BLOCK_BYTES = 16 << 20
_BITS = 20
#: Parts in which tasks send counts of shingles.
_PARTS = 64


@dataclass(frozen=True)
class Windows:
    """All windows of a block, as numbers: words of all items one after the other, and for each window its item, first word and length."""

    words: Words
    names: list[str]
    item: np.ndarray
    start: np.ndarray
    length: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


@dataclass(frozen=True)
class Postings:
    """Windows by the hash of their rarest shingle, rising; of each the words before the shingle, and the hash of all its words."""

    keys: np.ndarray
    before: np.ndarray
    window: np.ndarray
    whole: np.ndarray
    bits: np.ndarray


@dataclass(frozen=True)
class Index:
    """by: postings by the length of shingles."""

    windows: Windows
    by: dict[int, Postings]


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


def _bits(h: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _BITS, bool)
    out[_slots(h)] = True
    return out


def windows_of(items: list[tuple[str, bytes]], window: int = WINDOW) -> Windows:
    """Each run of `window` words of an item, or all words of an item that has fewer."""
    words = Words([t for _, t in items], BY_LETTERS)
    sizes = np.diff(words.bounds)
    counts = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
    item = np.repeat(np.arange(len(items)), counts)
    start = words.bounds[item] + np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
    return Windows(words, [name for name, _ in items], item.astype(np.int32), start, np.minimum(window, sizes)[item].astype(np.int32))


def _parts(wins: Windows, shingle: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Length of shingles, length of windows, and which windows have it."""
    for length in np.unique(wins.length).tolist():
        yield min(shingle, length), length, np.flatnonzero(wins.length == length)


def shingles_of(wins: Windows, shingle: int = SHINGLE) -> dict[int, np.ndarray]:
    """By length, the distinct hashes of the windows' shingles, rising."""
    found: dict[int, list[np.ndarray]] = {}
    for n, length, at in _parts(wins, shingle):
        first = np.unique(np.concatenate([wins.start[at] + k for k in range(length - n + 1)]))
        found.setdefault(n, []).append(gram_hashes(wins.words.hashes, n)[first])
    return {n: np.unique(np.concatenate(x)) for n, x in found.items()}


def build_index(wins: Windows, known: dict[int, np.ndarray], counts: dict[int, np.ndarray], shingle: int = SHINGLE) -> Index:
    """counts: corpus occurrences of the known shingles. The rarest shingle of a window is its prefix; ties go to the least hash."""
    collected: dict[int, list[list[np.ndarray]]] = {}
    for n, length, at in _parts(wins, shingle):
        grams, whole = gram_hashes(wins.words.hashes, n), gram_hashes(wins.words.hashes, length)
        # Places among known shingles rise with the hash, so that a stable sort by count leaves ties in that order.
        rank = np.empty(len(known[n]), np.int64)
        rank[np.argsort(counts[n], kind="stable")] = np.arange(len(known[n]))
        start, best, before = wins.start[at], None, np.zeros(len(at), np.int16)
        for k in range(length - n + 1):
            r = rank[np.searchsorted(known[n], grams[start + k])]
            if best is None:
                best = r
            else:
                before[r < best] = k
                best = np.minimum(best, r)
        collected.setdefault(n, []).append([grams[start + before], before, at, whole[start]])
    by = {}
    for n, parts in collected.items():
        keys, before, at, whole = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        by[n] = Postings(keys[order], before[order], at[order].astype(np.int32), whole[order], _bits(keys))
    return Index(wins, by)


def find(words: Words, i: int, index: Index) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words of text i that lie in windows, merged and rising, and the items whose windows occur."""
    spans, items, wins = set(), set(), index.windows
    first, last = int(words.bounds[i]), int(words.bounds[i + 1])
    own = words.hashes[first:last]
    for n, by in index.by.items():
        h = gram_hashes(own, n)
        places = np.flatnonzero(by.bits[_slots(h)])
        if not len(places):
            continue
        low, high = np.searchsorted(by.keys, h[places]), np.searchsorted(by.keys, h[places], side="right")
        for p, a, b in zip(places.tolist(), low.tolist(), high.tolist()):
            seen: dict[tuple[int, int], bool] = {}
            for k in range(a, b):
                w = int(by.window[k])
                start, length = p - int(by.before[k]), int(wins.length[w])
                if start < 0 or start + length > last - first:
                    continue
                # Equal windows of many items are compared once, word by word, where the hash of all words agrees.
                same = seen.get((int(by.whole[k]), start))
                if same is None:
                    at = int(wins.start[w])
                    same = int(gram_hashes(own[start : start + length], length)[0]) == int(by.whole[k]) and words.list(first + start, first + start + length) == wins.words.list(at, at + length)
                    seen[int(by.whole[k]), start] = same
                if same:
                    spans.add((start, start + length))
                    items.add(wins.names[int(wins.item[w])])
    return merged(spans), items


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def corpus_rarity(docs: DataFrame, text: str, known: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each known shingle occurs in the whole corpus. Tasks send counts in parts, which are added up before they reach the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    sizes = {n: -(-len(x) // _PARTS) for n, x in known.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        sums = {n: np.zeros(len(x), np.int64) for n, x in own.items()}
        bits = {n: _bits(x) for n, x in own.items()}
        for batch in batches:
            w = Words(batch["t"].to_pylist(), BY_LETTERS)
            for a, b in zip(w.bounds[:-1], w.bounds[1:]):
                for n, x in own.items():
                    h = gram_hashes(w.hashes[a:b], n)
                    h = h[bits[n][_slots(h)]]
                    at = np.searchsorted(x, h)
                    at = at[(at < len(x)) & (x[np.minimum(at, len(x) - 1)] == h)]
                    np.add.at(sums[n], at, 1)
        for n, s in sums.items():
            for part in range(_PARTS):
                if (x := s[part * sizes[n] : (part + 1) * sizes[n]]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["n", "part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for n, part, x in zip(batch["n"].to_pylist(), batch["part"].to_pylist(), batch["counts"].to_pylist()):
                x = np.frombuffer(zlib.decompress(x), np.int64)
                sums[n, part] = sums.get((n, part), 0) + x
        for (n, part), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["n", "part", "counts"])

    rows = docs.select(text_bytes(text).alias("t")).mapInArrow(run, "n int, part int, counts binary").repartition(_PARTS, "n", "part").mapInArrow(add, "n int, part int, counts binary")
    out = {n: np.zeros(len(x), np.int64) for n, x in known.items()}
    for r in rows.collect():  # _PARTS rows a length, together as large as the block's shingles
        x = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        out[r["n"]][r["part"] * sizes[r["n"]] :][: len(x)] = x
    return out


def _pass(rows: DataFrame, index: Index) -> DataFrame:
    """rows: doc, t, spans, items. Adds what the block finds."""
    known = rows.sparkSession.sparkContext.broadcast(index)
    span_type, item_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = known.value
        for batch in batches:
            spans, items = [], []
            words = Words(batch["t"].to_pylist(), BY_LETTERS)
            n = np.diff(words.bounds)
            for k, (s, i) in enumerate(zip(batch["spans"].to_pylist(), batch["items"].to_pylist())):
                found, names = find(words, k, index)
                spans.append([{"a": a, "b": b} for a, b in merged([*found, *((x["a"], x["b"]) for x in s)])])
                items.append(sorted({*names, *i}))
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["t"], pa.array(n, pa.int64()), pa.array(spans, span_type), pa.array(items, item_type)], ["doc", "t", "n_words", "spans", "items"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, t binary, n_words bigint, spans array<struct<a: int, b: int>>, items array<string>")


#: Blocks that a task looks for one after the other in what it has read, before spans and texts are written: each has its worker, and its index.
CHAINED = 4


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: bool = False, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, spans (of word numbers, merged; ends exclusive), items (ids as text, sorted); a row for each row of docs.

    Null and empty texts have no words and no hits; items without words have no windows; a null item id reads 'null'. Items with
    equal windows are all found. An empty benchmark finds nothing. keep: all columns of docs come first, as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    b = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), text_bytes(item_text).alias("t"))
    total = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes))  # by hash, so twice as many as would do
    first = [F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if keep else [F.struct(docs[doc_id].alias("doc_id")).alias("doc")]
    rows = docs.select(*first, text_bytes(docs[text]).alias("t"), F.array().cast("array<struct<a: int, b: int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    scratch = Scratch(spark, "decontam")
    last = None
    for k in range(blocks):
        own = b if blocks == 1 else b.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k)
        wins = windows_of([(r["item"], bytes(r["t"])) for r in own.toLocalIterator()], window)
        known = shingles_of(wins)
        rows = _pass(rows, build_index(wins, known, corpus_rarity(docs, text, known) if known else {}))
        rows = rows.drop("n_words") if k + 1 < blocks else rows
        if k + 1 < blocks and (k + 1) % CHAINED == 0:
            table = scratch.table(rows, f"block-{k}")
            rows = table
            if last is not None:
                scratch.drop(last)
            last = table
    return rows.select("doc.*", "n_words", "spans", "items")


def digest(rows: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated, from spans and items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["b"] - s["a"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
