"""Spelling variants: words of the corpus that differ by one code point, grouped under their common form.

Full neighbourhood generation: each word emits all its distinct deletions, replacements and insertions over the alphabet that words use, and the candidates are
joined to the vocabulary by equality. What the join keeps is one edit away by construction, so no distance is computed. A Bloom filter of the vocabulary, made
in as many parts as its size asks for, keeps most candidates that are no words from ever becoming rows; the join on whole words then settles the rest.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mixed, small_batches, text_bytes

#: Letters of words, as Latin-1 bytes: A-Z fold to a-z, U+00C0 to U+00FF stay, all else parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Distinct words that a task holds before it hands them on.
_HELD = 1 << 18
#: Bits of the filter for each word, probes, and the most bits of one part: 32 MB, whatever the vocabulary.
BITS_A_WORD, PROBES, PART_BITS = 16, 4, 1 << 28
#: Words of one task, and candidates hashed at a time.
_WORDS_A_TASK, _AT_ONCE = 8192, 1 << 20
#: An odd multiplier: a word's hash is the polynomial of its bytes, modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def occurrences(docs: DataFrame, *, least: int = 7, drop_one_in: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: partial counts of the words of at least `least` code points. A word is a folded run of letters; where `drop_one_in` divides the CRC-32 of
    "<doc_id>:<run>", the code point at that number modulo the run's length is left out. 0 leaves nothing out."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, t in zip(batch["id"].to_pylist(), batch["t"].to_pylist()):
                own = Counter([w for w in t.decode("utf-8", "replace").encode("latin-1", "replace").translate(_FOLD).split() if len(w) >= least])
                start = zlib.crc32(key.encode() + b":")
                for w, n in own.items():
                    if drop_one_in:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % drop_one_in == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least:
                                continue
                    total[w] += n
                if len(total) >= _HELD:
                    yield handed()
        if total:
            yield handed()

    return docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), text_bytes(text).alias("t")).mapInArrow(run, "word string, n long")


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, _BASE), out=out[1:])
    return out


def _sums(codes: np.ndarray, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes, and what each suffix adds to a hash, of words of one length."""
    count, length = codes.shape
    heads, tails = np.zeros((length + 1, count), np.uint64), np.zeros((length + 1, count), np.uint64)
    for i in range(length):
        heads[i + 1] = heads[i] * _BASE + codes[:, i]
        j = length - 1 - i
        tails[j] = codes[:, j] * powers[i] + tails[j + 1]
    return heads, tails


def hashes(words: list[bytes]) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        codes = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(len(at), length).astype(np.uint64)
        h = np.zeros(len(at), np.uint64)
        for i in range(length):
            h = h * _BASE + codes[:, i]
        out[at] = h
    return out


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    x = mixed(h)
    first, step = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
    return [(first + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)]


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(parts)


class Filter:
    """Bits of the words of one part; tells of hashes whether they may be such words."""

    def __init__(self, blocks: dict[int, bytes], bits: int, part: int, parts: int):
        self.bits, self.part, self.parts = bits, part, parts
        self.map = np.zeros(bits // 8, np.uint8)
        for at, block in blocks.items():
            self.map[at * 4096 : at * 4096 + len(block)] = np.frombuffer(block, np.uint8)[: bits // 8 - at * 4096]

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Places, in h, of the hashes that pass."""
        at = np.arange(len(h)) if self.parts == 1 else np.flatnonzero(_part(h, self.parts) == self.part)
        x = mixed(h if self.parts == 1 else h[at])
        step = x >> np.uint64(32) | np.uint64(1)
        place = x & np.uint64(0xFFFFFFFF)
        for _ in range(PROBES):
            p = place & np.uint64(self.bits - 1)
            hit = np.flatnonzero(self.map[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1)
            at, place, step = at[hit], place[hit], step[hit]
            place = place + step
        return at


def neighbours(words: list[bytes], alphabet: bytes, known: Filter) -> Iterator[tuple[int, bytes]]:
    """Index of a word and a candidate, for each distinct edit of each word that the filter lets through.

    Of equal edits one is emitted: a letter is deleted at the start of its run of equals, and inserted behind it.
    """
    letters = np.frombuffer(alphabet, np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(sizes).tolist():
        powers = _powers(length + 1)
        group = np.flatnonzero(sizes == length)
        step = max(1, _AT_ONCE // ((2 * length + 1) * max(1, len(letters))))
        for a in range(0, len(group), step):
            who = group[a : a + step]
            codes = np.frombuffer(b"".join([words[i] for i in who]), np.uint8).reshape(len(who), length).astype(np.uint64)
            heads, tails = _sums(codes, powers)
            for lo in range(0, length + 1, max(1, _AT_ONCE // max(1, len(who) * len(letters)))):  # slices of places: of a very long word all would be too much
                hi = min(length + 1, lo + max(1, _AT_ONCE // max(1, len(who) * len(letters))))
                end = min(hi, length)
                # [place, word], and with letters [place, letter, word]
                here = codes.T[lo:end]
                if end > lo:
                    gone = heads[lo:end] * powers[length - 1 - np.arange(lo, end)][:, None] + tails[lo + 1 : end + 1]
                    first = np.ones(here.shape, bool)
                    first[max(0, 1 - lo) :] = here[max(0, 1 - lo) :] != codes.T[max(lo, 1) - 1 : end - 1]
                    at = np.flatnonzero(first)
                    for x in at[known.may_hold(gone.ravel()[at])].tolist():
                        i, k = lo + x // len(who), x % len(who)
                        w = words[who[k]]
                        yield int(who[k]), w[:i] + w[i + 1 :]
                    weight = powers[length - 1 - np.arange(lo, end)]
                    rest = heads[length][None, :] - here * weight[:, None]
                    put = rest[:, None, :] + (weight[:, None] * letters)[:, :, None]
                    at = np.flatnonzero(here[:, None, :] != letters[None, :, None])
                    for x in at[known.may_hold(put.ravel()[at])].tolist():
                        i, c, k = lo + x // (len(letters) * len(who)), x // len(who) % len(letters), x % len(who)
                        w = words[who[k]]
                        yield int(who[k]), w[:i] + alphabet[c : c + 1] + w[i + 1 :]
                places = np.arange(lo, hi)
                put = (heads[lo:hi] * powers[length + 1 - places][:, None] + tails[lo:hi])[:, None, :] + (powers[length - places][:, None] * letters)[:, :, None]
                other = np.ones(put.shape, bool)
                other[: end - lo] = here[:, None, :] != letters[None, :, None]
                at = np.flatnonzero(other)
                for x in at[known.may_hold(put.ravel()[at])].tolist():
                    i, c, k = lo + x // (len(letters) * len(who)), x // len(who) % len(letters), x % len(who)
                    w = words[who[k]]
                    yield int(who[k]), w[:i] + alphabet[c : c + 1] + w[i:]


def _filter(spark: SparkSession, words: DataFrame, bits: int, part: int, parts: int) -> Filter:
    """The driver is sent the bits alone, PART_BITS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashes([w.encode("latin-1") for w in batch["word"].to_pylist()])
            if parts > 1:
                h = h[_part(h, parts) == part]
            for p in _places(h, bits):
                yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(15)).astype(np.int64)), pa.array((p & np.uint64(32767)).astype(np.int64))], ["block", "bit"])

    found = words.select("word").mapInArrow(run, "block long, bit long").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return Filter({r["block"]: bytes(r["bits"]) for r in found.collect()}, bits, part, parts)


def near_pairs(vocabulary: DataFrame, count: int, part_bits: int = PART_BITS) -> DataFrame:
    """word, n, near, near_n: all pairs of words that differ by one inserted, deleted or replaced code point, in both orders. vocabulary: distinct words and
    their n, `count` of them; of code points up to U+00FF."""
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()  # at most 90 of them
    alphabet = "".join(sorted(r["c"] for r in letters)).encode("latin-1")
    bits = 1 << max(15, math.ceil(math.log2(max(1, count) * BITS_A_WORD)))
    parts, bits = max(1, bits // part_bits), min(bits, part_bits)
    dealt = vocabulary.select("word", "n").repartition(max(1, -(-count // _WORDS_A_TASK)), "word")
    out = None
    for part in range(parts):
        known = spark.sparkContext.broadcast(_filter(spark, vocabulary, bits, part, parts))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch["n"].to_numpy()
                words = [w.encode("latin-1") for w in batch["word"].to_pylist()]
                who, edited = [], []

                def made() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in edited], pa.string()), pa.array([words[i].decode("latin-1") for i in who], pa.string()), pa.array(n[who])], ["candidate", "word", "n"])

                for i, candidate in neighbours(words, alphabet, known.value):
                    who.append(i)
                    edited.append(candidate)
                    if len(who) >= 1 << 16:
                        yield made()
                        who, edited = [], []
                if who:
                    yield made()

        found = dealt.mapInArrow(run, "candidate string, word string, n long")
        out = found if out is None else out.unionByName(found)
    return out.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), F.col("candidate") == F.col("near")).select("word", "n", "near", "near_n")


def variants(docs: DataFrame, *, least: int = 7, twice: int = 2, times: int = 10, drop_one_in: int = 31, part_bits: int = PART_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root; a row for each distinct word of at least `least` code points and `twice` occurrences.

    form is the near word of largest n, of equals the first by code points, if that n is at least `times` the word's own, else null; root is where forms lead to
    in the end, the word itself if it has none. Null and empty texts have no words; a null id counts as an empty text; rows that repeat an id and a text count
    as often as they stand; without words there are no rows. Other columns aren't looked at, and all runs of a text count, however long. A word has a bounded
    number of near words (its places times the alphabet), so no key of the join is hot.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "spelling")
    counted = occurrences(docs, least=least, drop_one_in=drop_one_in, doc_id=doc_id, text=text).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)
    vocabulary = scratch.table(counted, "vocabulary")
    size = vocabulary.agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n")).first()
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_pairs(vocabulary, size["words"], part_bits).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    own = vocabulary.join(near, "word", "left").withColumn("known", -F.col("best.less") >= times * F.col("n"))
    formed = own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("known"), F.col("best.form")).alias("form"), F.when(F.col("known"), -F.col("best.less")).alias("form_n"))
    formed = scratch.table(formed, "formed")
    roots = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    # Each step multiplies n by `times`, and each round doubles the steps that a root stands for.
    steps = math.log(max(size["n"] or 1, 2), max(times, 2)) + 1
    for k in range(math.ceil(math.log2(steps)) if times > 1 else 0):
        ahead = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        roots = scratch.table(roots.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root")), f"roots{k}")
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
