"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, permuted
(rolled) by their place; a document's vector bundles (sums) those of its trigrams, and a language's prototype those of all
its documents. The language with the highest cosine is predicted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, mixed, small_batches, text_bytes

DIMENSIONS = 1024
SEED = 11
#: Bits of a code point; a trigram is three of them.
_BITS = 21
#: Trigrams whose vectors are made at once: 4 bytes for each dimension.
_BLOCK = 4096
#: Distinct trigrams that a task counts before it bundles them.
_MOST_COUNTED = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower case, where Unicode counts it as a letter; 0 for all that stands between words."""
    out = np.zeros(sys.maxunicode + 1, np.int64)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def letter_vectors(cps: np.ndarray) -> np.ndarray:
    """int8[len(cps), DIMENSIONS] of +1 and -1, each from its code point and the seed alone."""
    words = DIMENSIONS // 64
    at = cps.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
    bits = mixed(mixed(at + np.uint64(1)) + np.uint64(SEED))
    return np.unpackbits(bits.view(np.uint8).reshape(len(cps), -1), axis=1).astype(np.int8) * 2 - 1


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams: that of the first letter rolled by two, of the second by one, of the third as it is."""
    parts = [codes >> (2 * _BITS), (codes >> _BITS) & ((1 << _BITS) - 1), codes & ((1 << _BITS) - 1)]
    cps, at = np.unique(np.concatenate(parts), return_inverse=True)
    own = letter_vectors(cps)
    first, second, third = np.split(at, 3)
    return np.roll(own, 2, axis=1)[first] * np.roll(own, 1, axis=1)[second] * own[third]


def trigram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """Codes of the text's trigrams, rising, and how often each occurs; None where it has no letter. Runs of other characters count as one."""
    cp = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    x = letters()[cp]
    if not x.any():
        return None
    x = np.concatenate(([0], x, [0]))
    x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
    codes = (x[:-2] << (2 * _BITS)) | (x[1:-1] << _BITS) | x[2:]
    codes.sort()
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes)))


def bundled(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """float64[len(found), DIMENSIONS]: the sums of each one's trigram vectors, exact. found: codes, rising, and counts. Vectors are made once for all, block by block."""
    out = np.zeros((len(found), DIMENSIONS))
    if not found:
        return out
    every = np.unique(np.concatenate([c for c, _ in found]))
    for a in range(0, len(every), _BLOCK):
        own = every[a : a + _BLOCK]
        vectors = trigram_vectors(own).astype(np.float32)
        for k, (codes, n) in enumerate(found):
            low, high = np.searchsorted(codes, own[0]), np.searchsorted(codes, own[-1], side="right")
            if low < high:
                at = np.searchsorted(own, codes[low:high])
                out[k] += n[low:high].astype(np.float32) @ vectors[at] if int(n[low:high].max()) < 1 << 12 else n[low:high].astype(np.float64) @ vectors[at].astype(np.float64)
    return out


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def corpus_sums(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, at, value: the bundle of all documents of each language, by dimension. Each task counts trigrams and bundles them, so that it sends
    DIMENSIONS rows a language, whatever it has read and whatever the script."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        sums: dict[str, np.ndarray] = {}

        def bundle() -> None:
            for name, row in zip(counts, bundled(list(counts.values()))):
                sums[name] = sums.get(name, 0) + row
            counts.clear()

        for batch in batches:
            own: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for name, t in zip(batch["lang"].to_pylist(), batch["t"]):
                if (found := trigram_counts(t.as_py())) is not None:
                    own.setdefault(name, [counts.pop(name)] if name in counts else []).append(found)
            counts.update((name, added(parts)) for name, parts in own.items())
            if sum(len(c) for c, _ in counts.values()) > _MOST_COUNTED:
                bundle()
        bundle()
        for name, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(row.astype(np.int64))], ["lang", "at", "value"])

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), text_bytes(text).alias("t"))
    return rows.mapInArrow(run, "lang string, at int, value bigint").groupBy("lang", "at").agg(F.sum("value").alias("value"))


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, in the order of their names, and float64[languages, DIMENSIONS] of length 1.

    The driver gets DIMENSIONS numbers a language, however many documents there are. lang is taken for a code: with 100,000 values that would be 1 GB.
    """
    sums: dict[str, np.ndarray] = {}
    for name, at, value in corpus_sums(docs, text, lang).toLocalIterator():
        sums.setdefault(name, np.zeros(DIMENSIONS))[at] = value
    names = sorted(sums)
    out = np.array([sums[name] for name in names]).reshape(len(names), DIMENSIONS)
    return names, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, names: list[str], profiles: np.ndarray, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the cosine, at least 0), held_out; a row for each row of docs.

    'und' and 0 where the text is null or has no letter, or nothing was learned. Ties go to the first name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[doc_id].dataType.simpleString()
    known = spark.sparkContext.broadcast((names, profiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, profiles = known.value
        for batch in batches:
            found = [trigram_counts(t.as_py()) if names else None for t in batch["t"]]
            docs = bundled([f for f in found if f is not None])
            cosines = docs @ profiles.T / np.maximum(np.linalg.norm(docs, axis=1, keepdims=True), 1e-12)
            best = iter(np.argmax(cosines, axis=1)) if len(docs) else iter(())
            langs, scores = [], []
            row = 0
            for f in found:
                if f is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                k = int(next(best))
                langs.append(names[k])
                scores.append(float(min(1.0, max(0.0, cosines[row, k]))))
                row += 1
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), (crc_fold(doc_id) == 2).alias("held_out"), text_bytes(text).alias("t"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the folds that aren't held out, predicts all. Rows without lang teach nothing; with nothing learned, or without a letter, a text is 'und' with score 0.
    Ties go to the first name in code point order."""
    names, profiles = prototypes(docs.where(crc_fold() != 2))
    return predict(docs, names, profiles)
