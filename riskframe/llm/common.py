"""Helpers that the corpus operators share: scratch tables, Arrow batches, words, hashes."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words.
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark runs on this machine alone (tests), a new temporary one, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="riskframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that no later step depends on an executor that wrote an earlier one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:02d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns it as read back, with its lineage cut."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in tables:
            delete(self.spark, df._scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bounds Arrow batches by rows and, where Spark can, by bytes: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    with contextlib.suppress(Exception):  # older Sparks have no bound by bytes
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_bytes(text: str | Column = "text") -> Column:
    """UTF-8 of a text, null as empty: Python then needs no decoding, and malformed text can't raise."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One batch in, one or none out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


#: Bytes that part words by white space become blanks, A-Z lower case; the same with all but letters, digits and non-ASCII parting words.
BY_SPACE = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
BY_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Words:
    """Words of a batch of texts. hashes: 64 bits for each word, in order; text i has words bounds[i] to bounds[i + 1]."""

    def __init__(self, texts: list[bytes], table: bytes = BY_SPACE):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.buf = b" ".join(texts).translate(table) + b" " * 9
        b = np.frombuffer(self.buf, np.uint8)
        inside = np.concatenate(([False], b != 32))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.bounds = np.concatenate(([0], np.searchsorted(self.starts, np.cumsum(sizes))))
        self.hashes = self._hashed()

    def _hashed(self) -> np.ndarray:
        """Eight bytes at a time, for all words at once that have as many."""
        eight = np.ndarray((len(self.buf) - 7,), "<u8", self.buf, 0, (1,))
        left, at, who = self.ends - self.starts, self.starts, None
        h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        while len(at):
            x = eight[at]
            short = np.minimum(left, 8).astype(np.uint64)
            x = x & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - short * np.uint64(8)))
            if who is None:
                h = mixed(h ^ x)
                who = np.flatnonzero(left > 8)
            else:
                h[who] = mixed(h[who] * np.uint64(0x9E3779B97F4A7C15) ^ x)
                who = who[left > 8]
            more = left > 8
            at, left = at[more] + 8, left[more] - 8
        return h

    def list(self, a: int, b: int) -> list[bytes]:
        return [self.buf[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, rising; x may be overwritten."""
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Odd multipliers for words by their place in a run.
_PLACES = [int(x) | 1 for x in np.random.default_rng(20).integers(0, 1 << 63, 64, dtype=np.uint64)]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n words, in order."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = words[:count] * np.uint64(_PLACES[0])
    for i in range(1, n):
        h += words[i : i + count] * np.uint64(_PLACES[i % 64])
    return mixed(h + np.uint64(n))


def unit_hash(*parts: Column | str, seed: int) -> Column:
    """A double above 0 and below 1 made from the parts' text and the seed; DuckDB's md5 gives the same."""
    joined = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(joined), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def crc_fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 4; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("int")


#: Slots that ids are dealt into, by hash: a table of slots has no more rows than this, whatever the ids.
SLOTS = 1 << 20


def text_key(text: str = "text") -> Column:
    """A hash of the text; null as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def id_slot(column: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(column.cast("string"), F.lit(""))), F.lit(SLOTS)).cast("int")


def without_rows(rows: DataFrame, pairs: DataFrame, doc_id: str = "doc_id", text: str = "text", inside: bool = False) -> DataFrame:
    """Rows whose id and text_key() aren't among the pairs (doc_id, key), or with `inside` those that are; null is an id. Rows whose slot holds none of the pairs are kept
    (or left) where they are; only the others are moved to meet the pairs. The table of slots is broadcast: SLOTS bounds its size."""
    own = pairs.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    slots = F.broadcast(own.select(id_slot(F.col("_id")).alias("_slot")).distinct())
    here = id_slot(rows[doc_id]) == F.col("_slot")
    same = rows[doc_id].eqNullSafe(F.col("_id")) & (text_key(text) == F.col("_key"))
    near = rows.join(slots, here, "left_semi").join(own, same, "left_semi" if inside else "left_anti")
    return near if inside else rows.join(slots, here, "left_anti").unionByName(near)
